"""Operator 2: near-duplicate vectors by E8 lattice hashing.

Each of several tables has a random projection to 8 dimensions, times ``blocks``;
the projected point is decoded to its nearest point of the lattice E8, whose
coordinates are the cell.  A vector is kept in its own cell and looked for there
and in the ``probes`` neighbouring cells that lie nearest to the projected point.
A 128-bit sign sketch rules most chance meetings out inside the join, with a bound
over four standard deviations beyond a true link's distance; what is left is
verified by cosine in double precision.

Groups are not paired out: equal vectors form a class with one representative.
Representatives at an angle of at most half the link angle from a common pivot
form a ball, all of whose members link with each other; within a ball links are
counted, not listed.  A ball of over ``big`` members enters the tables as a single
entity with its pivot's sketch, whose cells are those of all its members; where it
meets another entity and the wider sketch bound allows, their members are compared
in blocks of ``BLOCK`` by matrix products, which yield counts and one link a member.

Cases: a vector that is null, empty or zero, or holds null or non-finite components
links with nothing and is its own component; vectors of different lengths never
link; repeated rows with one vec_id count as vectors of their own and share that
id's component; rows without vec_id count as vectors for the others and link
like them, and a component without any id has a null component_id; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hot, scratch
from .components import components
from .textbatch import U, mix

COSINE, TABLES, PROBES, SCALE, BIG, BLOCK = 0.9, 8, 8, 0.8, 64, 256
SKETCH = 128


def neighbour_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    k = np.abs(off[odd]).argmax(axis=1)
    near[odd, k] += np.where(off[odd, k] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the even integers' lattice or its copy shifted by a half, whichever is nearer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def _cell_key(cells: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys of lattice points (last axis: coordinates)."""
    whole = np.rint(2 * cells).astype(np.int64).view(U)
    total = np.full(cells.shape[:-1], U(salt * 2 + 1))
    for k in range(cells.shape[-1]):
        total = mix(total * U(0x9E3779B97F4A7C15) + whole[..., k])
    return total.view(np.int64)


class Tables:
    """The projections for vectors of one length; they depend on the length and the seed only."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, seed: int = 7):
        rng = np.random.default_rng([seed, dim])
        self.planes = rng.standard_normal((dim, SKETCH))
        self.project = rng.standard_normal((tables, dim, 8 * blocks)) * scale
        self.blocks, self.short = blocks, neighbour_vectors()

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1, bitorder="little").view(np.int64).reshape(len(unit), SKETCH // 64)

    def cells(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """(vectors, tables, 1 + probes) keys; the first of each is the own cell's."""
        out = np.zeros((len(unit), len(self.project), 1 + probes), np.int64)
        for t, matrix in enumerate(self.project):
            x = unit @ matrix
            own = [decode(x[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)]
            out[:, t, 0] = _cell_key(np.concatenate(own, axis=1), t)
            gain = np.concatenate([(x[:, 8 * b : 8 * b + 8] - own[b]) @ self.short.T for b in range(self.blocks)], axis=1)
            best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            for p in range(probes):
                moved = [c.copy() for c in own]
                for b in range(self.blocks):
                    here = np.flatnonzero(best[:, p] // 240 == b)
                    moved[b][here] += self.short[best[here, p] % 240]
                out[:, t, 1 + p] = _cell_key(np.concatenate(moved, axis=1), t)
        return out


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _cosine(frames):
    """Pairs with their vectors -> pairs with their cosine."""
    for frame in frames:
        for _, part in frame.groupby(frame["x"].map(len), sort=False):  # pairs of one length at a time
            for lo in range(0, len(part), 4096):
                some = part.iloc[lo : lo + 4096]
                x, y = _safe(_matrix(some["x"])), _safe(_matrix(some["y"]))
                value = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))
                yield pd.DataFrame({"a": some["a"].to_numpy(), "b": some["b"].to_numpy(), "cosine": value})


def _safe(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would leave the range of doubles are scaled; all others stay as they are."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return np.where((most > 1e100) | (most < 1e-100), x / most, x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _crossed(least: float):
    """Blocks of two entities -> for each member with links the others' number, and one of them."""

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                for size in {len(v) for v in row.xs} & {len(v) for v in row.ys}:
                    own = [i for i, v in enumerate(row.xs) if len(v) == size]
                    other = [i for i, v in enumerate(row.ys) if len(v) == size]
                    x, y = _matrix([row.xs[i] for i in own]), _matrix([row.ys[i] for i in other])
                    value = _unit(x) @ _unit(y).T
                    for i, j in zip(*np.nonzero(np.abs(value - least) < 1e-9)):  # too close for another order of sums
                        p, q = _safe(x[i : i + 1])[0], _safe(y[j : j + 1])[0]
                        value[i, j] = (p * q).sum() / np.sqrt((p * p).sum()) / np.sqrt((q * q).sum())
                    near = value >= least
                    if not near.any():
                        continue
                    a, b = np.asarray(row.a_ids)[own], np.asarray(row.b_ids)[other]
                    m, n = np.asarray(row.a_copies)[own], np.asarray(row.b_copies)[other]
                    for ids, many, partners, hits in ((a, n, b, near), (b, m, a, near.T)):
                        some = hits.any(axis=1)
                        yield pd.DataFrame({"id": ids[some], "others": hits[some] @ many, "one": partners[hits[some].argmax(axis=1)]})

    return run


def _bound(angle: float) -> int:
    """Sketch bits in which two vectors at this angle differ, and 4.4 standard deviations."""
    p = angle / math.pi
    return math.ceil(SKETCH * p + 4.4 * math.sqrt(SKETCH * p * (1 - p)))


def near_vectors(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, blocks: int = 1, scale: float = SCALE, big: int = BIG) -> DataFrame:
    """The operator: vec_id, n_links, component_id, kept for each row of (vec_id, embedding)."""
    if not 0.0 < cosine < 1.0:
        raise ValueError("cosine must lie between 0 and 1")
    rows = scratch.written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), "rows")
    fine = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    fine = F.coalesce(fine, F.lit(False))
    # of several classes with one least id (an id repeated with other vectors, or none) each gets a number of its own
    classes = rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.written(classes.withColumn("id", F.expr("xxhash64(coalesce(rep, 0), embedding)")), "classes")
    angle = math.acos(cosine)

    def hashed(frames):
        kept: dict = {}
        for frame in frames:
            sizes = frame["embedding"].map(len)
            for dim, part in frame.groupby(sizes, sort=False):
                own = kept.setdefault(dim, Tables(dim, tables, blocks, scale))
                for lo in range(0, len(part), 2048):
                    some = part.iloc[lo : lo + 2048]
                    x = _matrix(some["embedding"])
                    x /= np.abs(x).max(axis=1)[:, None]
                    unit = x / np.linalg.norm(x, axis=1)[:, None]
                    keys, bits = own.cells(unit, probes), own.sketches(unit)
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "s0": bits[:, 0], "s1": bits[:, 1], "own": list(keys[:, :, 0]), "cells": list(keys.reshape(len(some), -1))})

    hashes = scratch.written(classes.select("id", "embedding").mapInPandas(hashed, "id long, s0 long, s1 long, own array<long>, cells array<long>"), "cells")
    vectors = classes.select("id", "embedding")
    differ = "bit_count(a.s0 ^ b.s0) + bit_count(a.s1 ^ b.s1)"

    def verified(pairs: DataFrame, least: float) -> DataFrame:
        x, y = vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y"))
        both = pairs.join(x, "a").join(y, "b").where("size(x) = size(y)")
        return both.select("a", "b", "x", "y").mapInPandas(_cosine, "a long, b long, cosine double").where(F.col("cosine") >= least)

    # balls: the least id in a fine bucket (two tables' cells at once) is a pivot for those within half the angle
    steps = [(i, (i + d) % tables) for d in (1, 2, 3) if d < tables for i in range(tables)] or [(0, 0)]
    buckets = hashes.select("id", "s0", "s1", F.explode(F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("own")[i], F.col("own")[j]) for i, j in steps])).alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min(F.struct("id", "s0", "s1")).alias("p"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("p.id").alias("pivot"), F.col("p.s0").alias("p0"), F.col("p.s1").alias("p1"))
    close = buckets.join(least, "bucket").where(f"id <> pivot AND bit_count(s0 ^ p0) + bit_count(s1 ^ p1) <= {_bound(angle / 2)}").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    # a hair inside half the angle, so that rounding can't put two members beyond the whole of it
    mates = scratch.written(verified(close, math.cos(angle / 2 - 1e-7)), "mates")
    pivot_of = mates.groupBy("a").agg(F.min("b").alias("pivot"))
    led = mates.select(F.col("b").alias("a")).distinct().withColumn("pivot", F.col("a"))
    balls = pivot_of.unionByName(led).groupBy("a").agg(F.min("pivot").alias("ball"))
    sizes = classes.select(F.col("id").alias("a"), "copies").join(balls, "a").groupBy("ball").agg(F.count("*").alias("members"), F.sum("copies").alias("ball_copies"))
    known = scratch.written(
        # a vector outside of any ball has its own id as the key, so that those don't meet under null
        classes.select(F.col("id").alias("a"), "copies").join(balls, "a", "left").withColumn("ball", F.coalesce("ball", "a")).join(sizes, "ball", "left")
        .select(F.col("a").alias("id"), "copies", "ball", F.coalesce("ball_copies", "copies").alias("ball_copies"), F.coalesce("members", F.lit(1)).alias("members"))
        .withColumn("is_big", F.col("members") > big).withColumn("entity", F.when(F.col("is_big"), F.xxhash64(F.lit("ball"), F.col("ball"))).otherwise(F.col("id"))), "balls")

    # entities in the tables: big balls under a number of their own with their pivots' sketches, all others by themselves
    side = scratch.written(hashes.join(known.select("id", "entity", "ball", "is_big"), "id"), "side")
    pivots = side.where("is_big and id = ball").select("ball", F.col("s0").alias("p0"), F.col("s1").alias("p1"))
    seen = hot.join(side, pivots, ["ball"], ["id"], "left").select("entity", "ball", "is_big", F.coalesce("p0", "s0").alias("s0"), F.coalesce("p1", "s1").alias("s1"), "own", "cells")
    seen = scratch.finished(seen, "seen", side, hashes)

    def placed(column: str) -> DataFrame:
        every = seen.select("entity", "ball", "is_big", "s0", "s1", F.explode(column).alias("cell"))
        return every.where("not is_big").unionByName(every.where("is_big").distinct())

    own, wide = placed("own"), placed("cells")
    crowded = hot.hot_keys(own.select("cell"), ["cell"])
    a, b = hot.dealt(own, crowded, ["cell"], ["entity"]).alias("a"), hot.repeated(wide, crowded, ["cell"]).alias("b")
    bounds = [_bound(angle), _bound(1.5 * angle), _bound(2 * angle)]
    allowed = f"element_at(array({', '.join(map(str, bounds))}), 1 + cast(a.is_big as int) + cast(b.is_big as int))"
    met = a.join(b, F.expr(f"a.cell = b.cell AND a.{hot.PART} = b.{hot.PART} AND a.ball <> b.ball AND {differ} <= {allowed}"))
    met = scratch.written(met.select(F.expr("least(a.entity, b.entity)").alias("e"), F.expr("greatest(a.entity, b.entity)").alias("f"), F.expr("a.is_big or b.is_big").alias("open")).distinct(), "met")
    links = scratch.written(verified(met.where("not open").select(F.col("e").alias("a"), F.col("f").alias("b")), cosine).select("a", "b"), "vector-links")
    inside = met.where("open").select(F.explode(F.array("e", "f")).alias("entity")).distinct()
    blocks = known.join(inside, "entity", "left_semi").join(vectors, "id").withColumn("block", F.expr(f"pmod(xxhash64(id), cast(ceil(members / {BLOCK}) as int))"))
    blocks = blocks.groupBy("entity", "block").agg(F.collect_list(F.struct("id", "copies", "embedding")).alias("held"))  # about BLOCK members
    blocks = scratch.written(blocks.select("entity", "block", F.col("held.id").alias("ids"), F.col("held.copies").alias("copies"), F.col("held.embedding").alias("vs")), "blocks")
    x = blocks.select(F.col("entity").alias("e"), F.col("ids").alias("a_ids"), F.col("copies").alias("a_copies"), F.col("vs").alias("xs"))
    y = blocks.select(F.col("entity").alias("f"), F.col("ids").alias("b_ids"), F.col("copies").alias("b_copies"), F.col("vs").alias("ys"))
    crossed = met.where("open").join(x, "e").join(y, "f").select("a_ids", "a_copies", "xs", "b_ids", "b_copies", "ys")
    crossed = scratch.finished(crossed.mapInPandas(_crossed(cosine), "id long, others long, one long"), "crossed", blocks, met, seen)

    # counts and components
    copies = known.select(F.col("id").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = both.join(copies, "b").select(F.col("a").alias("id"), F.col("copies").alias("others"))
    others = listed.unionByName(crossed.select("id", "others")).groupBy("id").agg(F.sum("others").alias("others"))
    found = components(links.unionByName(mates.select("a", "b")).unionByName(crossed.select(F.col("id").alias("a"), F.col("one").alias("b"))))
    named = classes.select("id", "rep").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("component"))
    named = scratch.written(named, "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = hot.join(named, smallest, ["component"], ["id"]).select("id", "component_id")
    told = known.join(others, "id", "left").join(labels, "id").select("id", (F.col("ball_copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    told = classes.join(told, "id").select("embedding", "n_links", "component_id")
    keyed = scratch.written(rows.where(fine), "fine")
    good = hot.join(keyed, told, ["embedding"], ["vec_id"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
    return scratch.finished(out, "near-vectors", rows, classes, mates, known, links, crossed, found, named, keyed)


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
