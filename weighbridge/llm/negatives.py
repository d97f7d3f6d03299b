"""Operator 12: hard negatives by angular triangle filtering.

Vectors become integers; a row's score is its integer inner product with an anchor.

1. Each row's angles to some reference directions are stored with its norm.  Rows are
   ordered by their nearest direction and their angle to it, cut into shelves by range,
   and packed into blocks of ``BLOCK`` rows.
2. For an anchor and a row, the angles to a direction differ by at most the angle between
   them, and add up to at least that.  Times both norms this bounds the score, with room
   for rounding.  Shelves whose bounds miss an anchor's window of scores are not joined
   with it; of the blocks of the others only the rows whose angle lies in the window are
   scored, in integers.
3. Each search starts in the anchor's own shelf, whose k-th best narrows the window for
   the others.  First the positives are searched (same label, the highest scores), then
   for each the negatives (other labels, scores within its share).

The references are the ends of a farthest-first walk over at most ``SAMPLE`` rows of a
length, those with the least hashes; lengths without such rows have random ones.  They
decide how much is scored, never what is found.

Cases: rows with a null label, a null vector or a null or non-finite component take no
part, nor do rows whose scaled components leave the range of doubles; rows of different
lengths have no score; rows with one vec_id count apart, each as an anchor and as a
candidate; rows without vec_id are candidates, after others of their score; scores
beyond 64 bits are an error; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hot, scratch

BLOCK, ANCHORS, SHELF, MOST_SHELVES = 1024, 128, 4096, 20_000
DIRECTIONS, SAMPLE, MOST_LENGTHS = 8, 1024, 16
SCALE = 256
#: Room for rounding in angles (an arc cosine near 1 loses half of the digits) and in scores.
SLACK = 1e-6
EXACT = 2.0**53


def directions(samples: dict[int, np.ndarray], length: int, count: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors, one in a row: a farthest-first walk over the sample, filled up with random ones."""
    found: list[np.ndarray] = []
    rows = samples.get(length, np.zeros((0, length)))
    norms = np.linalg.norm(rows, axis=1)
    rows = rows[norms > 0] / norms[norms > 0][:, None]
    if len(rows):
        found.append(rows[0])
        near = rows @ rows[0]
        while len(found) < count and near.min() < 1 - 1e-9:
            found.append(rows[int(near.argmin())])
            near = np.maximum(near, rows @ found[-1])
    rng = np.random.default_rng([12, length])
    while len(found) < count:
        more = rng.standard_normal(length)
        found.append(more / max(np.linalg.norm(more), 1e-300))
    return np.stack(found)


def _angles(x: np.ndarray, refs: np.ndarray, norm: np.ndarray) -> np.ndarray:
    safe = np.where(norm > 0, norm, 1.0)
    return np.arccos(np.clip((x / safe[:, None]) @ refs.T, -1.0, 1.0))


def _norms(x: np.ndarray) -> np.ndarray:
    """Norms that don't leave the range of doubles before the scores do."""
    most = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(most > 1e150, most, 1.0)
    return np.sqrt(((x / scale[:, None]) ** 2).sum(axis=1)) * scale


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """id, label, length and x (scaled whole numbers as doubles) of the rows that take part."""
    label = F.col("label") if label is None else label
    # floor() ends at 64 bits; beyond 10^15 doubles are whole anyway
    x = F.transform(F.col("embedding"), lambda v: F.when(F.abs(v.cast("double")) < 1e15, F.floor(v.cast("double") * SCALE).cast("double")).otherwise(v.cast("double") * SCALE))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= F.lit(1.7976931348623157e308 / SCALE)))
    kept = vectors.where(F.col("embedding").isNotNull() & F.col("label").isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.size("embedding").alias("length"), x.alias("x"))


_PLACED = "id long, label long, length int, x binary, norm double, angles array<double>, cell int, own double"


def _placed(samples: dict[int, np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs: dict[int, np.ndarray] = {}
        for frame in frames:
            for length, part in frame.groupby("length", sort=False):
                length = int(length)
                if length not in refs:
                    refs[length] = directions(samples, length)
                x = np.stack([np.asarray(v, np.float64) for v in part["x"]]) if length else np.zeros((len(part), 0))
                norm = _norms(x)
                angles = _angles(x, refs[length], norm)
                cell = angles.argmin(axis=1)
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "length": length, "x": [v.tobytes() for v in x], "norm": norm, "angles": list(angles), "cell": cell, "own": angles[np.arange(len(x)), cell]})

    return run


_BLOCKS = (
    "shelf int, block int, length int, cell int, n int, uids binary, ids binary, labels binary, x binary, norms binary, angles binary, "
    "anchors boolean, members array<long>, low array<double>, high array<double>, norm_low double, norm_high double")


def _packed(is_anchor: Callable[[np.ndarray], np.ndarray]):
    """Ordered rows of a shelf -> blocks of one length and direction, and its anchors in blocks of their own."""

    def block(shelf: int, nth: int, rows: pd.DataFrame, uids: np.ndarray, anchors: bool) -> tuple:
        angles = np.stack(rows["angles"].to_numpy())
        norms, raw = rows["norm"].to_numpy(), lambda v: np.ascontiguousarray(v).tobytes()
        return (
            shelf, nth, int(rows["length"].iat[0]), int(rows["cell"].iat[0]), len(rows), raw(uids), raw(rows["id"].to_numpy(np.int64)), raw(rows["label"].to_numpy(np.int64)), b"".join(rows["x"]),
            raw(norms), raw(angles), anchors, uids.tolist() if anchors else [], angles.min(axis=0), angles.max(axis=0), float(norms.min()), float(norms.max()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shelf = TaskContext.get().partitionId()
        nth = at = 0
        for frame in frames:
            out = []
            frame = frame.reset_index(drop=True)
            for _, part in frame.groupby(["length", "cell"], sort=False):
                for k in range(0, len(part), BLOCK):
                    some = part.iloc[k : k + BLOCK]
                    uids = (np.int64(shelf) << 40) + at + np.arange(len(some))
                    at += len(some)
                    out.append(block(shelf, nth, some, uids, False))
                    mine = np.flatnonzero(is_anchor(some["id"].to_numpy(np.int64)))
                    for a in range(0, len(mine), ANCHORS):
                        out.append(block(shelf, nth, some.iloc[mine[a : a + ANCHORS]], uids[mine[a : a + ANCHORS]], True))
                    nth += 1
            yield pd.DataFrame(out, columns=_BLOCK_NAMES)

    return run


_BLOCK_NAMES = [part.split()[0] for part in _BLOCKS.split(", ")]


def windows(angles: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, norm_low: float, norm_high: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest angle to an anchor of rows within norm_low..norm_high that can score from ``low`` to ``high``; low and high by anchor."""
    room = SLACK * np.maximum(norm * norm_high, 1.0) + 1.0

    def angle(score: np.ndarray, outward: int) -> np.ndarray:
        # the cosine that needs the least of the norms
        score = score + outward * room
        size = norm * np.where((score > 0) == (outward < 0), norm_high, norm_low)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(size > 0, score / np.where(size > 0, size, 1.0), np.where(score > 0, np.inf, -np.inf))
        return np.where(cosine > 1, -np.inf if outward < 0 else 0.0, np.where(cosine < -1, math.pi if outward < 0 else np.inf, np.arccos(np.clip(cosine, -1, 1))))

    return angle(high, 1) - SLACK, angle(low, -1) + SLACK


def may_meet(angles: np.ndarray, least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Anchors (rows of ``angles``) that a row with angles from ``low`` to ``high`` can meet at an angle of ``least`` to ``most``."""
    apart = np.maximum(0.0, np.maximum(low[None] - angles, angles - high[None])).max(axis=1)  # at least so far
    sums = angles[:, :, None] + np.stack([low, high], axis=-1)[None]
    within = np.minimum(sums.max(axis=2), 2 * math.pi - sums.min(axis=2)).min(axis=1)  # at most so far
    return (apart <= most + SLACK) & (within >= least - SLACK)


def _read(row, anchors: bool = False) -> dict[str, np.ndarray]:
    pick = (lambda c: getattr(row, "a_" + c)) if anchors else (lambda c: getattr(row, c))
    n = pick("n")
    out = {c: np.frombuffer(pick(c), np.int64) for c in ("uids", "ids", "labels")}
    return out | {"x": np.frombuffer(pick("x"), np.float64).reshape(n, row.length), "norms": np.frombuffer(pick("norms"), np.float64), "angles": np.frombuffer(pick("angles"), np.float64).reshape(n, -1)}


def integer_scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; ``most`` bounds their size."""
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda v: np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)
    exact = whole(a).dot(whole(b).T) if a.shape[1] else np.zeros((len(a), len(b)), object)
    if any(abs(int(x)) >= 2**63 for x in exact.flat):
        raise OverflowError("a score needs more than 64 bits")
    return exact.astype(np.int64)


_FOUND = "anchor long, anchor_id long, low long, high long, id long, score long"
_LEAST, _MOST = -(2**63), 2**63 - 1


def _score(same: bool, k: int):
    """Pairs of an anchor block with its windows and a block -> for each anchor and window the best k rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[np.ndarray] = []
            for row in frame.itertuples():
                a, b = _read(row, True), _read(row)
                who = np.array([w["at"] for w in row.asked], np.int64)  # anchors of the block, one for each window
                low, floor, high = (np.array([w[c] for w in row.asked], np.int64) for c in ("low", "floor", "high"))
                angles, norms = a["angles"][who], a["norms"][who]
                least, most = windows(angles, norms, floor.astype(float), high.astype(float), row.norm_low, row.norm_high)
                able = np.flatnonzero(may_meet(angles, least, most, np.asarray(row.low), np.asarray(row.high)))
                if not len(able):
                    continue
                # rows are ordered by their angle to the block's direction
                own, mine = b["angles"][:, row.cell], angles[able, row.cell]
                first = np.searchsorted(own, np.maximum(mine - most[able], least[able] - mine) - SLACK)
                last = np.searchsorted(own, np.minimum(mine + most[able], 2 * math.pi - least[able] - mine) + SLACK, side="right")
                able, first, last = (v[first < last] for v in (able, first, last))
                if not len(able):
                    continue
                begin, end = int(first.min()), int(last.max())
                scored, back = np.unique(who[able], return_inverse=True)
                scores = integer_scores(a["x"][scored], b["x"][begin:end], float(norms.max()) * row.norm_high * (1 + 1e-9) + 1)
                for i, w in enumerate(able):
                    at = who[w]
                    mine = scores[back[i]]
                    fit = (mine >= floor[w]) & (mine <= high[w]) & (b["uids"][begin:end] != a["uids"][at]) & ((b["labels"][begin:end] == a["labels"][at]) == same)
                    fit = np.flatnonzero(fit)
                    if len(fit) > k:
                        edge = np.partition(mine[fit], len(fit) - k)[len(fit) - k]
                        fit = fit[mine[fit] >= edge]
                        order = np.lexsort((_rank(b["ids"][begin + fit]), -mine[fit]))[:k]
                        fit = fit[order]
                    if len(fit):
                        m = len(fit)
                        out.append(np.stack([np.full(m, a["uids"][at]), np.full(m, a["ids"][at]), np.full(m, low[w]), np.full(m, high[w]), b["ids"][begin + fit], mine[fit]]))
            if out:
                yield pd.DataFrame(np.concatenate(out, axis=1).T, columns=["anchor", "anchor_id", "low", "high", "id", "score"])

    return run


def _rank(ids: np.ndarray) -> np.ndarray:
    """Ids with those that are null, the least number, at the end."""
    return np.where(ids == scratch.NO_ID, np.iinfo(np.int64).max, ids)


def _best(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    last = F.when(F.col("id") == scratch.NO_ID, 1).otherwise(0)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), last, "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _asked(windows_: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor blocks with the windows asked of their anchors: (anchor, low, high) each."""
    at = anchors.select("shelf", "block", "first", F.posexplode("members").alias("at", "anchor"))
    lists = at.join(windows_, "anchor").groupBy("shelf", "block", "first").agg(F.collect_list(F.struct("at", "low", "high", "floor")).alias("asked"))
    return anchors.join(lists, ["shelf", "block", "first"])


def _pairs(asked: DataFrame, shelves: DataFrame, home: bool) -> DataFrame:
    """For each anchor block the shelves that it must be joined with, and the windows that matter there."""
    if home:
        return asked.withColumn("to", F.col("shelf"))
    known = {(r["shelf"], r["length"]): (np.array(r["low"]), np.array(r["high"]), r["norm_low"], r["norm_high"]) for r in shelves.collect()}  # a row for each shelf and length
    schema = "shelf int, block int, first long, to int, asked array<struct<at: long, low: long, high: long, floor: long>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                angles, norms = np.frombuffer(row.angles, np.float64).reshape(row.n, -1), np.frombuffer(row.norms, np.float64)
                who = np.array([w["at"] for w in row.asked], np.int64)
                low, high = (np.array([w[c] for w in row.asked], np.int64) for c in ("floor", "high"))
                out = []
                for (to, length), (a, b, norm_low, norm_high) in known.items():
                    if to == row.shelf or length != row.length:
                        continue
                    least, most = windows(angles[who], norms[who], low.astype(float), high.astype(float), norm_low, norm_high)
                    able = np.flatnonzero(may_meet(angles[who], least, most, a, b))
                    if len(able):
                        out.append((row.shelf, row.block, row.first, to, [row.asked[i] for i in able]))
                if out:
                    yield pd.DataFrame(out, columns=["shelf", "block", "first", "to", "asked"])

    met = asked.select("shelf", "block", "first", "length", "n", "norms", "angles", "asked").mapInPandas(run, schema)
    return met.join(asked.drop("asked"), ["shelf", "block", "first"])


def _search(rows: DataFrame, anchors: DataFrame, shelves: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """The best k rows of each window (anchor, low, high): first in the anchor's own shelf, then where more can be."""
    keys = ["anchor", "low", "high"]
    columns = ["n", "uids", "ids", "labels", "x", "norms", "angles"]

    def scored(pairs: DataFrame) -> DataFrame:
        mine = pairs.select(F.col("to").alias("shelf"), F.col("length").alias("length"), "asked", *[F.col(c).alias("a_" + c) for c in columns])
        met = rows.select("shelf", "length", "cell", "low", "high", "norm_low", "norm_high", *columns).join(mine, ["shelf", "length"])
        return met.mapInPandas(_score(same, k), _FOUND)

    first = _asked(asked.withColumn("floor", F.col("low")), anchors)
    here = scratch.written(_best(scored(_pairs(first, shelves, True)), k, keys), "home")
    # what an anchor's own shelf has as k-th best is the least that others must reach
    floors = here.where(F.col("rank") == k).select(*keys, F.col("score").alias("floor"))
    rest = _asked(asked.join(floors, keys, "left").withColumn("floor", F.coalesce("floor", "low")), anchors)
    there = scored(_pairs(rest, shelves, False))
    return scratch.finished(_best(here.drop("rank").unionByName(there), k, keys), "best", here)


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), label: Column | None = None, shelf: int = SHELF) -> DataFrame:
    """The operator: for each anchor (vec_id divisible by ``anchor_every``) and each of its first positives the first negatives whose
    score is from share[0] to share[1] hundredths of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    used = usable(vectors, label)
    lengths = used.groupBy("length").count().orderBy(F.desc("count"), "length").limit(MOST_LENGTHS).collect()
    if not lengths:
        return spark.createDataFrame([], _RESULT)
    samples = {}
    for r in lengths:
        some = used.where(F.col("length") == r["length"]).orderBy(F.xxhash64("x"), "id").limit(SAMPLE).select("x").collect()  # at most SAMPLE rows
        samples[r["length"]] = np.array([v["x"] for v in some], np.float64).reshape(len(some), r["length"])
    n = used.count()
    parts = max(2, min(MOST_SHELVES, -(-n // shelf)))
    placed = scratch.written(used.withColumn("id", F.coalesce("id", F.lit(scratch.NO_ID))).mapInPandas(_placed(samples), _PLACED), "placed")
    order = ["length", "cell", "own", "id"]
    is_anchor = lambda ids: (ids != scratch.NO_ID) & (ids % anchor_every == 0)
    blocks = scratch.finished(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_packed(is_anchor), _BLOCKS), "blocks", placed)
    rows = blocks.where("not anchors")
    anchors = blocks.where("anchors").select("shelf", "block", "length", "n", "uids", "ids", "labels", "x", "norms", "angles", "members").withColumn("first", F.col("members")[0])
    least = lambda c, of: F.array(*[of(F.col(c)[i]) for i in range(DIRECTIONS)]).alias(c)
    shelves = rows.groupBy("shelf", "length").agg(least("low", F.min), least("high", F.max), F.min("norm_low").alias("norm_low"), F.max("norm_high").alias("norm_high"))
    everything = anchors.select(F.explode("members").alias("anchor"), F.lit(_LEAST).cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high"))
    found = _search(rows, anchors, shelves, everything, True, positives)
    ps = found.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 30 p <= 100 n <= 90 p as whole numbers; none if p is below 0
    low, high = F.expr(f"-floor(-{share[0]} * cast(positive_score as decimal(38,0)) / 100)").cast("long"), F.expr(f"floor({share[1]} * cast(positive_score as decimal(38,0)) / 100)").cast("long")
    asked = ps.select("anchor", low.alias("low"), high.alias("high")).where("low <= high").distinct()
    negative = _search(rows, anchors, shelves, asked, False, negatives)
    out = ps.withColumns({"low": low, "high": high}).join(negative.select("anchor", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "low", "high"])
    return out.select("anchor_id", scratch.id_out("positive_id"), F.col("rank").cast("int").alias("rank"), scratch.id_out("negative_id"), "positive_score", "negative_score")


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def moved_labels() -> Column:
    """The contract's rule: every seventh vector has the next label."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=moved_labels())


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
