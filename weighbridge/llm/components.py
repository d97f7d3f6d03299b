"""Connected components of a link table, by alternating large-star and small-star joins.

Each round is two shuffles of the links; links shrink towards stars and the number
of rounds grows with the logarithm of a component's size.  Before the first round and
after each, a partition's links are replaced by stars of the same reach, so that only
what joins partitions is left to the rounds; a task holds the ids of its own
partition.  Where no more than ``FEW`` links are left, one task ends them without any
round; more are never brought together.  Nothing is collected but counts and checksums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import hot, scratch

#: Contracted links that one task may hold: 16 MB of ids.
FEW = 1_000_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b): each node's neighbours are linked to the least of them and the node itself.

    large: only neighbours above the node; otherwise only those below it.
    """
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = hot.join(both, least, ["a"], ["b"])  # the middle of a large star has many links
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    up = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return up.unionByName(own).where("a <> b").distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node, but for the least of its component, to that least one."""
    nodes, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, x, y)
        while (root[root] != root).any():
            root = root[root]
    low = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[low], nodes[root[low]]


def _contracted(frames):
    a = b = np.zeros(0, np.int64)
    for frame in frames:
        a, b = stars(np.concatenate((a, frame["a"].to_numpy())), np.concatenate((b, frame["b"].to_numpy())))
    yield pd.DataFrame({"a": a, "b": b})


def _ended(frames):
    """Each node of links that no other task holds, with its component."""
    for frame in _contracted(frames):
        low, root = frame["a"].to_numpy(), frame["b"].to_numpy()
        ends = np.unique(root)
        yield pd.DataFrame({"node": np.concatenate((low, ends)), "component": np.concatenate((root, ends))})


def _mark() -> list[Column]:
    """A count and checksums of links."""
    h = F.xxhash64("a", "b")
    return [F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")]


def _settled(links: DataFrame, name: str) -> tuple[DataFrame, tuple, tuple]:
    """The links contracted and written, with their marks before and after."""
    before, after = Observation(f"{name}-before"), Observation(f"{name}-after")
    out = scratch.written(links.observe(before, *_mark()).mapInPandas(_contracted, "a long, b long").observe(after, *_mark()), "links")
    return out, tuple(before.get.values()), tuple(after.get.values())


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int | None = None) -> DataFrame:
    """Columns node and component (the least node that is reachable), for each node that has a link: a written table."""
    links = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    links, _, mark = _settled(links, "links")  # repeated links of a partition go here, others in the first round
    if mark[0] <= (FEW if few is None else few):
        return scratch.finished(links.coalesce(1).mapInPandas(_ended, "node long, component long"), "components", links)
    for k in range(most_rounds):
        after, found, now = _settled(_star(_star(links, True), False), f"links-{k}")
        scratch.drop(links)
        links = after
        if found == mark:  # a round that changes nothing has met stars
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    ends = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return scratch.finished(links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends), "components", links)
