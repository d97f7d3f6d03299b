"""What the trained operators share: held-out folds, bounded samples, a small optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(name: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; false where the id is null."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(ids: DataFrame, n: int, salt: int) -> list[int]:
    """At most ``n`` of the ids, those with the least hashes: a uniform sample, the same in every run."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    total = ids.count()
    if not total:
        return []
    rank = F.xxhash64(F.lit(salt), F.col("doc_id"))
    below = int(min(1.0, 2.0 * n / total + 40.0 / total) * 2**63) * 2 - 2**63 - 1
    few = ids.select("doc_id", rank.alias("rank")).where(F.col("rank") <= min(below, 2**63 - 1)).distinct()
    return [r["doc_id"] for r in few.orderBy("rank", "doc_id").limit(n).collect()]


def bounded_samples(ids: DataFrame, group: str, n: int, salt: int = 0) -> dict[str, list[int]]:
    """For each value of a column at most ``n`` ids, as :func:`bounded_sample` takes them, in two passes over the ids."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), group).where(F.col("doc_id").isNotNull() & F.col(group).isNotNull())
    counts = ids.groupBy(group).agg(F.count("*").alias("total")).collect()  # a row for each group
    if not counts:
        return {}
    ceiling = [(r[group], min(int(min(1.0, 2.0 * n / r["total"] + 40.0 / r["total"]) * 2**63) * 2 - 2**63 - 1, 2**63 - 1)) for r in counts]
    bounds = ids.sparkSession.createDataFrame(ceiling, f"{group} {dict(ids.dtypes)[group]}, below long")
    few = ids.withColumn("rank", F.xxhash64(F.lit(salt), F.col("doc_id"))).join(F.broadcast(bounds), group).where("rank <= below").select(group, "doc_id", "rank").distinct()
    first = few.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy("rank", "doc_id"))).where(F.col("nth") <= n)  # some 2 n rows a group
    out: dict = {r[group]: [] for r in counts}
    for r in first.select(group, "doc_id").collect():
        out[r[group]].append(r["doc_id"])
    return {k: sorted(v) for k, v in out.items()}


def with_ids(docs: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of a bounded list of ids."""
    listed = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    return docs.join(F.broadcast(listed), "doc_id", "left_semi")


class Adam:
    def __init__(self, shapes, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]

    def step(self, weights: list[np.ndarray], slopes: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(weights, slopes, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
