"""Weighted entity tables: restriction, weights, column drops, subsampling."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rand import uniform
from ..sources.tables import dropped, kept


@dataclass(frozen=True)
class Universe:
    """Entity tables around one weighted entity.

    tables: each has a column ``record_id``, the weighted record that its row belongs
    to (the weighted entity's own id in its own table).  weights: record_id, w0.
    mass_log: (step, factor, reason) of each logged change of total mass.
    """

    weight_entity: str
    tables: dict[str, DataFrame]
    weights: DataFrame
    kind: str = "design"
    mass_log: tuple[tuple[str, float, str], ...] = field(default=())

    def restricted(self, ids: DataFrame) -> Universe:
        """All tables and weights of the chosen records only."""
        chosen = ids.select("record_id").distinct()
        keep = lambda df: df.join(chosen, "record_id", "left_semi")
        return replace(self, tables={n: keep(t) for n, t in self.tables.items()}, weights=keep(self.weights))

    def with_weights(self, weights: DataFrame, kind: str) -> Universe:
        """Kinds only move forward: design, then calibrated."""
        order = ("design", "calibrated")
        if order.index(kind) < order.index(self.kind):
            raise ValueError(f"weights of kind {self.kind} can't become {kind}")
        return replace(self, weights=weights, kind=kind)

    def logged(self, step: str, factor: float, reason: str) -> Universe:
        return replace(self, mass_log=(*self.mass_log, (step, factor, reason)))


def to_full(universe_ids: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights of a subset over the whole universe; 0 for what is not retained."""
    return universe_ids.select("record_id").join(weights.select("record_id", "weight"), "record_id", "left").select("record_id", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def drop_columns(tables: dict[str, DataFrame], columns: list[str], keys: tuple[str, ...] = ("record_id",)) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    """Drops the named columns from whichever table has them; returns what was dropped from each."""
    gone = {n: sorted(c for c in t.columns if c in columns and c not in keys) for n, t in tables.items()}
    return {n: t.drop(*gone[n]) for n, t in tables.items()}, {n: g for n, g in gone.items() if g}


def reset_weights(weights: DataFrame, mode: str = "uniform") -> DataFrame:
    """uniform: each record gets total / n, so that the mass stays; keep: as they are."""
    if mode == "keep":
        return weights
    if mode != "uniform":
        raise ValueError(f"unknown weight reset {mode}")
    mean = weights.agg(F.avg("w0").alias("mean_w0"))
    return weights.crossJoin(F.broadcast(mean)).select("record_id", F.col("mean_w0").alias("w0"))  # one row


def random_subset(ids: DataFrame, n: int, seed: int, purpose: str = "subset") -> DataFrame:
    """The n ids with the least hash uniforms; all of them where there are no more than n.

    The bound is found from a histogram of the uniforms, then exactly within one of
    its bins, so that no task sorts all ids.  Uniforms are hashed once: they and the
    subset are written tables.
    """
    drawn = ids.select("record_id", uniform(purpose, seed, F.col("record_id")).alias("u"))
    bins = 4096
    placed = kept(drawn.withColumn("bin", F.floor(F.col("u") * bins).cast("int")), "drawn")
    held = sorted((r["bin"], r["count"]) for r in placed.groupBy("bin").count().collect())  # at most 4096 rows
    below = 0
    for k, count in held:
        if below + count >= n:
            break
        below += count
    else:
        dropped(placed)
        return ids.select("record_id")
    edge = placed.where(F.col("bin") == k).orderBy("u", "record_id").limit(n - below)
    chosen = kept(placed.where(F.col("bin") < k).select("record_id").unionByName(edge.select("record_id")), "subset")
    dropped(placed)
    return chosen


def random_start(universe: Universe, n: int, seed: int) -> Universe:
    """A uniform subset without replacement whose start weights share the full total."""
    total = universe.weights.agg(F.sum("w0").alias("total"))
    small = universe.restricted(random_subset(universe.weights, n, seed, "random"))
    count = small.weights.agg(F.count("*").alias("n"))
    scaled = small.weights.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(count)).select("record_id", (F.col("total") / F.col("n")).alias("w0"))
    return replace(small, weights=scaled).logged("random_subset", 1.0, f"{n} records carry the full total")
