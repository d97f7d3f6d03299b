"""Samples of weighted records: with and without replacement, and what weights they carry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import uniform
from .order_statistics import least
from .universe import random_subset

SLICES = 4096


def _positive_total(weights: DataFrame) -> float:
    total = weights.where("weight > 0").agg(F.sum("weight")).first()[0]
    if total is None or not total > 0:
        raise ValueError("the weights' total must be positive")
    return float(total)


def draw_with_replacement(weights: DataFrame, n: int, seed: int) -> DataFrame:
    """(record_id, weight, draws): exactly n draws with chances in proportion to the weights."""
    return draws_at(weights, [n], seed).select("record_id", "drawn_weight", "draws").withColumnRenamed("drawn_weight", "weight")


def draws_at(weights: DataFrame, budgets: list[int], seed: int) -> DataFrame:
    """(budget, record_id, drawn_weight, draws) of several budgets in one pass: a budget's draws are the first of the largest budget's.

    Records are dealt into slices by a hash; a slice holds a stretch of the line of
    cumulative weight.  Totals of the slices, which are few, place each draw in its
    slice, where the draws are merged with the records' own cumulative weights.
    """
    budgets = sorted(set(budgets))
    n = budgets[-1]
    total = _positive_total(weights)
    rows = weights.where("weight > 0").select("record_id", "weight", F.floor(uniform("slice", seed, F.col("record_id")) * SLICES).cast("int").alias("slice"))
    sums = rows.groupBy("slice").agg(F.sum("weight").alias("held"))
    ends = sums.withColumn("end", F.sum("held").over(Window.orderBy("slice"))).withColumn("begin", F.col("end") - F.col("held"))  # SLICES rows at most
    draws = weights.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform("draw", seed, F.col("id")) * total).alias("at"))
    line = ends.select(F.col("slice"), F.col("begin")).collect()
    starts = sorted((r["begin"], r["slice"]) for r in line)
    bounds, names = np.array([b for b, _ in starts]), np.array([s for _, s in starts], np.int32)

    @F.pandas_udf("slice int, at double")
    def place(at: pd.Series) -> pd.DataFrame:
        """The last slice that begins at or before the draw, and the way into it."""
        nth = np.searchsorted(bounds, at.to_numpy(), side="right") - 1
        return pd.DataFrame({"slice": names[nth], "at": at.to_numpy() - bounds[nth]})

    placed = draws.select("draw", place("at").alias("to")).select("draw", "to.slice", "to.at")
    order = Window.partitionBy("slice").orderBy("record_id").rowsBetween(Window.unboundedPreceding, 0)
    marks = rows.withColumn("at", F.sum("weight").over(order) - F.col("weight")).select("slice", "at", F.lit(0).alias("kind"), "record_id", "weight", F.lit(None).cast("long").alias("draw"))
    both = marks.unionByName(placed.select("slice", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("record_id"), F.lit(None).cast("double").alias("weight"), "draw"))
    walk = Window.partitionBy("slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("kind", "draw", F.last(F.when(F.col("kind") == 0, F.struct("record_id", "weight")), ignorenulls=True).over(walk).alias("hit")).where("kind = 1")
    counts = [F.struct(F.lit(b).cast("long").alias("budget"), F.count_if(F.col("draw") < b).alias("draws")) for b in budgets]
    by_record = found.groupBy(F.col("hit.record_id").alias("record_id")).agg(F.first("hit.weight").alias("drawn_weight"), F.array(*counts).alias("at"))
    return by_record.select("record_id", "drawn_weight", F.inline("at")).where("draws > 0").select("budget", "record_id", "drawn_weight", "draws")


def draw_without_replacement(weights: DataFrame, n: int, seed: int) -> DataFrame:
    """(record_id, weight, draws): the n records with the least -ln(u) / weight."""
    keyed = weights.where("weight > 0").select("record_id", "weight", (-F.ln(uniform("pps", seed, F.col("record_id"))) / F.col("weight")).alias("key"))
    return least(keyed, "key", "record_id", n).select("record_id", "weight", F.lit(1).cast("long").alias("draws"))


def equal_mass(drawn: DataFrame, total: float, n: int) -> DataFrame:
    """Each draw carries total / n; a record drawn twice carries twice that."""
    return drawn.select("record_id", (F.col("draws") * F.lit(total) / F.lit(n)).alias("weight"))


def renorm_kept(drawn: DataFrame, total: float) -> DataFrame:
    """Each draw keeps its record's weight; all are scaled to the total."""
    held = drawn.agg(F.sum(F.col("draws") * F.col("weight")).alias("held"))
    return drawn.crossJoin(F.broadcast(held)).select("record_id", (F.col("draws") * F.col("weight") * total / F.col("held")).alias("weight"))  # one row


def weighted_sample(weights: DataFrame, n: int, seed: int, replace: bool = True, reweight: str = "equal_mass") -> tuple[DataFrame, dict]:
    """Sampled weights, and how many draws and how many different records they are."""
    total = _positive_total(weights)
    drawn = draw_with_replacement(weights, n, seed) if replace else draw_without_replacement(weights, n, seed)
    draws, unique = drawn.agg(F.sum("draws"), F.count("*")).first()
    if reweight == "equal_mass":
        out = equal_mass(drawn, total, draws)
    elif reweight == "renorm_kept":
        out = renorm_kept(drawn, total)
    else:
        raise ValueError(f"unknown reweighting {reweight}")
    return out, {"n_selected": int(draws), "n_unique": int(unique), "total": total}


def dense_scaled_sample(dense: DataFrame, n: int, seed: int) -> DataFrame:
    """A uniform subset of dense weights, scaled to the dense total; no refit."""
    total = _positive_total(dense)
    kept = dense.join(random_subset(dense.where("weight > 0"), n, seed, "scaled"), "record_id", "left_semi")
    held = kept.agg(F.sum("weight").alias("held"))
    return kept.crossJoin(F.broadcast(held)).select("record_id", (F.col("weight") * total / F.col("held")).alias("weight"))
