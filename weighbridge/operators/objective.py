"""The capped, weighted objective and its summaries over stored diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import finite, interval


def raw_relative_error() -> Column:
    return F.when(F.col("target_value") != 0, F.abs(F.col("achieved_value") - F.col("target_value")) / F.abs("target_value"))


def capped_relative_error(cap: float | None = 1.0) -> Column:
    """Error over the stored scale (or the greater of |target| and 1), at most ``cap``."""
    scale = F.coalesce(F.col("scale"), F.greatest(F.abs("target_value"), F.lit(1.0)))
    error = F.abs(F.col("achieved_value") - F.col("target_value")) / scale
    return error if cap is None else F.least(error, F.lit(float(cap)))


def objective(cap: float | None = 1.0) -> Column:
    """Weighted mean of the capped error; unweighted where no row has a weight; null for no rows or no positive total.

    A row without a weight among rows with weights takes no part.
    """
    e, w = capped_relative_error(cap), F.col("loss_weight")
    total = F.sum(w)
    return F.when(F.count(w) == 0, F.avg(e)).when(total > 0, F.sum(e * w) / total)


def fraction_within(threshold: float = 0.1) -> Column:
    """Share of targets whose raw error is at most the threshold, among those that have one."""
    e = raw_relative_error()
    return F.avg(F.when(e.isNotNull(), F.when(e <= threshold, 1.0).otherwise(0.0)))


def summarize(rows: DataFrame, group: list[str], cap: float | None = 1.0, within: float = 0.1, drop_degenerate: bool = False) -> DataFrame:
    """Objective, median and mean raw error, share within the threshold and count, by the keys that are present."""
    if drop_degenerate:
        rows = rows.where(~F.col("is_degenerate"))
    e = raw_relative_error()
    keys = [k for k in group if k in rows.columns]
    return rows.groupBy(*keys).agg(
        objective(cap).alias("objective"), F.median(e).alias("median_raw"), F.avg(e).alias("mean_raw"), fraction_within(within).alias("fraction_within"), F.count("*").alias("n"))


def across_seeds(summary: DataFrame, group: list[str]) -> DataFrame:
    """Means and intervals over seeds of the columns of :func:`summarize`, and the rounded mean count."""
    columns = ("objective", "median_raw", "mean_raw", "fraction_within")
    parts = [x for c in columns for x in (F.avg(finite(F.col(c))).alias(c), F.stddev_samp(finite(F.col(c))).alias(f"__sd_{c}"), F.count(finite(F.col(c))).alias(f"__n_{c}"))]
    out = summary.groupBy(*group).agg(*parts, F.bround(F.avg("n")).cast("long").alias("n"), F.count_distinct("seed").alias("n_seeds"))
    bounds = {}
    for c in columns:
        bounds[f"{c}_lo"], bounds[f"{c}_hi"] = interval(F.col(c), F.col(f"__sd_{c}"), F.col(f"__n_{c}"))
    return out.withColumns(bounds).select(*group, *[x for c in columns for x in (c, f"{c}_lo", f"{c}_hi")], "n", "n_seeds")


def loss_weight_summary(weights: DataFrame) -> DataFrame:
    """Count, sum, mean, least and greatest loss weight; null values stand for uniform weights."""
    w = F.col("loss_weight")
    return weights.agg(F.count(w).alias("n"), F.sum(w).alias("sum"), F.avg(w).alias("mean"), F.min(w).alias("min"), F.max(w).alias("max"), (F.count(w) == 0).alias("uniform"))


def loss_summary(history: DataFrame, run_keys: list[str], windows: tuple[int, ...] = (50, 100, 250)) -> DataFrame:
    """First, last and best loss, the first best epoch, and the relative improvement over the last epochs of each run."""
    from pyspark.sql import Window

    order = Window.partitionBy(*run_keys).orderBy("epoch")
    lagged = history.withColumns({f"__lag_{w}": F.lag("loss", w).over(order) for w in windows})
    out = lagged.groupBy(*run_keys).agg(
        F.min_by("loss", "epoch").alias("first_loss"), F.max_by("loss", "epoch").alias("last_loss"), F.min("loss").alias("best_loss"),
        F.min(F.struct("loss", "epoch"))["epoch"].alias("best_epoch"), F.count("*").alias("epochs"), *[F.max_by(f"__lag_{w}", "epoch").alias(f"__lag_{w}") for w in windows])
    gain = {f"improvement_{w}": (F.col(f"__lag_{w}") - F.col("last_loss")) / F.greatest(F.abs(f"__lag_{w}"), F.lit(1e-12)) for w in windows}
    return out.withColumns(gain).drop(*[f"__lag_{w}" for w in windows])
