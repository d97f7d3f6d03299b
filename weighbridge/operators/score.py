"""Scores of weight vectors: per-target diagnostics, error summaries, weight diagnostics, long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas
from ..sources.tables import dropped, kept
from .order_statistics import quantiles


def target_scale(value: Column) -> Column:
    return F.greatest(F.abs(value), F.lit(1.0))


def relative_error(value: Column, achieved: Column) -> Column:
    """Absolute relative error; null for targets of value 0."""
    return F.when(value != 0, F.abs(achieved - value) / F.abs(value))


def target_diagnostics(scored: DataFrame, loss_weights: DataFrame | None = None, degenerate: DataFrame | None = None) -> DataFrame:
    """Adds error, absolute and relative errors, scale, loss weight, zero and degenerate flags to (target_name, value, achieved_value)."""
    v, a = F.col("value"), F.col("achieved_value")
    out = scored.withColumns({
        "error": a - v, "absolute_error": F.abs(a - v), "relative_error": F.when(v != 0, (a - v) / v), "absolute_relative_error": relative_error(v, a),
        "scale": target_scale(v), "is_zero_value_target": v == 0,
    })
    if loss_weights is not None:
        n, m = scored.select("target_name").distinct().count(), loss_weights.count()
        if n != m:
            raise ValueError(f"{m} loss weights for {n} targets")
        out = out.join(loss_weights.select("target_name", "loss_weight"), "target_name", "left")
    elif "loss_weight" not in out.columns:
        out = out.withColumn("loss_weight", F.lit(None).cast("double"))
    if degenerate is not None:
        out = out.join(degenerate.select("target_name", F.lit(True).alias("__named")), "target_name", "left").withColumn("is_degenerate", F.col("__named").isNotNull()).drop("__named")
    return out


def score(diagnostics: DataFrame, run_keys: list[str], are: str = "absolute_relative_error", value: str = "target_value", achieved: str = "achieved_value") -> DataFrame:
    """One pass over all levels: (run keys, scope, scope_value) with relative-error and zero-target statistics.

    n counts the targets with a relative error, n_targets all of them.  A family or
    level without any such target has no row.  The columns of removal sensitivity look
    at targets with a relative error alone and are null where no degenerate targets
    are named (no column is_degenerate).
    """
    d = diagnostics.withColumns({"__are": F.col(are), "__abs": F.abs(F.col(achieved) - F.col(value)), "__zero": F.col(value) == 0})
    named = F.lit("is_degenerate" in d.columns)
    if "is_degenerate" not in d.columns:
        d = d.withColumn("is_degenerate", F.lit(False))
    zero = lambda f: f(F.when(F.col("__zero"), F.col("__abs")))
    levels = [run_keys, [*run_keys, "family"], [*run_keys, "geography_level"]]
    grouped = d.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in [*run_keys, "family", "geography_level"]])
    out = grouped.agg(
        F.grouping("family").alias("__f"), F.grouping("geography_level").alias("__g"),
        F.avg("__are").alias("mean_are"), F.median("__are").alias("median_are"), F.max("__are").alias("max_are"), F.count("__are").alias("n"), F.count("*").alias("n_targets"),
        F.count_if("__zero").alias("n_zero_value_targets"), zero(F.avg).alias("mean_absolute_error_zero"), zero(F.max).alias("max_absolute_error_zero"),
        F.avg(F.when(~F.col("is_degenerate"), F.col("__are"))).alias("__ex"), F.count_if(F.col("is_degenerate") & F.col("__are").isNotNull()).alias("n_degenerate"),
        F.count_if(F.col("__are") > 1).alias("n_are_gt_1"), F.count_if(F.col("__are") > 5).alias("n_are_gt_5"))
    out = out.where("n > 0 OR (__f = 1 AND __g = 1)")
    scope = F.when(F.col("__f") == 0, "family").when(F.col("__g") == 0, "geography").otherwise("overall")
    return out.select(
        *run_keys, scope.alias("scope"), F.coalesce(F.when(F.col("__f") == 0, F.col("family")), F.when(F.col("__g") == 0, F.col("geography_level")), F.lit("")).alias("scope_value"),
        "mean_are", "median_are", "max_are", "n", "n_targets", "n_zero_value_targets", "mean_absolute_error_zero", "max_absolute_error_zero",
        F.when(named, F.col("__ex")).alias("mean_are_ex_degenerate"), F.when(named, F.col("n_degenerate")).alias("n_degenerate"),
        "n_are_gt_1", "n_are_gt_5")


def weight_diagnostics(weights: DataFrame, run_keys: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Count, sum, effective sample size, extremes and quantiles of the positive weights of each run; zeros for a run without any.

    The weights are written first: they are read in each round of the quantiles.
    The result is a written table too, a row for each run.
    """
    positive = kept(weights.where("weight > 0").select(*run_keys, "weight"), "weights")
    out = positive.groupBy(*run_keys).agg(
        F.count("*").alias("n_selected"), F.sum("weight").alias("weight_sum"), (F.pow(F.sum("weight"), F.lit(2.0)) / F.sum(F.col("weight") * F.col("weight"))).alias("ess"),
        F.min("weight").alias("min_weight"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"))
    names = {"q0": "p50_weight", "q1": "p90_weight", "q2": "p99_weight"}
    out = kept(out.join(quantiles(positive, run_keys, "weight", [0.5, 0.9, 0.99]).withColumnsRenamed(names), run_keys), "weight-diagnostics")
    dropped(positive)
    if runs is not None:
        out = runs.select(*run_keys).distinct().join(out, run_keys, "left").na.fill(0)
    return out


def tail_counts(rows: DataFrame, run_keys: list[str], thresholds: tuple[float, ...] = (1.0, 5.0), are: str = "absolute_relative_error") -> DataFrame:
    """Numbers of scored targets, and of those with a relative error strictly above each threshold."""
    more = [F.count_if(F.col(are) > t).alias(f"n_are_gt_{t:g}") for t in thresholds]
    return rows.groupBy(*run_keys).agg(F.count(are).alias("n_scored"), *more)


#: Metrics of a score; the last two are those of the overall scope alone.
SCORE_METRICS = ("mean_are", "median_are", "max_are", "n", "mean_are_ex_degenerate", "n_degenerate")


def long_rows(scored: DataFrame, run_values: DataFrame, keys: list[str], holdout_type: str, fold: int) -> DataFrame:
    """Metric rows of all runs: scores (keys, split, scope, scope_value) and run values (keys, one column each), null metrics dropped."""
    columns = schemas.names(schemas.METRICS_LONG)
    doubles = [F.col(m).cast("double").alias(m) for m in SCORE_METRICS]
    a = scored.select(*keys, "split", "scope", "scope_value", *doubles).unpivot([*keys, "split", "scope", "scope_value"], list(SCORE_METRICS), "metric", "value")
    a = a.where("scope = 'overall' OR metric NOT IN ('mean_are_ex_degenerate', 'n_degenerate')")
    metrics = [c for c in run_values.columns if c not in keys]
    b = run_values.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keys, metrics, "metric", "value")
    b = b.withColumns({"split": F.lit("na"), "scope": F.lit("run"), "scope_value": F.lit("")})
    budget = run_values.select(*keys, F.col("n_selected").cast("long").alias("budget_achieved")) if "n_selected" in metrics else None
    out = a.unionByName(b).where("value is not null")
    out = out.join(budget, keys, "left") if budget is not None else out.withColumn("budget_achieved", F.lit(None).cast("long"))
    return out.withColumns({"holdout_type": F.lit(holdout_type), "fold": F.lit(fold), "budget_requested": F.col("budget_requested").cast("long")}).select(*columns)


def diagnostic_rows(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics in the columns that are stored."""
    return diagnostics.select(*schemas.names(schemas.TARGET_DIAGNOSTICS))
