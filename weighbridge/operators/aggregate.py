"""Summaries of long metric rows across seeds, budgets, methods and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import finite, interval, interval_parts, t_tail


def sliced(rows: DataFrame, holdout_type: str | None = None, split: str | None = None, scope: str | None = "overall", metric: str | None = None) -> DataFrame:
    for column, value in (("holdout_type", holdout_type), ("split", split), ("scope", scope), ("metric", metric)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def with_interval(rows: DataFrame, keys: list[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """mean, lo, hi and n_values of a column for each key; undefined values are left out."""
    out = rows.groupBy(*keys).agg(*interval_parts(F.col(value)), F.count_distinct("seed").alias("n_seeds"))
    lo, hi = interval(F.col("mean"), F.col("sd"), F.col("n_values"), confidence)
    return out.withColumns({"lo": lo, "hi": hi}).drop("sd")


def achieved_budget(rows: DataFrame, holdout_type: str) -> DataFrame:
    """(method, l2, budget, budget_achieved): for the survey sample that of L0, else of random, else the requested one.

    Sampled records are counted in draws, so that the sample's own count isn't comparable.
    """
    keys = ["l2_lambda", "budget_requested"]
    own = sliced(rows, holdout_type, scope="run", metric="budget_achieved").groupBy("method", *keys).agg(F.avg("value").alias("own"))
    of = lambda m, name: own.where(F.col("method") == m).select(*keys, F.col("own").alias(name))
    out = own.join(of("informed_l0", "l0"), keys, "left").join(of("random_reweight", "random"), keys, "left")
    chosen = F.when(F.col("method") == "dense_sample", F.coalesce("l0", "random", F.col("budget_requested").cast("double"))).otherwise(F.coalesce("own", F.col("budget_requested").cast("double")))
    return out.select("method", *keys, chosen.alias("budget_achieved"))


def frontier(rows: DataFrame, holdout_type: str = "fixed_family", metric: str = "mean_are", confidence: float = 0.95) -> DataFrame:
    """Mean and interval over seeds of an overall metric for each split, method, l2 and budget."""
    keys = ["split", "method", "l2_lambda", "budget_requested"]
    out = with_interval(sliced(rows, holdout_type, metric=metric), keys, confidence=confidence)
    return out.join(achieved_budget(rows, holdout_type), ["method", "l2_lambda", "budget_requested"], "left").select(*keys, "budget_achieved", "mean", "lo", "hi", "n_seeds")


def rotation_seed_scores(rows: DataFrame, validation_only: list[str], holdout_type: str = "rotation") -> DataFrame:
    """Target-weighted mean over the folds' held-out families for each seed; validation-only families are left out and counted."""
    keys = ["method", "l2_lambda", "budget_requested", "seed"]
    own = rows.where((F.col("holdout_type") == holdout_type) & (F.col("split") == "out_of_sample") & (F.col("scope") == "family") & F.col("metric").isin("mean_are", "n"))
    wide = own.groupBy(*keys, "fold", "scope_value").pivot("metric", ["mean_are", "n"]).agg(F.avg("value"))
    excluded = F.col("scope_value").isin(validation_only) if validation_only else F.lit(False)
    good = ~excluded & F.col("mean_are").isNotNull() & (F.col("n") > 0)
    out = wide.groupBy(*keys).agg(
        (F.sum(F.when(good, F.col("mean_are") * F.col("n"))) / F.sum(F.when(good, F.col("n")))).alias("value"),
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0.0)).cast("long").alias("n_targets"),
        F.count_distinct(F.when(good, F.col("fold"))).alias("n_folds"), F.coalesce(F.sum(F.when(excluded, F.col("n"))), F.lit(0.0)).cast("long").alias("n_excluded"))
    return out.where("value is not null")


def rotation_frontier(rows: DataFrame, validation_only: list[str], confidence: float = 0.95) -> DataFrame:
    """Intervals over seeds of the rotation scores."""
    scores = rotation_seed_scores(rows, validation_only)
    keys = ["method", "l2_lambda", "budget_requested"]
    out = with_interval(scores, keys, confidence=confidence)
    more = scores.groupBy(*keys).agg(F.max("n_targets").alias("n_targets"), F.max("n_folds").alias("n_folds"))
    return out.join(more, keys).select(*keys, "mean", "lo", "hi", "n_seeds", "n_targets", "n_folds")


def paired_difference(rows: DataFrame, challenger: str, baseline: str, metric: str = "mean_are", split: str = "out_of_sample", holdout_type: str = "fixed_family", confidence: float = 0.95) -> DataFrame:
    """Same-seed differences of two methods for each l2 and budget, with interval and two-sided p-value.

    The p-value needs two pairs and differences that aren't all the same; the
    interval's verdict needs three seeds.
    """
    own = sliced(rows, holdout_type, split, metric=metric)
    wide = own.groupBy("l2_lambda", "budget_requested", "seed").pivot("method", [challenger, baseline]).agg(F.avg("value"))
    pairs = wide.select("l2_lambda", "budget_requested", "seed", F.col(challenger).alias("c"), F.col(baseline).alias("b")).dropna().withColumn("d", F.col("c") - F.col("b"))
    out = pairs.groupBy("l2_lambda", "budget_requested").agg(
        F.avg("c").alias("mean_challenger"), F.avg("b").alias("mean_baseline"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n_pairs"))
    lo, hi = interval(F.col("mean_diff"), F.col("sd"), F.col("n_pairs"), confidence)
    t = F.col("mean_diff") / (F.col("sd") / F.sqrt(F.col("n_pairs").cast("double")))
    p = F.when((F.col("n_pairs") >= 2) & (F.col("sd") > 1e-300), t_tail(t, (F.col("n_pairs") - 1).cast("int")))
    return out.withColumns({"diff_lo": lo, "diff_hi": hi, "p_value": p}).withColumns({
        "challenger_better": F.col("mean_diff") < 0,
        "ci_excludes_zero": (F.col("n_pairs") >= 3) & ((F.col("diff_lo") > 0) | (F.col("diff_hi") < 0))}).drop("sd")


def macro_average(rows: DataFrame, metric: str = "mean_are", split: str = "out_of_sample", holdout_type: str = "fixed_family", confidence: float = 0.95) -> DataFrame:
    """Mean over families in a seed, then mean and interval over seeds."""
    keys = ["method", "l2_lambda", "budget_requested"]
    seeds = sliced(rows, holdout_type, split, "family", metric).groupBy(*keys, "seed").agg(F.avg(finite(F.col("value"))).alias("value"))
    return with_interval(seeds, keys, confidence=confidence).select(*keys, "mean", "lo", "hi", "n_seeds")


def by_family(rows: DataFrame, budget: int, metric: str = "mean_are", split: str = "out_of_sample", holdout_type: str = "fixed_family") -> DataFrame:
    """Each family's error at one budget, averaged over seeds and folds."""
    own = sliced(rows, holdout_type, split, "family", metric).where(F.col("budget_requested") == budget)
    return own.groupBy("method", "l2_lambda", F.col("scope_value").alias("family")).agg(F.avg("value").alias("value"))


def run_metric(rows: DataFrame, metric: str, holdout_type: str = "fixed_family", confidence: float = 0.95) -> DataFrame:
    """Mean and interval of a run's own metric, with the achieved budget."""
    keys = ["method", "l2_lambda", "budget_requested"]
    out = with_interval(sliced(rows, holdout_type, scope="run", metric=metric), keys, confidence=confidence)
    return out.join(achieved_budget(rows, holdout_type), keys, "left").select(*keys, F.coalesce("budget_achieved", F.col("budget_requested").cast("double")).alias("budget_achieved"), "mean", "lo", "hi", "n_seeds")


def operability(rows: DataFrame, method: str, budget: int, holdout_type: str = "fixed_family") -> DataFrame:
    """For each l2: effective sample size, greatest weight, errors inside and outside of the fit, in one pass."""
    own = rows.where((F.col("holdout_type") == holdout_type) & (F.col("method") == method) & (F.col("budget_requested") == budget))
    at = lambda metric, scope, split=None: F.avg(F.when((F.col("metric") == metric) & (F.col("scope") == scope) & (F.lit(True) if split is None else F.col("split") == split), F.col("value")))
    return own.groupBy("l2_lambda").agg(
        at("ess", "run").alias("ess"), at("max_weight", "run").alias("max_weight"), at("mean_are", "overall", "in_sample").alias("mean_are_in"),
        at("mean_are", "overall", "out_of_sample").alias("mean_are_out"), at("median_are", "overall", "out_of_sample").alias("median_are_out"))


def generalization_gap(rows: DataFrame, metric: str = "mean_are", holdout_type: str = "fixed_family") -> DataFrame:
    """Error outside of the fit minus error inside, for each method, l2 and budget."""
    f = frontier(rows, holdout_type, metric)
    keys = ["method", "l2_lambda", "budget_requested"]
    side = lambda s, name: f.where(F.col("split") == s).select(*keys, F.col("mean").alias(name))
    return side("in_sample", "inside").join(side("out_of_sample", "outside"), keys).withColumn("gap", F.col("outside") - F.col("inside"))


def top_contributors(diagnostics: DataFrame, k: int = 15, l2: float | None = None, split: str = "out_of_sample", share_keys: tuple[str, ...] = ("method", "budget_requested")) -> DataFrame:
    """The k targets of each method and budget that drive the mean error of a split, with their share of its summed error."""
    diagnostics = diagnostics.where(F.col("split") == split)
    if l2 is not None:
        diagnostics = diagnostics.where(F.col("l2_lambda") == l2)
    elif diagnostics.agg(F.count_distinct("l2_lambda")).first()[0] > 1:
        raise ValueError("several l2 values: choose one")
    keys = list(share_keys)
    mean = diagnostics.where("absolute_relative_error is not null").groupBy(*keys, "target_name", "family", "is_degenerate").agg(F.avg("absolute_relative_error").alias("mean_are"))
    total = F.sum("mean_are").over(Window.partitionBy(*keys))
    shared = mean.withColumn("share", F.when(total > 0, F.col("mean_are") / total).otherwise(0.0))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean_are"), "target_name"))
    return shared.withColumn("rank", nth).where(F.col("rank") <= k)


def at(rows: DataFrame, column: str = "value", **where: object) -> Column:
    """Conditional mean of the rows that agree with all given values, for use in one pass over many cells."""
    cond = F.lit(True)
    for name, value in where.items():
        cond = cond & (F.col(name) == F.lit(value))
    return F.avg(F.when(cond, F.col(column)))


def headline_split(rows: DataFrame, holdout_type: str = "fixed_family") -> DataFrame:
    """One row: out_of_sample if there is an overall mean error of that split, else in_sample."""
    there = F.max(F.when((F.col("holdout_type") == holdout_type) & (F.col("scope") == "overall") & (F.col("metric") == "mean_are") & (F.col("split") == "out_of_sample"), 1))
    return rows.agg(F.when(there == 1, "out_of_sample").otherwise("in_sample").alias("split"))


def headline_method(rows: DataFrame) -> DataFrame:
    """One row: the refit arm if present, else L0."""
    return rows.agg(F.when(F.max(F.when(F.col("method") == "informed_l0_refit", 1)) == 1, "informed_l0_refit").otherwise("informed_l0").alias("method"))


def anchor_budget(rows: DataFrame, requested: int | None = None) -> DataFrame:
    """One row: the requested budget if L0 ran at it, else the upper median of L0's budgets with the richest l2 grid, else the requested one."""
    own = sliced(rows, "fixed_family", scope="run", metric="ess").where("method = 'informed_l0'")
    per = own.groupBy("budget_requested").agg(F.count_distinct("l2_lambda").alias("grid"))
    listed = per.agg(F.max("grid").alias("most"), F.array_sort(F.collect_list(F.struct("budget_requested", "grid"))).alias("all"))
    rich = F.transform(F.filter("all", lambda x: x["grid"] == F.col("most")), lambda x: x["budget_requested"])
    chosen = F.element_at(rich, (F.size(rich) / 2).cast("int") + 1)
    if requested is not None:
        chosen = F.when(F.exists("all", lambda x: x["budget_requested"] == requested), F.lit(requested).cast(dict(rows.dtypes)["budget_requested"])).otherwise(F.coalesce(chosen, F.lit(requested).cast(dict(rows.dtypes)["budget_requested"])))
    return listed.select(chosen.alias("budget_requested"))
