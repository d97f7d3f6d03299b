"""Report frames: numeric result tables with formatted cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import aggregate as A
from .objective import across_seeds, summarize


#: What a summary keeps of a score.
SCORE_FIELDS = ("n", "mean_are", "median_are", "max_are")


def method_comparison(scores: DataFrame, weights: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each method of a run: retained records, errors inside and outside, effective size, greatest weight, time."""
    overall = scores.where("scope = 'overall'").groupBy(*keys).pivot("split", ["in_sample", "out_of_sample"]).agg(F.avg("mean_are"))
    out = runs.join(weights.select(*keys, "n_selected", "ess", "max_weight"), keys, "left").join(overall, keys, "left")
    return out.withColumns({"label": T.method_label(F.col("method")), "position": T.method_order(F.col("method"))}).orderBy("position", "method")


def accuracy_by(scores: DataFrame, keys: list[str], scope: str, levels: list[str] | None = None) -> DataFrame:
    """Accuracy by geography or family with a total row; asked-for levels that are absent are shown empty."""
    own = scores.where(F.col("scope") == scope).withColumnRenamed("scope_value", "level")
    if levels is not None:
        wanted = scores.sparkSession.createDataFrame([(v,) for v in levels], "level string")
        runs = scores.select(*keys).distinct()
        own = runs.crossJoin(F.broadcast(wanted)).join(own, [*keys, "level"], "left")  # runs x a few levels
    total = scores.where("scope = 'overall'").withColumn("level", F.lit("total"))
    columns = [*keys, "level", "n", "mean_are", "median_are", "max_are"]
    return own.select(*columns).unionByName(total.select(*columns))


def frontier_pivot(frontier: DataFrame, split: str, methods: list[str], penalties: list[float]) -> DataFrame:
    """One row for each budget, a cell with its interval for each method and penalty."""
    name = F.lit(None).cast("string")
    for m in methods:
        for p in penalties:
            name = F.when((F.col("method") == m) & (F.col("l2_lambda") == p), f"{m}_{p}").otherwise(name)
    cells = frontier.where((F.col("split") == split) & name.isNotNull()).withColumns({"column": name, "cell": T.interval_cell(F.col("mean"), F.col("lo"), F.col("hi"))})
    first = F.lit(len(penalties) > 1)
    out = cells.groupBy("budget_requested").pivot("column", [f"{m}_{p}" for m in methods for p in penalties]).agg(F.first("cell"))
    shown = cells.groupBy("budget_requested").agg(F.when(first, F.first("budget_requested").cast("double")).otherwise(F.avg("budget_achieved")).alias("shown_budget"))
    return shown.join(out, "budget_requested").orderBy("budget_requested")


def paired_rows(paired: DataFrame) -> DataFrame:
    return paired.withColumn("cell", T.interval_cell(F.col("mean_diff"), F.col("diff_lo"), F.col("diff_hi"))).orderBy("l2_lambda", "budget_requested")


def paired_median_and_mean(rows: DataFrame, challenger: str, baseline: str, **settings) -> DataFrame:
    """Paired differences of the median errors, and beside them those of the mean errors."""
    keys = ["l2_lambda", "budget_requested"]
    one = lambda metric: A.paired_difference(rows, challenger, baseline, metric, **settings).select(*keys, *[F.col(c).alias(f"{metric}_{c}") for c in ("mean_diff", "diff_lo", "diff_hi", "p_value")])
    return one("median_are").join(one("mean_are"), keys, "left")


def anchor_comparison(rows: DataFrame, budget: int, holdout_type: str = "fixed_family") -> DataFrame:
    """Methods at one budget without an l2 term: median and mean error, effective size, greatest weight."""
    def at(df: DataFrame, name: str) -> DataFrame:
        return df.where((F.col("budget_requested") == budget) & (F.col("l2_lambda") == 0)).select("method", *(["split"] if "split" in df.columns else []), F.col("mean").alias(name))

    both = at(A.frontier(rows, holdout_type, "median_are"), "median_are").join(at(A.frontier(rows, holdout_type, "mean_are"), "mean_are"), ["method", "split"])
    return both.join(at(A.run_metric(rows, "ess", holdout_type), "ess"), "method", "left").join(at(A.run_metric(rows, "max_weight", holdout_type), "max_weight"), "method", "left")


def geography_at_anchor(rows: DataFrame, method: str, budget: int, split: str, holdout_type: str = "fixed_family") -> DataFrame:
    """Cross-seed means of one method's metrics for each level of geography."""
    own = A.sliced(rows, holdout_type, split, "geography").where((F.col("method") == method) & (F.col("budget_requested") == budget))
    return own.groupBy("l2_lambda", F.col("scope_value").alias("geography_level")).pivot("metric", ["mean_are", "median_are", "max_are", "n"]).agg(F.avg("value"))


def presets(rows: DataFrame, method: str = "informed_l0") -> DataFrame:
    """Converged penalty and achieved count for each budget."""
    own = rows.where((F.col("scope") == "run") & (F.col("method") == method))
    return own.groupBy("budget_requested").agg(A.at(own, metric="l0_lambda").alias("l0_lambda"), A.at(own, metric="budget_achieved").alias("budget_achieved")).orderBy("budget_requested")


def raw_metric_table(rows: DataFrame, metric: str, methods: list[str], split: str | None = None, scope: str = "overall") -> DataFrame:
    """A metric by budget and penalty, a column for each method."""
    return A.sliced(rows, None, split, scope, metric).groupBy("budget_requested", "l2_lambda").pivot("method", methods).agg(F.avg("value")).orderBy("budget_requested", "l2_lambda")


def degenerate_sensitivity(rows: DataFrame, holdout_type: str = "fixed_family") -> DataFrame:
    """Mean error, the same without degenerate targets, median error, and how many are degenerate."""
    keys = ["split", "method", "l2_lambda", "budget_requested"]
    own = A.sliced(rows, holdout_type).where(F.col("metric").isin("mean_are", "mean_are_ex_degenerate", "median_are", "n_degenerate"))
    return own.groupBy(*keys).pivot("metric", ["mean_are", "mean_are_ex_degenerate", "median_are", "n_degenerate"]).agg(F.avg("value"))


def rotation_table(rows: DataFrame, methods: list[str]) -> DataFrame:
    """For each fold the families held out, and each method's mean of their errors."""
    own = rows.where((F.col("holdout_type") == "rotation") & (F.col("scope") == "family") & (F.col("metric") == "mean_are") & (F.col("split") == "out_of_sample"))
    held = own.groupBy("fold").agg(F.sort_array(F.collect_set("scope_value")).alias("families"))
    return held.join(own.groupBy("fold").pivot("method", methods).agg(F.avg("value")), "fold").orderBy("fold")


def loss_comparison(diagnostics: DataFrame, pairs: list[tuple[str, str]], keys: list[str], cap: float = 1.0) -> DataFrame:
    """Difference in points and relative change of the objective for chosen pairs of methods."""
    o = summarize(diagnostics, [*keys, "method"], cap).select(*keys, "method", "objective")
    listed = diagnostics.sparkSession.createDataFrame(pairs, "challenger string, baseline string")
    side = lambda name: o.withColumnRenamed("method", name).withColumnRenamed("objective", f"{name}_objective")
    both = side("challenger").join(F.broadcast(listed), "challenger").join(side("baseline"), [*keys, "baseline"])
    return both.withColumns({"difference": F.col("challenger_objective") - F.col("baseline_objective"), "relative_change": (F.col("challenger_objective") - F.col("baseline_objective")) / F.col("baseline_objective")})


def series(rows: DataFrame, diagnostics: DataFrame, holdout_type: str = "fixed_family") -> dict[str, DataFrame]:
    """The data of the report's figures: (method, l2, budget) with mean and interval."""
    cost = A.run_metric(rows, "runtime_s", holdout_type).select("method", "l2_lambda", "budget_requested", F.col("mean").alias("runtime_s"))
    error = A.frontier(rows, holdout_type, "median_are").where("split = 'out_of_sample'").select("method", "l2_lambda", "budget_requested", F.col("mean").alias("median_are"))
    return {
        "objective": across_seeds(summarize(diagnostics, ["method", "l2_lambda", "budget_requested", "seed"]), ["method", "l2_lambda", "budget_requested"]),
        "mean": A.frontier(rows, holdout_type, "mean_are"), "median": A.frontier(rows, holdout_type, "median_are"),
        "ess": A.run_metric(rows, "ess", holdout_type), "max_weight": A.run_metric(rows, "max_weight", holdout_type),
        "by_family": A.sliced(rows, holdout_type, None, "family", "mean_are").groupBy("split", "method", "l2_lambda", "budget_requested", F.col("scope_value").alias("family")).agg(F.avg("value").alias("value")),
        "operability": operability_by_budget(rows, holdout_type),
        "gap": A.generalization_gap(rows, holdout_type=holdout_type), "cost": cost.join(error, ["method", "l2_lambda", "budget_requested"]),
    }


def operability_by_budget(rows: DataFrame, holdout_type: str = "fixed_family") -> DataFrame:
    """For each method, penalty and budget: effective sample size, greatest weight, and errors inside and outside of the fit, in one pass."""
    own = rows.where(F.col("holdout_type") == holdout_type)
    at = lambda metric, scope, **more: A.at(own, metric=metric, scope=scope, **more)
    return own.groupBy("method", "l2_lambda", "budget_requested").agg(
        at("ess", "run").alias("ess"), at("max_weight", "run").alias("max_weight"), at("mean_are", "overall", split="in_sample").alias("mean_are_in"),
        at("mean_are", "overall", split="out_of_sample").alias("mean_are_out"), at("median_are", "overall", split="out_of_sample").alias("median_are_out"))


def manifest_methods(manifest: DataFrame) -> DataFrame:
    """One row for each method of a manifest with a map ``methods``."""
    return manifest.select("run_id", F.explode("methods").alias("method", "result")).select("run_id", "method", T.method_order(F.col("method")).alias("position"), "result.*").orderBy("position", "method")


def method_rows(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run of nested summaries: overall errors inside and outside of the fit."""
    side = lambda s: [F.col(f"{s}.overall.{c}").alias(f"{s}_{c}") for c in SCORE_FIELDS]
    return summaries.select(*keys, *side("in_sample"), *side("out_of_sample")).withColumn("position", T.method_order(F.col("method"))).orderBy("position", *keys)


def family_rows(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run, split and family of nested summaries."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}.by_family").alias("families")) for s in ("in_sample", "out_of_sample")])).alias("side")
    return summaries.select(*keys, sides).select(*keys, "side.split", F.explode("side.families").alias("family", "stats")).select(*keys, "split", "family", "stats.*")


def sweep_tables(rows: DataFrame, validation_only: list[str], challenger: str, split: str, penalties: list[float], methods: list[str], baseline: str = "random_reweight", has_rotation: bool = False) -> dict[str, DataFrame]:
    """The table set of a sweep: frontiers of both splits with a cell for each method and penalty, the paired comparison, and the rotation where there is one."""
    front = A.frontier(rows)
    out = {f"frontier_{s}": frontier_pivot(front, s, methods, penalties) for s in ("out_of_sample", "in_sample")}
    out["paired_comparison"] = paired_rows(A.paired_difference(rows, challenger, baseline, split=split))
    if has_rotation:
        rotated = A.rotation_frontier(rows, validation_only).withColumns({"split": F.lit("out_of_sample"), "budget_achieved": F.col("budget_requested").cast("double")})
        out["frontier_rotation"] = frontier_pivot(rotated, "out_of_sample", methods, penalties)
    return out


def result_tables(rows: DataFrame, budget: int, method: str, split: str, baseline: str = "random_reweight") -> dict[str, DataFrame]:
    """The curated tables of a report at one budget."""
    return {
        "sampling_comparison": anchor_comparison(rows, budget), "calibration_accuracy": geography_at_anchor(rows, method, budget, split),
        "presets": presets(rows), "paired_comparison": paired_median_and_mean(rows, method, baseline, split=split),
    }


def summary_bundle(rows: DataFrame, diagnostics: DataFrame, validation_only: list[str], cap: float = 1.0, baseline: str = "random_reweight", top: int = 15) -> tuple[dict, dict[str, DataFrame]]:
    """All frames of a sweep's summary over written metric and diagnostic rows, and the choices that they rest on.

    One row is collected for the choices (headline split and method, anchor budget,
    penalties, methods); a frame that its input has nothing for is left out.
    """
    chosen = A.headline_split(rows).crossJoin(A.headline_method(rows)).crossJoin(A.anchor_budget(rows)).first()  # one row each
    s = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    has = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    there = rows.agg(s("method"), s("l2_lambda"), s("budget_requested"), s("seed"), has(F.col("holdout_type") == "rotation").alias("rotation"), has(F.col("metric") == "mean_are_ex_degenerate").alias("degenerate")).first()
    split, method, budget = chosen["split"], chosen["method"], chosen["budget_requested"]
    choices = {"split": split, "method": method, "anchor_budget": budget, "methods": there["method"], "l2_lambdas": there["l2_lambda"], "budgets": there["budget_requested"], "n_seeds": len(there["seed"])}
    own = diagnostics.where(F.col("split") == split)
    keys = ["method", "split", "l2_lambda", "budget_requested"]
    frames = {
        "objective_by_budget": across_seeds(summarize(own, [*keys, "seed"], cap), keys), "median_by_budget": A.frontier(rows, metric="median_are"), "mean_by_budget": A.frontier(rows),
        "paired": A.paired_difference(rows, method, baseline, split=split), "macro": A.macro_average(rows, split=split),
        "attribution": A.top_contributors(own, top, split=split, l2=min(there["l2_lambda"], default=0.0)),
    }
    if there["degenerate"]:
        frames["sensitivity"] = degenerate_sensitivity(rows)
    if there["rotation"]:
        frames["rotation"] = A.rotation_frontier(rows, validation_only)
        frames["rotation_by_fold"] = rotation_table(rows, there["method"])
    if budget is not None:
        frames |= {f"result_{k}": v for k, v in result_tables(rows, budget, method, split, baseline).items()}
    frames |= {f"sweep_{k}": v for k, v in sweep_tables(rows, validation_only, method, split, there["l2_lambda"], there["method"], baseline, there["rotation"]).items()}
    frames |= {f"series_{k}": v for k, v in series(rows, diagnostics).items()}
    return choices, frames
