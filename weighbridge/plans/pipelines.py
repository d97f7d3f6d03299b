"""Whole jobs: registry compile, pre-calibration, and the comparisons of methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate as K
from ..operators import matrix, objective, score
from ..operators import targets as T
from ..operators import universe as U
from ..operators.folds import split_targets
from ..sources import tables


def compile_registry(facts: DataFrame, period: int, identity: list[str], crosswalk: DataFrame | None = None, geography: str = "geography_id", required: DataFrame | None = None, partial: bool = False) -> DataFrame:
    """Facts to targets: latest vintage, new geography, classes; required references that are missing are an error unless ``partial``."""
    if partial and required is None:
        raise ValueError("partial has no meaning without required references")
    chosen = T.latest_vintage(facts, identity, period)
    if crosswalk is not None:
        moved = T.crosswalked(chosen, crosswalk, geography, "value", [c for c in identity if c != geography])
        chosen = moved.withColumn("metadata", F.expr("cast(map() as map<string,string>)")) if "metadata" not in moved.columns else moved
    out = T.classified(T.with_registry_family(chosen)) if "family" in chosen.columns else T.classified(chosen)
    if required is not None and not partial:
        gone = [r[0] for r in required.join(out.select("target_name"), "target_name", "left_anti").limit(5).collect()]
        if gone:
            raise ValueError(f"required references are missing, such as {gone}")
    return out


def precalibrate(universe: U.Universe, facts: DataFrame, period: int, identity: list[str], supported: list[str], households: int | None = None, seed: int = 0, drop: list[str] | None = None, reset: str = "uniform", to_targets: Callable[[DataFrame], DataFrame] = lambda t: t, path: str | None = None) -> tuple[U.Universe, DataFrame, DataFrame, DataFrame]:
    """(universe, targets, matrix, audit): facts to a registry, filters, subsample, dropped columns, matrix, weight reset, freeze."""
    registry = compile_registry(facts, period, identity)
    kept, unsupported = T.unsupported_filters(registry, supported)
    if households is not None:
        universe = universe.restricted(U.random_subset(universe.weights, households, seed, "households"))
    slim, dropped = U.drop_columns(universe.tables, drop or [])
    universe = U.replace(universe, tables=slim, weights=U.reset_weights(universe.weights, reset))
    found = to_targets(kept)
    built = matrix.constraint_matrix(universe, found)
    counts = [("targets", found.count()), ("unsupported_targets", unsupported.count()), ("records", universe.weights.count()), ("dropped_columns", sum(map(len, dropped.values())))]
    audit = facts.sparkSession.createDataFrame(counts, "key string, value long")
    if path is not None:
        tables.freeze(universe.tables, found, dict(counts), path)
    return universe, found, built, audit


@dataclass
class Task:
    """What the methods of one comparison share, and what the first of them leave for the others."""

    built: DataFrame
    weights: DataFrame
    targets: DataFrame
    loss_weights: DataFrame | None
    budget: int
    seed: int
    options: K.Options
    width: int
    problem: K.Problem
    matched: int
    selection: DataFrame | None = None


def _l0(task: Task) -> tuple[DataFrame, int, float]:
    found = K.informed_l0_at_budget(task.problem, task.options, task.budget, task.seed, width=task.width, tolerance=max(1, task.budget // 100), open_at_start=0.8)
    task.selection, task.matched = K.weights_of(found.fit, found.configuration), found.retained or task.budget
    return task.selection, found.retained, found.fit.loss[found.configuration]


def _l0_refit(task: Task) -> tuple[DataFrame, int, float]:
    full, refit = K.post_selection_refit(task.built, task.weights, task.targets, task.selection, task.options, task.loss_weights, task.seed)
    return full.where("weight > 0"), refit.retained[0], refit.loss[0]


def _l1(task: Task) -> tuple[DataFrame, int, float]:
    found = K.informed_l1_at_budget(task.problem, task.options, task.matched, task.seed, width=task.width, tolerance=max(1, task.budget // 100))
    return K.weights_of(found.fit, found.configuration), found.retained, found.fit.loss[found.configuration]


def _random(task: Task) -> tuple[DataFrame, int, float]:
    full, got = K.random_reweight(task.built, task.weights, task.targets, task.matched, task.seed, task.options, task.loss_weights)
    return full.where("weight > 0"), got.retained[0], got.loss[0]


def _dense_sample(task: Task) -> tuple[DataFrame, int, float]:
    got, sampled = K.dense_then_sample(task.problem, [task.matched], task.seed, task.options)
    return sampled.select("record_id", "weight"), task.matched, got.loss[0]


#: Method -> its function and the method that must run before it; in the order in which they run.
BY_NAME: dict[str, tuple[Callable[[Task], tuple[DataFrame, int, float]], str | None]] = {
    "informed_l0": (_l0, None), "informed_l0_refit": (_l0_refit, "informed_l0"), "informed_l1": (_l1, None), "random_reweight": (_random, None), "dense_sample": (_dense_sample, None),
}


def run_methods(built: DataFrame, weights: DataFrame, targets: DataFrame, budget: int, seed: int, options: K.Options, methods: list[str], loss_weights: DataFrame | None = None, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """Weights (method, seed, budget_requested, record_id, weight) and run values of the chosen methods.

    The baselines are matched to the number of records that L0 retains, which is searched to a hundredth of the budget.
    """
    unknown = sorted(set(methods) - set(BY_NAME))
    if unknown:
        raise ValueError(f"unknown methods {unknown}; known are {sorted(BY_NAME)}")
    wanted = set(methods) | {BY_NAME[m][1] for m in methods if BY_NAME[m][1]}
    problem = K.Problem.build(built, weights, targets, loss_weights, options.partitions)
    task = Task(built, weights, targets, loss_weights, budget, seed, options, width, problem, budget)
    parts, rows = [], []
    for method in (m for m in BY_NAME if m in wanted):
        w, n, loss = BY_NAME[method][0](task)
        if method in methods:
            parts.append(w.select(F.lit(method).alias("method"), F.lit(seed).alias("seed"), F.lit(budget).cast("long").alias("budget_requested"), "record_id", "weight"))
            rows.append((method, seed, budget, n, loss))
    problem.blocks.unpersist()
    runs = built.sparkSession.createDataFrame(rows, "method string, seed int, budget_requested long, n_selected long, final_loss double")
    return reduce(lambda a, b: a.unionByName(b), parts), runs


#: Methods that a comparison can be asked for.
METHODS = tuple(BY_NAME)


def score_methods(built: DataFrame, fit_targets: DataFrame, holdout: DataFrame, weights: DataFrame, runs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Diagnostics and scores of all runs on both sides of the split."""
    both = fit_targets.withColumn("split", F.lit("in_sample")).unionByName(holdout.withColumn("split", F.lit("out_of_sample")), allowMissingColumns=True)
    scored = matrix.achieved(both, runs, matrix.estimates(built, weights, keys), keys)
    d = score.target_diagnostics(scored).withColumn("target_value", F.col("value"))
    return d, score.score(d, [*keys, "split"])


def compare_at_budget(built: DataFrame, weights: DataFrame, targets: DataFrame, budget: int, seed: int, options: K.Options, methods: list[str], holdout_frac: float = 0.2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-budget comparison: fit on a part of the targets, score on both; (weights, run values, scores)."""
    split = split_targets(targets, holdout_frac, seed)
    fitted, held = split.where("split = 'fit'").drop("split"), split.where("split = 'holdout'").drop("split")
    w, runs = run_methods(built, weights, fitted, budget, seed, options, methods)
    _, scores = score_methods(built, fitted, held, w, runs, ["method"])
    return w, runs, scores


def compare_at_penalty(built: DataFrame, weights: DataFrame, targets: DataFrame, share: float, seed: int, options: K.Options, loss_weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fixed-penalty comparison on the full surface: L0, its refit, and random and the dense sample matched to its count; (weights, run values)."""
    problem = K.Problem.build(built, weights, targets, loss_weights, options.partitions)
    got = K.informed_l0(problem, options, [K.resolve_penalty(problem.n, share=share)], seed, open_at_start=0.8)
    selection = got.weights.select("record_id", "weight")
    full, refit = K.post_selection_refit(built, weights, targets, selection, options, loss_weights, seed)
    other, random = K.random_reweight(built, weights, targets, got.retained[0], seed, options, loss_weights)
    dense, drawn = K.dense_then_sample(problem, [got.retained[0]], seed, options)
    parts = [("informed_l0", selection), ("informed_l0_refit", full.where("weight > 0")), ("random_reweight", other.where("weight > 0")), ("dense_sample", drawn.select("record_id", "weight"))]
    out = None
    for m, w in parts:
        one = w.select(F.lit(m).alias("method"), "record_id", "weight")
        out = one if out is None else out.unionByName(one)
    spark = built.sparkSession
    runs = spark.createDataFrame([("informed_l0", got.retained[0], got.loss[0]), ("informed_l0_refit", refit.retained[0], refit.loss[0]), ("random_reweight", random.retained[0], random.loss[0]), ("dense_sample", got.retained[0], dense.loss[0])], "method string, n_selected long, final_loss double")
    problem.blocks.unpersist()
    return out, runs


def demo(spark: SparkSession, n: int = 300, budget: int = 80, seed: int = 0, options: K.Options | None = None, methods: tuple[str, ...] = METHODS) -> tuple[DataFrame, DataFrame]:
    """The synthetic universe from end to end: (scores, objective by method)."""
    options = options or K.Options(epochs=60, rate=0.15, cap=1.0, partitions=2)
    toy = tables.toy_universe(spark, n, seed)
    targets = tables.toy_targets(toy, copies=4).withColumns({"target_pos": F.xxhash64("target_name"), "family": F.col("measure"), "geography_level": F.lit("national"), "filter": F.expr("cast(map() as map<string,string>)")})
    targets = spark.createDataFrame(targets.collect(), targets.schema)  # a dozen rows
    built = matrix.constraint_matrix(U.Universe("household", {"household": toy}, toy.select("record_id", "w0")), targets)
    weights = toy.select("record_id", "w0")
    split = split_targets(targets, 0.25, seed)
    fitted, held = split.where("split = 'fit'").drop("split"), split.where("split = 'holdout'").drop("split")
    w, runs = run_methods(built, weights, fitted, budget, seed, options, list(methods))
    d, scores = score_methods(built, fitted, held, w, runs, ["method"])
    return scores, objective.summarize(d, ["method", "split"])


def staged(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[tuple[str, list[str]]]]:
    """Applies named transforms in order; the record has each stage's columns."""
    record = []
    for name, stage in stages:
        df = df.transform(stage)
        record.append((name, df.columns))
    return df, record
