"""Scoring of runs into a resumable sweep, its manifest, and the merge of sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import schemas
from ..sources.state import Artifacts, Shards, read_record, utc_now, write_record
from ..sources.tables import dropped, exists, kept
from . import matrix, score
from .report import SCORE_FIELDS
from .runs import completed_cells

RUN = list(schemas.RUN_KEYS)
TABLES = {"metrics": schemas.METRICS_LONG, "diagnostics": schemas.TARGET_DIAGNOSTICS}
#: Parts of a manifest in which shards of one sweep may differ.
SHARD_PARTS = ("run_id", "status", "created_at", "updated_at", "n_rows", "completed_cells", "merged_from", "grid.seeds", "grid.methods", "grid.l2_lambdas", "grid.budgets", "tables")


def shards(spark: SparkSession, root: str) -> Shards:
    return Shards(spark, root, TABLES)


def run_metrics(weights: DataFrame, runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One row for each run with the metrics that depend on its weights alone, and what the run reports of itself.

    n_unique_selected counts records with a weight above 0.  n_selected is what the run
    reports (draws, for a sample with replacement), else that count; budget_achieved
    is n_selected.
    """
    own = score.weight_diagnostics(weights, keys, runs).withColumnsRenamed({"n_selected": "n_unique_selected", "weight_sum": "sum_weight"}).drop("min_weight")
    told = [c for c in ("n_selected", "runtime_s", "l0_lambda", "final_loss") if c in runs.columns]
    out = runs.select(*keys, *told).join(own, keys)
    if "n_selected" not in told:
        out = out.withColumn("n_selected", F.col("n_unique_selected"))
    return out.withColumn("budget_achieved", F.col("n_selected").cast("double"))


def scored_tables(built: DataFrame, fit_targets: DataFrame, holdout: DataFrame, weights: DataFrame, runs: DataFrame, holdout_type: str, fold: int, degenerate: DataFrame | None = None, loss_weights: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Metric and diagnostic rows of all runs, from one pass over the matrix joined with the weights.

    Returns the tables, and the written frame that they read, to be dropped after them.
    Diagnostics are kept for the headline split (``fixed_family``) alone.
    """
    both = fit_targets.withColumn("split", F.lit("in_sample")).unionByName(holdout.withColumn("split", F.lit("out_of_sample")), allowMissingColumns=True)
    found = matrix.achieved(both, runs, matrix.estimates(built, weights, RUN), RUN)
    if loss_weights is not None:
        found = found.drop("loss_weight").join(loss_weights.select("target_name", "loss_weight"), "target_name", "left")
    named = degenerate if degenerate is not None else both.select("target_name").limit(0)
    d = score.target_diagnostics(found, degenerate=named).withColumn("target_value", F.col("value"))
    if "loss_weight" not in d.columns:
        d = d.withColumn("loss_weight", F.lit(None).cast("double"))
    d = kept(d.select(*schemas.names(schemas.TARGET_DIAGNOSTICS)), "scored")
    tails = score.tail_counts(d.where("split = 'out_of_sample'"), RUN).withColumnsRenamed({"n_scored": "holdout_n_scored", "n_are_gt_1": "holdout_n_are_gt_1", "n_are_gt_5": "holdout_n_are_gt_5"})
    values = run_metrics(weights, runs).join(tails, RUN, "left")
    tables = {"metrics": score.long_rows(score.score(d, [*RUN, "split"]), values, RUN, holdout_type, fold)}
    if holdout_type == "fixed_family":
        tables["diagnostics"] = d
    return tables, d


def score_and_append(state: Shards, shard: str, *args, **more) -> bool:
    """Scores runs (arguments as for :func:`scored_tables`) and commits their rows as a shard; False, and nothing done, if it is committed."""
    if not state.pending([shard]):
        return False
    tables, held = scored_tables(*args, **more)
    state.commit(shard, tables)
    dropped(held)
    return True


def method_summaries(scores: DataFrame, runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One nested row for each run: what it reports, and for each split overall, by_family and by_geography errors."""
    stats = F.struct(*[F.col(c) for c in SCORE_FIELDS])
    own = scores.withColumn("stats", stats)

    def side(split: str):
        mine = F.col("split") == split
        by = lambda scope: F.map_from_entries(F.array_sort(F.collect_list(F.when(mine & (F.col("scope") == scope), F.struct("scope_value", "stats")))))  # noqa: E731  families or levels of one run
        return F.struct(F.max(F.when(mine & (F.col("scope") == "overall"), F.col("stats"))).alias("overall"), by("family").alias("by_family"), by("geography").alias("by_geography")).alias(split)

    nested = own.groupBy(*keys).agg(side("in_sample"), side("out_of_sample"))
    return runs.join(nested, keys, "left")


def sweep_manifest(spark: SparkSession, root: str, run_id: str, status: str, config: dict, methods: list[str], created_at: str | None = None) -> dict:
    """The record of a sweep's state: its grid, how many rows each table has, which cells are complete; written beside the tables."""
    state = shards(spark, root)
    totals = state.index().select(F.explode("tables").alias("name", "told")).groupBy("name").agg(F.sum("told.n_rows").alias("n")).collect()  # a row for each table
    metrics = state.read("metrics")
    s = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    axes = metrics.agg(s("seed"), s("budget_requested"), s("l2_lambda"), s("method")).first()  # one row of a few values
    before = read_record(spark, f"{root}/manifest")
    record = {
        "schema_version": 1, "run_id": run_id, "status": status, "created_at": created_at or before.get("created_at") or utc_now(), "updated_at": utc_now(), "config": config,
        "grid": {"seeds": axes["seed"], "budgets": axes["budget_requested"], "l2_lambdas": axes["l2_lambda"], "methods": axes["method"]},
        "n_rows": {r["name"]: r["n"] for r in totals}, "n_weight_artifact_rows": Artifacts(spark, root).index().count(),
        "completed_cells": completed_cells(metrics, methods).count() if methods else 0, "tables": sorted(TABLES),
    }
    write_record(spark, record, f"{root}/manifest")
    return record


def _flat(record: object, at: str = "") -> dict[str, str]:
    if isinstance(record, dict):
        return {k: v for name, part in record.items() for k, v in _flat(part, f"{at}.{name}" if at else str(name)).items()}
    return {at: repr(record)}


def different_part(a: dict, b: dict, may_differ: tuple[str, ...] = SHARD_PARTS) -> str | None:
    """The first part, by name, in which two manifests differ, but for those that may."""
    x, y = _flat(a), _flat(b)
    free = lambda k: any(k == m or k.startswith(m + ".") for m in may_differ)
    return next((k for k in sorted(set(x) | set(y)) if not free(k) and x.get(k) != y.get(k)), None)


def merge_sweeps(spark: SparkSession, inputs: dict[str, str], out: str, run_id: str, methods: list[str]) -> dict:
    """Merges finished sweeps (name -> folder) into a new one; returns its manifest.

    An error if their manifests differ outside of what shards may differ in, if some have
    diagnostics, audits or weights and others don't, or if their audits differ.
    Weight artifacts are copied and get new paths; the grid is found anew from the rows.
    """
    if len(inputs) < 2:
        raise ValueError("at least two sweeps")
    names = sorted(inputs)
    manifests = {n: read_record(spark, f"{inputs[n]}/manifest") for n in names}
    for n in names[1:]:
        if (part := different_part(manifests[names[0]], manifests[n])) is not None:
            raise ValueError(f"{names[0]} and {n} differ in {part}")
    all_or_none = lambda have, what: _all_or_none({n: have(inputs[n]) for n in names}, what)
    states = {n: shards(spark, inputs[n]) for n in names}
    with_diagnostics = all_or_none(lambda root: exists(spark, f"{root}/diagnostics"), "diagnostics")
    if all_or_none(lambda root: exists(spark, f"{root}/degenerate"), "audits"):
        audits = {n: spark.read.parquet(f"{inputs[n]}/degenerate") for n in names}
        for n in names[1:]:
            a, b = audits[names[0]], audits[n]
            if a.columns != b.columns or a.exceptAll(b).limit(1).count() or b.exceptAll(a).limit(1).count():
                raise ValueError(f"{names[0]} and {n} have different audits")
        audits[names[0]].write.mode("overwrite").parquet(f"{out}/degenerate")
    target = shards(spark, out)
    for n in names:
        frames = {"metrics": states[n].certified("metrics").drop("shard")}
        if with_diagnostics:
            frames["diagnostics"] = states[n].certified("diagnostics").drop("shard")
        target.commit(n, frames)
    if all_or_none(lambda root: exists(spark, f"{root}/weights_index"), "weight artifacts"):
        sources = [Artifacts(spark, inputs[n]) for n in names]
        union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
        Artifacts(spark, out).save(union([s.index() for s in sources]), union([s.vectors() for s in sources]), union([s.trajectories() for s in sources]))
    record = sweep_manifest(spark, out, run_id, "merged", manifests[names[0]].get("config", {}), methods)
    record |= {"merged_from": [inputs[n] for n in names], "completed_cells": sum(m.get("completed_cells", 0) for m in manifests.values())}
    write_record(spark, record, f"{out}/manifest")
    return record


def _all_or_none(have: dict[str, bool], what: str) -> bool:
    if len(set(have.values())) > 1:
        raise FileNotFoundError(f"some sweeps have {what} and others don't: {have}")
    return next(iter(have.values()))
