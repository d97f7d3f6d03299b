"""State of resumable sweeps: grids, completed cells, certified checkpoints, merges, config compares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["holdout_type", "fold", "seed", "budget_requested", "l2_lambda"]


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of a few short lists."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)


def completed_methods(rows: DataFrame) -> DataFrame:
    """Cells and methods that have a run-level budget row."""
    return rows.where((F.col("scope") == "run") & (F.col("metric") == "budget_achieved")).select(*CELL, "method").distinct()


def completed_cells(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Cells in which every requested method is complete."""
    wanted = rows.sparkSession.createDataFrame([(m,) for m in set(methods)], "method string")
    done = completed_methods(rows).join(F.broadcast(wanted), "method", "left_semi")
    return done.groupBy(*CELL).agg(F.count_distinct("method").alias("n")).where(F.col("n") == len(set(methods))).select(*CELL)


def achieved_budgets(rows: DataFrame) -> DataFrame:
    """The achieved budget of each completed cell and method."""
    own = rows.where((F.col("scope") == "run") & (F.col("metric") == "budget_achieved"))
    return own.groupBy(*CELL, "method").agg(F.max("value").cast("long").alias("budget_achieved"))


def matched_budgets(cells: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """Each cell's budget for the baselines: L0's count of this run, else of an earlier one, else the requested one."""
    of = lambda df, name: df.where(F.col("method") == "informed_l0").select(*CELL, F.col("budget_achieved").alias(name))
    out = cells.join(of(now, "now"), CELL, "left").join(of(before, "before"), CELL, "left")
    return out.withColumn("matched_budget", F.coalesce("now", "before", F.col("budget_requested").cast("long"))).drop("now", "before")


def pending(requested: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(completed.select(*keys).distinct(), keys, "left_anti")


def append_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming`` that ``existing`` doesn't hold, after all of ``existing``; nulls are equal, its own repeats stay."""
    fresh = incoming.dropDuplicates().alias("i")
    same = reduce(lambda a, b: a & b, [F.col(f"i.{c}").eqNullSafe(F.col(f"e.{c}")) for c in existing.columns])
    return existing.unionByName(fresh.join(existing.alias("e"), same, "left_anti"))


def certify(rows: DataFrame, declared: DataFrame, key: str = "shard") -> DataFrame:
    """The rows, if each shard has as many as its manifest declares; a shard without a manifest is an error."""
    counts = rows.groupBy(key).agg(F.count("*").alias("actual"))
    both = counts.join(declared.select(key, "declared"), key, "full_outer")
    bad = both.where(~F.coalesce("actual", F.lit(0)).eqNullSafe(F.col("declared"))).orderBy(key).limit(5).collect()
    if bad:
        raise ValueError(f"row counts differ from the manifest: {[tuple(r) for r in bad]}")
    return rows


def first_difference(configs: DataFrame, a: str, b: str, may_differ: list[str]) -> DataFrame:
    """The first key (by name) whose value differs between two runs, but for those that may; no row if there is none."""
    side = lambda run, name: configs.where(F.col("run_id") == run).select("key", F.col("value").alias(name))
    joined = side(a, "left_value").join(side(b, "right_value"), "key", "full_outer")
    listed = [F.lit(k) for k in may_differ]
    free = F.exists(F.array(*listed), lambda k: (F.col("key") == k) | F.col("key").startswith(F.concat(k, F.lit(".")))) if listed else F.lit(False)
    return joined.where(~F.col("left_value").eqNullSafe(F.col("right_value")) & ~free).orderBy("key").limit(1)


def merge_runs(runs: dict[str, DataFrame], configs: DataFrame, may_differ: list[str], audits: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of compatible runs with a ``shard`` column; incompatible columns, configs or audits are an error."""
    names = sorted(runs)
    if len(names) < 2:
        raise ValueError("at least two runs")
    columns = runs[names[0]].columns
    for n in names[1:]:
        if runs[n].columns != columns:
            raise ValueError(f"{n} has other columns than {names[0]}")
        found = first_difference(configs, names[0], n, may_differ).collect()
        if found:
            raise ValueError(f"{names[0]} and {n} differ in {found[0]['key']}")
        if audits and (audits[n].exceptAll(audits[names[0]]).limit(1).count() or audits[names[0]].exceptAll(audits[n]).limit(1).count()):
            raise ValueError(f"{names[0]} and {n} have different audits")
    return reduce(lambda x, y: x.unionByName(y), [runs[n].withColumn("shard", F.lit(n)) for n in names])


def merge_single(runs: dict[str, DataFrame], configs: DataFrame, axis: str, may_differ: list[str]) -> DataFrame:
    """Merge of runs of one value each on an axis (l2_lambda, seed): one value in each, all different."""
    merged = merge_runs(runs, configs, [*may_differ, axis])
    held = merged.groupBy("shard").agg(F.collect_set(axis).alias("held")).collect()  # a row for each run
    values = [tuple(r["held"]) for r in held]
    if any(len(v) != 1 for v in values) or len(set(values)) != len(values):
        raise ValueError(f"each run must have one {axis} of its own")
    return merged


def recovered_grid(rows: DataFrame) -> DataFrame:
    """One row: seeds, methods, penalties and budgets present."""
    s = lambda c: F.sort_array(F.collect_set(c)).alias(c)
    return rows.agg(s("seed"), s("method"), s("l2_lambda"), s("budget_requested"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that tells tables apart by their rows in any order: xor of row hashes, count, sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.bit_xor(h).alias("xor"), F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file below a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
