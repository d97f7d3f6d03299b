"""Readers and writers of the tables that jobs exchange."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rand import standard_normal, uniform
from . import schemas


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode, where they are one process."""
    folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not folder:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame, written to a folder of the application's own in the shared one and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`kept` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank ones are skipped, broken ones are an error that names them."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    out = lines.select(F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("fact")).select("fact.*")
    bad = [r[0] for r in out.where("_corrupt_record is not null").select("_corrupt_record").limit(3).collect()]
    if bad:
        raise ValueError(f"broken facts: {bad}")
    return out.drop("_corrupt_record")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Long metrics from CSV: values that are no numbers become null, an absent penalty 0, a null scope value the empty string."""
    raw = spark.read.option("header", True).csv(path)
    if "l2_lambda" not in raw.columns:
        raw = raw.withColumn("l2_lambda", F.lit("0.0"))
    kinds = {part.split()[0]: part.split()[1] for part in schemas.METRICS_LONG.split(", ")}
    out = raw.select(*[F.expr(f"try_cast({c} as {kinds[c]})").alias(c) if c in raw.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds])
    return out.withColumns({"l2_lambda": F.coalesce("l2_lambda", F.lit(0.0)), "scope_value": F.coalesce("scope_value", F.lit(""))})


def read_diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Target diagnostics from CSV; empty numbers are null, True and False are booleans."""
    raw = spark.read.option("header", True).csv(path)
    kinds = {part.split()[0]: part.split()[1] for part in schemas.TARGET_DIAGNOSTICS.split(", ")}
    out = raw.select(*[F.expr(f"try_cast({c} as {kinds[c]})").alias(c) if c in raw.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds])
    return out.withColumn("l2_lambda", F.coalesce("l2_lambda", F.lit(0.0)))


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Checkpoint rows; none where there is no such table."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_metrics(rows: DataFrame, path: str, csv: bool = False, mode: str = "overwrite") -> None:
    out = rows.select(*schemas.names(schemas.METRICS_LONG)).write.mode(mode)
    out.option("header", True).csv(path) if csv else out.partitionBy("holdout_type", "method").parquet(path)


def write_diagnostics(rows: DataFrame, path: str, csv: bool = False, mode: str = "overwrite") -> None:
    out = rows.select(*schemas.names(schemas.TARGET_DIAGNOSTICS)).write.mode(mode)
    out.option("header", True).csv(path) if csv else out.partitionBy("method").parquet(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """Weight vectors of some runs; a run's partition is replaced, others stay."""
    out = weights.select(*schemas.names(schemas.WEIGHTS))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("holdout_type", "fold", "method", "seed", "budget_requested", "l2_lambda").parquet(path)


def read_weights(spark: SparkSession, path: str, runs: DataFrame, **cell: object) -> DataFrame:
    """Weights of one cell, if the run table has it (its last row wins); nothing stored for it is an error."""
    mine = runs
    for name, value in cell.items():
        mine = mine.where(F.col(name) == F.lit(value))
    if not mine.limit(1).count():
        raise ValueError(f"no such run: {cell}")
    out = spark.read.schema(schemas.WEIGHTS).parquet(path)
    for name, value in cell.items():
        out = out.where(F.col(name) == F.lit(value))
    if not out.limit(1).count():
        raise ValueError(f"the weights of {cell} are missing")
    return out


def last_runs(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each run."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return runs.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def freeze(tables: dict[str, DataFrame], targets: DataFrame, manifest: dict, path: str) -> None:
    """Entity tables, targets and a manifest of a prepared input."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/entity={name}")
    targets.write.mode("overwrite").parquet(f"{path}/targets")
    spark = targets.sparkSession
    write_manifest(spark.createDataFrame([(k, str(v)) for k, v in manifest.items()], "key string, value string"), f"{path}/manifest")


def thaw(spark: SparkSession, path: str, entities: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What :func:`freeze` wrote; columns of the targets that are not known are left out."""
    targets = spark.read.parquet(f"{path}/targets")
    known = [c for c in schemas.names(schemas.TARGETS) if c in targets.columns]
    return {e: spark.read.parquet(f"{path}/entity={e}") for e in entities}, targets.select(*known)


def strict(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, as strict JSON needs."""
    out = {c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(out) if out else df


def write_manifest(df: DataFrame, path: str) -> None:
    strict(df).coalesce(1).write.mode("overwrite").json(path)  # a record or a few


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_json(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(schemas.CROSSWALK).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A report frame of tens of rows as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_audit(audits: dict[str, DataFrame], path: str) -> None:
    """Degenerate targets of both splits (split -> audit) as one CSV file, each row with its split."""
    rows = [df.withColumn("split", F.lit(split)) for split, df in sorted(audits.items())]
    write_summary(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), path)


def toy_universe(spark: SparkSession, n: int = 120, seed: int = 0, weight: float = 1000.0) -> DataFrame:
    """Households with lognormal income and Bernoulli renters."""
    ids = spark.range(n).select(F.col("id").alias("record_id"))
    return ids.select(
        "record_id", F.lit(1.0).alias("household_count"), F.exp(10.4 + 0.55 * standard_normal("income", seed, F.col("record_id"))).alias("income"),
        (uniform("renter", seed, F.col("record_id")) < 0.35).cast("double").alias("is_renter"), F.lit(weight).alias("w0"))


def toy_targets(universe: DataFrame, measures: tuple[str, ...] = ("household_count", "income", "is_renter"), raised: float = 1.08, copies: int = 1) -> DataFrame:
    """True totals times ``raised``, each ``copies`` times under names of their own."""
    sums = universe.agg(*[F.sum(F.col(m) * F.col("w0")).alias(m) for m in measures]).unpivot([], list(measures), "measure", "total")
    many = sums.crossJoin(universe.sparkSession.range(copies).withColumnRenamed("id", "copy"))  # a few rows
    return many.select(F.concat("measure", F.when(F.col("copy") > 0, F.concat(F.lit("_"), F.col("copy").cast("string"))).otherwise("")).alias("target_name"), F.lit("household").alias("entity"), "measure", (F.col("total") * raised).alias("value"))


def write_bundle(frames: dict[str, DataFrame], path: str, choices: dict) -> dict:
    """Each frame as a CSV folder of its own (reports: tens to thousands of rows), and a record of their columns and rows."""
    from .state import utc_now, write_record

    listed = {}
    for name, df in sorted(frames.items()):
        seen = Observation(name)
        flat = df.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, kind in df.dtypes])
        flat.observe(seen, F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        listed[name] = {"columns": df.columns, "n_rows": seen.get["n"]}
    record = {"written_at": utc_now(), "choices": choices, "frames": listed}
    write_record(next(iter(frames.values())).sparkSession, record, f"{path}/bundle")
    return record
