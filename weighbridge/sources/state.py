"""State of a sweep in a folder that all executors share: shards, weight artifacts, manifests.

Everything is committed in two steps.  Data are written first, under an attempt's own
name; then a row of an index names the attempt and tells how many rows each of its
tables has, and a digest of them.  A job that dies between the steps leaves data that
no reader sees, and its successor writes another attempt.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .tables import exists

SHARDS = "shard string, attempt string, committed_at string, tables map<string, struct<n_rows: long, xor: long, total: string>>"
#: Rows of an index that are broadcast; a longer index is joined by a shuffle.
MOST_BROADCAST = 100_000


def utc_now() -> str:
    """The time in UTC, to microseconds, as a manifest has it."""
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def utc_text(at: Column) -> Column:
    """A timestamp as UTC text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def _marks(df: DataFrame) -> list[Column]:
    """Count, and xor and sum of the rows' hashes: the same in any order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return [F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("total")]


def _with_index(rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the attempts that the index names."""
    small = index.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(F.broadcast(index) if small else index, keys)


class Shards:
    """Tables of a sweep, committed shard by shard."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, str]):
        """tables: name -> schema of its rows."""
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables

    def index(self) -> DataFrame:
        """One row for each committed shard; of several attempts the last."""
        path = f"{self.root}/index"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], SHARDS)
        nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("committed_at"), "attempt"))
        return self.spark.read.schema(SHARDS).json(path).withColumn("nth", nth).where("nth = 1").drop("nth")

    def write(self, shard: str, frames: dict[str, DataFrame]) -> dict:
        """The first step: data of a new attempt; returns its index row."""
        attempt, found = uuid.uuid4().hex, {}
        for name, df in frames.items():
            kinds = self.spark.createDataFrame([], self.tables[name]).schema
            own = df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in kinds])  # as it will be read: hashes depend on types
            seen = Observation(f"{name}-{attempt}")
            marked = own.observe(seen, *_marks(own)).withColumns({"shard": F.lit(shard), "attempt": F.lit(attempt)})
            marked.write.mode("append").partitionBy("shard", "attempt").parquet(f"{self.root}/{name}")
            found[name] = seen.get
        return {"shard": shard, "attempt": attempt, "tables": {k: {"n_rows": v["n_rows"], "xor": v["xor"], "total": v["total"]} for k, v in found.items()}}

    def publish(self, row: dict) -> dict:
        """The second step: the index row, one small file."""
        row = row | {"committed_at": utc_now()}
        self.spark.createDataFrame([row], SHARDS).coalesce(1).write.mode("append").json(f"{self.root}/index")
        return row

    def commit(self, shard: str, frames: dict[str, DataFrame]) -> dict | None:
        """Writes and publishes a shard; nothing happens if it is committed."""
        if self.index().where(F.col("shard") == shard).limit(1).count():
            return None
        return self.publish(self.write(shard, frames))

    def pending(self, shards: list[str]) -> list[str]:
        """Those of the given shards that are not committed, in their order."""
        wanted = self.spark.createDataFrame([(s,) for s in shards], "shard string")
        left = {r[0] for r in wanted.join(self.index(), "shard", "left_anti").collect()}  # of the given list
        return [s for s in shards if s in left]

    def read(self, name: str) -> DataFrame:
        """Rows of all committed attempts, with their ``shard``."""
        path = f"{self.root}/{name}"
        schema = f"{self.tables[name]}, shard string, attempt string"
        rows = self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)
        return _with_index(rows, self.index().select("shard", "attempt"), ["shard", "attempt"]).drop("attempt")

    def certified(self, name: str) -> DataFrame:
        """As :meth:`read`; rows that differ in number or content from what was committed are an error that names shards."""
        rows = self.read(name)
        own = rows.drop("shard")
        now = rows.groupBy("shard").agg(*_marks(own))
        told = self.index().select("shard", F.col("tables")[name].alias("told")).where("told is not null")
        both = told.join(now, "shard", "full_outer")
        n, xor, total = F.coalesce("n_rows", F.lit(0)), F.coalesce("xor", F.lit(0)), F.coalesce("total", F.lit("0"))
        wrong = both.where(F.col("told").isNull() | (n != F.col("told.n_rows")) | (xor != F.col("told.xor")) | (total != F.col("told.total")))
        bad = [(r["shard"], r["told"]["n_rows"] if r["told"] else None, r["n_rows"]) for r in wrong.orderBy("shard").limit(5).collect()]
        if bad:
            raise ValueError(f"{name} differs from what was committed (shard, committed rows, rows found): {bad}")
        return rows


# ---- weight artifacts ------------------------------------------------------------------------------------------

CELL = ["method", "seed", "budget_requested", "l2_lambda", "holdout_type", "fold"]
VECTORS = "record_id long, weight double, start_weight double"
TRAJECTORY = "epoch int, loss double"
_CELL_KINDS = "method string, seed int, budget_requested long, l2_lambda double, holdout_type string, fold int"


class Artifacts:
    """Weight vectors with their start weights and losses, and an index row for each run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, runs: DataFrame, vectors: DataFrame, trajectory: DataFrame) -> str:
        """runs (columns of schemas.RUNS but the path), vectors (cell, VECTORS; all candidates), trajectory (cell, TRAJECTORY): all runs in one job each."""
        attempt = uuid.uuid4().hex
        for name, df, schema in (("vectors", vectors, VECTORS), ("trajectories", trajectory, TRAJECTORY)):
            own = df.select(*CELL, *schemas.names(schema)).withColumn("attempt", F.lit(attempt))
            own.write.mode("append").partitionBy("attempt", *CELL).parquet(f"{self.root}/{name}")
        path = F.concat(F.lit(f"vectors/attempt={attempt}"), *[F.concat(F.lit(f"/{c}="), F.col(c).cast("string")) for c in CELL])
        rows = runs.withColumns({"artifact_path": path, "attempt": F.lit(attempt), "saved_at": F.lit(utc_now())})
        rows.select(*schemas.names(schemas.RUNS), "attempt", "saved_at").coalesce(1).write.mode("append").json(f"{self.root}/weights_index")  # a row for each run
        return attempt

    def index(self) -> DataFrame:
        """The last row of each run."""
        path = f"{self.root}/weights_index"
        schema = f"{schemas.RUNS}, attempt string, saved_at string"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        nth = F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("saved_at"), F.desc("attempt")))
        return self.spark.read.schema(schema).json(path).withColumn("nth", nth).where("nth = 1").drop("nth")

    def _data(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = f"{schema}, attempt string, {_CELL_KINDS}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def vectors(self) -> DataFrame:
        """Vectors of all runs in the index; a run whose data are gone is an error that names its path."""
        index = self.index()
        rows = _with_index(self._data("vectors", VECTORS), index.select("attempt", *CELL), ["attempt", *CELL])
        gone = index.join(rows.select("attempt", *CELL).distinct(), ["attempt", *CELL], "left_anti")
        lost = [r["artifact_path"] for r in gone.orderBy("artifact_path").limit(5).collect()]
        if lost:
            raise FileNotFoundError(f"weight artifacts are missing: {lost}")
        return rows.drop("attempt")

    def trajectories(self) -> DataFrame:
        return _with_index(self._data("trajectories", TRAJECTORY), self.index().select("attempt", *CELL), ["attempt", *CELL]).drop("attempt")

    def load(self, **cell: object) -> tuple[dict, DataFrame, DataFrame]:
        """(index row, vectors, trajectory) of one run."""
        mine = self.index()
        for name, value in cell.items():
            mine = mine.where(F.col(name) == F.lit(value))
        rows = mine.limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{'no' if not rows else 'more than one'} run of {cell}")
        record = rows[0].asDict()

        def own(df: DataFrame) -> DataFrame:
            for name in ("attempt", *CELL):  # partitions are pruned
                df = df.where(F.col(name) == F.lit(record[name]))
            return df.drop("attempt", *CELL)

        vectors = own(self._data("vectors", VECTORS))
        if not vectors.limit(1).count():
            raise FileNotFoundError(f"the weight artifact {record['artifact_path']} is missing")
        return record, vectors, own(self._data("trajectories", TRAJECTORY))


# ---- manifests -------------------------------------------------------------------------------------------------


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """A nested record as one JSON file; numbers that are not finite become null."""
    text = json.dumps(_finite(record), sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    """A record; {} where there is none. A broken one is an error that tells the file and the position."""
    if not exists(spark, path):
        return {}
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").limit(2).collect()  # one small file
    if len(files) != 1:
        raise ValueError(f"{path} holds {'no' if not files else 'more than one'} record")

    def constant(name: str) -> None:
        raise ValueError(f"{files[0]['file']}: {name} is no number")

    try:
        return json.loads(files[0]["value"], parse_constant=constant)
    except json.JSONDecodeError as e:
        raise ValueError(f"{files[0]['file']}: {e.msg} in line {e.lineno}, column {e.colno}") from e


def _finite(value: object) -> object:
    if isinstance(value, dict):
        return {str(k): _finite(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_finite(v) for v in (sorted(value) if isinstance(value, set) else value)]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)
