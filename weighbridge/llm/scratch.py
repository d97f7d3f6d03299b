"""Where intermediate tables of long jobs are kept.

Everything goes to the folder that the session names in ``spark.checkpoint.dir``,
which all executors share, below a folder of the application's own.  Where the
setting is absent a temporary folder is chosen, but only in local mode, where driver
and tasks are one process; elsewhere that is an error.  Files are written and deleted
by Spark and Hadoop's file system API, so any store that Spark can reach will do.

An operator drops its own tables as soon as nothing reads them; the one that its
result reads stays until :func:`clear` or until the folder's owner empties it.  While a
table is written, Spark is told to remove the job's shuffle files as it ends, since many
small jobs would fill the disks before the driver's garbage collector lets them go; that
setting is put back, and no other setting of the session is changed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside Python, where a null would turn all ids of a batch into floats.
NO_ID = -(2**63)
_LOCAL: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def id_out(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(NO_ID)).alias(name)


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def shared_folder(spark: SparkSession) -> str:
    """The application's folder within the shared one."""
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return f"{folder.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside remove their shuffle files as they end, which no later job needs; the session's setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def finished(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """As :func:`written`; then drops the tables that ``df`` was made from."""
    back = written(df, name)
    drop(*done)
    return back


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has kept; frames that read them fail from then on."""
    delete(spark, shared_folder(spark))
