"""Joins on keys of which one may have a large share of all rows.

Keys with over ``per`` rows are dealt into parts of about ``per`` rows by a hash of
other columns, and what they are joined to is repeated for each part.  Of such keys
the ``MOST_HOT`` largest count (any other has less than a ``MOST_HOT``-th of all rows):
their list is broadcast, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER, MOST_HOT = 500, 10_000
PART, PARTS = "__part", "__parts"


def hot_keys(rows: DataFrame, keys: list[str], per: int = PER) -> DataFrame:
    """keys and PARTS of the keys that have too many rows: at most MOST_HOT."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > per).orderBy(F.desc("__n"), *keys).limit(MOST_HOT)
    return many.select(*keys, F.ceil(F.col("__n") / per).cast("int").alias(PARTS))


def dealt(rows: DataFrame, hot: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The rows with their part, 0 where the key isn't hot."""
    out = rows.join(F.broadcast(hot), keys, "left")
    return out.withColumn(PART, F.coalesce(F.pmod(F.xxhash64(*by), F.col(PARTS)), F.lit(0)).cast("int")).drop(PARTS)


def repeated(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Each row once for each part of its key."""
    out = rows.join(F.broadcast(hot), keys, "left")
    return out.withColumn(PART, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(PARTS), F.lit(1)) - 1))).drop(PARTS)


def join(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner", per: int = PER) -> DataFrame:
    """``many`` joined to ``few``; ``many``, a written table, may have hot keys and is dealt by the columns ``by``."""
    hot = hot_keys(many.select(*keys), keys, per)
    return dealt(many, hot, keys, by).join(repeated(few, hot, keys), [*keys, PART], how).drop(PART)
