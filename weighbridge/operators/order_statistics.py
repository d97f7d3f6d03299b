"""Exact order statistics without sorting: histograms that close in on a rank.

Each round counts the values of each group between two bounds in ``bins`` bins and keeps
the bin that holds the rank, until it has few values or a single one.  A round is one
pre-aggregated pass; no task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dropped, kept

#: Values that are sorted at once, and bins of a round.
FEW, BINS = 1000, 256


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: DataFrame, few: int = FEW, bins: int = BINS) -> DataFrame:
    """ranks (keys, rank from 0) -> (keys, rank, value): the value at each rank of its group; nulls and NaN must be left out before."""
    rows = df.select(*keys, F.col(value).alias("__v"))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("held"))
    sought = ranks.select(*keys, F.col("rank").cast("long").alias("rank"))
    state = sought.join(ends, keys) if keys else sought.crossJoin(F.broadcast(ends))  # one row
    state = kept(state.withColumn("below", F.lit(0).cast("long")), "ranks")
    wide = (F.col("held") > few) & (F.col("lo") < F.col("hi"))
    by = [*keys, "rank"]
    while state.where(wide).limit(1).count():
        open_ = state.where(wide).select(*by, "lo", "hi", F.col("below").alias("under"))
        inside = _inside(rows, open_, keys)
        nth = F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
        counts = inside.groupBy(*by, "under", nth.alias("bin")).agg(F.count("*").alias("held"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        up_to = F.sum("held").over(Window.partitionBy(*by).orderBy("bin"))  # ``bins`` rows of a rank at most
        counts = counts.withColumn("below", F.col("under") + up_to - F.col("held"))
        closer = counts.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("held"))).select(*state.columns)
        after = kept(state.where(~wide).unionByName(closer), "ranks")
        dropped(state)
        state = after
    same = state.where("lo = hi").select(*by, F.col("lo").alias("value"))
    last = state.where("lo < hi").select(*by, "lo", "hi", "below")
    found = _inside(rows, last, keys).groupBy(*by, "below").agg(F.sort_array(F.collect_list("__v")).alias("all"))  # ``few`` values at most
    return same.unionByName(found.select(*by, F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("value")))


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the bounds that they lie within."""
    joined = rows.join(state, keys) if keys else rows.crossJoin(F.broadcast(state))  # a row for each rank
    return joined.where(F.col("__v").between(F.col("lo"), F.col("hi")))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW, bins: int = BINS) -> DataFrame:
    """(keys, one column q0, q1, ... for each share): exact quantiles, linear between neighbours, of each group."""
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    place = lambda s: F.lit(s) * (F.col("n") - 1)
    ends = F.array(*[F.struct(F.lit(i).alias("i"), side.alias("side"), rank.cast("long").alias("rank")) for i, s in enumerate(shares) for side, rank in ((F.lit(0), F.floor(place(s))), (F.lit(1), F.ceil(place(s))))])
    wanted = kept(sizes.where("n > 0").select(*keys, "n", F.inline(ends)), "wanted")
    found = at_ranks(df.where(F.col(value).isNotNull()), keys, value, wanted.select(*keys, "rank").distinct(), few, bins)
    at = wanted.join(found, [*keys, "rank"]).groupBy(*keys, "n")
    end = lambda i, side: F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("value")))
    out = []
    for i, s in enumerate(shares):
        way = place(s) - F.floor(place(s))
        out.append((end(i, 0) + (end(i, 1) - end(i, 0)) * F.max(way)).alias(f"q{i}"))
    return at.agg(*out).drop("n")


def least(df: DataFrame, by: str, tie: str | Column, n: int, few: int = FEW) -> DataFrame:
    """The n rows with the least ``by``, equal ones by ``tie``; all where there are no more. No task sorts n rows."""
    if n <= 0:
        return df.limit(0)
    held = df.where(F.col(by).isNotNull()).count()
    if held <= n:
        return df.where(F.col(by).isNotNull())
    rank = df.sparkSession.range(1).select(F.lit(n - 1).alias("rank"))
    bound = at_ranks(df.where(F.col(by).isNotNull()), [], by, rank, few).first()["value"]
    below = df.where(F.col(by) < bound)
    return below.unionByName(df.where(F.col(by) == bound).orderBy(tie).limit(n - below.count()))  # rows that share the bound
