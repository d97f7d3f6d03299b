"""Means with intervals, t quantiles and p-values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def t_tail(t: Column, df: Column) -> Column:
    """P(|T| > t) for whole degrees of freedom, by the finite series in cos(atan(t / sqrt(df)))."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.cos(theta) * F.cos(theta)
    # terms: odd df start at cos, factors 2k/(2k+1); even df start at 1, factors (2k-1)/(2k)
    odd = df % 2 == 1
    steps = F.greatest(F.lit(0), F.floor((df - F.when(odd, 3).otherwise(2)) / 2)).cast("int")
    ratio = lambda k: F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    grow = lambda acc, k: F.struct((acc["term"] * cos2 * ratio(k.cast("double"))).alias("term"), (acc["total"] + acc["term"] * cos2 * ratio(k.cast("double"))).alias("total"))
    series = F.when(steps < 1, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, grow, lambda a: a["total"]))
    inside_odd = 2.0 / F.pi() * (theta + F.when(df > 1, F.sin(theta) * F.cos(theta) * series).otherwise(0.0))
    inside_even = F.sin(theta) * series
    return 1.0 - F.when(odd, inside_odd).otherwise(inside_even)


def t_quantile(confidence: float, df: Column, rounds: int = 80) -> Column:
    """The t that |T| stays below with this chance, by bisection of theta = atan(t / sqrt(df))."""
    start = F.struct(F.lit(0.0).alias("lo"), (F.pi() / 2).alias("hi"))

    def halve(acc: Column, _k: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        below = 1.0 - t_tail(F.sqrt(df.cast("double")) * F.tan(mid), df) < confidence
        return F.struct(F.when(below, mid).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda a: F.tan((a["lo"] + a["hi"]) / 2))
    return F.when(df >= 1, F.sqrt(df.cast("double")) * found)


def finite(x: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def interval_parts(x: Column) -> list[Column]:
    """Aggregates that an interval needs; see :func:`interval`."""
    x = finite(x)
    return [F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n_values")]


#: Quantiles of few degrees of freedom are asked for again and again; a table of them is joined by column expression.
def interval(mean: Column, sd: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """(low, high): the mean itself for one value, null for none."""
    half = t_quantile(confidence, (n - 1).cast("int")) * sd / F.sqrt(n.cast("double"))
    return F.when(n >= 2, mean - half).when(n == 1, mean), F.when(n >= 2, mean + half).when(n == 1, mean)
