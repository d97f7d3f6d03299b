"""Holdouts and folds over targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rand import uniform


def _nth(targets: DataFrame, seed: int, purpose: str) -> DataFrame:
    """Adds a seeded order number; targets are a published list of tens of thousands, which one sort holds."""
    return targets.withColumn("__nth", F.row_number().over(Window.orderBy(uniform(purpose, seed, F.col("target_name")), "target_pos")))


def split_targets(targets: DataFrame, holdout_frac: float, seed: int) -> DataFrame:
    """Adds ``split``: round(n * frac), half to even, of the targets are held out."""
    if not 0 <= holdout_frac < 1:
        raise ValueError("holdout_frac must lie in [0, 1)")
    n = targets.agg(F.bround(F.count("*") * F.lit(float(holdout_frac))).cast("long").alias("__take"))
    out = _nth(targets, seed, "split").crossJoin(F.broadcast(n))  # one row
    return out.withColumn("split", F.when(F.col("__nth") <= F.col("__take"), "holdout").otherwise("fit")).drop("__nth", "__take")


def split_by_family(targets: DataFrame, families: list[str], extra_frac: float = 0.0, seed: int = 0) -> DataFrame:
    """Holds whole families out, and a random share of the rest; unknown families are an error."""
    asked = targets.sparkSession.createDataFrame([(f,) for f in families], "family string")
    unknown = [r["family"] for r in asked.join(targets.select("family").distinct(), "family", "left_anti").collect()]
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    out = targets.where(F.col("family").isin(families)).withColumn("split", F.lit("holdout"))
    return out.unionByName(split_targets(targets.where(~F.col("family").isin(families)), extra_frac, seed))


def deal_families(targets: DataFrame, n_folds: int, seed: int, balance: bool = True) -> DataFrame:
    """(family, fold): whole families, greedily to the least loaded fold from the largest on, or one after the other.

    Families of one size come in a seeded order; of equal loads the lowest fold takes.
    """
    sizes = targets.groupBy("family").agg(F.count("*").alias("size")).withColumn("u", uniform("fold", seed, F.col("family")))
    total = sizes.count()
    if not 2 <= n_folds <= total:
        raise ValueError(f"n_folds must lie between 2 and the {total} families")
    if not balance:
        return sizes.select("family", ((F.row_number().over(Window.orderBy("u", "family")) - 1) % n_folds).cast("int").alias("fold"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "u", "family", "size"))).alias("families"))
    dealt = F.expr(f"""aggregate(families,
        named_struct('load', array_repeat(0L, {n_folds}), 'out', cast(array() as array<struct<family:string,fold:int>>)),
        (acc, f) -> named_struct(
            'load', transform(acc.load, (x, i) -> if(i = array_position(acc.load, array_min(acc.load)) - 1, x + f.size, x)),
            'out', array_append(acc.out, named_struct('family', f.family, 'fold', cast(array_position(acc.load, array_min(acc.load)) - 1 as int)))),
        acc -> acc.out)""")
    return listed.select(F.inline(dealt))


def rotated_folds(targets: DataFrame, n_folds: int, seed: int, balance: bool = True, exclude_validation_only: bool = True) -> DataFrame:
    """Targets of each fold with ``split``; validation-only families are held out in every fold and fitted in none."""
    spark = targets.sparkSession
    dealt = targets.where(~F.col("validation_only")) if exclude_validation_only else targets
    own = deal_families(dealt, n_folds, seed, balance).withColumnRenamed("fold", "own_fold")
    folds = spark.range(n_folds).select(F.col("id").cast("int").alias("fold"))
    every = targets.join(own, "family", "left").crossJoin(F.broadcast(folds))
    held = (F.col("own_fold") == F.col("fold")) | F.col("own_fold").isNull()
    return every.withColumn("split", F.when(held, "holdout").otherwise("fit")).drop("own_fold")


def validation_only_families(targets: DataFrame) -> DataFrame:
    """Families present that have a validation-only target."""
    return targets.where("validation_only").select("family").intersect(targets.select("family"))


def held_families(targets: DataFrame, requested: list[str]) -> DataFrame:
    """Requested holdouts and validation-only families together."""
    asked = targets.sparkSession.createDataFrame([(f,) for f in requested], "family string")
    return asked.union(validation_only_families(targets)).distinct()


def complement(targets: DataFrame, holdout: DataFrame) -> DataFrame:
    """All targets but the held-out ones, in their order."""
    return targets.join(holdout.select("target_pos"), "target_pos", "left_anti").orderBy("target_pos")


def full_surface(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fit on every target, hold none out."""
    return targets, targets.limit(0)
