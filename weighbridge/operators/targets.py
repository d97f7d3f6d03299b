"""Target tables: facts to targets, filters, loss weights, crosswalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_registry_family(targets: DataFrame) -> DataFrame:
    """Puts the registry's family into the metadata without overwriting one that is there."""
    has = F.map_contains_key("metadata", F.lit("family"))
    return targets.withColumn("metadata", F.when(has | F.col("family").isNull(), F.col("metadata")).otherwise(F.map_concat(F.create_map(F.lit("family"), F.col("family")), F.map_filter("metadata", lambda k, _: k != "family"))))


def classified(targets: DataFrame) -> DataFrame:
    """Adds family, geography_level and loss_family from the metadata and the name."""
    m, n = F.col("metadata"), F.col("target_name")
    return targets.withColumns({"geography_level": T.geography_level(m), "family": T.reporting_family(m, n), "loss_family": T.loss_family(m, n)})


def unsupported_filters(targets: DataFrame, supported: list[str], prefix: str = "ledger_filter") -> tuple[DataFrame, DataFrame]:
    """(targets without filter keys that aren't supported, report of the others' keys)."""
    known = F.array(*[F.lit(s) for s in supported]).cast("array<string>")
    bad = F.filter(F.map_keys("metadata"), lambda k: k.startswith(prefix) & ~F.array_contains(known, k))
    marked = targets.withColumn("unsupported", F.array_sort(bad))
    return marked.where(F.size("unsupported") == 0).drop("unsupported"), marked.where(F.size("unsupported") > 0).select("target_name", "unsupported")


def merged_facts(base: DataFrame, suite: DataFrame, key: str = "aggregate_fact_key") -> DataFrame:
    """Both feeds with their source; a key that occurs twice is an error, rows without a key are exempt."""
    both = base.withColumn("source_feed", F.lit("base")).unionByName(suite.withColumn("source_feed", F.lit("suite")), allowMissingColumns=True)
    twice = [r[0] for r in both.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise ValueError(f"duplicate fact keys, such as {twice}")
    return both


def latest_vintage(facts: DataFrame, identity: list[str], period: int, vintage: str = "vintage") -> DataFrame:
    """The latest row of each identity whose vintage is not after the period."""
    others = [c for c in facts.columns if c not in identity]
    best = facts.where(F.col(vintage) <= period).groupBy(*identity).agg(F.max_by(F.struct(*others), F.col(vintage)).alias("__row"))
    return best.select(*identity, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*facts.columns)


def crosswalked(facts: DataFrame, crosswalk: DataFrame, geography: str, value: str, keys: list[str]) -> DataFrame:
    """Facts of an old geography re-expressed in the new one by the crosswalk's weights."""
    joined = facts.join(crosswalk, facts[geography] == crosswalk["source_geography_id"])
    return joined.groupBy(*keys, F.col("target_geography_id").alias(geography)).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def basis_of(metadata: Column) -> Column:
    """count for indicator sums and ids that end in count, else amount."""
    return F.when((metadata["measure_mode"] == "indicator_sum") | metadata["source_measure_id"].endswith("count"), "count").otherwise("amount")


def loss_weights(targets: DataFrame, weighting: str = "production") -> DataFrame:
    """(target_name, loss_weight): root of the scale, mean one in each basis, bases of equal totals, mean one over all.

    ``uniform`` gives null weights.
    """
    if weighting == "uniform":
        return targets.select("target_name", F.lit(None).cast("double").alias("loss_weight"))
    if weighting != "production":
        raise ValueError(f"unknown weighting {weighting}")
    raw = targets.select("target_name", "basis", F.sqrt(F.greatest(F.abs("value"), F.lit(1.0))).alias("raw"))
    per = raw.groupBy("basis").agg(F.avg("raw").alias("mean_raw"), F.count("*").alias("n"))
    whole = per.agg(F.sum("n").alias("targets"), F.count("*").alias("bases"))
    sized = per.crossJoin(F.broadcast(whole)).select("basis", "mean_raw", (F.col("targets") / F.col("bases") / F.col("n")).alias("share"))  # one row
    return raw.join(F.broadcast(sized), "basis").select("target_name", (F.col("raw") / F.col("mean_raw") * F.col("share")).alias("loss_weight"))


def inventory(targets: DataFrame) -> DataFrame:
    """Targets of each family by level, each family's and the whole total."""
    return targets.rollup("family", "geography_level").agg(F.count("*").alias("n_targets"), F.grouping_id().alias("level"))


def registry_record(targets: DataFrame) -> DataFrame:
    """One row: number of targets, sorted families, sorted levels."""
    return targets.agg(F.count("*").alias("n_targets"), F.sort_array(F.collect_set("family")).alias("families"), F.sort_array(F.collect_set("geography_level")).alias("levels"))
