"""Frames that the registered queries start from, made by the operators from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matrix, score
from ..operators.universe import Universe
from ..sources.fixtures import table
from ..sources.tables import dropped, kept, shared_folder  # noqa: F401

RUN = ["method", "seed", "budget_requested", "l2_lambda"]
MOST_TARGETS = 1_000_000
FOLD_OF = {"balance": 0, "population": 0, "activity": 1, "segment": 1}


def universe(spark: SparkSession, sf_dir: str) -> Universe:
    """Customers as weighted records, orders as their members."""
    record = kept(table(spark, sf_dir, "fx_record"), "fx-record")  # read for each shape of target
    own = record.withColumn("record_count", F.lit(1.0))
    for segment in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        own = own.withColumn(f"seg_{segment}", (F.col("segment") == segment).cast("double"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("orders_total"))
    placed = orders.withColumn("n_orders", F.lit(1.0)).join(record.select("record_id", "state", "district"), "record_id")
    return Universe("record", {"record": own, "order": placed}, record.select("record_id", "w0"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture targets in the columns of the target table."""
    fx = table(spark, sf_dir, "fx_target")
    place, measure = F.split_part("target_name", F.lit("/"), F.lit(2)), F.split_part("target_name", F.lit("/"), F.lit(3))
    known = F.when(F.col("target_name") == "stress/tiny", "acctbal").when(F.col("target_name") == "stress/zero", "record_count").when(F.col("target_name") == "forecast/n_orders", "n_orders").otherwise(measure)
    by = F.when(F.col("geography_level") == "state", F.create_map(F.lit("state"), place)).when(F.col("geography_level") == "district", F.create_map(F.lit("district"), place)).otherwise(F.expr("cast(map() as map<string,string>)"))
    out = fx.withColumns({"measure": known, "filter": by})
    out = out.select(
        F.crc32(F.col("target_name").cast("binary")).alias("target_pos"), "target_name", F.when(F.col("measure").isin("orders_total", "n_orders"), "order").otherwise("record").alias("entity"), "measure", "value", "family",
        "geography_level", "basis", "filter", F.create_map(F.lit("family"), F.col("family"), F.lit("geography_level"), F.col("geography_level")).alias("metadata"), "validation_only")
    # a published list, of tens of thousands at most: it is made once and kept as a local table
    rows = out.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return spark.createDataFrame(rows, out.schema)


def built_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target matrix, written once."""
    return kept(matrix.constraint_matrix(universe(spark, sf_dir), targets(spark, sf_dir)), "matrix")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight vectors of the runs, written once for all that a query makes of them."""
    return kept(table(spark, sf_dir, "fx_weight"), "fx-weight")


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-target results of the run grid, with relative errors."""
    d = table(spark, sf_dir, "fx_diag")
    return d.withColumn("absolute_relative_error", score.relative_error(F.col("target_value"), F.col("achieved_value")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score(diagnostics(spark, sf_dir), [*RUN, "split"])


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric rows of the run grid, written once for all the summaries that a query makes of them."""
    return kept(score.long_rows(scores(spark, sf_dir), table(spark, sf_dir, "fx_runvalue"), RUN, "fixed_family", -1), "metrics")


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family rows as if held out in two folds; validation-only families are held out in both."""
    rows = metrics(spark, sf_dir).where("scope = 'family'")
    own = F.lit(None).cast("int")
    for family, fold in FOLD_OF.items():
        own = F.when(F.col("scope_value") == family, fold).otherwise(own)
    folds = F.when(F.col("scope_value") == "forecast", F.array(F.lit(0), F.lit(1))).otherwise(F.array(own))
    out = rows.withColumns({"fold": F.explode(folds), "holdout_type": F.lit("rotation"), "split": F.lit("out_of_sample")})
    return out.where("fold is not null")


# The same frames in DuckDB SQL, as further clauses after the fixtures.
SCORES_SQL = """
are AS (SELECT *, CASE WHEN target_value <> 0 THEN abs(achieved_value - target_value) / abs(target_value) END AS e FROM fx_diag),
scored AS (SELECT method, seed, budget_requested, l2_lambda, split,
    CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(geography_level) = 0 THEN 'geography' ELSE 'overall' END AS scope,
    CASE WHEN grouping(family) = 0 THEN family WHEN grouping(geography_level) = 0 THEN geography_level ELSE '' END AS scope_value,
    avg(e) AS mean_are, median(e) AS median_are, max(e) AS max_are, count(e) AS n, count(*) AS n_targets,
    count(*) FILTER (WHERE target_value = 0) AS n_zero_value_targets,
    avg(abs(achieved_value - target_value)) FILTER (WHERE target_value = 0) AS mean_absolute_error_zero,
    max(abs(achieved_value - target_value)) FILTER (WHERE target_value = 0) AS max_absolute_error_zero,
    avg(e) FILTER (WHERE NOT is_degenerate) AS mean_are_ex_degenerate, count(e) FILTER (WHERE is_degenerate) AS n_degenerate,
    count(*) FILTER (WHERE e > 1) AS n_are_gt_1, count(*) FILTER (WHERE e > 5) AS n_are_gt_5
  FROM are GROUP BY GROUPING SETS ((method, seed, budget_requested, l2_lambda, split),
    (method, seed, budget_requested, l2_lambda, split, family), (method, seed, budget_requested, l2_lambda, split, geography_level))
  HAVING count(e) > 0 OR (grouping(family) = 1 AND grouping(geography_level) = 1))"""

METRICS_SQL = SCORES_SQL + """,
tall AS (UNPIVOT (SELECT method, seed, budget_requested, l2_lambda, split, scope, scope_value, mean_are, median_are, max_are, CAST(n AS DOUBLE) AS n, mean_are_ex_degenerate,
    CAST(n_degenerate AS DOUBLE) AS n_degenerate FROM scored) ON mean_are, median_are, max_are, n, mean_are_ex_degenerate, n_degenerate INTO NAME metric VALUE value),
ran AS (UNPIVOT (SELECT method, seed, budget_requested, l2_lambda, CAST(n_selected AS DOUBLE) AS n_selected, budget_achieved, ess, max_weight, runtime_s FROM fx_runvalue)
    ON n_selected, budget_achieved, ess, max_weight, runtime_s INTO NAME metric VALUE value),
long AS (SELECT b.*, v.n_selected AS budget_achieved, 'fixed_family' AS holdout_type, -1 AS fold FROM (
    SELECT method, seed, budget_requested, l2_lambda, split, scope, scope_value, metric, value FROM tall WHERE scope = 'overall' OR metric NOT IN ('mean_are_ex_degenerate', 'n_degenerate')
    UNION ALL SELECT method, seed, budget_requested, l2_lambda, 'na', 'run', '', metric, value FROM ran) b
  JOIN fx_runvalue v USING (method, seed, budget_requested, l2_lambda))"""
