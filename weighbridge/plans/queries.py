"""Registered queries of the calibration library, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rand import uniform
from ..operators import aggregate as A
from ..operators import calibrate as K
from ..operators import folds, matrix, objective, report, runs, sample, score, sweep
from ..operators import targets as targets_
from ..operators import universe as U
from ..sources import state as state_
from ..sources.fixtures import duckdb, table
from ..sources.state import Artifacts
from . import frames, pipelines
from .frames import METRICS_SQL, RUN, SCORES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    """Registers a function under its name; sql is a body over the named fixtures."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = duckdb(sql, *needs)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    out = {c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(out) if out else df


def metrics_query(body: str, *needs: str):
    return query(f"WITH {METRICS_SQL.strip()}\n{body}", "fx_diag", "fx_runvalue", *needs)


T2 = "4.302652729911275"  # t quantile of 95 % for two degrees of freedom

# ---- matrix, estimates, scores ---------------------------------------------------------------------------------


@query("""SELECT target_name, count(*) AS n_records, round(sum(value) / 1000, 6) AS total_k, round(max(value), 6) AS largest
FROM fx_matrix WHERE value <> 0 GROUP BY target_name""", "fx_matrix")
def matrix_build(spark, sf):
    m = frames.built_matrix(spark, sf)
    return m.groupBy("target_name").agg(F.count("*").alias("n_records"), F.round(F.sum("value") / 1000, 6).alias("total_k"), F.round(F.max("value"), 6).alias("largest"))


START_SQL = """WITH est AS (SELECT target_name, sum(value * w0) AS achieved FROM fx_matrix GROUP BY target_name),
d AS (SELECT t.*, coalesce(achieved, 0) AS achieved FROM fx_target t LEFT JOIN est USING (target_name))"""


@query(START_SQL + """SELECT target_name, family, geography_level, round(value / 1000000, 6) AS value_m, round(achieved / 1000000, 6) AS achieved_m,
round((achieved - value) / 1000000, 6) AS error_m, CASE WHEN value <> 0 THEN round((achieved - value) / value, 6) END AS relative_error,
CASE WHEN value <> 0 THEN round(abs(achieved - value) / abs(value), 6) END AS absolute_relative_error, round(greatest(abs(value), 1) / 1000000, 6) AS scale_m,
value = 0 AS is_zero_value_target, abs(value) < identifiability_floor AS is_degenerate FROM d""", "fx_matrix", "fx_target")
def target_diagnostics(spark, sf):
    d = _start(spark, sf)
    m = lambda c: F.round(F.col(c) / 1000000, 6)
    return d.select(
        "target_name", "family", "geography_level", m("value").alias("value_m"), m("achieved_value").alias("achieved_m"), m("error").alias("error_m"), F.round("relative_error", 6).alias("relative_error"),
        F.round("absolute_relative_error", 6).alias("absolute_relative_error"), m("scale").alias("scale_m"), "is_zero_value_target", "is_degenerate")


def _start(spark, sf):
    """Diagnostics of the start weights."""
    t, m, w = frames.targets(spark, sf), frames.built_matrix(spark, sf), table(spark, sf, "fx_record").select("record_id", "w0")
    run = spark.createDataFrame([("start",)], "method string")
    weights = w.select(F.lit("start").alias("method"), "record_id", F.col("w0").alias("weight"))
    scored = matrix.achieved(t, run, matrix.estimates(m, weights, ["method"]), ["method"])
    return score.target_diagnostics(scored, degenerate=matrix.degenerate_names(t, matrix.identifiability_floors(m, w)))


SCORE_COLUMNS = ("mean_are", "median_are", "max_are", "n", "n_targets", "n_zero_value_targets", "mean_absolute_error_zero", "max_absolute_error_zero", "mean_are_ex_degenerate", "n_degenerate", "n_are_gt_1", "n_are_gt_5")


@query(START_SQL + """, e AS (SELECT *, CASE WHEN value <> 0 THEN abs(achieved - value) / abs(value) END AS are, abs(value) < identifiability_floor AS bad FROM d)
SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(geography_level) = 0 THEN 'geography' ELSE 'overall' END AS scope,
CASE WHEN grouping(family) = 0 THEN family WHEN grouping(geography_level) = 0 THEN geography_level ELSE '' END AS scope_value,
round(avg(are) / 1000, 6) AS mean_are_k, round(median(are), 6) AS median_are, round(max(are) / 1000, 3) AS max_are_k, count(are) AS n, count(*) AS n_targets,
round(avg(are) FILTER (WHERE NOT bad), 6) AS mean_are_ex_degenerate, count(are) FILTER (WHERE bad) AS n_degenerate
FROM e GROUP BY GROUPING SETS ((), (family), (geography_level)) HAVING count(are) > 0 OR (grouping(family) = 1 AND grouping(geography_level) = 1)""", "fx_matrix", "fx_target")
def score_start(spark, sf):
    d = _start(spark, sf).withColumn("target_value", F.col("value"))
    s = score.score(d, ["method"])
    return s.select("scope", "scope_value", F.round(F.col("mean_are") / 1000, 6).alias("mean_are_k"), F.round("median_are", 6).alias("median_are"), F.round(F.col("max_are") / 1000, 3).alias("max_are_k"),
                    "n", "n_targets", F.round("mean_are_ex_degenerate", 6).alias("mean_are_ex_degenerate"), "n_degenerate")


@query(f"WITH {SCORES_SQL.strip()} SELECT method, seed, budget_requested, l2_lambda, split, scope, scope_value, "
       + ", ".join(c if c.startswith("n") else f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS) + " FROM scored", "fx_diag")
def score_runs(spark, sf):
    return rounded(frames.scores(spark, sf).select(*RUN, "split", "scope", "scope_value", *SCORE_COLUMNS))


@query("""SELECT w.method, w.seed, w.budget_requested, m.target_name, round(sum(m.value * w.weight) / 1000000, 6) AS achieved_m
FROM fx_matrix m JOIN fx_weight w USING (record_id) WHERE m.value <> 0 GROUP BY ALL""", "fx_matrix", "fx_weight")
def estimates_runs(spark, sf):
    found = matrix.estimates(frames.built_matrix(spark, sf), table(spark, sf, "fx_weight"), ["method", "seed", "budget_requested"])
    return found.select("method", "seed", "budget_requested", "target_name", F.round(F.col("achieved_value") / 1000000, 6).alias("achieved_m"))


@query("""SELECT method, seed, budget_requested, count(*) AS n_selected, round(sum(weight), 3) AS weight_sum, round(sum(weight) * sum(weight) / sum(weight * weight), 4) AS ess,
round(min(weight), 6) AS min_weight, round(avg(weight), 6) AS mean_weight, round(max(weight), 6) AS max_weight, round(quantile_cont(weight, 0.5), 6) AS p50_weight,
round(quantile_cont(weight, 0.9), 6) AS p90_weight, round(quantile_cont(weight, 0.99), 6) AS p99_weight FROM fx_weight WHERE weight > 0 GROUP BY ALL""", "fx_weight")
def weight_diagnostics(spark, sf):
    d = score.weight_diagnostics(table(spark, sf, "fx_weight"), ["method", "seed", "budget_requested"])  # writes the weights itself
    return rounded(d.withColumns({"weight_sum": F.round("weight_sum", 3), "ess": F.round("ess", 4)}))


@query("""SELECT target_name, round(value, 6) AS value, round(identifiability_floor, 4) AS floor, round(identifiability_floor / abs(value), 4) AS floor_ratio
FROM fx_target WHERE value <> 0 AND abs(value) < identifiability_floor""", "fx_target")
def degenerate_audit(spark, sf):
    t = frames.targets(spark, sf)
    found = matrix.degenerate_audit(t, matrix.identifiability_floors(frames.built_matrix(spark, sf), table(spark, sf, "fx_record")))
    return found.select("target_name", F.round("value", 6).alias("value"), F.round("floor", 4).alias("floor"), F.round("floor_ratio", 4).alias("floor_ratio"))


@query("SELECT target_name FROM fx_target WHERE abs(value) < identifiability_floor", "fx_target")
def degenerate_names(spark, sf):
    return matrix.degenerate_names(frames.targets(spark, sf), matrix.identifiability_floors(frames.built_matrix(spark, sf), table(spark, sf, "fx_record")))


@metrics_query("""SELECT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested, budget_achieved, l2_lambda, holdout_type, fold, split, scope, scope_value, metric, round(value, 6) AS value FROM long""")
def metrics_long(spark, sf):
    return rounded(frames.metrics(spark, sf))


@query("""SELECT method, l2_lambda, seed, CAST(budget_requested AS BIGINT) AS budget_requested, split, target_name, family, geography_level, round(target_value / 1000000, 6) AS target_m,
round(achieved_value / 1000000, 6) AS achieved_m, CASE WHEN target_value <> 0 THEN round(abs(achieved_value - target_value) / abs(target_value), 6) END AS absolute_relative_error, is_degenerate FROM fx_diag""", "fx_diag")
def diagnostics_long(spark, sf):
    d = score.diagnostic_rows(frames.diagnostics(spark, sf))
    return d.select("method", "l2_lambda", "seed", F.col("budget_requested").cast("long").alias("budget_requested"), "split", "target_name", "family", "geography_level",
                    F.round(F.col("target_value") / 1000000, 6).alias("target_m"), F.round(F.col("achieved_value") / 1000000, 6).alias("achieved_m"), F.round("absolute_relative_error", 6).alias("absolute_relative_error"), "is_degenerate")


@query("""SELECT method, split, count(CASE WHEN target_value <> 0 THEN 1 END) AS n_scored,
count(*) FILTER (WHERE target_value <> 0 AND abs(achieved_value - target_value) > abs(target_value)) AS n_are_gt_1,
count(*) FILTER (WHERE target_value <> 0 AND abs(achieved_value - target_value) / abs(target_value) > 5) AS n_are_gt_5 FROM fx_diag GROUP BY ALL""", "fx_diag")
def tail_counts(spark, sf):
    return score.tail_counts(frames.diagnostics(spark, sf), ["method", "split"])


# ---- objective -------------------------------------------------------------------------------------------------

RAW = "CASE WHEN target_value <> 0 THEN abs(achieved_value - target_value) / abs(target_value) END"
SUMMARY_SQL = f"""s AS (SELECT method, l2_lambda, seed, budget_requested, split,
sum(least(abs(achieved_value - target_value) / scale, CAST(1 AS DOUBLE)) * loss_weight) / sum(loss_weight) AS objective, median({RAW}) AS median_raw, avg({RAW}) AS mean_raw,
avg(CASE WHEN {RAW} IS NULL THEN NULL WHEN {RAW} <= 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fraction_within, count(*) AS n FROM fx_diag GROUP BY ALL)"""
OBJECTIVE = ("objective", "median_raw", "mean_raw", "fraction_within")


@query(f"WITH {SUMMARY_SQL} SELECT method, l2_lambda, seed, budget_requested, split, {', '.join(f'round({c}, 6) AS {c}' for c in OBJECTIVE)}, n FROM s", "fx_diag")
def objective_summary(spark, sf):
    return rounded(objective.summarize(frames.diagnostics(spark, sf), ["method", "l2_lambda", "seed", "budget_requested", "split"]))


@query(f"WITH {SUMMARY_SQL.replace('FROM fx_diag', 'FROM fx_diag WHERE NOT is_degenerate').replace('CAST(1 AS DOUBLE))', 'CAST(1000000 AS DOUBLE))')} SELECT method, l2_lambda, seed, budget_requested, split, {', '.join(f'round({c}, 6) AS {c}' for c in OBJECTIVE)}, n FROM s", "fx_diag")
def objective_uncapped(spark, sf):
    return rounded(objective.summarize(frames.diagnostics(spark, sf), ["method", "l2_lambda", "seed", "budget_requested", "split"], cap=None, drop_degenerate=True))


@query(f"WITH {SUMMARY_SQL} SELECT method, l2_lambda, budget_requested, split, " + ", ".join(
    f"round(avg({c}), 6) AS {c}, round(avg({c}) - {T2} * stddev_samp({c}) / sqrt(3), 6) AS {c}_lo, round(avg({c}) + {T2} * stddev_samp({c}) / sqrt(3), 6) AS {c}_hi" for c in OBJECTIVE)
    + ", CAST(round_even(avg(n), 0) AS BIGINT) AS n, count(DISTINCT seed) AS n_seeds FROM s GROUP BY ALL", "fx_diag")
def objective_across_seeds(spark, sf):
    keys = ["method", "l2_lambda", "budget_requested", "split"]
    return rounded(objective.across_seeds(objective.summarize(frames.diagnostics(spark, sf), [*keys, "seed"]), keys))


LOSS_WEIGHT_SQL = """raw AS (SELECT target_name, basis, sqrt(greatest(abs(value), 1)) AS r FROM fx_target),
per AS (SELECT basis, avg(r) AS mean_raw, count(*) AS n FROM raw GROUP BY basis),
lw AS (SELECT target_name, r / mean_raw * ((SELECT sum(n) FROM per) / (SELECT count(*) FROM per)::DOUBLE / n) AS loss_weight FROM raw JOIN per USING (basis))"""


@query(f"WITH {LOSS_WEIGHT_SQL} SELECT target_name, round(loss_weight, 6) AS loss_weight FROM lw", "fx_target")
def loss_weights(spark, sf):
    return rounded(targets_.loss_weights(frames.targets(spark, sf)))


@query(f"WITH {LOSS_WEIGHT_SQL} SELECT count(*) AS n, round(sum(loss_weight), 6) AS sum, round(avg(loss_weight), 6) AS mean, round(min(loss_weight), 6) AS min, round(max(loss_weight), 6) AS max, false AS uniform FROM lw", "fx_target")
def loss_weight_summary(spark, sf):
    return rounded(objective.loss_weight_summary(targets_.loss_weights(frames.targets(spark, sf))))


# ---- folds and samples -----------------------------------------------------------------------------------------

POS_SQL = "pos AS (SELECT *, {U(concat('split:7:', target_name))} AS u FROM fx_target)"


@query(f"""WITH {POS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY u, target_name) AS nth, count(*) OVER () AS total FROM pos)
SELECT target_name, CASE WHEN nth <= round_even(total * CAST(0.3 AS DOUBLE), 0) THEN 'holdout' ELSE 'fit' END AS split FROM n""", "fx_target")
def split_targets(spark, sf):
    return folds.split_targets(frames.targets(spark, sf), 0.3, 7).select("target_name", "split")


@query(f"""WITH {POS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY u, target_name) AS nth, count(*) OVER () AS total FROM pos WHERE family NOT IN ('orders', 'forecast'))
SELECT target_name, 'holdout' AS split FROM fx_target WHERE family IN ('orders', 'forecast')
UNION ALL SELECT target_name, CASE WHEN nth <= round_even(total * CAST(0.1 AS DOUBLE), 0) THEN 'holdout' ELSE 'fit' END FROM n""", "fx_target")
def split_by_family(spark, sf):
    return folds.split_by_family(frames.targets(spark, sf), ["orders", "forecast"], 0.1, 7).select("target_name", "split")


@query("""WITH f AS (SELECT DISTINCT family, {U(concat('fold:7:', family))} AS u FROM fx_target WHERE NOT validation_only),
o AS (SELECT family, CAST((row_number() OVER (ORDER BY u, family) - 1) % 3 AS INTEGER) AS own FROM f)
SELECT k.fold, t.target_name, CASE WHEN o.own IS NULL OR o.own = k.fold THEN 'holdout' ELSE 'fit' END AS split
FROM fx_target t LEFT JOIN o USING (family) CROSS JOIN (VALUES (0), (1), (2)) AS k(fold)""", "fx_target")
def rotated_folds(spark, sf):
    return folds.rotated_folds(frames.targets(spark, sf), 3, 7, balance=False).select("fold", "target_name", "split")


@query("""WITH RECURSIVE f AS (SELECT family, count(*) AS size, {U(concat('fold:7:', family))} AS u FROM fx_target GROUP BY family),
o AS (SELECT *, row_number() OVER (ORDER BY -size, u, family) AS nth FROM f),
deal AS (SELECT 0::BIGINT AS nth, [0::BIGINT, 0::BIGINT, 0::BIGINT] AS load, ''::VARCHAR AS family, 0 AS fold
  UNION ALL SELECT o.nth, list_transform(deal.load, lambda x, i: CASE WHEN i = list_position(deal.load, list_min(deal.load)) THEN x + o.size ELSE x END), o.family,
    CAST(list_position(deal.load, list_min(deal.load)) - 1 AS INTEGER) FROM deal JOIN o ON o.nth = deal.nth + 1)
SELECT family, fold FROM deal WHERE nth > 0""", "fx_target")
def deal_families(spark, sf):
    return folds.deal_families(frames.targets(spark, sf), 3, 7)


ORACLES["deal_families"] = ORACLES["deal_families"].replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE f AS", ", f AS")


@query("SELECT family FROM fx_target WHERE validation_only UNION SELECT 'orders'", "fx_target")
def held_families(spark, sf):
    return folds.held_families(frames.targets(spark, sf), ["orders"])


@query("""SELECT c.record_id FROM (SELECT record_id, row_number() OVER (ORDER BY {U(concat('subset:3:', record_id))}, record_id) AS nth, count(*) OVER () AS n FROM fx_record) c WHERE nth <= n // 3""", "fx_record")
def random_subset(spark, sf):
    ids = table(spark, sf, "fx_record").select("record_id")
    return U.random_subset(ids, ids.count() // 3, 3)


@query("""WITH c AS (SELECT record_id, row_number() OVER (ORDER BY {U(concat('subset:3:', record_id))}, record_id) AS nth, count(*) OVER () AS n FROM fx_record)
SELECT o_orderkey AS order_id, o_custkey AS record_id FROM orders JOIN c ON c.record_id = o_custkey WHERE nth <= n // 3""", "fx_record")
def restrict_universe(spark, sf):
    u = frames.universe(spark, sf)
    return u.restricted(U.random_subset(u.weights, u.weights.count() // 3, 3)).tables["order"].select("order_id", "record_id")


@query("""SELECT record_id, round(coalesce(weight, 0), 6) AS weight FROM fx_record LEFT JOIN (SELECT * FROM fx_weight WHERE method = 'informed_l0' AND seed = 0 AND budget_requested = 2000) USING (record_id)""", "fx_weight")
def scatter_to_universe(spark, sf):
    w = table(spark, sf, "fx_weight").where("method = 'informed_l0' and seed = 0 and budget_requested = 2000")
    return rounded(U.to_full(table(spark, sf, "fx_record"), w))


@query("SELECT record_id, round((SELECT avg(acctbal) FROM fx_record), 6) AS w0 FROM fx_record", "fx_record")
def reset_weights(spark, sf):
    return rounded(U.reset_weights(table(spark, sf, "fx_record").select("record_id", F.col("acctbal").alias("w0"))))


# weights for draws: 1 + orders
DRAW_SQL = "w AS (SELECT record_id, 1 + n_orders AS weight FROM fx_record)"


def _drawable(spark, sf):
    return table(spark, sf, "fx_record").select("record_id", (1 + F.col("n_orders")).alias("weight"))


@query(f"""WITH {DRAW_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY -ln({{U(concat('pps:5:', record_id))}}) / weight, record_id) AS nth FROM w WHERE weight > 0)
SELECT record_id, round((SELECT sum(weight) FROM w) / 50, 6) AS weight FROM k WHERE nth <= 50""", "fx_record")
def sample_without_replacement(spark, sf):
    out, _ = sample.weighted_sample(_drawable(spark, sf), 50, 5, replace=False)
    return rounded(out)


@query(f"""WITH {DRAW_SQL}, k AS (SELECT *, row_number() OVER (ORDER BY -ln({{U(concat('pps:5:', record_id))}}) / weight, record_id) AS nth FROM w WHERE weight > 0)
SELECT record_id, round(weight * (SELECT sum(weight) FROM w) / (SELECT sum(weight) FROM k WHERE nth <= 50), 6) AS weight FROM k WHERE nth <= 50""", "fx_record")
def sample_renormalised(spark, sf):
    out, _ = sample.weighted_sample(_drawable(spark, sf), 50, 5, replace=False, reweight="renorm_kept")
    return rounded(out)


@query(f"""WITH {DRAW_SQL}, line AS (SELECT *, sum(weight) OVER (ORDER BY floor({{U(concat('slice:11:', record_id))}} * 4096), record_id) - weight AS begin FROM w),
t AS (SELECT sum(weight) AS total, 2 * count(*) AS n FROM w), d AS (SELECT {{U(concat('draw:11:', r.i))}} * total AS at FROM t, range(CAST((SELECT 2 * count(*) FROM w) AS BIGINT)) AS r(i))
SELECT l.record_id, count(*) AS draws, round(count(*) * (SELECT total / n FROM t), 6) AS weight FROM d ASOF JOIN line l ON d.at >= l.begin GROUP BY l.record_id""", "fx_record")
def sample_with_replacement(spark, sf):
    w = _drawable(spark, sf)
    n, total = 2 * w.count(), w.agg(F.sum("weight")).first()[0]
    drawn = frames.kept(sample.draw_with_replacement(w, n, 11), "drawn")
    return rounded(drawn.select("record_id", "draws").join(sample.equal_mass(drawn, total, n), "record_id"))


@query("""WITH k AS (SELECT record_id, 1 + n_orders AS weight, row_number() OVER (ORDER BY {U(concat('scaled:9:', record_id))}, record_id) AS nth FROM fx_record)
SELECT record_id, round(weight * (SELECT sum(weight) FROM k) / (SELECT sum(weight) FROM k WHERE nth <= 40), 6) AS weight FROM k WHERE nth <= 40""", "fx_record")
def dense_scaled_sample(spark, sf):
    return rounded(sample.dense_scaled_sample(_drawable(spark, sf), 40, 9))


# ---- targets and facts -----------------------------------------------------------------------------------------

FACT_SQL = """facts AS (SELECT concat(target_name, ':', y.v) AS aggregate_fact_key, target_name, y.v AS vintage, value * (1 + (y.v - 2022) * CAST(0.01 AS DOUBLE)) AS value
FROM fx_target CROSS JOIN (VALUES (2022), (2023), (2024), (2025)) AS y(v))"""


def _facts(spark, sf):
    years = spark.createDataFrame([(2022,), (2023,), (2024,), (2025,)], "vintage int")
    t = table(spark, sf, "fx_target").crossJoin(F.broadcast(years))
    return t.select(F.concat_ws(":", "target_name", "vintage").alias("aggregate_fact_key"), "target_name", "vintage", (F.col("value") * (1 + (F.col("vintage") - 2022) * 0.01)).alias("value"))


@query(f"WITH {FACT_SQL} SELECT CASE WHEN vintage = 2024 THEN 'base' ELSE 'suite' END AS source_feed, count(*) AS n, count(DISTINCT aggregate_fact_key) AS n_keys FROM facts GROUP BY 1", "fx_target")
def merged_facts(spark, sf):
    f = _facts(spark, sf)
    both = targets_.merged_facts(f.where("vintage = 2024"), f.where("vintage <> 2024"))
    return both.groupBy("source_feed").agg(F.count("*").alias("n"), F.count_distinct("aggregate_fact_key").alias("n_keys"))


@query(f"WITH {FACT_SQL} SELECT aggregate_fact_key, target_name, vintage, round(value / 1000000, 6) AS value_m FROM facts WHERE vintage = 2024", "fx_target")
def latest_vintage(spark, sf):
    return targets_.latest_vintage(_facts(spark, sf), ["target_name"], 2024).select("aggregate_fact_key", "target_name", "vintage", F.round(F.col("value") / 1000000, 6).alias("value_m"))


@query("""WITH x AS (SELECT DISTINCT district AS s, CASE WHEN ascii(district) % 2 = 0 THEN 'even' ELSE 'odd' END AS t FROM fx_record),
cw AS (SELECT s, t, CAST(0.75 AS DOUBLE) AS w FROM x UNION ALL SELECT s, 'rest', CAST(0.25 AS DOUBLE) FROM x)
SELECT measure, t AS district, round(sum(value * w) / 1000, 6) AS value_k FROM fx_measure JOIN cw ON s = district GROUP BY ALL""", "fx_measure")
def crosswalked(spark, sf):
    m = table(spark, sf, "fx_measure")
    d = m.select("district").distinct()
    main = d.select(F.col("district").alias("source_geography_id"), F.when(F.ascii("district") % 2 == 0, "even").otherwise("odd").alias("target_geography_id"), F.lit(0.75).alias("weight"))
    walk = main.unionByName(d.select(F.col("district").alias("source_geography_id"), F.lit("rest").alias("target_geography_id"), F.lit(0.25).alias("weight")))
    out = targets_.crosswalked(m, walk, "district", "value", ["measure"])
    return out.select("measure", "district", F.round(F.col("value") / 1000, 6).alias("value_k"))


META = "concat('src.', family, '/', target_name)"


@query("""SELECT target_name, geography_level, CASE WHEN family = 'balance' THEN 'named' WHEN family IN ('activity', 'segment') THEN 'plain' WHEN family = 'stress' THEN family ELSE 'src' END AS family,
CASE WHEN family = 'activity' THEN 'plain' WHEN family = 'segment' THEN split_part(target_name, '/', 1) WHEN family = 'stress' THEN family ELSE 'src' END AS loss_family FROM fx_target""", "fx_target")
def classified_targets(spark, sf):
    t = frames.targets(spark, sf)
    level = F.when(F.col("geography_level") == "national", " US ").when(F.col("geography_level") == "district", "Congressional_District").otherwise(F.col("geography_level"))
    family = F.col("family")
    # ids with a dot, an id without a separator, no id (a role alone), and a family that is named
    record = F.when(family == "activity", "plain").when(~family.isin("segment", "stress"), F.concat(F.lit("src."), family, F.lit("/"), F.col("target_name")))
    pairs = [("ledger_source_record_id", record), ("geo_level", level), ("target_family", F.when(family == "balance", "named").when(family.isin("activity", "segment"), "plain")), ("family", F.when(family == "stress", family))]
    m = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    return targets_.classified(t.withColumn("metadata", m)).select("target_name", "geography_level", "family", "loss_family")


@query("SELECT target_name FROM fx_target WHERE geography_level <> 'district'", "fx_target")
def supported_filters(spark, sf):
    t = frames.targets(spark, sf)
    m = F.map_concat("metadata", F.transform_keys("filter", lambda k, _: F.concat(F.lit("ledger_filter_"), k)))
    kept, _ = targets_.unsupported_filters(t.withColumn("metadata", m), ["ledger_filter_state"])
    return kept.select("target_name")


@query("""SELECT family, geography_level, count(*) AS n_targets, CAST(grouping(family, geography_level) AS BIGINT) AS level FROM fx_target GROUP BY ROLLUP (family, geography_level)""", "fx_target")
def target_inventory(spark, sf):
    return targets_.inventory(frames.targets(spark, sf))


# ---- aggregation over runs -------------------------------------------------------------------------------------


def _ci(value: str, name: str = "") -> str:
    p = f"{name}_" if name else ""
    return f"round(avg({value}), 6) AS {p}mean, round(avg({value}) - {T2} * stddev_samp({value}) / sqrt(3), 6) AS {p}lo, round(avg({value}) + {T2} * stddev_samp({value}) / sqrt(3), 6) AS {p}hi, count(DISTINCT seed) AS n_seeds"


ACHIEVED_SQL = """own AS (SELECT method, l2_lambda, budget_requested, avg(value) AS own FROM long WHERE scope = 'run' AND metric = 'budget_achieved' GROUP BY ALL),
ach AS (SELECT o.method, o.l2_lambda, o.budget_requested, CASE WHEN o.method = 'dense_sample' THEN coalesce(l.own, r.own, o.budget_requested) ELSE coalesce(o.own, o.budget_requested) END AS budget_achieved
  FROM own o LEFT JOIN own l ON l.method = 'informed_l0' AND l.l2_lambda = o.l2_lambda AND l.budget_requested = o.budget_requested
  LEFT JOIN own r ON r.method = 'random_reweight' AND r.l2_lambda = o.l2_lambda AND r.budget_requested = o.budget_requested)"""


def _frontier_sql(metric: str) -> str:
    return f""", {ACHIEVED_SQL}, fr AS (SELECT split, method, l2_lambda, budget_requested, {_ci('value')} FROM long WHERE scope = 'overall' AND metric = '{metric}' GROUP BY ALL)
SELECT fr.split, method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(budget_achieved, 6) AS budget_achieved, mean, lo, hi, n_seeds FROM fr JOIN ach USING (method, l2_lambda, budget_requested)"""


@metrics_query(_frontier_sql("mean_are"))
def frontier_mean(spark, sf):
    return rounded(A.frontier(frames.metrics(spark, sf)))


@metrics_query(_frontier_sql("median_are"))
def frontier_median(spark, sf):
    return rounded(A.frontier(frames.metrics(spark, sf), metric="median_are"))


PAIR_SQL = """, p AS (SELECT l2_lambda, budget_requested, seed, avg(value) FILTER (WHERE method = 'informed_l0_refit') AS c, avg(value) FILTER (WHERE method = 'random_reweight') AS b
  FROM long WHERE scope = 'overall' AND metric = 'mean_are' AND split = 'out_of_sample' GROUP BY ALL),
q AS (SELECT l2_lambda, budget_requested, avg(c) AS mc, avg(b) AS mb, avg(c - b) AS md, stddev_samp(c - b) AS sd, count(*) AS n FROM p WHERE c IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
z AS (SELECT *, md / (sd / sqrt(n)) AS t FROM q)"""


@metrics_query(PAIR_SQL + f""" SELECT l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(mc, 6) AS mean_challenger, round(mb, 6) AS mean_baseline, round(md, 6) AS mean_diff, n AS n_pairs,
round(md - {T2} * sd / sqrt(3), 6) AS diff_lo, round(md + {T2} * sd / sqrt(3), 6) AS diff_hi, round(1 - abs(t) / sqrt(2 + t * t), 6) AS p_value, md < 0 AS challenger_better,
md - {T2} * sd / sqrt(3) > 0 OR md + {T2} * sd / sqrt(3) < 0 AS ci_excludes_zero FROM z""")
def paired_difference(spark, sf):
    return rounded(A.paired_difference(frames.metrics(spark, sf), "informed_l0_refit", "random_reweight"))


@metrics_query(f""", s AS (SELECT method, l2_lambda, budget_requested, seed, avg(value) AS v FROM long WHERE scope = 'family' AND metric = 'mean_are' AND split = 'out_of_sample' GROUP BY ALL)
SELECT method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, {_ci('v')} FROM s GROUP BY ALL""")
def macro_average(spark, sf):
    return rounded(A.macro_average(frames.metrics(spark, sf)))


@metrics_query(""" SELECT method, l2_lambda, scope_value AS family, round(avg(value), 6) AS value FROM long WHERE scope = 'family' AND metric = 'mean_are' AND split = 'in_sample' AND budget_requested = 5000 GROUP BY ALL""")
def by_family_at_budget(spark, sf):
    return rounded(A.by_family(frames.metrics(spark, sf), 5000, split="in_sample"))


@metrics_query(f""", {ACHIEVED_SQL}, r AS (SELECT method, l2_lambda, budget_requested, {_ci('value')} FROM long WHERE scope = 'run' AND metric = 'ess' GROUP BY ALL)
SELECT method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(budget_achieved, 6) AS budget_achieved, mean, lo, hi, n_seeds FROM r JOIN ach USING (method, l2_lambda, budget_requested)""")
def run_metric(spark, sf):
    return rounded(A.run_metric(frames.metrics(spark, sf), "ess"))


@metrics_query(""" SELECT l2_lambda, round(avg(value) FILTER (WHERE scope = 'run' AND metric = 'ess'), 6) AS ess, round(avg(value) FILTER (WHERE scope = 'run' AND metric = 'max_weight'), 6) AS max_weight,
round(avg(value) FILTER (WHERE scope = 'overall' AND split = 'in_sample' AND metric = 'mean_are'), 6) AS mean_are_in, round(avg(value) FILTER (WHERE scope = 'overall' AND split = 'out_of_sample' AND metric = 'mean_are'), 6) AS mean_are_out,
round(avg(value) FILTER (WHERE scope = 'overall' AND split = 'out_of_sample' AND metric = 'median_are'), 6) AS median_are_out FROM long WHERE method = 'informed_l0' AND budget_requested = 10000 GROUP BY l2_lambda""")
def operability(spark, sf):
    return rounded(A.operability(frames.metrics(spark, sf), "informed_l0", 10000))


@metrics_query(""", f AS (SELECT split, method, l2_lambda, budget_requested, avg(value) AS m FROM long WHERE scope = 'overall' AND metric = 'mean_are' GROUP BY ALL)
SELECT method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(i.m, 6) AS inside, round(o.m, 6) AS outside, round(o.m - i.m, 6) AS gap
FROM f i JOIN f o USING (method, l2_lambda, budget_requested) WHERE i.split = 'in_sample' AND o.split = 'out_of_sample'""")
def generalization_gap(spark, sf):
    return rounded(A.generalization_gap(frames.metrics(spark, sf)))


ROTATION_SQL = """, rot AS (SELECT l.method, l.seed, l.budget_requested, l.l2_lambda, l.scope_value, l.metric, l.value, k.fold FROM long l JOIN (VALUES ('balance', 0), ('population', 0), ('activity', 1), ('segment', 1), ('forecast', 0), ('forecast', 1)) AS k(family, fold)
  ON k.family = l.scope_value WHERE l.scope = 'family'),
wide AS (SELECT method, l2_lambda, budget_requested, seed, fold, scope_value, avg(value) FILTER (WHERE metric = 'mean_are') AS a, avg(value) FILTER (WHERE metric = 'n') AS n FROM rot GROUP BY ALL),
rs AS (SELECT method, l2_lambda, budget_requested, seed, sum(a * n) FILTER (WHERE scope_value <> 'forecast') / sum(n) FILTER (WHERE scope_value <> 'forecast' AND a IS NOT NULL) AS value,
  CAST(sum(n) FILTER (WHERE scope_value <> 'forecast' AND a IS NOT NULL) AS BIGINT) AS n_targets, count(DISTINCT fold) FILTER (WHERE scope_value <> 'forecast') AS n_folds, CAST(sum(n) FILTER (WHERE scope_value = 'forecast') AS BIGINT) AS n_excluded FROM wide GROUP BY ALL)"""


@metrics_query(ROTATION_SQL + " SELECT method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, seed, round(value, 6) AS value, n_targets, n_folds, n_excluded FROM rs")
def rotation_seed_scores(spark, sf):
    return rounded(A.rotation_seed_scores(frames.rotation(spark, sf), ["forecast"]))


@metrics_query(ROTATION_SQL + f" SELECT method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, {_ci('value')}, max(n_targets) AS n_targets, max(n_folds) AS n_folds FROM rs GROUP BY ALL")
def rotation_frontier(spark, sf):
    return rounded(A.rotation_frontier(frames.rotation(spark, sf), ["forecast"]))


@metrics_query(ROTATION_SQL + """ SELECT fold, string_agg(DISTINCT scope_value, ',' ORDER BY scope_value) AS families, round(avg(value) FILTER (WHERE method = 'informed_l0'), 6) AS informed_l0,
round(avg(value) FILTER (WHERE method = 'dense_sample'), 6) AS dense_sample FROM rot WHERE metric = 'mean_are' GROUP BY fold""")
def rotation_table(spark, sf):
    return rounded(report.rotation_table(frames.rotation(spark, sf), ["informed_l0", "dense_sample"]).withColumn("families", F.concat_ws(",", "families")))


@query(f"""WITH d AS (SELECT *, {RAW} AS e FROM fx_diag WHERE l2_lambda = 0 AND split = 'in_sample'), m AS (SELECT method, budget_requested, target_name, family, is_degenerate, avg(e) AS mean_are FROM d WHERE e IS NOT NULL GROUP BY ALL),
r AS (SELECT *, mean_are / sum(mean_are) OVER (PARTITION BY method, budget_requested) AS share, row_number() OVER (PARTITION BY method, budget_requested ORDER BY mean_are DESC, target_name) AS rank FROM m)
SELECT method, budget_requested, target_name, family, is_degenerate, round(mean_are, 6) AS mean_are, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""", "fx_diag")
def top_contributors(spark, sf):
    return rounded(A.top_contributors(frames.diagnostics(spark, sf), 5, l2=0.0, split="in_sample"))


@metrics_query(""", pick AS (SELECT budget_requested, count(DISTINCT l2_lambda) AS g FROM long WHERE scope = 'run' AND metric = 'ess' AND method = 'informed_l0' GROUP BY 1), rich AS (SELECT list(budget_requested ORDER BY budget_requested) AS b FROM pick WHERE g = (SELECT max(g) FROM pick))
SELECT 'out_of_sample' AS split, 'informed_l0_refit' AS method, CAST(b[len(b) // 2 + 1] AS BIGINT) AS budget_requested FROM rich""")
def headline(spark, sf):
    m = frames.metrics(spark, sf)
    return A.headline_split(m).crossJoin(A.headline_method(m)).crossJoin(A.anchor_budget(m))  # one row each


# ---- run state -------------------------------------------------------------------------------------------------


@metrics_query(""" SELECT holdout_type, fold, seed, CAST(budget_requested AS BIGINT) AS budget_requested, l2_lambda FROM long WHERE scope = 'run' AND metric = 'budget_achieved' AND NOT (method = 'informed_l1' AND seed = 2)
AND method IN ('informed_l0', 'informed_l1') GROUP BY ALL HAVING count(DISTINCT method) = 2""")
def completed_cells(spark, sf):
    m = frames.metrics(spark, sf).where("not (method = 'informed_l1' and seed = 2)")
    return runs.completed_cells(m, ["informed_l0", "informed_l1"])


@metrics_query(""" SELECT DISTINCT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested, l2_lambda FROM long WHERE method = 'informed_l1' AND seed = 2""")
def pending_work(spark, sf):
    m = frames.metrics(spark, sf)
    done = runs.completed_methods(m.where("not (method = 'informed_l1' and seed = 2)"))
    requested = runs.grid(spark, method=["informed_l0", "informed_l1"], seed=[0, 1, 2]).withColumn("seed", F.col("seed").cast("int")).crossJoin(m.select("budget_requested", "l2_lambda").distinct())
    return runs.pending(requested, done, RUN).select(*RUN)


@metrics_query(""" SELECT DISTINCT holdout_type, fold, seed, CAST(budget_requested AS BIGINT) AS budget_requested, l2_lambda,
CASE WHEN seed = 0 OR seed = 1 THEN CAST(budget_requested - 10 * seed - 1 AS BIGINT) ELSE CAST(budget_requested AS BIGINT) END AS matched_budget FROM long""")
def matched_budgets(spark, sf):
    m = frames.metrics(spark, sf)
    found = runs.achieved_budgets(m)
    return runs.matched_budgets(m.select(*runs.CELL).distinct(), found.where("seed = 0"), found.where("seed = 1"))


@metrics_query(""" SELECT method, scope, metric, count(*) AS n FROM long WHERE seed < 2 GROUP BY ALL""")
def append_new_rows(spark, sf):
    m = frames.metrics(spark, sf)
    return runs.append_new(m.where("seed = 0"), m.where("seed = 1").unionByName(m.where("seed = 0"))).groupBy("method", "scope", "metric").agg(F.count("*").alias("n"))


@metrics_query(""" SELECT concat('seed', seed) AS shard, count(*) AS n, round(sum(value) / 1000, 5) AS total_k FROM long GROUP BY ALL""")
def merged_runs(spark, sf):
    m = frames.metrics(spark, sf)
    configs = spark.createDataFrame([(f"seed{s}", k, v) for s in range(3) for k, v in (("epochs", "120"), ("seed", str(s)))], "run_id string, key string, value string")
    merged = runs.merge_single({f"seed{s}": m.where(F.col("seed") == s) for s in range(3)}, configs, "seed", [])
    counts = merged.groupBy("shard").agg(F.count("*").alias("declared"))
    return runs.certify(merged, counts).groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("value") / 1000, 5).alias("total_k"))


@query("SELECT 'targets.n' AS key, CAST((SELECT count(*) FROM fx_target) AS VARCHAR) AS left_value, CAST((SELECT count(*) FROM fx_record) AS VARCHAR) AS right_value", "fx_target")
def config_difference(spark, sf):
    n = table(spark, sf, "fx_target").agg(F.count("*").cast("string").alias("value"))
    m = table(spark, sf, "fx_record").agg(F.count("*").cast("string").alias("value"))
    row = lambda run, df: df.select(F.lit(run).alias("run_id"), F.lit("targets.n").alias("key"), "value")
    more = spark.createDataFrame([("a", "seed", "0"), ("b", "seed", "1"), ("a", "z", "1"), ("b", "z", "2")], "run_id string, key string, value string")
    return runs.first_difference(row("a", n).unionByName(row("b", m)).unionByName(more), "a", "b", ["seed"])


@query()
def table_fingerprints(spark, sf):
    out = None
    for name in ("customer", "orders", "lineitem"):
        one = runs.fingerprint(spark.read.parquet(f"{sf}/{name}.parquet")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "n", F.col("xor").cast("string").alias("xor"), F.col("total").cast("string").alias("total"))


# ---- reports ---------------------------------------------------------------------------------------------------


@metrics_query(""" SELECT CAST(budget_requested AS BIGINT) AS budget_requested, l2_lambda, round(avg(value) FILTER (WHERE method = 'informed_l0'), 6) AS informed_l0, round(avg(value) FILTER (WHERE method = 'dense_sample'), 6) AS dense_sample
FROM long WHERE scope = 'overall' AND metric = 'mean_are' AND split = 'in_sample' GROUP BY ALL""")
def raw_metric_table(spark, sf):
    return rounded(report.raw_metric_table(frames.metrics(spark, sf), "mean_are", ["informed_l0", "dense_sample"], "in_sample"))


@metrics_query(""" SELECT split, method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(avg(value) FILTER (WHERE metric = 'mean_are'), 6) AS mean_are, round(avg(value) FILTER (WHERE metric = 'mean_are_ex_degenerate'), 6) AS mean_are_ex_degenerate,
round(avg(value) FILTER (WHERE metric = 'median_are'), 6) AS median_are, round(avg(value) FILTER (WHERE metric = 'n_degenerate'), 6) AS n_degenerate FROM long WHERE scope = 'overall' GROUP BY ALL""")
def degenerate_sensitivity(spark, sf):
    return rounded(report.degenerate_sensitivity(frames.metrics(spark, sf)))


@metrics_query(""" SELECT l2_lambda, scope_value AS geography_level, round(avg(value) FILTER (WHERE metric = 'mean_are'), 6) AS mean_are, round(avg(value) FILTER (WHERE metric = 'median_are'), 6) AS median_are,
round(avg(value) FILTER (WHERE metric = 'max_are'), 6) AS max_are, round(avg(value) FILTER (WHERE metric = 'n'), 6) AS n FROM long WHERE scope = 'geography' AND split = 'out_of_sample' AND method = 'informed_l0' AND budget_requested = 10000 GROUP BY ALL""")
def geography_at_anchor(spark, sf):
    return rounded(report.geography_at_anchor(frames.metrics(spark, sf), "informed_l0", 10000, "out_of_sample"))


@metrics_query(""", m AS (SELECT method, split, round(avg(value) FILTER (WHERE metric = 'median_are'), 6) AS median_are, round(avg(value) FILTER (WHERE metric = 'mean_are'), 6) AS mean_are FROM long WHERE scope = 'overall' AND budget_requested = 10000 AND l2_lambda = 0 GROUP BY ALL),
r AS (SELECT method, round(avg(value) FILTER (WHERE metric = 'ess'), 6) AS ess, round(avg(value) FILTER (WHERE metric = 'max_weight'), 6) AS max_weight FROM long WHERE scope = 'run' AND budget_requested = 10000 AND l2_lambda = 0 GROUP BY ALL)
SELECT * FROM m JOIN r USING (method)""")
def anchor_comparison(spark, sf):
    return rounded(report.anchor_comparison(frames.metrics(spark, sf), 10000))


@query(f"""WITH s AS (SELECT l2_lambda, budget_requested, method, sum(least(abs(achieved_value - target_value) / scale, CAST(1 AS DOUBLE)) * loss_weight) / sum(loss_weight) AS o FROM fx_diag GROUP BY ALL)
SELECT c.l2_lambda, c.budget_requested, c.method AS challenger, b.method AS baseline, round(c.o, 6) AS challenger_objective, round(b.o, 6) AS baseline_objective, round(c.o - b.o, 6) AS difference, round((c.o - b.o) / b.o, 6) AS relative_change
FROM s c JOIN s b ON c.l2_lambda = b.l2_lambda AND c.budget_requested = b.budget_requested WHERE c.method = 'informed_l0_refit' AND b.method IN ('random_reweight', 'informed_l0')""", "fx_diag")
def loss_comparison(spark, sf):
    pairs = [("informed_l0_refit", "random_reweight"), ("informed_l0_refit", "informed_l0")]
    out = report.loss_comparison(frames.diagnostics(spark, sf), pairs, ["l2_lambda", "budget_requested"])
    return rounded(out.select("l2_lambda", "budget_requested", "challenger", "baseline", "challenger_objective", "baseline_objective", "difference", "relative_change"))


@metrics_query(f""", fr AS (SELECT method, l2_lambda, budget_requested, avg(value) AS m, {T2} * stddev_samp(value) / sqrt(3) AS h FROM long WHERE scope = 'overall' AND metric = 'mean_are' AND split = 'out_of_sample' AND method IN ('informed_l0', 'dense_sample') GROUP BY ALL),
c AS (SELECT *, printf('%.4f [%.4f, %.4f]', m, m - h, m + h) AS cell FROM fr)
SELECT CAST(budget_requested AS BIGINT) AS budget_requested, CAST(budget_requested AS DOUBLE) AS shown_budget, max(cell) FILTER (WHERE method = 'informed_l0' AND l2_lambda = 0) AS l0_free, max(cell) FILTER (WHERE method = 'dense_sample' AND l2_lambda > 0) AS dense_l2 FROM c GROUP BY ALL""")
def frontier_pivot(spark, sf):
    out = report.frontier_pivot(A.frontier(frames.metrics(spark, sf)), "out_of_sample", ["informed_l0", "dense_sample"], [0.0, 0.0001])
    return out.select("budget_requested", "shown_budget", F.col("`informed_l0_0.0`").alias("l0_free"), F.col("`dense_sample_0.0001`").alias("dense_l2"))


@metrics_query(""" SELECT DISTINCT method, CASE method WHEN 'informed_l0_refit' THEN 'L0 + refit' WHEN 'informed_l0' THEN 'L0' WHEN 'informed_l1' THEN 'L1' WHEN 'random_reweight' THEN 'Random + reweight' ELSE 'Dense, sampled' END AS label,
concat(CAST(budget_requested // 1000 AS VARCHAR), 'k') AS budget, CAST(budget_requested AS BIGINT) AS budget_requested FROM long""")
def labels(spark, sf):
    m = frames.metrics(spark, sf).select("method", "budget_requested").distinct()
    return m.select("method", T.method_label(F.col("method")).alias("label"), T.budget_label(F.col("budget_requested")).alias("budget"), "budget_requested")


@metrics_query(""" SELECT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested, l2_lambda, CASE WHEN scope = 'overall' THEN 'total' ELSE scope_value END AS level,
round(max(value) FILTER (WHERE metric = 'n'), 6) AS n, round(max(value) FILTER (WHERE metric = 'mean_are'), 6) AS mean_are, round(max(value) FILTER (WHERE metric = 'median_are'), 6) AS median_are,
round(max(value) FILTER (WHERE metric = 'max_are'), 6) AS max_are FROM long WHERE split = 'in_sample' AND scope IN ('overall', 'geography') GROUP BY ALL""")
def accuracy_by_geography(spark, sf):
    out = report.accuracy_by(frames.scores(spark, sf).where("split = 'in_sample'"), RUN, "geography")
    return rounded(out.withColumns({"n": F.col("n").cast("double"), "budget_requested": F.col("budget_requested").cast("long")}))


@metrics_query(""" SELECT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested, l2_lambda, CASE WHEN scope = 'overall' THEN 'total' ELSE scope_value END AS level,
round(max(value) FILTER (WHERE metric = 'n'), 6) AS n, round(max(value) FILTER (WHERE metric = 'mean_are'), 6) AS mean_are, round(max(value) FILTER (WHERE metric = 'median_are'), 6) AS median_are,
round(max(value) FILTER (WHERE metric = 'max_are'), 6) AS max_are FROM long WHERE split = 'out_of_sample' AND scope IN ('overall', 'family') GROUP BY ALL""")
def accuracy_by_family(spark, sf):
    out = report.accuracy_by(frames.scores(spark, sf).where("split = 'out_of_sample'"), RUN, "family")
    return rounded(out.withColumns({"n": F.col("n").cast("double"), "budget_requested": F.col("budget_requested").cast("long")}))


@metrics_query(PAIR_SQL + f""", c AS (SELECT *, md - {T2} * sd / sqrt(3) AS lo, md + {T2} * sd / sqrt(3) AS hi FROM q)
SELECT l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, printf('%.4f [%.4f, %.4f]', md, lo, hi) AS cell FROM c""")
def paired_rows(spark, sf):
    return report.paired_rows(A.paired_difference(frames.metrics(spark, sf), "informed_l0_refit", "random_reweight")).select("l2_lambda", "budget_requested", "cell")


@metrics_query(""", p AS (SELECT metric, l2_lambda, budget_requested, seed, avg(value) FILTER (WHERE method = 'informed_l0_refit') - avg(value) FILTER (WHERE method = 'random_reweight') AS d
  FROM long WHERE scope = 'overall' AND metric IN ('mean_are', 'median_are') AND split = 'out_of_sample' GROUP BY ALL)
SELECT l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(avg(d) FILTER (WHERE metric = 'median_are'), 6) AS median_are_mean_diff, round(avg(d) FILTER (WHERE metric = 'mean_are'), 6) AS mean_are_mean_diff FROM p GROUP BY ALL""")
def paired_median_and_mean(spark, sf):
    out = report.paired_median_and_mean(frames.metrics(spark, sf), "informed_l0_refit", "random_reweight")
    return rounded(out.select("l2_lambda", "budget_requested", "median_are_mean_diff", "mean_are_mean_diff"))


@metrics_query(""" SELECT CAST(budget_requested AS BIGINT) AS budget_requested, round(avg(value), 6) AS budget_achieved FROM long WHERE scope = 'run' AND metric = 'budget_achieved' AND method = 'informed_l0' GROUP BY ALL""")
def presets(spark, sf):
    return rounded(report.presets(frames.metrics(spark, sf)).select("budget_requested", "budget_achieved"))


@query("""SELECT target_name, family, round(abs(achieved - value) / greatest(abs(value), 1), 6) AS scaled_error, round(sqrt(greatest(abs(value), 1)) / 1000, 6) AS loss_weight_k
FROM (SELECT t.*, coalesce(sum(m.value * w0), 0) AS achieved FROM fx_target t LEFT JOIN fx_matrix m USING (target_name) GROUP BY ALL)""".replace("t.*, coalesce", "t.target_name, t.family, t.value, coalesce"), "fx_matrix", "fx_target")
def weighted_diagnostics(spark, sf):
    t, w = frames.targets(spark, sf), table(spark, sf, "fx_record").select("record_id", "w0")
    run = spark.createDataFrame([("start",)], "method string")
    scored = matrix.achieved(t, run, matrix.estimates(frames.built_matrix(spark, sf), w.select(F.lit("start").alias("method"), "record_id", F.col("w0").alias("weight")), ["method"]), ["method"])
    weights = t.select("target_name", F.sqrt(F.greatest(F.abs("value"), F.lit(1.0))).alias("loss_weight"))
    d = score.target_diagnostics(scored.drop("loss_weight"), weights)
    return d.select("target_name", "family", F.round(F.col("absolute_error") / F.col("scale"), 6).alias("scaled_error"), F.round(F.col("loss_weight") / 1000, 6).alias("loss_weight_k"))


@query("""SELECT record_id, method, seed, budget_requested, round(weight, 6) AS weight FROM fx_weight WHERE method = 'informed_l1'""", "fx_weight")
def stored_weights(spark, sf):
    """Weight vectors of some runs written as partitions and read back for two cells."""
    from ..sources import tables

    w = table(spark, sf, "fx_weight").where("method = 'informed_l1'").withColumns({"holdout_type": F.lit("fixed_family"), "fold": F.lit(-1), "l2_lambda": F.lit(0.0)})
    path = f"{tables.shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    tables.write_weights(w, path)
    done = w.select("method", "seed", "budget_requested").distinct()
    cells = sorted((r["seed"], r["budget_requested"]) for r in done.collect())
    parts = [tables.read_weights(spark, path, done, method="informed_l1", seed=s, budget_requested=b) for s, b in cells]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("record_id", "method", F.col("seed").cast("int").alias("seed"), F.col("budget_requested").cast("int").alias("budget_requested"), F.round("weight", 6).alias("weight"))


@query("SELECT record_id, {U(concat('draw:1:', record_id))} AS u, round(sqrt(-2 * ln({U(concat('z:1:', record_id, ':r'))})) * cos(2 * pi() * {U(concat('z:1:', record_id, ':a'))}), 6) AS z FROM fx_record", "fx_record")
def hash_uniforms(spark, sf):
    from ..functions.rand import standard_normal

    return table(spark, sf, "fx_record").select("record_id", uniform("draw", 1, F.col("record_id")).alias("u"), F.round(standard_normal("z", 1, F.col("record_id")), 6).alias("z"))


# ---- calibration -----------------------------------------------------------------------------------------------

FITTED = ("balance", "population", "activity", "segment")


def _problem(spark, sf, options):
    """Fit targets of the fixture, their matrix and start weights, written once for all fits of a query."""
    t = frames.targets(spark, sf).where(F.col("family").isin(*FITTED))
    t = spark.createDataFrame(t.collect(), t.schema)
    m = frames.kept(matrix.constraint_matrix(frames.universe(spark, sf), t), "matrix")
    w = frames.kept(table(spark, sf, "fx_record").select("record_id", "w0"), "records")
    return m, w, t, K.Problem.build(m, w, t, None, options.partitions)


def _options(epochs, **more):
    return K.Options(epochs=epochs, rate=0.15, cap=1.0, **more)


def _dense_sql(epochs: int, rate: float = 0.15, cap: float = 1.0) -> str:
    """The epochs of a dense fit written out: estimates, slopes by target, a step of Adam for each record's log weight."""
    fitted = ", ".join(f"'{f}'" for f in FITTED)
    out = [f"""mx AS (SELECT m.target_name, record_id, m.value FROM fx_matrix m JOIN fx_target t USING (target_name) WHERE t.family IN ({fitted}) AND m.value <> 0),
tg AS (SELECT target_name, value, greatest(abs(value), 1) AS scale, 1.0::DOUBLE / count(*) OVER () AS share FROM fx_target WHERE family IN ({fitted})),
s0 AS (SELECT record_id, ln(w0) AS theta, 0::DOUBLE AS m, 0::DOUBLE AS v FROM fx_record)"""]
    for k in range(epochs):
        t = k + 1
        out.append(f"""e{k} AS (SELECT target_name, sum(value * exp(theta)) AS est FROM mx JOIN s{k} USING (record_id) GROUP BY 1),
d{k} AS (SELECT target_name, CASE WHEN abs((coalesce(est, 0) - value) / scale) < {cap} THEN sign(coalesce(est, 0) - value) * share / scale ELSE 0 END AS slope FROM tg LEFT JOIN e{k} USING (target_name)),
g{k} AS (SELECT record_id, sum(value * slope) AS g FROM mx JOIN d{k} USING (target_name) GROUP BY 1),
a{k} AS (SELECT record_id, theta, 0.9::DOUBLE * m + 0.1::DOUBLE * coalesce(g, 0) * exp(theta) AS m, 0.999::DOUBLE * v + 0.001::DOUBLE * pow(coalesce(g, 0) * exp(theta), 2) AS v FROM s{k} LEFT JOIN g{k} USING (record_id)),
s{t} AS (SELECT record_id, theta - {rate}::DOUBLE * (m / (1 - pow(0.9::DOUBLE, {t}))) / (sqrt(v / (1 - pow(0.999::DOUBLE, {t}))) + 1e-12::DOUBLE) AS theta, m, v FROM a{k})""")
    return "WITH " + ",\n".join(out) + f"\nSELECT record_id, round(exp(theta), 3) AS weight FROM s{epochs}"


@query(_dense_sql(40), "fx_matrix", "fx_target", "fx_record")
def calibrate_dense(spark, sf):
    o = _options(40)
    return K.calibrate_dense(_problem(spark, sf, o)[3], o).weights.select("record_id", F.round("weight", 3).alias("weight"))


@query("SELECT count(*) AS n_records, true AS near_budget, true AS refit_inside, true AS refit_better, true AS ended FROM fx_record", "fx_record")
def calibrate_l0(spark, sf):
    o = _options(120)
    m, w, t, p = _problem(spark, sf, o)
    budget = p.n // 3
    found = K.informed_l0_at_budget(p, o, budget, shares=(1.0, 30.0), tolerance=budget // 50, open_at_start=0.8)
    selection = K.weights_of(found.fit, found.configuration)
    full, refit = K.post_selection_refit(m, w, t, selection, o)
    outside = full.where("weight > 0").join(selection, "record_id", "left_anti").count()
    least = min(gap for _, _, _, gap in found.tries)
    return spark.createDataFrame([(full.count(), found.gap <= 0.02 * budget, outside == 0, refit.loss[0] < found.fit.loss[found.configuration], found.gap == least)], "n_records long, near_budget boolean, refit_inside boolean, refit_better boolean, ended boolean")


@query("SELECT count(*) AS n_records, CAST(count(*) // 2 AS BIGINT) AS budget, true AS near_budget, true AS finite_loss FROM fx_record", "fx_record")
def calibrate_l1(spark, sf):
    """To a hundredth of the budget."""
    o = _options(60)
    _, w, _, p = _problem(spark, sf, o)
    budget = p.n // 2
    found = K.informed_l1_at_budget(p, o, budget, tolerance=budget // 100)
    full = U.to_full(w, K.weights_of(found.fit, found.configuration))
    return spark.createDataFrame([(full.count(), budget, abs(full.where("weight > 0").count() - budget) <= 0.01 * budget, 0 <= found.fit.loss[found.configuration] <= 1)], "n_records long, budget long, near_budget boolean, finite_loss boolean")


def _l1_round(name: str, epochs: int, rate: float = 0.15, cap: float = 1.0) -> str:
    """Epochs of soft-threshold steps at each penalty of the clause grid_<name> (k, penalty), written out, and the counts that they keep."""
    out = [f"{name}0 AS (SELECT k, penalty, record_id, w0, w0 AS w FROM fx_record CROSS JOIN grid_{name})"]
    for t in range(epochs):
        step = rate / (1 + t) ** 0.5
        out.append(f"""{name}e{t} AS (SELECT k, target_name, sum(value * w) AS est FROM mx JOIN {name}{t} USING (record_id) GROUP BY ALL),
{name}d{t} AS (SELECT k, target_name, CASE WHEN abs((est - value) / scale) < {cap} THEN sign(est - value) * share / scale ELSE 0 END AS slope FROM tg JOIN {name}e{t} USING (target_name)),
{name}g{t} AS (SELECT k, record_id, sum(value * slope) AS g FROM mx JOIN {name}d{t} USING (target_name) GROUP BY ALL),
{name}{t + 1} AS (SELECT k, penalty, record_id, w0, greatest(w / w0 - {step!r}::DOUBLE * n * coalesce(g, 0) * w0 - {step!r}::DOUBLE * penalty, 0) * w0 AS w FROM {name}{t} LEFT JOIN {name}g{t} USING (k, record_id) CROSS JOIN size)""")
    out.append(f"kept_{name} AS (SELECT k, penalty, count(*) FILTER (WHERE w > 0) AS retained FROM {name}{epochs} GROUP BY ALL)")
    return ",\n".join(out)


def _l1_search_sql(epochs: int = 4, width: int = 4, low: float = 1e-3, high: float = 1e2) -> str:
    """Two rounds of the search: the second one's grid lies between the neighbours of the first crossing of the first."""
    fitted = ", ".join(f"'{f}'" for f in FITTED)
    grid = f"(SELECT i AS k, pow(10, lo + (hi - lo) * (i + 1) / {width + 1}) AS penalty FROM {{ends}} CROSS JOIN range({width}) AS r(i))"
    return f"""WITH mx AS (SELECT m.target_name, record_id, m.value FROM fx_matrix m JOIN fx_target t USING (target_name) WHERE t.family IN ({fitted}) AND m.value <> 0),
tg AS (SELECT target_name, value, greatest(abs(value), 1) AS scale, 1.0::DOUBLE / count(*) OVER () AS share FROM fx_target WHERE family IN ({fitted})),
size AS (SELECT count(*) AS n, CAST(count(*) // 2 AS BIGINT) AS budget FROM fx_record),
ends_a AS (SELECT log10({low}::DOUBLE) AS lo, log10({high}::DOUBLE) AS hi),
grid_a AS {grid.format(ends="ends_a")},
{_l1_round("a", epochs)},
crossed AS (SELECT coalesce(min(k) FILTER (WHERE retained <= budget), {width}) AS k FROM kept_a CROSS JOIN size),
ends_b AS (SELECT coalesce(max(log10(penalty)) FILTER (WHERE a.k = c.k - 1), log10({low}::DOUBLE)) AS lo, coalesce(max(log10(penalty)) FILTER (WHERE a.k = c.k), log10({high}::DOUBLE)) AS hi FROM kept_a a CROSS JOIN crossed c),
grid_b AS {grid.format(ends="ends_b")},
{_l1_round("b", epochs)},
tries AS (SELECT 0 AS round, * FROM kept_a UNION ALL SELECT 1, * FROM kept_b)
SELECT round AS search_round, CAST(k AS BIGINT) AS nth, round(log10(penalty), 6) AS log_penalty, retained, abs(retained - budget) AS gap, row_number() OVER (ORDER BY abs(retained - budget), round, k) = 1 AS chosen FROM tries CROSS JOIN size"""


@query(_l1_search_sql(), "fx_matrix", "fx_target", "fx_record")
def l1_search(spark, sf):
    """All tries of a search of two rounds, and the one that won."""
    o = _options(4)
    p = _problem(spark, sf, o)[3]
    run = lambda grid: K.fit(p, [K.Config("informed_l1", 0, l1=g) for g in grid], o)
    # a bracket of five decades is cut to a fifth twice; nothing is near enough to end it earlier
    found = K.search_penalty(run, 1e-3, 1e2, p.n // 2, width=4, empty=False, tolerance=-1, narrow=10**0.21)
    nth, rows = {}, []
    for round_, penalty, retained, gap in found.tries:
        k = nth[round_] = nth.get(round_, -1) + 1
        rows.append((round_, k, round(float(np.log10(penalty)), 6), retained, gap, penalty == found.penalty))
    return spark.createDataFrame(rows, "search_round int, nth long, log_penalty double, retained long, gap long, chosen boolean")


@query("SELECT count(*) AS n_records, CAST(count(*) // 3 AS BIGINT) AS n_selected, round(sum(w0), 3) AS mass, true AS loss_fell FROM fx_record", "fx_record")
def calibrate_random(spark, sf):
    o = _options(30, mass="conserve")
    m, w, t, _ = _problem(spark, sf, o)
    full, got = K.random_reweight(m, w, t, w.count() // 3, 1, o)
    return spark.createDataFrame([(full.count(), got.retained[0], round(full.agg(F.sum("weight")).first()[0], 3), got.loss[0] < got.history[0][2])], "n_records long, n_selected long, mass double, loss_fell boolean")


@query(_dense_sql(4).rsplit("SELECT record_id", 1)[0].rstrip() + """, w AS (SELECT record_id, exp(theta) AS weight FROM s4), line AS (SELECT *, sum(weight) OVER (ORDER BY floor({U(concat('slice:4:', record_id))} * 4096), record_id) - weight AS begin FROM w),
t AS (SELECT sum(weight) AS total, count(*) AS n FROM w), b AS (SELECT CAST(n // k AS BIGINT) AS budget, total FROM t CROSS JOIN (VALUES (2), (5)) AS v(k)),
d AS (SELECT r.i, {U(concat('draw:4:', r.i))} * total AS at FROM t, range(CAST((SELECT max(budget) FROM b) AS BIGINT)) AS r(i)), hit AS (SELECT d.i, l.record_id FROM d ASOF JOIN line l ON d.at >= l.begin)
SELECT budget, record_id, count(*) AS draws, round(count(*) * max(total) / budget, 3) AS weight FROM hit JOIN b ON i < budget GROUP BY budget, record_id""", "fx_matrix", "fx_target", "fx_record")
def calibrate_dense_sample(spark, sf):
    """One dense fit, drawn at two budgets, draw by draw."""
    o = _options(4)
    p = _problem(spark, sf, o)[3]
    _, sampled = K.dense_then_sample(p, [p.n // 2, p.n // 5], 4, o)
    return sampled.select("budget", "record_id", "draws", F.round("weight", 3).alias("weight"))


@query("SELECT count(*) AS n_targets, true AS capped_below_uncapped, CAST(4 AS BIGINT) AS n_methods FROM fx_target WHERE family IN ('balance', 'population', 'activity', 'segment')", "fx_target")
def fixed_penalty_comparison(spark, sf):
    o = _options(25)
    m, w, t, _ = _problem(spark, sf, o)
    weights, found = pipelines.compare_at_penalty(m, w, t, 1.0, 0, o)
    d, _ = pipelines.score_methods(m, t, t.limit(0), weights, found, ["method"])
    d = frames.kept(d, "scored")
    capped, free = (objective.summarize(d, ["method"], cap=c).agg(F.sum("objective")).first()[0] for c in (1.0, None))
    return spark.createDataFrame([(d.select("target_name").distinct().count(), capped <= free + 1e-12, found.count())], "n_targets long, capped_below_uncapped boolean, n_methods long")


@query("SELECT 'dropped_columns' AS key, CAST(1 AS BIGINT) AS value UNION ALL SELECT 'records', CAST(count(*) // 2 AS BIGINT) FROM fx_record UNION ALL SELECT 'targets', count(*) FROM fx_target UNION ALL SELECT 'unsupported_targets', CAST(0 AS BIGINT)", "fx_target")
def precalibration(spark, sf):
    u = frames.universe(spark, sf)
    base = frames.targets(spark, sf)
    years = spark.createDataFrame([(2023,), (2024,), (2025,)], "vintage int")
    facts = base.crossJoin(F.broadcast(years)).withColumn("aggregate_fact_key", F.concat_ws(":", "target_name", "vintage"))
    merged = targets_.merged_facts(facts.where("vintage < 2025"), facts.where("vintage = 2025"))
    _, _, _, audit = pipelines.precalibrate(u, merged, 2024, ["target_name"], ["state", "district"], households=u.weights.count() // 2, seed=2, drop=["segment"])
    return audit


# ---- resumable sweeps ------------------------------------------------------------------------------------------

HELD = ("orders", "forecast")
SHOWN = "printf('%.6e', value)"

SWEEP_SQL = """est AS (SELECT method, seed, budget_requested, target_name, sum(m.value * w.weight) AS achieved FROM fx_matrix m JOIN fx_weight w USING (record_id) GROUP BY ALL),
ran AS (SELECT DISTINCT method, seed, budget_requested FROM fx_weight),
d AS (SELECT r.method, r.seed, r.budget_requested, family, geography_level, CASE WHEN family IN ('orders', 'forecast') THEN 'out_of_sample' ELSE 'in_sample' END AS split,
  CASE WHEN t.value <> 0 THEN abs(coalesce(achieved, 0) - t.value) / abs(t.value) END AS e, abs(t.value) < identifiability_floor AS bad
  FROM ran r CROSS JOIN fx_target t LEFT JOIN est ON est.method = r.method AND est.seed = r.seed AND est.budget_requested = r.budget_requested AND est.target_name = t.target_name),
g AS (SELECT method, seed, budget_requested, split, CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(geography_level) = 0 THEN 'geography' ELSE 'overall' END AS scope,
  CASE WHEN grouping(family) = 0 THEN family WHEN grouping(geography_level) = 0 THEN geography_level ELSE '' END AS scope_value, avg(e) AS mean_are, median(e) AS median_are, max(e) AS max_are, CAST(count(e) AS DOUBLE) AS n,
  avg(e) FILTER (WHERE NOT bad) AS mean_are_ex_degenerate, CAST(count(e) FILTER (WHERE bad) AS DOUBLE) AS n_degenerate
  FROM d GROUP BY GROUPING SETS ((method, seed, budget_requested, split), (method, seed, budget_requested, split, family), (method, seed, budget_requested, split, geography_level)) HAVING count(e) > 0),
own AS (SELECT method, seed, budget_requested, CAST(count(*) AS DOUBLE) AS n_selected, CAST(count(*) AS DOUBLE) AS n_unique_selected, CAST(count(*) AS DOUBLE) AS budget_achieved, sum(weight) AS sum_weight, sum(weight) * sum(weight) / sum(weight * weight) AS ess,
  avg(weight) AS mean_weight, max(weight) AS max_weight, quantile_cont(weight, 0.5) AS p50_weight, quantile_cont(weight, 0.9) AS p90_weight, quantile_cont(weight, 0.99) AS p99_weight, 1.0::DOUBLE / count(*) AS l0_lambda, avg(weight) / 1000 AS final_loss FROM fx_weight WHERE weight > 0 GROUP BY ALL),
tails AS (SELECT method, seed, budget_requested, CAST(count(e) AS DOUBLE) AS holdout_n_scored, CAST(count(*) FILTER (WHERE e > 1) AS DOUBLE) AS holdout_n_are_gt_1, CAST(count(*) FILTER (WHERE e > 5) AS DOUBLE) AS holdout_n_are_gt_5 FROM d WHERE split = 'out_of_sample' GROUP BY ALL),
tall AS (UNPIVOT g ON mean_are, median_are, max_are, n, mean_are_ex_degenerate, n_degenerate INTO NAME metric VALUE value),
of_run AS (UNPIVOT (SELECT * FROM own JOIN tails USING (method, seed, budget_requested)) ON n_selected, n_unique_selected, budget_achieved, sum_weight, ess, mean_weight, max_weight, p50_weight, p90_weight, p99_weight, l0_lambda, final_loss, holdout_n_scored, holdout_n_are_gt_1, holdout_n_are_gt_5 INTO NAME metric VALUE value),
swept AS (SELECT method, seed, budget_requested, split, scope, scope_value, metric, value FROM tall WHERE scope = 'overall' OR metric NOT IN ('mean_are_ex_degenerate', 'n_degenerate')
  UNION ALL SELECT method, seed, budget_requested, 'na', 'run', '', metric, value FROM of_run)"""


def _told(weights: DataFrame) -> DataFrame:
    """What runs report of themselves: a penalty and a loss that their weights decide."""
    return weights.groupBy(*RUN).agg((F.lit(1.0) / F.count("*")).alias("l0_lambda"), (F.avg("weight") / 1000).alias("final_loss"))


def _swept(spark, sf):
    """(scoring arguments by seed) of the fixture's weight vectors."""
    t = frames.targets(spark, sf)
    built = frames.built_matrix(spark, sf)
    w = frames.weights(spark, sf).withColumn("l2_lambda", F.lit(0.0))
    degenerate = frames.kept(matrix.degenerate_names(t, matrix.identifiability_floors(built, table(spark, sf, "fx_record"))), "degenerate")
    told = frames.kept(_told(w), "told")
    fitted, held = t.where(~F.col("family").isin(*HELD)), t.where(F.col("family").isin(*HELD))

    def of(seed: int) -> tuple:
        mine = w.where(F.col("seed") == seed)
        return built, fitted, held, mine, told.where(F.col("seed") == seed), "fixed_family", -1, degenerate

    return of


def _folder(spark, name: str) -> str:
    return f"{frames.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {SWEEP_SQL} SELECT concat('seed-', seed) AS shard, method, CAST(budget_requested AS BIGINT) AS budget_requested, split, scope, scope_value, metric, {SHOWN} AS value FROM swept", "fx_matrix", "fx_target", "fx_weight")
def resumed_sweep(spark, sf):
    """A sweep that stops between the two steps of a commit, goes on, and runs once more without effect."""
    of, state = _swept(spark, sf), sweep.shards(spark, _folder(spark, "sweep"))
    sweep.score_and_append(state, "seed-0", *of(0))
    tables_, held = sweep.scored_tables(*of(1))
    state.write("seed-1", {"metrics": tables_["metrics"].limit(10)})  # the job dies here: data, but no index row
    frames.dropped(held)
    for _ in range(2):
        for shard in state.pending(["seed-0", "seed-1"]):
            sweep.score_and_append(state, shard, *of(int(shard[-1])))
    out = state.certified("metrics")
    return out.select("shard", "method", "budget_requested", "split", "scope", "scope_value", "metric", F.format_string("%.6e", "value").alias("value"))


@query(f"""WITH {SWEEP_SQL}, c AS (SELECT concat('seed-', seed) AS shard, metric, count(*) AS n FROM swept GROUP BY ALL)
SELECT shard, metric, n, (SELECT count(DISTINCT (seed, budget_requested)) FROM fx_weight WHERE method IN ('informed_l0', 'informed_l1')) AS completed_cells, (SELECT string_agg(DISTINCT CAST(budget_requested AS VARCHAR), ',' ORDER BY CAST(budget_requested AS VARCHAR)) FROM fx_weight) AS budgets,
(SELECT count(*) FROM swept) AS n_rows, (SELECT count(*) FROM ran) AS n_artifacts FROM c""", "fx_matrix", "fx_target", "fx_weight")
def merged_sweeps(spark, sf):
    """Two finished sweeps of one seed each, with their weight artifacts, merged into one."""
    of, roots, methods = _swept(spark, sf), {}, ["informed_l0", "informed_l1"]
    for seed in (0, 1):
        root = roots[f"seed-{seed}"] = _folder(spark, f"sweep{seed}")
        args = of(seed)
        sweep.score_and_append(sweep.shards(spark, root), "all", *args)
        _save(Artifacts(spark, root), args[3], table(spark, sf, "fx_record"))
        sweep.sweep_manifest(spark, root, f"seed-{seed}", "complete", {"epochs": 120, "targets": "fixture"}, methods)
    out = _folder(spark, "merged")
    record = sweep.merge_sweeps(spark, roots, out, "both", methods)
    counts = sweep.shards(spark, out).certified("metrics").groupBy("shard", "metric").agg(F.count("*").alias("n"))
    grid = record["grid"]["budgets"]
    more = {"completed_cells": record["completed_cells"], "budgets": ",".join(sorted(map(str, grid))), "n_rows": record["n_rows"]["metrics"], "n_artifacts": record["n_weight_artifact_rows"]}
    return counts.select("shard", "metric", "n", *[F.lit(v).cast("string" if k == "budgets" else "long").alias(k) for k, v in more.items()])


def _save(store: Artifacts, weights: DataFrame, records: DataFrame, factor: float = 1.0) -> None:
    """Artifacts of weight vectors: all candidates with their start weights, and a loss for each of three epochs."""
    cells = weights.withColumns({"holdout_type": F.lit("fixed_family"), "fold": F.lit(-1)}).withColumn("weight", F.col("weight") * factor)
    runs_ = frames.kept(cells.groupBy(*state_.CELL).agg(F.count("*").alias("n_selected"), F.avg("weight").alias("final_loss")), "runs")
    n = records.count()
    rows = runs_.withColumns({"budget_achieved": F.col("n_selected"), "weight_entity": F.lit("record"), "candidate_records": F.lit(n).cast("long"), "runtime_s": F.lit(None).cast("double"), "l0_lambda": F.lit(None).cast("double"), "target_loss_cap": F.lit(1.0)})
    every = runs_.select(*state_.CELL).crossJoin(records.select("record_id", F.col("w0").alias("start_weight")))  # a row for each candidate and run: what is stored
    vectors = every.join(cells.select(*state_.CELL, "record_id", "weight"), [*state_.CELL, "record_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    losses = runs_.select(*state_.CELL, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("epoch"), "final_loss").withColumn("loss", F.col("final_loss") * (3 - F.col("epoch")))
    store.save(rows, vectors, losses)


@query("""SELECT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested, count(weight) AS n_selected, round(sum(weight), 3) AS sum_weight, (SELECT count(*) FROM fx_record) AS candidates, round((SELECT sum(w0) FROM fx_record), 3) AS sum_start,
CAST(3 AS BIGINT) AS epochs, round(avg(weight) * 6, 6) AS sum_loss FROM fx_weight WHERE NOT (method = 'informed_l1' AND seed = 1) GROUP BY ALL""", "fx_weight", "fx_record")
def stored_artifacts(spark, sf):
    """Artifacts of all runs but one method of one seed; seed 0 is saved twice, and the later row wins."""
    store = Artifacts(spark, _folder(spark, "artifacts"))
    w, records = frames.weights(spark, sf).withColumn("l2_lambda", F.lit(0.0)), frames.kept(table(spark, sf, "fx_record").select("record_id", "w0"), "records")
    _save(store, w.where("seed = 0"), records, 2.0)
    _save(store, w.where("not (method = 'informed_l1' and seed = 1)"), records)
    keys = ["method", "seed", "budget_requested"]
    own = store.vectors().groupBy(*keys).agg(F.count_if(F.col("weight") > 0).alias("n_selected"), F.round(F.sum("weight"), 3).alias("sum_weight"), F.count("*").alias("candidates"), F.round(F.sum("start_weight"), 3).alias("sum_start"))
    return own.join(store.trajectories().groupBy(*keys).agg(F.count("*").alias("epochs"), F.round(F.sum("loss"), 6).alias("sum_loss")), keys)


@query(f"WITH {SCORES_SQL.strip()} SELECT method, seed, budget_requested, l2_lambda, split, scope_value AS family, n, round(mean_are, 6) AS mean_are, round(median_are, 6) AS median_are, round(max_are, 6) AS max_are FROM scored WHERE scope = 'family'", "fx_diag")
def family_summary_rows(spark, sf):
    """Family rows of nested method summaries."""
    s = frames.scores(spark, sf)
    return rounded(report.family_rows(sweep.method_summaries(s, s.select(*RUN).distinct()), RUN))


@query(f"""WITH {SCORES_SQL.strip()}, o AS (SELECT * FROM scored WHERE scope = 'overall')
SELECT i.method, i.seed, i.budget_requested, i.l2_lambda, i.n AS in_sample_n, round(i.mean_are, 6) AS in_sample_mean_are, round(i.median_are, 6) AS in_sample_median_are, o.n AS out_of_sample_n, round(o.mean_are, 6) AS out_of_sample_mean_are, round(o.median_are, 6) AS out_of_sample_median_are
FROM o i JOIN o USING (method, seed, budget_requested, l2_lambda) WHERE i.split = 'in_sample' AND o.split = 'out_of_sample'""", "fx_diag")
def method_summary_rows(spark, sf):
    s = frames.scores(spark, sf)
    out = rounded(report.method_rows(sweep.method_summaries(s, s.select(*RUN).distinct()), RUN))
    return out.select(*RUN, *[f"{side}_{c}" for side in ("in_sample", "out_of_sample") for c in ("n", "mean_are", "median_are")])


@metrics_query(""", cells AS (SELECT DISTINCT method, l2_lambda, budget_requested FROM long), ls AS (SELECT count(DISTINCT l2_lambda) AS l, count(DISTINCT budget_requested) AS b, count(DISTINCT method) AS m FROM long),
c AS (SELECT (SELECT count(*) FROM cells) AS cells, l, b, m FROM ls)
SELECT u.* FROM c, LATERAL (SELECT * FROM (VALUES ('objective_by_budget', cells), ('median_by_budget', 2 * cells), ('mean_by_budget', 2 * cells), ('paired', l * b), ('macro', cells), ('attribution', m * b * least(15, (SELECT count(*) FROM fx_target WHERE family IN ('orders', 'forecast') AND value <> 0))),
('sensitivity', 2 * cells), ('result_sampling_comparison', 2 * m), ('result_calibration_accuracy', (SELECT l * count(DISTINCT scope_value) FROM long WHERE scope = 'geography' AND split = 'out_of_sample')), ('result_presets', b), ('result_paired_comparison', l * b),
('sweep_frontier_out_of_sample', b), ('sweep_frontier_in_sample', b), ('sweep_paired_comparison', l * b), ('series_objective', cells), ('series_mean', 2 * cells), ('series_median', 2 * cells), ('series_ess', cells), ('series_max_weight', cells),
('series_by_family', (SELECT count(DISTINCT (split, scope_value)) * (SELECT count(*) FROM cells) FROM long WHERE scope = 'family' AND metric = 'mean_are')), ('series_operability', cells), ('series_gap', cells), ('series_cost', cells)) AS v(frame, n_rows)) u""", "fx_target")
def summary_bundle(spark, sf):
    """All frames of the summary, written as one bundle, with the rows that its record tells."""
    from ..sources.tables import write_bundle

    d = frames.kept(frames.diagnostics(spark, sf), "diagnostics")
    choices, found = report.summary_bundle(frames.metrics(spark, sf), d, ["forecast"])
    record = write_bundle(found, _folder(spark, "bundle"), choices)
    return spark.createDataFrame([(k, v["n_rows"]) for k, v in record["frames"].items()], "frame string, n_rows long")


@metrics_query(f""", r AS (SELECT method, l2_lambda, budget_requested, avg(value) FILTER (WHERE scope = 'run' AND metric = 'runtime_s') AS runtime_s, avg(value) FILTER (WHERE scope = 'overall' AND metric = 'median_are' AND split = 'out_of_sample') AS median_are FROM long GROUP BY ALL)
SELECT method, l2_lambda, CAST(budget_requested AS BIGINT) AS budget_requested, round(runtime_s, 6) AS runtime_s, round(median_are, 6) AS median_are FROM r""")
def cost_accuracy(spark, sf):
    return rounded(report.series(frames.metrics(spark, sf), frames.diagnostics(spark, sf))["cost"])


@metrics_query(""" SELECT string_agg(DISTINCT CAST(seed AS VARCHAR), ',' ORDER BY CAST(seed AS VARCHAR)) AS seeds, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, count(DISTINCT l2_lambda) AS n_penalties, count(DISTINCT budget_requested) AS n_budgets FROM long""")
def recovered_grid(spark, sf):
    g = runs.recovered_grid(frames.metrics(spark, sf))
    return g.select(F.concat_ws(",", F.col("seed").cast("array<string>")).alias("seeds"), F.concat_ws(",", "method").alias("methods"), F.size("l2_lambda").cast("long").alias("n_penalties"), F.size("budget_requested").cast("long").alias("n_budgets"))


@query("""WITH h AS (SELECT method, seed, row_number() OVER (PARTITION BY method, seed ORDER BY target_name) - 1 AS epoch, abs(achieved_value - target_value) / scale AS loss FROM fx_diag WHERE l2_lambda = 0 AND budget_requested = 2000),
l AS (SELECT *, max(epoch) OVER w AS last, lag(loss, 50) OVER (w ORDER BY epoch) AS l50, lag(loss, 100) OVER (w ORDER BY epoch) AS l100 FROM h WINDOW w AS (PARTITION BY method, seed)),
b AS (SELECT method, seed, min(loss) AS best FROM h GROUP BY ALL)
SELECT l.method, l.seed, round(max(loss) FILTER (WHERE epoch = 0), 6) AS first_loss, round(max(loss) FILTER (WHERE epoch = last), 6) AS last_loss, round(max(best), 6) AS best_loss, min(epoch) FILTER (WHERE loss = best) AS best_epoch, count(*) AS epochs,
round(max((l50 - loss) / greatest(abs(l50), 1e-12)) FILTER (WHERE epoch = last), 4) AS improvement_50, round(max((l100 - loss) / greatest(abs(l100), 1e-12)) FILTER (WHERE epoch = last), 4) AS improvement_100
FROM l JOIN b USING (method, seed) GROUP BY ALL""".replace("(w ORDER BY epoch)", "(PARTITION BY method, seed ORDER BY epoch)"), "fx_diag")
def loss_trajectories(spark, sf):
    """First, last and best loss, and the improvement over the last epochs, of trajectories laid out by target."""
    from pyspark.sql import Window

    d = table(spark, sf, "fx_diag").where("l2_lambda = 0 and budget_requested = 2000")
    epoch = F.row_number().over(Window.partitionBy("method", "seed").orderBy("target_name")) - 1
    h = d.select("method", "seed", epoch.cast("long").alias("epoch"), (F.abs(F.col("achieved_value") - F.col("target_value")) / F.col("scale")).alias("loss"))
    out = objective.loss_summary(h, ["method", "seed"], (50, 100))
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("improvement_50", "improvement_100")}))


@query(f"""WITH {SCORES_SQL.strip()}, w AS (SELECT method, seed, budget_requested, count(*) AS n_selected, round(sum(weight) * sum(weight) / sum(weight * weight), 4) AS ess, round(max(weight), 6) AS max_weight FROM fx_weight WHERE weight > 0 GROUP BY ALL),
o AS (SELECT method, seed, budget_requested, avg(mean_are) FILTER (WHERE split = 'in_sample') AS a, avg(mean_are) FILTER (WHERE split = 'out_of_sample') AS b FROM scored WHERE scope = 'overall' AND l2_lambda = 0 GROUP BY ALL)
SELECT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested, n_selected, ess, max_weight, round(a, 6) AS in_sample, round(b, 6) AS out_of_sample FROM w JOIN o USING (method, seed, budget_requested)""", "fx_diag", "fx_weight")
def method_comparison(spark, sf):
    keys = ["method", "seed", "budget_requested"]
    w = frames.weights(spark, sf)
    out = report.method_comparison(frames.scores(spark, sf).where("l2_lambda = 0"), score.weight_diagnostics(w, keys), w.select(*keys).distinct(), keys)
    return out.select("method", "seed", F.col("budget_requested").cast("long").alias("budget_requested"), "n_selected", F.round("ess", 4).alias("ess"), F.round("max_weight", 6).alias("max_weight"), F.round("in_sample", 6).alias("in_sample"), F.round("out_of_sample", 6).alias("out_of_sample"))


def _run_rows(spark, sf) -> DataFrame:
    """Run-level metric rows of the given weight vectors; weights and metrics are written once for all that read them."""
    w = frames.weights(spark, sf).withColumn("l2_lambda", F.lit(0.0))
    metrics = frames.kept(sweep.run_metrics(w, frames.kept(_told(w), "told")), "run-metrics")
    none = spark.createDataFrame([], "method string, seed int, budget_requested long, l2_lambda double, split string, scope string, scope_value string, " + ", ".join(f"{m} double" for m in score.SCORE_METRICS))
    return score.long_rows(none, metrics, RUN, "fixed_family", -1)


KEPT_SQL = "k AS (SELECT method, seed, budget_requested, count(*) AS n FROM fx_weight WHERE weight > 0 GROUP BY ALL)"


@query(f"WITH {KEPT_SQL} SELECT CAST(budget_requested AS BIGINT) AS budget_requested, round(avg(1.0::DOUBLE / n), 9) AS l0_lambda, round(avg(n), 6) AS budget_achieved FROM k WHERE method = 'informed_l0' GROUP BY ALL", "fx_weight")
def presets_of_runs(spark, sf):
    """Converged penalty and achieved count for each budget, of the given weight vectors."""
    return report.presets(_run_rows(spark, sf)).select("budget_requested", F.round("l0_lambda", 9).alias("l0_lambda"), F.round("budget_achieved", 6).alias("budget_achieved"))


@query(f"""WITH {KEPT_SQL}, own AS (SELECT seed, budget_requested, n FROM k WHERE method = 'informed_l0' AND (seed = 0 OR n > budget_requested // 4))
SELECT DISTINCT c.seed, CAST(c.budget_requested AS BIGINT) AS budget_requested, CAST(coalesce(own.n, c.budget_requested) AS BIGINT) AS matched_budget FROM k c LEFT JOIN own USING (seed, budget_requested)""", "fx_weight")
def budgets_of_runs(spark, sf):
    """The baselines' budgets: what L0 kept in this run (seed 0), or in an earlier one if that kept enough, else the requested one."""
    rows = _run_rows(spark, sf)
    found = runs.achieved_budgets(rows)
    before = found.where((F.col("seed") == 1) & (F.col("budget_achieved") > F.floor(F.col("budget_requested") / 4)))
    return runs.matched_budgets(rows.select(*runs.CELL).distinct(), found.where("seed = 0"), before).select("seed", "budget_requested", "matched_budget")


@query(f"""WITH {KEPT_SQL}, m AS (SELECT seed, budget_requested, count(DISTINCT method) AS done FROM k WHERE method IN ('informed_l0', 'dense_sample') AND n % 3 <> 0 GROUP BY ALL)
SELECT seed, CAST(budget_requested AS BIGINT) AS budget_requested FROM m WHERE done = 2""", "fx_weight")
def cells_of_runs(spark, sf):
    """Cells in which two methods are complete, where the rows of every run whose count is divisible by three are lost."""
    rows = _run_rows(spark, sf)
    lost = rows.where("metric = 'n_selected' and value % 3 = 0").select(*RUN)
    return runs.completed_cells(rows.join(lost, RUN, "left_anti"), ["informed_l0", "dense_sample"]).select("seed", "budget_requested")


@query(f"""WITH {KEPT_SQL} SELECT method, seed, CAST(budget_requested AS BIGINT) AS budget_requested FROM k WHERE n % 3 = 0""", "fx_weight")
def pending_of_runs(spark, sf):
    """Runs that must be done again, where the rows of every run whose count is divisible by three are lost."""
    rows = _run_rows(spark, sf)
    lost = rows.where("metric = 'n_selected' and value % 3 = 0").select(*RUN)
    done = runs.completed_methods(rows.join(lost, RUN, "left_anti"))
    return runs.pending(rows.select(*RUN).distinct(), done, RUN).select("method", "seed", "budget_requested")


@query(f"""WITH {KEPT_SQL} SELECT CAST(budget_requested AS BIGINT) AS budget_requested, method, round(avg(n), 6) AS mean, count(DISTINCT seed) AS n_seeds FROM k GROUP BY ALL""", "fx_weight")
def retained_of_runs(spark, sf):
    """The mean number of retained records over seeds."""
    return rounded(A.run_metric(_run_rows(spark, sf), "n_unique_selected")).select("budget_requested", "method", "mean", "n_seeds")


# ---- tables written and read back ------------------------------------------------------------------------------


@query("""SELECT target_name, CASE WHEN geography_level = 'state' THEN 'named' WHEN geography_level = 'district' THEN family ELSE NULL END AS family FROM fx_target""", "fx_target")
def registry_families(spark, sf):
    """The registry's family in the metadata: kept where one is named (states), put in where none is (districts), absent where the registry has none (nation)."""
    t = frames.targets(spark, sf)
    level = F.col("geography_level")
    bare = t.withColumns({"metadata": F.when(level == "state", F.create_map(F.lit("family"), F.lit("named"))).otherwise(F.expr("cast(map() as map<string,string>)")), "family": F.when(level != "national", F.col("family"))})
    return targets_.with_registry_family(bare).select("target_name", F.col("metadata")["family"].alias("family"))


@query(f"""WITH {POS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY u, target_name) AS nth, count(*) OVER () AS total FROM pos)
SELECT target_name, (SELECT count(*) FROM fx_target) AS full_fit, CAST(0 AS BIGINT) AS full_holdout FROM n WHERE nth > round_even(total * CAST(0.3 AS DOUBLE), 0)""", "fx_target")
def complement_of_split(spark, sf):
    """Targets that a split leaves to the fit, by removing its holdout; beside them the sizes of the full surface."""
    t = frames.targets(spark, sf)
    held = folds.split_targets(t, 0.3, 7).where("split = 'holdout'")
    fit, none = folds.full_surface(t)
    return folds.complement(t, held).select("target_name", F.lit(fit.count()).alias("full_fit"), F.lit(none.count()).alias("full_holdout"))


@query("""SELECT method, l2_lambda, split, count(*) AS n, count(CASE WHEN target_value <> 0 THEN 1 END) AS n_scored, count(*) FILTER (WHERE is_degenerate) AS n_degenerate, round(sum(achieved_value / scale), 4) AS ratios FROM fx_diag GROUP BY ALL""", "fx_diag")
def diagnostics_read_back(spark, sf):
    """Diagnostics written as CSV and read again: empty numbers stay null, flags stay flags."""
    from ..sources import tables

    path = _folder(spark, "diagnostics")
    tables.write_diagnostics(score.diagnostic_rows(frames.diagnostics(spark, sf)), path, csv=True)
    back = tables.read_diagnostics(spark, path)
    return back.groupBy("method", "l2_lambda", "split").agg(F.count("*").alias("n"), F.count("absolute_relative_error").alias("n_scored"), F.count_if("is_degenerate").alias("n_degenerate"), F.round(F.sum(F.col("achieved_value") / F.col("scale")), 4).alias("ratios"))


@metrics_query(" SELECT method, scope, metric, count(*) AS n, count(value) FILTER (WHERE metric <> 'n') AS n_numbers, count(*) FILTER (WHERE scope_value = '') AS n_plain FROM long GROUP BY ALL")
def metrics_read_back(spark, sf):
    """Long metrics written as CSV and read again; one metric's values are no numbers there and become null."""
    from ..sources import tables

    path = _folder(spark, "metrics")
    rows = frames.metrics(spark, sf)
    odd = rows.withColumn("value", F.when(F.col("metric") == "n", "many").otherwise(F.col("value").cast("string")))
    tables.write_metrics(odd, path, csv=True)
    return tables.read_metrics(spark, path).groupBy("method", "scope", "metric").agg(F.count("*").alias("n"), F.count("value").alias("n_numbers"), F.count_if(F.col("scope_value") == "").alias("n_plain"))


@query(f"WITH {FACT_SQL} SELECT aggregate_fact_key, target_name, vintage, round(value / 1000000, 6) AS value_m FROM facts", "fx_target")
def facts_read_back(spark, sf):
    """Facts written as JSON lines, with blank lines between them, and read again."""
    from ..sources import tables

    path = _folder(spark, "facts")
    lines = _facts(spark, sf).select(F.to_json(F.struct("aggregate_fact_key", "target_name", "vintage", "value")).alias("value"))
    lines.unionByName(lines.select(F.lit("  ").alias("value"))).write.text(path)
    back = tables.read_facts(spark, path, "aggregate_fact_key string, target_name string, vintage int, value double")
    return back.select("aggregate_fact_key", "target_name", "vintage", F.round(F.col("value") / 1000000, 6).alias("value_m"))


@query("""SELECT record_id, round(acctbal, 6) AS acctbal, district, (SELECT count(*) FROM fx_target) AS n_targets FROM fx_record""", "fx_record", "fx_target")
def frozen_input(spark, sf):
    """A prepared input that was frozen and read again."""
    from ..sources import tables

    path, t = _folder(spark, "frozen"), frames.targets(spark, sf)
    u = frames.universe(spark, sf)
    tables.freeze({"record": u.tables["record"]}, t, {"targets": t.count()}, path)
    entities, targets = tables.thaw(spark, path, ["record"])
    return entities["record"].select("record_id", F.round("acctbal", 6).alias("acctbal"), "district", F.lit(targets.count()).alias("n_targets"))
