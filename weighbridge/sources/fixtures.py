"""Calibration fixtures that are derived from the customer, orders, nation and region tables.

``SQL`` has one text for each derived table, the same for Spark and for DuckDB but
for the hash uniform; ``table`` gives the Spark frame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import kept

# The uniform of a key as each engine writes it.
SPARK_UNIFORM = "((CAST(conv(substr(md5({0}),1,12),16,10) AS DOUBLE)+0.5D)/281474976710656D)"
DUCKDB_UNIFORM = "((CAST(('0x'||substr(md5({0}),1,12)) AS BIGINT)::DOUBLE+0.5::DOUBLE)/281474976710656::DOUBLE)"

BASE = ("customer", "nation", "region", "orders")

SQL = {
    "fx_record": """
SELECT c.c_custkey AS record_id, CAST(1000 AS DOUBLE) AS w0, n.n_name AS district, r.r_name AS state,
       c.c_mktsegment AS segment, c.c_acctbal AS acctbal,
       coalesce(o.total, CAST(0 AS DOUBLE)) AS orders_total, CAST(coalesce(o.cnt, 0) AS DOUBLE) AS n_orders
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS cnt FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""",
    "fx_measure": """
SELECT record_id, w0, state, district, 'balance' AS family, 'amount' AS basis, 'acctbal' AS measure, acctbal AS value FROM fx_record
UNION ALL SELECT record_id, w0, state, district, 'orders', 'amount', 'orders_total', orders_total FROM fx_record
UNION ALL SELECT record_id, w0, state, district, 'population', 'count', 'record_count', CAST(1 AS DOUBLE) FROM fx_record
UNION ALL SELECT record_id, w0, state, district, 'activity', 'count', 'n_orders', n_orders FROM fx_record
UNION ALL SELECT record_id, w0, state, district, 'segment', 'count', concat('seg_', segment), CAST(1 AS DOUBLE) FROM fx_record""",
    "fx_matrix": """
SELECT concat('national/US/', measure) AS target_name, record_id, w0, family, basis, 'national' AS geography_level, value FROM fx_measure
UNION ALL SELECT concat('state/', state, '/', measure), record_id, w0, family, basis, 'state', value FROM fx_measure
UNION ALL SELECT concat('district/', district, '/', measure), record_id, w0, family, basis, 'district', value FROM fx_measure
UNION ALL SELECT 'stress/tiny', record_id, w0, 'stress', 'amount', 'national', value FROM fx_measure WHERE measure = 'acctbal'
UNION ALL SELECT 'stress/zero', record_id, w0, 'void', 'count', 'national', value FROM fx_measure WHERE measure = 'record_count'
UNION ALL SELECT 'forecast/n_orders', record_id, w0, 'forecast', 'count', 'national', value FROM fx_measure WHERE measure = 'n_orders'""",
    "fx_target": """
SELECT target_name, family, basis, geography_level, family = 'forecast' AS validation_only,
       CASE WHEN target_name = 'stress/tiny' THEN CAST(1 AS DOUBLE) WHEN target_name = 'stress/zero' THEN CAST(0 AS DOUBLE)
            ELSE sum(value * w0) * CAST(1.08 AS DOUBLE) END AS value,
       max(abs(value) * w0) AS identifiability_floor
FROM fx_matrix GROUP BY target_name, family, basis, geography_level""",
    "fx_run": """
SELECT m.method, m.amp, s.seed, b.budget_requested, l.l2_lambda
FROM (VALUES ('informed_l0', CAST(0.10 AS DOUBLE)), ('informed_l0_refit', CAST(0.06 AS DOUBLE)), ('informed_l1', CAST(0.14 AS DOUBLE)),
             ('random_reweight', CAST(0.12 AS DOUBLE)), ('dense_sample', CAST(0.30 AS DOUBLE))) AS m(method, amp)
CROSS JOIN (VALUES (0), (1), (2)) AS s(seed)
CROSS JOIN (VALUES (2000), (5000), (10000), (20000), (40000)) AS b(budget_requested)
CROSS JOIN (VALUES (CAST(0.0 AS DOUBLE)), (CAST(0.0001 AS DOUBLE))) AS l(l2_lambda)""",
    "fx_diag": """
SELECT r.method, r.l2_lambda, r.seed, r.budget_requested,
       CASE WHEN t.family IN ('orders', 'forecast') THEN 'out_of_sample' ELSE 'in_sample' END AS split,
       t.target_name, t.family, t.geography_level, t.value AS target_value,
       t.value * (1 + r.amp * (2 * {U(concat('achieved:', r.method, ':', r.seed, ':', r.budget_requested, ':', CASE WHEN r.l2_lambda = 0 THEN 'a' ELSE 'b' END, ':', t.target_name))} - 1) * sqrt(CAST(2000 AS DOUBLE) / r.budget_requested))
         + CASE WHEN t.family IN ('stress', 'void') THEN CAST(50 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS achieved_value,
       greatest(abs(t.value), CAST(1 AS DOUBLE)) AS scale, sqrt(greatest(abs(t.value), CAST(1 AS DOUBLE))) AS loss_weight,
       abs(t.value) < t.identifiability_floor AS is_degenerate
FROM fx_run r CROSS JOIN fx_target t""",
    # what a run reports of itself
    "fx_runvalue": """
SELECT method, seed, budget_requested, l2_lambda, CAST(budget_requested - 10 * seed AS BIGINT) AS n_selected,
       CAST(budget_requested - 10 * seed - 1 AS DOUBLE) AS budget_achieved,
       budget_requested * (CAST(0.5 AS DOUBLE) + amp) * (1 - l2_lambda * 100) + seed AS ess,
       CAST(900000 AS DOUBLE) / (1 + l2_lambda * 10000) + 1000 * seed + amp AS max_weight,
       amp * 1000 + seed + budget_requested / CAST(1000 AS DOUBLE) AS runtime_s
FROM fx_run""",
    # one weight vector for each run of seeds 0 and 1 with the first two budgets and no l2 term
    "fx_weight": """
SELECT k.method, k.seed, k.budget_requested, k.record_id, k.weight FROM (
  SELECT r.method, r.seed, r.budget_requested, c.record_id,
         {U(concat('keep:', r.method, ':', r.seed, ':', r.budget_requested, ':', c.record_id))} AS keep,
         1000 * (CAST(0.5 AS DOUBLE) + {U(concat('w:', r.method, ':', r.seed, ':', r.budget_requested, ':', c.record_id))}) AS weight
  FROM fx_run r CROSS JOIN fx_record c WHERE r.l2_lambda = 0 AND r.seed < 2 AND r.budget_requested < 10000) k
WHERE k.keep < CAST(0.5 AS DOUBLE)""",
}


def _uniforms(text: str, form: str) -> str:
    """Replaces each {U(key)} by the engine's expression."""
    out = ""
    while (at := text.find("{U(")) >= 0:
        depth, end = 0, at + 2
        while True:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
            if not depth:
                break
        out += text[:at] + form.format(text[at + 3 : end - 1])
        text = text[end + 1 :]
    return out + text


def _needed(names: list[str]) -> list[str]:
    """The fixtures that these need, each after what it needs."""
    out: list[str] = []

    def visit(name: str) -> None:
        for other in SQL:
            if other != name and re.search(rf"\b{other}\b", SQL[name]):
                visit(other)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def with_clause(*names: str, form: str = DUCKDB_UNIFORM) -> str:
    """``WITH`` and the named fixtures, ready for a query or further clauses after a comma."""
    return "WITH " + ",\n".join(f"{n} AS ({_uniforms(SQL[n], form)})" for n in _needed(list(names)))


def duckdb(body: str, *names: str) -> str:
    """DuckDB SQL of a body over the named fixtures; {U(key)} in the body is the uniform of a key."""
    body = _uniforms(body, DUCKDB_UNIFORM).strip()
    return f"{with_clause(*names)}{', ' + body[5:] if body.upper().startswith('WITH ') else chr(10) + body}"


#: Records of a task, about: what is made of a record is many times its row in the given tables.
MOST_RECORDS = 50_000


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; customers, from which most rows are made, dealt by key where they are many.

    A file of a few MB is one task to Spark, however many rows it holds.
    """
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = -(-read.count() // MOST_RECORDS) if name == "customer" else 1
    return read.repartition(parts, "c_custkey") if parts > 1 else read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = with_clause(name, form=SPARK_UNIFORM) + f"\nSELECT * FROM {name}"
    if "fx_measure" in _needed([name]):  # made of the records in many branches: they are written once
        record = kept(table(spark, sf_dir, "fx_record"), "fx-record")
        text = text.replace(f"fx_record AS ({SQL['fx_record']})", "fx_record AS (SELECT * FROM {fx_record_kept})")
        return spark.sql(text, fx_record_kept=record)
    read = {t: given(spark, sf_dir, t) for t in BASE if re.search(rf"\b{t} ", text)}
    for t in read:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **read)
