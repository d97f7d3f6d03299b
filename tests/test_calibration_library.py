"""Hand-computed cases and invariants of the calibration library."""

import math
import os

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from weighbridge.functions import stats
from weighbridge.functions import text as T
from weighbridge.operators import aggregate as A
from weighbridge.operators import calibrate as K
from weighbridge.operators import folds, matrix, objective, runs, sample, score
from weighbridge.operators import targets as TT
from weighbridge.operators import universe as U
from weighbridge.plans import pipelines
from weighbridge.sources import tables

DIAG = "method string, target_value double, achieved_value double, scale double, loss_weight double, is_degenerate boolean"


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([("m", 1000.0, 1100.0, 1000.0, 10.0, False), ("m", 1.0, 51.0, 1.0, 1.0, True)], DIAG)


def test_objective_arithmetic(two):
    one = lambda **k: objective.summarize(two, ["method"], **k).first()
    assert one().objective == pytest.approx(2 / 11) and one(cap=None).objective == pytest.approx(51 / 11)
    assert one().mean_raw == one().median_raw == pytest.approx(25.05) and one().fraction_within == 0.5
    left = one(drop_degenerate=True)
    assert left.objective == pytest.approx(0.1) and left.fraction_within == 1.0


def test_objective_without_weights_or_rows(two):
    bare = two.withColumn("loss_weight", F.lit(None).cast("double"))
    assert objective.summarize(bare, ["method"]).first().objective == pytest.approx((0.1 + 1) / 2)
    assert two.where("false").agg(objective.objective().alias("o")).first().o is None


def test_t_quantiles(spark):
    want = {1: 12.706205, 2: 4.302653, 3: 3.182446, 4: 2.776445, 9: 2.262157, 30: 2.042272}
    df = spark.createDataFrame([(k,) for k in want], "df int").select("df", stats.t_quantile(0.95, F.col("df")).alias("q"), stats.t_tail(stats.t_quantile(0.95, F.col("df")), F.col("df")).alias("p"))
    for r in df.collect():
        assert r.q == pytest.approx(want[r.df], abs=1e-5) and r.p == pytest.approx(0.05, abs=1e-9)


def test_interval_of_one_value_and_none(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, float("nan")), ("b", 2, None)], "k string, seed int, value double")
    got = {r.k: r for r in A.with_interval(df, ["k"]).collect()}
    assert (got["a"].mean, got["a"].lo, got["a"].hi) == (0.5, 0.5, 0.5) and got["b"].mean is None and got["b"].lo is None


def test_tail_counts(spark):
    df = spark.createDataFrame([("m", 0.5), ("m", 2.0), ("m", None), ("m", 10.0)], "method string, absolute_relative_error double")
    r = score.tail_counts(df, ["method"]).first()
    assert (r.n_scored, r.n_are_gt_1, r.n_are_gt_5) == (3, 2, 1)


def test_loss_weights(spark):
    t = spark.createDataFrame([("a", 100.0, "amount"), ("b", 400.0, "amount"), ("c", 25.0, "count")], "target_name string, value double, basis string")
    got = {r.target_name: r.loss_weight for r in TT.loss_weights(t).collect()}
    assert got["b"] / got["a"] == pytest.approx(2) and sum(got.values()) / 3 == pytest.approx(1) and got["a"] + got["b"] == pytest.approx(got["c"])
    assert objective.loss_weight_summary(TT.loss_weights(t, "uniform")).first().uniform


def test_rotation_weights_families_by_targets(spark):
    rows = []
    for family, n, are, fold in (("a", 10.0, 0.1, 0), ("b", 30.0, 0.3, 1), ("cbo", 5.0, 9.0, 0), ("cbo", 5.0, 9.0, 1)):
        rows += [("m", 0, 10, 0.0, "rotation", fold, "out_of_sample", "family", family, k, v) for k, v in (("mean_are", are), ("n", n))]
    df = spark.createDataFrame(rows, "method string, seed int, budget_requested long, l2_lambda double, holdout_type string, fold int, split string, scope string, scope_value string, metric string, value double")
    r = A.rotation_seed_scores(df, ["cbo"]).first()
    assert r.value == pytest.approx((0.1 * 10 + 0.3 * 30) / 40) and (r.n_targets, r.n_folds, r.n_excluded) == (40, 2, 10)


def test_folds(spark):
    sizes = {"soi": 10, "pep": 5, "snap": 3, "jct": 2, "cbo": 1}
    rows = [(i, f"{f}{k}", f, f == "cbo") for i, (f, k) in enumerate((f, k) for f, n in sizes.items() for k in range(n))]
    t = spark.createDataFrame(rows, "target_pos long, target_name string, family string, validation_only boolean")
    dealt = {r.family: r.fold for r in folds.deal_families(t, 2, 0).collect()}
    load = [sum(n for f, n in sizes.items() if dealt[f] == k) for k in (0, 1)]
    assert sorted(load) == [10, 11] and set(dealt) == set(sizes)
    assert {r.family: r.fold for r in folds.deal_families(t, 2, 0).collect()} == dealt
    rot = folds.rotated_folds(t, 2, 0)
    assert rot.where("family = 'cbo' and split = 'fit'").count() == 0 and rot.where("family <> 'cbo' and split = 'holdout'").count() == 20
    with pytest.raises(ValueError):
        folds.deal_families(t, 9, 0)
    with pytest.raises(ValueError):
        folds.split_by_family(t, ["nope"])
    split = folds.split_targets(t, 0.5, 3)
    assert split.where("split = 'holdout'").count() == round(21 * 0.5)
    assert folds.complement(t, split.where("split = 'holdout'")).count() == 21 - round(21 * 0.5)


def test_sampling(spark):
    w = spark.createDataFrame([(i, float(i + 1)) for i in range(6)], "record_id long, weight double")
    for replace in (True, False):
        out, info = sample.weighted_sample(w, 3, 1, replace)
        assert out.agg(F.sum("weight")).first()[0] == pytest.approx(21) and info["n_selected"] == 3 and out.count() == info["n_unique"] <= 3
    assert sample.weighted_sample(w, 3, 1, False)[1]["n_unique"] == 3
    many = sample.draw_with_replacement(w, 6000, 2)
    got = {r.record_id: r.draws for r in many.collect()}
    assert sum(got.values()) == 6000 and all(abs(got[i] - 6000 * (i + 1) / 21) < 5 * math.sqrt(6000 * (i + 1) / 21) for i in range(6))
    with pytest.raises(ValueError):
        sample.weighted_sample(w.withColumn("weight", F.lit(0.0)), 3, 1)


def test_classes_of_targets(spark):
    cases = [({"geography_level": " US "}, "x", "national"), ({"geo_level": "CD"}, "x", "district"), ({"geography_level": "County"}, "x", "county"), ({"state_fips": "06"}, "x", "state"), ({}, "x", "national")]
    df = spark.createDataFrame([(m, n, w) for m, n, w in cases], "m map<string,string>, n string, want string")
    assert all(r.got == r.want for r in df.select(T.geography_level(F.col("m")).alias("got"), "want").collect())
    names = spark.createDataFrame([({}, "soi/total"), ({"ledger_source_record_id": "pep.x"}, "y"), ({"family": "f"}, "y.z"), ({}, "plain")], "m map<string,string>, n string")
    got = names.select(T.reporting_family(F.col("m"), F.col("n")).alias("a"), T.loss_family(F.col("m"), F.col("n")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("unknown", "soi"), ("pep", "pep"), ("f", "f"), ("unknown", "unspecified")]


def test_cells(spark):
    df = spark.createDataFrame([(0.12345, 0.1, 0.2, 10000, 2.37e-6)], "m double, lo double, hi double, b long, x double")
    r = df.select(T.interval_cell(F.col("m"), F.col("lo"), F.col("hi")), T.interval_cell(F.col("m"), F.col("m"), F.col("m")), T.budget_label(F.col("b")), T.scientific(F.col("x")), T.percent(F.col("m")), T.thousands(F.col("b"))).first()
    assert tuple(r) == ("0.1235 [0.1000, 0.2000]", "0.1235", "10k", "2.37e-6", "12.3%", "10,000")


def test_zero_targets_have_no_relative_error(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("b", 2.0, 1.0)], "target_name string, value double, achieved_value double")
    got = {r.target_name: r for r in score.target_diagnostics(df).collect()}
    assert got["a"].absolute_relative_error is None and got["a"].absolute_error == 5 and got["a"].is_zero_value_target and got["b"].absolute_relative_error == 0.5


def test_run_state(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "k int, v string")
    assert sorted((r.k, r.v or "") for r in runs.append_new(a, b).collect()) == [(1, ""), (1, ""), (2, "x"), (3, "y")]
    with pytest.raises(ValueError):
        runs.certify(a.withColumn("shard", F.lit("s")), spark.createDataFrame([("s", 4)], "shard string, declared long"))
    configs = spark.createDataFrame([("p", "seed", "0"), ("q", "seed", "1"), ("p", "cap", "1"), ("q", "cap", "2")], "run_id string, key string, value string")
    assert runs.first_difference(configs, "p", "q", ["seed"]).first().key == "cap"
    with pytest.raises(ValueError):
        runs.merge_runs({"p": a, "q": b}, configs, ["seed"])
    assert runs.merge_runs({"p": a, "q": b}, configs, ["seed", "cap"]).count() == 6
    assert runs.fingerprint(a).first() == runs.fingerprint(a.repartition(3)).first() != runs.fingerprint(b).first()


def test_facts(spark):
    f = spark.createDataFrame([("x", "t", 2023, 1.0), ("y", "t", 2024, 2.0), ("z", "t", 2025, 3.0)], "aggregate_fact_key string, target_name string, vintage int, value double")
    assert TT.latest_vintage(f, ["target_name"], 2024).first().value == 2.0
    with pytest.raises(ValueError):
        TT.merged_facts(f, f)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("method,seed,budget_requested,split,scope,scope_value,metric,value\na,0,10,na,run,,ess,oops\na,0,10,na,run,,n,2.5\n")
    rows = tables.read_metrics(spark, str(tmp_path / "m.csv")).orderBy("metric").collect()
    assert [(r.value, r.l2_lambda, r.scope_value) for r in rows] == [(None, 0.0, ""), (2.5, 0.0, "")]
    (tmp_path / "f.json").write_text('{"aggregate_fact_key": "x"}\n\n   \n')
    assert tables.read_facts(spark, str(tmp_path / "f.json"), "aggregate_fact_key string").count() == 1
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, v double")
    tables.write_manifest(df, str(tmp_path / "manifest"))
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "manifest").glob("*.json"))
    assert tables.read_rows(spark, str(tmp_path / "absent"), "k int").count() == 0
    metrics = tables.read_metrics(spark, str(tmp_path / "m.csv")).withColumns({"holdout_type": F.lit("h"), "fold": F.lit(-1)})
    tables.write_metrics(metrics, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).count() == 2


def test_penalties_and_caps():
    assert K.resolve_penalty(200, raw=1e-3) == 1e-3 and K.resolve_penalty(200, share=0.2) == pytest.approx(1e-3)
    assert K.resolve_cap("production") == 1 and K.resolve_cap("uniform") == 10 and K.resolve_cap("uniform", 3) == 3
    for bad in (lambda: K.resolve_penalty(5), lambda: K.resolve_penalty(5, 1.0, 1.0), lambda: K.resolve_cap("uniform", math.inf)):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def toy(spark):
    u = tables.toy_universe(spark, 120, 1)
    t = tables.toy_targets(u, copies=2).withColumns({"target_pos": F.xxhash64("target_name"), "family": F.col("measure"), "geography_level": F.lit("national"), "filter": F.expr("cast(map() as map<string,string>)")})
    t = spark.createDataFrame(t.collect(), t.schema)
    return matrix.constraint_matrix(U.Universe("household", {"household": u}, u.select("record_id", "w0")), t), u.select("record_id", "w0"), t


def test_dense_fit_equals_plain_numpy(spark, toy):
    m, w, t = toy
    options = K.Options(epochs=6, rate=0.15, cap=1.0, partitions=3, checkpoint_every=2)
    p = K.Problem.build(m, w, t, None, 3)
    got = K.calibrate_dense(p, options)
    names = {n: i for i, n in enumerate(p.names)}
    dense = np.zeros((len(names), 120))
    for r in m.collect():
        dense[names[r.target_name], r.record_id] = r.value
    w0 = np.array([r.w0 for r in w.orderBy("record_id").collect()])
    theta, mo, v = np.log(w0), np.zeros(120), np.zeros(120)
    scale = np.maximum(np.abs(p.value), 1)
    for e in range(6):
        error = (dense @ np.exp(theta) - p.value) / scale
        slope = np.where(np.abs(error) < 1, np.sign(error), 0) / len(names) / scale
        g = (dense.T @ slope) * np.exp(theta)
        mo, v = 0.9 * mo + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.15 * (mo / (1 - 0.9 ** (e + 1))) / (np.sqrt(v / (1 - 0.999 ** (e + 1))) + 1e-12)
    mine = {r.record_id: r.weight for r in got.weights.collect()}
    assert np.allclose([mine[i] for i in range(120)], np.exp(theta), rtol=1e-6)


def test_selection_refit_and_mass(spark, toy):
    m, w, t = toy
    options = K.Options(epochs=40, rate=0.15, cap=1.0, partitions=2)
    p = K.Problem.build(m, w, t, None, 2)
    found = K.informed_l0_at_budget(p, options, 40, shares=(1.0, 30.0), width=3, tolerance=2, open_at_start=0.8)
    chosen = K.weights_of(found.fit, found.configuration)
    assert found.retained < 120 and len(found.tries) >= 3 and chosen.count() == found.retained
    full, refit = K.post_selection_refit(m, w, t, chosen, options)
    assert full.count() == 120 and refit.loss[0] < found.fit.loss[found.configuration]
    held, fit = K.random_reweight(m, w, t, 30, 1, K.with_options(options, mass="conserve"))
    assert held.agg(F.sum("weight")).first()[0] == pytest.approx(120_000) and held.where("weight > 0").count() == 30
    capped = K.fit(p, [K.Config("informed_l0", 0, l0=1e-9, weight_ratio=1.01)], options)
    assert capped.weights.agg(F.max("weight")).first()[0] <= 1010.0001
    with pytest.raises(ValueError):
        K.post_selection_refit(m, w, t, chosen.where("false"), options)
    with pytest.raises(ValueError):
        K.informed_l1_at_budget(p, options, 10, bracket=(1.0, 0.1))


def test_demo(spark):
    scores, objectives = pipelines.demo(spark, 60, 20, options=K.Options(epochs=8, rate=0.15, cap=1.0, partitions=2), methods=("random_reweight", "dense_sample"))
    assert {r.method for r in objectives.collect()} == {"random_reweight", "dense_sample"} and scores.where("scope = 'overall'").count() == 4


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Queries held against their SQL in every run; ALL_SQL=1 takes all of them, which takes some twenty minutes.
EVERY_RUN = (
    "score_runs", "weight_diagnostics", "paired_difference", "deal_families", "sample_without_replacement", "sample_with_replacement", "loss_weights", "calibrate_dense", "calibrate_dense_sample", "calibrate_l1", "l1_search",
    "resumed_sweep", "merged_sweeps", "stored_artifacts", "summary_bundle", "family_summary_rows", "method_comparison", "loss_trajectories", "presets_of_runs", "pending_of_runs", "cells_of_runs", "facts_read_back", "metrics_read_back", "frozen_input",
)


def _names() -> list[str]:
    from weighbridge.plans.queries import ORACLES

    return sorted(ORACLES) if os.environ.get("ALL_SQL") else list(EVERY_RUN)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", _names())
def test_queries_equal_their_sql(spark, duck, name):
    from weighbridge.plans.queries import ORACLES, QUERIES

    want, got = duck.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    rows = lambda d: sorted(map(repr, d[sorted(d)].astype(object).where(d[sorted(d)].notna(), None).map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x).values.tolist()))
    assert sorted(want) == sorted(got) and rows(want) == rows(got)
