"""Fits against plain numpy, searches, exact order statistics, and the state of sweeps."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.operators import calibrate as K
from weighbridge.operators import matrix, objective, order_statistics, report, runs, sample, sweep
from weighbridge.operators import universe as U
from weighbridge.plans import pipelines
from weighbridge.sources import state, tables


@pytest.fixture(scope="module")
def toy(spark):
    u = tables.toy_universe(spark, 90, 2)
    t = tables.toy_targets(u, copies=2).withColumns({"target_pos": F.xxhash64("target_name"), "family": F.col("measure"), "geography_level": F.lit("national"), "filter": F.expr("cast(map() as map<string,string>)")})
    t = spark.createDataFrame(t.collect(), t.schema)
    m = matrix.constraint_matrix(U.Universe("household", {"household": u}, u.select("record_id", "w0")), t)
    w = u.select("record_id", "w0")
    names = sorted(r.target_name for r in t.collect())
    dense = np.zeros((len(names), 90))
    for r in m.collect():
        dense[names.index(r.target_name), r.record_id] = r.value
    value = np.array([r.value for r in sorted(t.collect(), key=lambda r: r.target_name)])
    return SimpleNamespace(m=m, w=w, t=t, dense=dense, value=value, w0=np.array([r.w0 for r in w.orderBy("record_id").collect()]))


def _plain(toy, config: K.Config, epochs: int, rate: float, cap: float) -> np.ndarray:
    """Weights after so many epochs, record by record and without blocks."""
    ids, n = np.arange(len(toy.w0)), len(toy.w0)
    scale, share = np.maximum(np.abs(toy.value), 1), 1 / len(toy.value)
    sig = lambda x: 1 / (1 + np.exp(-x))
    theta = np.log(toy.w0) + (0.05 * K._normal(config.seed, 1, ids) if config.l0 else 0)
    gate = np.full(n, math.log(config.open_at_start / (1 - config.open_at_start))) + (0.01 * K._normal(config.seed, 3, ids) if config.l0 else 0)
    soft, moments = toy.w0.copy(), [np.zeros(n) for _ in range(4)]

    def gates(epoch):
        if not config.l0:
            return np.ones(n), np.zeros(n)
        u = K._noise(config.seed, epoch, 7, ids) if epoch is not None else None
        s = sig((np.log(u) - np.log(1 - u) + gate) / config.temperature) if epoch is not None else sig(gate)
        wide = 1.2 * s - 0.1
        inside = (wide > 0) & (wide < 1)
        return np.clip(wide, 0, 1), np.where(inside, 1.2 * s * (1 - s) / config.temperature, 0)

    for e in range(epochs):
        z, dz = gates(e)
        base = soft if config.l1 else np.exp(theta)
        w = base * z
        error = (toy.dense @ w - toy.value) / scale
        g = toy.dense.T @ (np.where(np.abs(error) < cap, np.sign(error), 0) * share / scale)
        gt, gg = g * w, g * base * dz
        if config.l2:
            gt = gt + 2 * config.l2 / n * (w / toy.w0) ** 2
            gg = gg + 2 * config.l2 / n * w * base * dz / toy.w0**2
        if config.l0:
            p = sig(gate - config.temperature * math.log(0.1 / 1.1))
            gg = gg + config.l0 * p * (1 - p)
        m, v, gm, gv = moments
        m, v, gm, gv = 0.9 * m + 0.1 * gt, 0.999 * v + 0.001 * gt**2, 0.9 * gm + 0.1 * gg, 0.999 * gv + 0.001 * gg**2
        moments, step = [m, v, gm, gv], lambda a, b: rate * (a / (1 - 0.9 ** (e + 1))) / (np.sqrt(b / (1 - 0.999 ** (e + 1))) + 1e-12)
        if config.l1:
            r = rate / math.sqrt(1 + e)
            soft = np.maximum(soft / toy.w0 - r * n * g * toy.w0 - r * config.l1, 0) * toy.w0
        else:
            theta = theta - step(m, v)
        gate = gate - step(gm, gv)
        if config.weight_ratio is not None:
            theta, soft = np.minimum(theta, np.log(config.weight_ratio * toy.w0)), np.minimum(soft, config.weight_ratio * toy.w0)
    return (soft if config.l1 else np.exp(theta)) * gates(None)[0]


CONFIGS = [
    K.Config("informed_l0", 1, l0=0.05, open_at_start=0.8), K.Config("informed_l0", 2, l0=0.05, l2=0.5, open_at_start=0.8), K.Config("informed_l0", 1, l0=0.02, weight_ratio=1.02, open_at_start=0.6, temperature=0.5),
    K.Config("informed_l1", 0, l1=0.3), K.Config("dense", 0, l2=2.0), K.Config("dense", 0, weight_ratio=1.03),
]


@pytest.mark.parametrize("blocks", [1, 4, 7])
def test_all_methods_equal_plain_numpy_on_any_number_of_blocks(toy, blocks):
    options = K.Options(epochs=5, rate=0.15, cap=1.0, checkpoint_every=2)
    p = K.Problem.build(toy.m, toy.w, toy.t, None, blocks)
    assert p.blocks.getNumPartitions() == blocks and sum(p.blocks.map(lambda b: len(b.ids)).collect()) == 90
    got = K.fit(p, CONFIGS, options)
    found = np.zeros((len(CONFIGS), 90))
    for r in got.weights.collect():
        found[r.configuration, r.record_id] = r.weight
    for k, config in enumerate(CONFIGS):
        assert np.allclose(found[k], _plain(toy, config, 5, 0.15, 1.0), rtol=1e-6, atol=1e-9), config
    history = K.history_frame(toy.w.sparkSession, got)
    assert history.count() == 5 * len(CONFIGS) and history.where("configuration = 4 and epoch = 4").first().n_open == 90
    p.blocks.unpersist()


def test_number_of_blocks():
    assert K.blocks_for(1_500, 27_000, 8) == 3 and K.blocks_for(15_000, 270_000, 8) == 8
    assert K.blocks_for(10_000_000, 100, 8) == 200 and K.blocks_for(1_000, 40_000_000, 8) == 20 and K.blocks_for(1, 0, 8) == 1


def test_open_chance_is_that_of_a_gate_above_zero():
    rng = np.random.default_rng(0)
    u = rng.random(400_000)
    for gate, temperature in ((-1.0, 0.25), (0.3, 0.6), (2.0, 1.0)):
        s = 1 / (1 + np.exp(-(np.log(u / (1 - u)) + gate) / temperature))
        assert abs((1.2 * s - 0.1 > 0).mean() - K.open_chance(np.array(gate), temperature)) < 3e-3


def _steps(counts):
    """A search's fits over a step function of the penalty."""
    def run(grid):
        run.fits += len(grid)
        return SimpleNamespace(retained=[counts(g) for g in grid])

    run.fits = 0
    return run


def test_search_ends_by_gap_or_bracket():
    steep = _steps(lambda g: 1499 if g < 1.2345 else max(0, int(1499 - 60_000 * (g - 1.2345))))  # all happens within two hundredths
    found = K.search_penalty(steep, 1e-3, 1e2, 750, tolerance=2, narrow=1 + 1e-7)
    assert found.gap <= 2 and abs(found.penalty - 1.247) < 1e-3
    jump = K.search_penalty(_steps(lambda g: 900 if g < 0.5 else 10), 1e-3, 1e2, 750)  # no penalty keeps 750
    assert jump.retained == 900 and jump.penalty < 0.5 and len(jump.tries) < 80
    early = K.search_penalty(_steps(lambda g: 749 if g > 1 else 751), 1e-3, 1e2, 750)  # equal gaps: the earliest
    assert (early.penalty, early.retained) == (early.tries[0][1], 751)
    none = _steps(lambda g: 0 if g > 2e-3 else 5)
    assert K.search_penalty(none, 1e-3, 1e2, 750, empty=False).retained == 5
    with pytest.raises(ValueError):
        K.search_penalty(_steps(lambda g: 0), 1e-3, 1e2, 750, empty=False)


def test_order_statistics_and_quantiles(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.choice([1, 2, 2.5, rng.random() * 10**rng.randint(0, 9)]))) for k in range(3) for _ in range((1, 400, 901)[k])]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r for r in order_statistics.quantiles(df, ["k"], "v", [0.0, 0.5, 0.9, 0.99, 1.0], few=10, bins=8).collect()}
    for k in range(3):
        own = [v for i, v in rows if i == k]
        assert np.allclose([got[k][f"q{i}"] for i in range(5)], np.quantile(own, [0, 0.5, 0.9, 0.99, 1]), rtol=1e-12)
    keyed = spark.createDataFrame([(i, float(i % 50)) for i in range(1000)] + [(2000, None)], "id long, key double")
    for n in (0, 1, 19, 20, 21, 505, 1000, 5000):
        want = sorted(range(1000), key=lambda i: (i % 50, i))[:n]
        assert sorted(r.id for r in order_statistics.least(keyed, "key", "id", n, few=10).collect()) == sorted(want)


def test_draws_of_several_budgets_are_those_of_each(spark):
    w = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "record_id long, weight double")
    both = sample.draws_at(w, [30, 90], 5)
    for n in (30, 90):
        alone = {r.record_id: r.draws for r in sample.draw_with_replacement(w, n, 5).collect()}
        assert {r.record_id: r.draws for r in both.where(F.col("budget") == n).collect()} == alone and sum(alone.values()) == n


# ---- sweeps ----------------------------------------------------------------------------------------------------

ROWS = [("a", 0, 10, 9, 0.0, "fixed_family", -1, "na", "run", "", "budget_achieved", 9.0), ("a", 0, 10, 9, 0.0, "fixed_family", -1, "in_sample", "overall", "", "mean_are", 0.5)]


def _metrics(spark, rows=None):
    return spark.createDataFrame(ROWS if rows is None else rows, sweep.TABLES["metrics"])


def test_shards_are_seen_when_committed_and_certified(spark, tmp_path):
    s = sweep.shards(spark, f"file://{tmp_path}/sweep")
    assert s.pending(["x, 1/2", "y"]) == ["x, 1/2", "y"] and s.read("metrics").count() == 0
    row = s.write("x, 1/2", {"metrics": _metrics(spark)})
    assert s.read("metrics").count() == 0 and s.pending(["x, 1/2"]) == ["x, 1/2"]  # data without an index row
    s.publish(row)
    assert s.certified("metrics").count() == 2 and s.pending(["y", "x, 1/2"]) == ["y"]
    assert s.commit("x, 1/2", {"metrics": _metrics(spark).limit(1)}) is None and s.certified("metrics").count() == 2
    empty = s.commit("y", {"metrics": _metrics(spark, [])})
    assert empty["tables"]["metrics"]["n_rows"] == 0 and s.certified("metrics").count() == 2
    # an attempt that lost a row, or whose rows changed
    lost = s.write("z", {"metrics": _metrics(spark)})
    lost["tables"]["metrics"]["n_rows"] = 3
    s.publish(lost)
    with pytest.raises(ValueError, match="z"):
        s.certified("metrics")


def test_artifacts_last_row_wins_and_missing_ones_are_named(spark, tmp_path):
    a = state.Artifacts(spark, f"file://{tmp_path}/run")
    cell = ("m", 0, 10, 0.0, "fixed_family", -1)
    kinds = state._CELL_KINDS
    run = spark.createDataFrame([(*cell, 2, "record", 3, 2, 1.0, 0.5, 0.1, 1.0)], f"{kinds}, budget_achieved long, weight_entity string, candidate_records long, n_selected long, runtime_s double, l0_lambda double, final_loss double, target_loss_cap double")
    vectors = lambda f: spark.createDataFrame([(*cell, i, f * i, 1.0) for i in range(3)], f"{kinds}, {state.VECTORS}")
    losses = spark.createDataFrame([(*cell, e, 1.0 / (1 + e)) for e in range(4)], f"{kinds}, {state.TRAJECTORY}")
    a.save(run, vectors(5.0), losses)
    attempt = a.save(run, vectors(1.0), losses)
    record, v, t = a.load(method="m", seed=0)
    assert record["n_selected"] == 2 and attempt in record["artifact_path"] and sorted(r.weight for r in v.collect()) == [0.0, 1.0, 2.0] and t.count() == 4
    assert a.vectors().count() == 3 and a.trajectories().count() == 4
    with pytest.raises(ValueError):
        a.load(method="other")
    (tmp_path / "run" / "vectors").rename(tmp_path / "gone")
    for read in (a.vectors, lambda: a.load(method="m")):
        with pytest.raises(FileNotFoundError, match="vectors/attempt="):
            read()


def test_records_are_strict(spark, tmp_path):
    path = f"file://{tmp_path}/record"
    assert state.read_record(spark, path) == {}
    state.write_record(spark, {"a": {"b": [1, float("nan"), np.float64(2.5), {"c": float("inf")}]}, "t": (1, 2), "s": {3, 1}}, path)
    assert state.read_record(spark, path) == {"a": {"b": [1, None, 2.5, {"c": None}]}, "t": [1, 2], "s": [1, 3]}
    for text, said in (('{"a": 1,\n "b": }', "line 2, column 7"), ('{"a": NaN}', "NaN")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        with pytest.raises(ValueError, match=said):
            state.read_record(spark, path)
    at = spark.sql("select timestamp'2024-03-01 12:00:00.25' as t").select(state.utc_text(F.col("t"))).first()[0]
    assert at == "2024-03-01T12:00:00.250000+00:00" and state.utc_now().endswith("+00:00")


def test_merge_of_sweeps_refuses_what_differs(spark, tmp_path):
    roots = {}
    for name, epochs in (("a", 5), ("b", 5), ("c", 6)):
        root = roots[name] = f"file://{tmp_path}/{name}"
        rows = [(*r[:1], "abc".index(name), *r[2:]) for r in ROWS]
        frames = {"metrics": _metrics(spark, rows)}
        sweep.shards(spark, root).commit("all", frames)
        sweep.sweep_manifest(spark, root, name, "complete", {"epochs": epochs, "deep": {"x": [1, 2]}}, ["a"])
    record = sweep.merge_sweeps(spark, {n: roots[n] for n in "ab"}, f"file://{tmp_path}/ab", "ab", ["a"])
    assert record["completed_cells"] == 2 and record["grid"]["seeds"] == [0, 1] and record["n_rows"] == {"metrics": 4} and state.read_record(spark, f"file://{tmp_path}/ab/manifest") == record
    with pytest.raises(ValueError, match="config.epochs"):
        sweep.merge_sweeps(spark, {n: roots[n] for n in "ac"}, f"file://{tmp_path}/ac", "ac", ["a"])
    with pytest.raises(ValueError):
        sweep.merge_sweeps(spark, {"a": roots["a"]}, f"file://{tmp_path}/one", "one", ["a"])
    spark.createDataFrame([("t",)], "target_name string").write.parquet(f"{roots['a']}/degenerate")
    with pytest.raises(FileNotFoundError, match="audits"):
        sweep.merge_sweeps(spark, {n: roots[n] for n in "ab"}, f"file://{tmp_path}/no", "no", ["a"])
    spark.createDataFrame([("u",)], "target_name string").write.parquet(f"{roots['b']}/degenerate")
    with pytest.raises(ValueError, match="audits"):
        sweep.merge_sweeps(spark, {n: roots[n] for n in "ab"}, f"file://{tmp_path}/no", "no", ["a"])


def test_run_metrics_of_samples(spark):
    w = spark.createDataFrame([("a", 0, 4, 0.0, i, x) for i, x in enumerate((1.0, 3.0, 0.0, 4.0))], "method string, seed int, budget_requested long, l2_lambda double, record_id long, weight double")
    told = spark.createDataFrame([("a", 0, 4, 0.0, 5, 0.25, 1.5)], "method string, seed int, budget_requested long, l2_lambda double, n_selected long, final_loss double, runtime_s double")
    r = sweep.run_metrics(w, told).first()
    assert (r.n_selected, r.n_unique_selected, r.budget_achieved, r.sum_weight, r.final_loss) == (5, 3, 5.0, 8.0, 0.25)
    assert r.ess == pytest.approx(64 / 26) and r.p50_weight == 3.0
    assert sweep.run_metrics(w, told.drop("n_selected")).first().n_selected == 3


# ---- smaller pieces --------------------------------------------------------------------------------------------


def test_loss_summary_takes_the_first_best_epoch(spark):
    h = spark.createDataFrame([("a", e, x) for e, x in enumerate((4.0, 1.0, 2.0, 1.0, 3.0))], "run string, epoch int, loss double")
    r = objective.loss_summary(h, ["run"], (2, 50)).first()
    assert (r.first_loss, r.last_loss, r.best_loss, r.best_epoch, r.epochs) == (4.0, 3.0, 1.0, 1, 5) and r.improvement_2 == -0.5 and r.improvement_50 is None


def test_registry_needs_its_references(spark):
    facts = spark.createDataFrame([("k1", "t1", 2023, 1.0, {"geo_level": "national"}), ("k2", "t1", 2024, 2.0, {"geo_level": "national"})], "aggregate_fact_key string, target_name string, vintage int, value double, metadata map<string,string>")
    wanted = spark.createDataFrame([("t1",), ("t2",)], "target_name string")
    assert pipelines.compile_registry(facts, 2024, ["target_name"], required=wanted.limit(1)).select("value").first()[0] == 2.0
    with pytest.raises(ValueError, match="t2"):
        pipelines.compile_registry(facts, 2024, ["target_name"], required=wanted)
    assert pipelines.compile_registry(facts, 2024, ["target_name"], required=wanted, partial=True).count() == 1
    with pytest.raises(ValueError):
        pipelines.compile_registry(facts, 2024, ["target_name"], partial=True)


def test_staged_transforms_and_frozen_inputs(spark, tmp_path):
    df = spark.range(3)
    out, record = pipelines.staged(df, [("double", lambda d: d.withColumn("x", F.col("id") * 2)), ("keep", lambda d: d.where("x > 0").select("x"))])
    assert [r.x for r in out.orderBy("x").collect()] == [2, 4] and record == [("double", ["id", "x"]), ("keep", ["x"])]
    targets = spark.createDataFrame([("t", 1.0, "extra")], "target_name string, value double, other string")
    tables.freeze({"record": df}, targets, {"n": 3}, f"file://{tmp_path}/frozen")
    entities, back = tables.thaw(spark, f"file://{tmp_path}/frozen", ["record"])
    assert entities["record"].count() == 3 and back.columns == ["target_name", "value"]
    (tmp_path / "walk.csv").write_text("source_geography_id,target_geography_id,weight\na,b,0.5\n")
    assert tables.read_crosswalk(spark, f"file://{tmp_path}/walk.csv").first().weight == 0.5


def test_bundle_is_written_with_its_record(spark, tmp_path):
    record = tables.write_bundle({"one": spark.range(2), "two": spark.createDataFrame([([1, 2],)], "v array<int>")}, f"file://{tmp_path}/bundle", {"split": "in_sample"})
    assert {k: v["n_rows"] for k, v in record["frames"].items()} == {"one": 2, "two": 1}
    assert state.read_record(spark, f"file://{tmp_path}/bundle/bundle") == record and (tmp_path / "bundle" / "two").is_dir()
    assert report.SCORE_FIELDS and runs.CELL


def test_audits_of_both_splits(spark, tmp_path):
    a = spark.createDataFrame([("t", 1.0)], "target_name string, floor double")
    tables.write_audit({"in_sample": a, "out_of_sample": a.limit(0)}, f"file://{tmp_path}/audit")
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/audit").collect()
    assert [(r.target_name, r.split) for r in got] == [("t", "in_sample")]


def test_methods_by_name(toy):
    with pytest.raises(ValueError, match="other"):
        pipelines.run_methods(toy.m, toy.w, toy.t, 30, 0, K.Options(epochs=2), ["dense_sample", "other"])
    w, ran = pipelines.run_methods(toy.m, toy.w, toy.t, 30, 0, K.Options(epochs=4, rate=0.15, cap=1.0, partitions=2), ["dense_sample", "random_reweight"])
    assert {r.method: r.n_selected for r in ran.collect()} == {"dense_sample": 30, "random_reweight": 30} and w.where("method = 'random_reweight'").count() == 30
