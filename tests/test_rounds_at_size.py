"""What decides how a job grows: searches beyond their bracket, blocks, tables written once, records dealt out."""

import math
from types import SimpleNamespace

from conftest import SF
from pyspark.sql import functions as F

from weighbridge.operators import calibrate as K
from weighbridge.operators import matrix, score
from weighbridge.operators import universe as U
from weighbridge.plans import queries
from weighbridge.sources import fixtures


def test_budget_beyond_the_first_bracket(monkeypatch):
    rounds = []

    def fits(problem, options, penalties, seed=0, **settings):
        rounds.append(len(penalties))
        return SimpleNamespace(retained=[min(1500, int(500 * 0.8 / (p * problem.n))) for p in penalties])

    monkeypatch.setattr(K, "informed_l0", fits)
    found = K.informed_l0_at_budget(SimpleNamespace(n=1500), None, 500, shares=(1.0, 30.0), tolerance=10)
    assert found.gap <= 10 and found.penalty * 1500 < 1 and len(rounds) <= 4
    found = K.informed_l0_at_budget(SimpleNamespace(n=1500), None, 5, shares=(1.0, 30.0), tolerance=0)
    assert found.gap == 0 and found.penalty * 1500 > 30


def test_guessed_penalties_lie_within_the_bracket():
    for width in (4, 5, 6):
        for kept in ((900, 10), (900, 899), (5, 5), (1000, 0)):
            grid = K._around(0.01, 0.5, kept, 300, width)
            assert len(grid) == width and grid == sorted(grid) and 0.01 < grid[0] and grid[-1] < 0.5


def test_a_guess_needs_few_rounds():
    n = [0]

    def run(grid):
        n[0] += 1
        return SimpleNamespace(retained=[int(7000 * math.exp(-g)) for g in grid])

    assert K.search_penalty(run, 1e-3, 1e2, 3333, tolerance=33, guess=True).gap <= 33 and n[0] <= 4


def test_tasks_follow_the_work_and_not_shuffle_partitions():
    assert K.tasks_for(18_000, 12) == 1 and K.tasks_for(1_080_000, 12) == 12 and K.tasks_for(180_000, 12) == 3


def test_run_rows_read_written_weights(spark):
    """The weight vectors are hashed once: what is made of them reads a written table."""
    rows = queries._run_rows(spark, SF)
    assert "md5" not in rows._jdf.queryExecution().toString()
    d = score.weight_diagnostics(fixtures.table(spark, SF, "fx_weight"), ["method", "seed", "budget_requested"])
    assert "md5" not in d._jdf.queryExecution().toString()


def test_many_customers_are_dealt_out(spark, monkeypatch):
    whole = fixtures.table(spark, SF, "fx_weight").agg(F.count("*"), F.sum("record_id"), F.round(F.sum("weight"), 4)).first()
    monkeypatch.setattr(fixtures, "MOST_RECORDS", 40)
    dealt = fixtures.table(spark, SF, "fx_weight")
    assert "c_custkey" in dealt._jdf.queryExecution().toString() and "RepartitionByExpression" in dealt._jdf.queryExecution().toString()
    assert dealt.agg(F.count("*"), F.sum("record_id"), F.round(F.sum("weight"), 4)).first() == whole


def test_matrix_sums_records_before_targets(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (1, "b", 4.0), (2, "a", 1.0), (2, "a", -1.0), (3, None, 7.0)], "record_id long, place string, money double")
    targets = spark.createDataFrame([("all", "e", "money", {}), ("a", "e", "money", {"place": "a"}), ("b", "e", "money", {"place": "b"})], "target_name string, entity string, measure string, filter map<string,string>")
    entity = U.Universe("e", {"e": rows}, rows.select("record_id", F.lit(1.0).alias("w0")).distinct())
    got = {(r.target_name, r.record_id): r.value for r in matrix.constraint_matrix(entity, targets).collect()}
    assert got == {("all", 1): 9.0, ("a", 1): 5.0, ("b", 1): 4.0, ("all", 3): 7.0}
    twice = matrix.constraint_matrix(entity, targets.unionByName(targets.where("target_name = 'b'")))
    assert {r.record_id: r.value for r in twice.where("target_name = 'b'").collect()} == {1: 8.0}


def test_estimates_of_many_runs_meet_each_record_once(spark):
    """More runs than columns of a row, repeated and missing records, weights of 0; what is grouped is as long as the matrix, not times the runs."""
    from weighbridge.operators import matrix

    n_runs, n = matrix.WIDE + 5, 40
    rows = [("m", k, i, float((i * 7 + k) % 11)) for k in range(n_runs) for i in range(n) if (i + k) % 3] + [("m", 0, 1, 5.0), ("m", 1, 999, 3.0), (None, 1, 2, 4.0), ("far", 0, 999, 2.0)]
    cells = [(f"t{i % 4}", i, float(i) - 9.5) for i in range(n)] + [("all", i, 1.0) for i in range(n)]
    w = spark.createDataFrame(rows, "method string, seed int, record_id long, weight double")
    m = spark.createDataFrame(cells, "target_name string, record_id long, value double")
    want = {}
    for method, seed, i, x in rows:
        for t, j, v in cells:
            if i == j:
                want[method, seed, t] = want.get((method, seed, t), 0.0) + v * x
    found = matrix.estimates(m, w, ["method", "seed"])
    got = {(r.method, r.seed, r.target_name): r.achieved_value for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert not matrix.estimates(m, w.limit(0), ["method", "seed"]).count()
    joined = matrix.estimates(m, w.where("method = 'm' and seed < 8"), ["method", "seed"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (record_id" in joined and joined.count("__w7") > 1


def test_a_subset_hashes_its_records_once_and_a_table_is_summed_once(spark, monkeypatch):
    """The subset is a written table, and rows of a record are read once however many shapes of target there are."""
    from weighbridge.operators import matrix

    ids = spark.range(100).select(F.col("id").alias("record_id"))
    found = U.random_subset(ids, 30, 3)
    u = F.expr(fixtures.SPARK_UNIFORM.format("concat('subset:3:', record_id)"))
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString() and {r[0] for r in found.collect()} == {r[0] for r in ids.orderBy(u, "record_id").limit(30).collect()}
    assert U.random_subset(ids, 100, 3).count() == 100 == U.random_subset(ids, 999, 3).count()

    names = []
    monkeypatch.setattr(matrix, "kept", lambda df, name, own=matrix.kept: names.append(name) or own(df, name))
    orders = spark.createDataFrame([(1, "n", 2.0), (1, "s", 3.0), (2, "n", None), (2, "n", 4.0), (3, "s", 0.0)], "record_id long, place string, total double")
    record = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "record_id long, w0 double")
    t = spark.createDataFrame([("all", "order", "total", {}), ("n", "order", "total", {"place": "n"}), ("s", "order", "total", {"place": "s"})], "target_name string, entity string, measure string, filter map<string,string>")
    built = matrix.constraint_matrix(U.Universe("record", {"record": record, "order": orders}, record), t)
    assert {tuple(r) for r in built.collect()} == {("all", 1, 5.0), ("all", 2, 4.0), ("n", 1, 2.0), ("n", 2, 4.0), ("s", 1, 3.0)} and names == ["sums"]
