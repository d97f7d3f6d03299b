"""The target-by-record matrix: how it is built, estimates from it, identifiability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from .universe import Universe

#: Runs whose weights are columns of one row.
WIDE = 32
#: Runs whose keys, and targets that, are broadcast.
MOST_BROADCAST = 100_000


def constraint_matrix(universe: Universe, targets: DataFrame) -> DataFrame:
    """(target_name, record_id, value): the sum, over a record's rows of the target's entity that pass its filter, of the measure.

    Filters are maps of column to value.  Targets are joined for each set of filter
    columns by itself, on measure and values at once, so that a row meets only the
    targets that it belongs to.  Zeros are dropped.  A record's rows are summed before
    they meet targets, so that what is grouped is as long as the entity's table and not
    as the matrix; a target has one entity, measure and filter, hence one such sum.
    """
    shapes = targets.groupBy("entity", F.array_sort(F.map_keys("filter")).alias("keys"), "measure").count().collect()  # a row for each shape of target
    few = sum(r["count"] for r in shapes) <= MOST_BROADCAST
    repeated = bool(targets.groupBy("target_name").count().where("count > 1").limit(1).count())
    parts = []
    by_shape = sorted({(r["entity"], tuple(r["keys"])) for r in shapes})
    tables = dict(universe.tables)
    for entity in {e for e, _ in by_shape if e != universe.weight_entity and sum(e == other for other, _ in by_shape) > 1}:
        # rows of a record are summed by all filter columns at once, so that the table is read once for all shapes
        every = sorted({k for e, keys in by_shape if e == entity for k in keys})
        summed = sorted({r["measure"] for r in shapes if r["entity"] == entity and r["measure"] in tables[entity].columns} - set(every) - {"record_id"})
        if summed:
            cells = tables[entity].select("record_id", *every, *[F.col(m).cast("double").alias(m) for m in summed])
            tables[entity] = kept(cells.groupBy("record_id", *every).agg(*[F.sum(m).alias(m) for m in summed]), "sums")
    for entity, keys in by_shape:
        table = tables[entity]
        measures = sorted(r["measure"] for r in shapes if (r["entity"], tuple(r["keys"])) == (entity, keys) and r["measure"] in table.columns)
        if not measures:
            continue
        same_keys = F.array_sort(F.map_keys("filter")) == F.array(*[F.lit(k) for k in keys]).cast("array<string>")
        shaped = targets.where((F.col("entity") == entity) & same_keys).select("target_name", "measure", *[F.col("filter")[k].alias(f"__{k}") for k in keys])
        values = table.select("record_id", *[F.col(k).cast("string").alias(f"__{k}") for k in keys], *[F.col(m).cast("double").alias(m) for m in measures])
        sums = values.groupBy("record_id", *[f"__{k}" for k in keys]).agg(*[F.sum(m).alias(m) for m in measures])
        long = sums.unpivot(["record_id", *[f"__{k}" for k in keys]], measures, "measure", "value").where("value <> 0")
        parts.append(long.join(F.broadcast(shaped) if few else shaped, ["measure", *[f"__{k}" for k in keys]]).select("target_name", "record_id", "value"))
    if not parts:
        return targets.sparkSession.createDataFrame([], "target_name string, record_id long, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if repeated:  # rows of one name are one target
        out = out.groupBy("target_name", "record_id").agg(F.sum("value").alias("value")).where("value <> 0")
    return out


def estimates(matrix: DataFrame, weights: DataFrame, run_keys: list[str]) -> DataFrame:
    """Weighted sums (run keys, target_name, achieved_value) of all runs in one pass; targets that no record touches have no row.

    The weights of up to ``WIDE`` runs are columns of one row of a record, so that the matrix
    meets a record once for so many runs and what is grouped is as long as the matrix.
    """
    cells, held = matrix.select("target_name", "record_id", "value"), weights.select(*run_keys, "record_id", "weight")
    runs = kept(held.select(*run_keys).distinct(), "runs")
    n = runs.count()
    if not n or n > MOST_BROADCAST:
        return cells.join(held, "record_id").groupBy(*run_keys, "target_name").agg(F.sum(F.col("value") * F.col("weight")).alias("achieved_value"))
    nth = F.row_number().over(Window.orderBy(*run_keys)) - 1  # of MOST_BROADCAST runs at most
    runs = runs.select(*run_keys, F.floor(nth / WIDE).cast("int").alias("__part"), (nth % WIDE).alias("__nth"))
    width = min(n, WIDE)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in run_keys]
    wide = held.alias("w").join(F.broadcast(runs).alias("r"), same).groupBy("record_id", "__part").agg(*[F.sum(F.when(F.col("__nth") == k, F.col("weight"))).alias(f"__w{k}") for k in range(width)])
    sums = cells.join(wide, "record_id").groupBy("__part", "target_name").agg(*[F.sum(F.col("value") * F.col(f"__w{k}")).alias(f"__w{k}") for k in range(width)])
    told = F.array(*[F.struct(F.lit(k).alias("__nth"), F.col(f"__w{k}").alias("achieved_value")) for k in range(width)])
    long = sums.select("__part", "target_name", F.inline(told)).where("achieved_value is not null")
    return long.join(F.broadcast(runs), ["__part", "__nth"]).select(*run_keys, "target_name", "achieved_value")


def achieved(targets: DataFrame, runs: DataFrame, found: DataFrame, run_keys: list[str]) -> DataFrame:
    """All targets of all runs with their estimate, 0 where there is none."""
    own = runs.select(*run_keys).distinct()
    few = own.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    grid = targets.crossJoin(F.broadcast(own) if few else own)  # targets x runs, as many rows as there are results
    return grid.join(found, [*run_keys, "target_name"], "left").withColumn("achieved_value", F.coalesce("achieved_value", F.lit(0.0)))


def identifiability_floors(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """(target_name, floor): the largest share that a single record can have in a target, at start weights."""
    joined = matrix.select("target_name", "record_id", "value").join(weights.select("record_id", "w0"), "record_id")
    return joined.groupBy("target_name").agg(F.max(F.abs("value") * F.col("w0")).alias("floor"))


def degenerate_audit(targets: DataFrame, floors: DataFrame) -> DataFrame:
    """Targets with a value that is not 0 and below the floor, the worst first."""
    both = targets.join(floors, "target_name").where((F.col("value") != 0) & (F.abs("value") < F.col("floor")))
    return both.withColumn("floor_ratio", F.col("floor") / F.abs("value")).orderBy(F.desc("floor_ratio"), "target_name")


def degenerate_names(targets: DataFrame, floors: DataFrame) -> DataFrame:
    """Names of targets below the floor; those of value 0 are among them."""
    return targets.join(floors, "target_name").where(F.abs("value") < F.col("floor")).select("target_name").distinct()
