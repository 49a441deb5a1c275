"""The lattice's size estimate and its tasks: later joins must not broadcast it, and sorts must see small parts of it."""

from pyspark.sql import functions as F

from risklattice.functions import ordered
from risklattice.operators import impute, windows
from risklattice.operators.joins import build_lattice
from risklattice.queries import views


def test_lattice_is_whole(spark):
    rows = build_lattice(spark.createDataFrame([(1, 0), (2, 1)], "pos int, dir int"), "2024-01-01", "2024-03-01", 60)
    assert rows.count() == rows.distinct().count() == 2 * 60 * 24
    first, last = rows.agg(F.min("t").cast("string"), F.max("t").cast("string")).first()
    assert (first, last) == ("2024-01-01 00:00:00", "2024-02-29 23:00:00")


def test_lattice_is_not_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        one, two = (build_lattice(spark.range(2000).select(F.col("id").alias("pos")).distinct(), "2024-01-01", "2024-01-31", 60) for _ in "ab")
        both = one.join(two, ["pos", "t"], "left")
        rows = both.agg(F.count(F.lit(1)))
        assert rows.collect()[0][0] == 2000 * 720
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sorts_see_small_parts(spark, tmp_path):
    """The grid compresses well, but joined, windowed and interpolated rows stay in many tasks."""
    events = spark.range(4000).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-03 05:00:00' as ts", "id % 40 as user_id", "'view' as event_type", "cast(id as double) as value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    cells = views.cells(spark, str(tmp_path))
    lagged = windows.lags(cells, ["dir", "pos"], "t", "flow")
    filled = impute.interpolate(cells.select("pos", "dir", "t", "speed"), ["dir", "pos"], "t", ["speed"])
    for df in (lagged, filled):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(sizes) == 40 * 720 and len(sizes) > 2 * spark.sparkContext.defaultParallelism


def test_tasks_follow_the_rows_of_the_grid(spark, tmp_path, monkeypatch):
    """However few the cores are, a task of the joins, windows and interpolations gets a bounded share of the grid."""
    events = spark.range(4000).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-03 05:00:00' as ts", "id % 40 as user_id", "'view' as event_type", "cast(id as double) as value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(ordered.dealt, "__defaults__", (1, 300))
    cells = views.cells(spark, str(tmp_path))
    lagged = windows.lags(cells, ["dir", "pos"], "t", "flow")
    steep = windows.spatial_gradient(lagged, ["t", "dir"], "pos", {"flow": "vol"}, ["flow"])
    filled = impute.interpolate(cells.select("pos", "dir", "t", "speed"), ["dir", "pos"], "t", ["speed"])
    for df in (cells, lagged, steep, filled):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert ordered.grid_rows(df) == sum(sizes) == 40 * 720 and len(sizes) > 60
    assert ordered.grid_rows(build_lattice(spark.createDataFrame([], "pos int"), "2024-01-01", "2024-03-01", 60)) == 0
    assert ordered.grid_rows(build_lattice(spark.createDataFrame([(1,)], "pos int"), "2024-01-01", "2024-01-01", 60)) == 0
