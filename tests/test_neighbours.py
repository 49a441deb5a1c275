"""Neighbours at band edges and lags by row number, against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklattice.functions.ordered import row_lag
from risklattice.functions.timeparts import POSTS_PER_BAND, day_chunk
from risklattice.operators.joins import neighbour_context


def test_neighbours_across_band_edges(spark):
    b = POSTS_PER_BAND
    posts = [-1, 0, 1, 3, b - 2, b - 1, b, b + 1, 2 * b - 1, 2 * b + 1]
    rows = [(d, p, None if p == 1 else float(p * 10 + d)) for d in (0, 1) for p in posts] + [(0, None, 5.0)]
    df = spark.createDataFrame(rows, "dir int, pos long, v double")
    got = {(r.dir, r.pos): r for r in neighbour_context(df, ["v"], ["dir"], "pos").collect()}
    have = {(d, p): v for d, p, v in rows}
    assert len(got) == len(rows)
    for (d, p), v in have.items():
        for side, step in (("v_up", -1), ("v_dn", 1)):
            near = None if p is None else have.get((d, p + step))
            assert got[d, p][side] == (v if near is None else near), (d, p, side)
    assert neighbour_context(df, ["v"], ["dir"], "pos").columns == ["dir", "pos", "v", "v_up", "v_grad_up", "v_dn", "v_grad_dn"]
    assert neighbour_context(df.limit(0), ["v"], ["dir"], "pos").count() == 0


def test_neighbours_take_one_shuffle(spark):
    df = spark.range(10).select(F.lit(0).alias("dir"), F.col("id").alias("pos"), F.rand(1).alias("v"))
    plan = neighbour_context(df, ["v"], ["dir"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_lag_by_row_number(spark):
    rows = [(k, d, None if d % 7 == 0 else float(d * 100 + k)) for k in (1, 2) for d in range(0, 90, k)]
    df = spark.createDataFrame(rows, "k int, d int, v double").withColumn("t", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(d)"))
    got = {(r.k, r.d): r.old for r in row_lag(df, ["k"], ["t"], day_chunk("t", 10), {"v": "old"}, 25).collect()}
    want = {}
    for k in (1, 2):
        own = [r for r in rows if r[0] == k]
        want |= {(k, own[i][1]): own[i - 25][2] for i in range(25, len(own))}
    assert got == want
    assert row_lag(df, ["k"], ["t"], day_chunk("t", 10), {"v": "old"}, 1000).count() == 0
