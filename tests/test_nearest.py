"""Nearest neighbours against brute force, on copies, ties and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.operators import diagnose


def frame(spark, points, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vec array<double>")


def brute(queries, points, k, first=0, skip_self=False):
    out = []
    for i, q in enumerate(queries):
        dist = np.sqrt(((q[None] - points) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(points)), dist)) if not (skip_self and j == i)][:k]
        out += [(i, first + j, round(float(dist[j]), 9), r + 1) for r, j in enumerate(order)]
    return sorted(out)


def rows(df):
    return sorted((r.id, r.neighbour, round(r.distance, 9), r["rank"]) for r in df.collect())


def test_cells_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    grid = rng.integers(0, 9, (900, 2)).astype(float)
    points = np.r_[grid, np.full((300, 2), 4.0), rng.normal(size=(400, 2)) * 0.01, [[500.0, -500.0]]]
    df = frame(spark, points)
    assert rows(diagnose.nearest(df, df, "id", "vec", 4, skip_self=True, rows_per_block=60)) == brute(points, points, 4, skip_self=True)


@pytest.mark.parametrize("dims", [1, 3, 20])
def test_other_points(spark, dims):
    rng = np.random.default_rng(dims)
    queries, points = rng.normal(size=(350, dims)) * 2, rng.normal(size=(500, dims)) + 1000
    got = diagnose.nearest(frame(spark, queries), frame(spark, points, 10_000), "id", "vec", 5, rows_per_block=40)
    assert rows(got) == brute(queries, points, 5, first=10_000)


def test_few_points_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0])], "id long, vec array<double>")
    assert rows(diagnose.nearest(df, df, "id", "vec", 3, skip_self=True)) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    assert diagnose.nearest(df, df.limit(0), "id", "vec", 3).count() == 0


def test_work_of_copies_and_many_rows_stays_small(spark):
    """Points are dealt to the blocks of the queries of their cell, not to all blocks of queries."""
    n = 30_000
    df = spark.range(n).select("id", F.array(F.rand(1), (F.col("id") % 24).cast("double")).alias("vec"))
    got = diagnose.nearest(df, df, "id", "vec", 2, skip_self=True, rows_per_block=1000)
    assert got.count() == 2 * n
