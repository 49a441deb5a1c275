"""The block-wise helpers against plain pandas, on skewed and irregular data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from risklattice.functions import ordered
from risklattice.operators import diagnose, evaluate, models


@pytest.fixture(scope="module")
def skewed():
    """One key holds two thirds of the rows; steps are irregular, with long holes."""
    rng = np.random.default_rng(3)
    k = np.where(rng.random(3000) < 0.66, 0, rng.integers(1, 9, 3000))
    t = rng.integers(0, 5000, 3000)
    pdf = pd.DataFrame({"k": k, "t": t}).drop_duplicates().reset_index(drop=True)
    pdf.loc[pdf.t.between(1000, 2500), "t"] += 100_000
    pdf = pdf.drop_duplicates(["k", "t"]).reset_index(drop=True)
    pdf["x"] = rng.integers(0, 40, len(pdf)).astype(float)
    return pdf


def as_pandas(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_over_blocks_equals_plain_window(spark, skewed):
    sdf = spark.createDataFrame(skewed)

    def exprs(w):
        return {"l3": F.lag("x", 3).over(w), "d2": F.lead("x", 2).over(w), "m5": F.avg("x").over(w.rowsBetween(-4, 0))}

    got = as_pandas(ordered.over_blocks(sdf, ["k"], ["t"], F.floor(F.col("t") / 7).cast("long"), exprs, 4, 2), "k", "t")
    want = skewed.sort_values(["k", "t"]).reset_index(drop=True)
    g = want.groupby("k")["x"]
    want["l3"], want["d2"] = g.shift(3), g.shift(-2)
    want["m5"] = g.rolling(5, min_periods=1).mean().reset_index(level=0, drop=True)
    pd.testing.assert_frame_equal(got[["k", "t", "l3", "d2", "m5"]], want[["k", "t", "l3", "d2", "m5"]], check_dtype=False)


def test_running_equals_cumsum(spark, skewed):
    sdf = spark.createDataFrame(skewed)
    out = ordered.running(sdf, ["k"], ["t"], F.floor(F.col("t") / 11).cast("long"), {"c": F.col("x")}, totals=True)
    got, want = as_pandas(out, "k", "t"), skewed.sort_values(["k", "t"]).reset_index(drop=True)
    assert (got["c"] == want.groupby("k")["x"].cumsum()).all()
    assert (got["tot_c"] == want.groupby("k")["x"].transform("sum")).all()


def test_exact_quantiles(spark, skewed):
    shifted = skewed.assign(x=skewed.x - 13.5)
    out = ordered.exact_quantiles(spark.createDataFrame(shifted), ["k"], "x", {"a": 0.05, "b": 0.5, "c": 0.985})
    got = as_pandas(out, "k").set_index("k")
    for name, q in (("a", 0.05), ("b", 0.5), ("c", 0.985)):
        np.testing.assert_allclose(got[name], shifted.groupby("k")["x"].quantile(q))


def test_value_bin_never_decreases(spark):
    rng = np.random.default_rng(0)
    values = np.sort(np.r_[rng.normal(size=500) * 10.0 ** rng.integers(-9, 9, 500), 0.0, 1.0, -1.0])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).withColumn("b", ordered.value_bin("v"))
    assert df.toPandas().sort_values("v")["b"].is_monotonic_increasing


@pytest.mark.parametrize("n", [0, 1, 500, 10_000])
def test_sample_rank_is_exact(spark, n):
    df = spark.range(2000).withColumn("h", ordered.scatter("id", 4))
    out = ordered.sample_rank(df, "h", "id", F.lit(n))
    assert out.count() == min(n, 2000)
    if n == 500:
        want = df.orderBy("h", "id").limit(500).select("id")
        assert out.select("id").exceptAll(want).count() == 0


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    points = np.r_[rng.normal(size=(300, 6)), rng.normal(size=(300, 6)) * 0.05 + 3, np.tile(rng.normal(size=(1, 6)), (5, 1))]
    sdf = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    got = diagnose.nearest(sdf, sdf, "id", "vec", 3, skip_self=True, pivots=7, rows_per_block=90).toPandas()
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    want = np.sort(dist, axis=1)[:, :3]
    got = got.sort_values(["id", "rank"])
    assert len(got) == len(points) * 3
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(-1, 3), want, atol=1e-9)


def test_bootstrap_equals_resampled_rows(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"day": rng.integers(0, 6, 400), "y": rng.integers(0, 2, 400), "s": rng.integers(0, 30, 400) / 30})
    sdf = spark.createDataFrame(pdf).withColumn("m", F.lit("a"))
    got = evaluate.bootstrap_days(sdf, "y", "s", "day", ["m"], 8, 5).toPandas().set_index("rep")
    counts = evaluate._multiplicities(6, 8, 5)
    for rep in range(8):
        rows = pd.concat([pdf[pdf.day == d] for d in range(6) for _ in range(int(counts[d, rep]))])
        g = rows.groupby("s")["y"].agg(["size", "sum"]).sort_index(ascending=False)
        ap = (g["sum"] * g["sum"].cumsum() / g["size"].cumsum()).sum() / g["sum"].sum()
        assert got.loc[rep, "ap"] == pytest.approx(ap)


def test_smote_rows_lie_between_positives(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": np.arange(200), "a": rng.random(200), "b": rng.random(200), "y": (np.arange(200) % 5 == 0).astype(int)})
    out = models.smote(spark.createDataFrame(pdf), ["a", "b"], "y", "id").toPandas()
    assert out["id"].is_unique and (out["y"] == 1).sum() == (out["y"] == 0).sum()
    made, pos = out[out.synthetic == 1], pdf[pdf.y == 1]
    for c in ("a", "b"):
        assert made[c].between(pos[c].min(), pos[c].max()).all()


def test_permutation_keeps_the_values(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    out = diagnose.permute_column(df, "x", "id", 1).toPandas()
    assert sorted(out["x"]) == list(range(0, 2000, 2)) and (out["x"] != out["id"] * 2).mean() > 0.9


def test_nan_is_missing_in_quantiles(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, float("nan"), 5.0, None)], "k int, x double")
    assert ordered.exact_quantiles(df, ["k"], "x", {"m": 0.5}).first().m == 2.5
    assert ordered.exact_quantiles(df, [], "x", {"top": 1.0}).first().top == 5.0


def test_minutes_spread_a_month_of_instants(spark):
    month = spark.range(0, 40_000).selectExpr("1704067200000000 + id * 60000000 as t")
    bins = month.groupBy(ordered.minute_bin("t").alias("b")).count()
    assert bins.count() == 40_000
    picked = ordered.exact_quantiles(month, [], "t", {"m": 0.5}, ordered.minute_bin).first().m
    assert picked == 1704067200000000 + 19_999.5 * 60000000
