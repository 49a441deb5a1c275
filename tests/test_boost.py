"""Boosted trees: derivatives, monotone responses, missing values, subsamples and what they learn."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.operators import boost as B
from risklattice.operators.models import MODELS


def rows(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x, noise, drop = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    z = 1.5 * x - 1.0 * (drop > 0) - 1 + 0.8 * np.sin(4 * x)  # x rises on the whole, but waves
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    data = [(i, float(a) if i % 50 else None, float(b) if i % 70 else float("nan"), float(c), int(t)) for i, (a, b, c, t) in enumerate(zip(x, noise, drop, y))]
    return spark.createDataFrame(data, "id long, speed_std double, noise double, other double, y int")


@pytest.mark.parametrize("objective, loss", [
    (B.logistic, lambda z, y: -np.log(1 / (1 + np.exp(-z * (2 * y - 1))))),
    (B.focal(0.3, 1.5), lambda z, y: -(0.3 if y else 0.7) * (1 - 1 / (1 + np.exp(-z * (2 * y - 1)))) ** 1.5 * np.log(1 / (1 + np.exp(-z * (2 * y - 1))))),
])
def test_derivatives(spark, objective, loss):
    grid = spark.createDataFrame([(float(z), y) for z in np.linspace(-3, 3, 13) for y in (0, 1)], "z double, y int")
    g, h = objective(F.col("z"), F.col("y"))
    for r in grid.select("z", "y", g.alias("g"), h.alias("h")).collect():
        e = 1e-4
        first = (loss(r.z + e, r.y) - loss(r.z - e, r.y)) / (2 * e)
        second = (loss(r.z + e, r.y) - 2 * loss(r.z, r.y) + loss(r.z - e, r.y)) / e**2
        assert abs(r.g - first) < 1e-5 and abs(r.h - max(second, 1e-6)) < 1e-3


def test_scores_rise_in_a_sweep(spark):
    df = rows(spark)
    features = ["speed_std", "noise", "other"]
    sweep = spark.range(41).select(*[F.lit(v).alias(f) for f, v in (("noise", 0.1), ("other", -0.2))], ((F.col("id") - 20) / 8).alias("speed_std"))
    free = [r.prob for r in B.fit_boosted(df, features, "y", trees=12, depth=4, step=0.3, bins=16)(sweep).orderBy("speed_std").collect()]
    held = [r.prob for r in B.fit_gbt_mono(df, features, "y", trees=12, depth=4, step=0.3, bins=16)(sweep).orderBy("speed_std").collect()]
    assert any(b < a - 1e-6 for a, b in zip(free, free[1:]))
    assert all(b >= a - 1e-12 for a, b in zip(held, held[1:])) and held[-1] > held[0] + 0.2
    low = B.fit_boosted(df, features, "y", trees=6, depth=3, step=0.3, bins=16, falling=["^other$"])
    down = [r.prob for r in low(spark.range(41).select(F.lit(0.0).alias("speed_std"), F.lit(0.0).alias("noise"), ((F.col("id") - 20) / 8).alias("other"))).orderBy("other").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(down, down[1:])) and down[0] > down[-1]


def test_learns_and_repeats(spark):
    df = rows(spark)
    how = dict(trees=10, depth=3, step=0.3, bins=16, key="id", subsample=0.7, feature_share=0.7, flush=3)
    one, two = (B.fit_gbt_focal(df, ["speed_std", "noise", "other"], "y", **how) for _ in range(2))
    flat = lambda m: [tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in m.table()]  # noqa: E731  sums vary in their last bits
    assert flat(one) == flat(two) and len(one.trees) == 10
    scored = one(df).select("y", "prob").toPandas()
    ranks = scored["prob"].rank()
    positive = scored["y"] == 1
    auc = (ranks[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())
    assert auc > 0.75
    assert {"gbt_focal", "gbt_mono"} <= set(MODELS)


def test_missing_values_and_no_rows(spark):
    data = [(i, None if i % 2 else float(i % 7), i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "id long, x double, y int")
    model = B.fit_boosted(df, ["x"], "y", trees=3, depth=2, step=0.5)
    prob = {r.id % 2: r.prob for r in model(df).collect()}
    assert prob[1] > 0.6 and prob[0] < 0.4 and model.trees[0][1].cut == 0
    empty = B.fit_boosted(df.limit(0), ["x"], "y", trees=2)
    assert [n.value for t in empty.trees for n in t.values()] == [0.0, 0.0]
    assert all(r.prob == 0.5 for r in empty(df).collect())
    with pytest.raises(ValueError):
        B.fit_boosted(df, ["x"], "y", subsample=0.5)
