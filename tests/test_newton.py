"""Newton's logistic regression against a dense solution, and its border cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.operators.newton import fit_newton


def rows(spark, n=1500, posts=12):
    rng = np.random.default_rng(4)
    a, b, post = rng.normal(size=n), rng.normal(size=n) * 3, np.minimum(rng.geometric(0.3, n), posts) - 1  # one post has a third of all
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * a - 0.3 * b + (post - 5) / 4)))).astype(int)
    y[post == 7] = 0  # a post without an event
    data = [(int(p) if p else None, float(u), float(v), int(t), float(1 + (t > 0))) for p, u, v, t in zip(post, a, b, y)]
    return spark.createDataFrame(data, "post int, a double, b double, y int, w double"), a, b, post, y


def dense(x, y, w, penalty):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
    return beta


def test_equals_dense_solution(spark):
    df, a, b, _, y = rows(spark)
    got = fit_newton(df, ["a", "b"], "y", weight="w", ridge=0.5)
    want = dense(np.column_stack([np.ones(len(a)), a, b]), y, 1.0 + y, np.array([0, 0.5, 0.5]))
    assert np.allclose([got.intercept, *got.coefficients], want, atol=1e-8) and got.gradient < 1e-10


def test_group_effects_are_eliminated_exactly(spark):
    df, a, b, post, y = rows(spark)
    got = fit_newton(df, ["a", "b"], "y", group="post", ridge=0.1, group_ridge=2.0)
    seen = np.unique(post)
    x = np.column_stack([np.ones(len(a)), a, b, post[:, None] == seen[None, :]])
    want = dense(x, y, np.ones(len(y)), np.array([0, 0.1, 0.1] + [2.0] * len(seen)))
    assert np.allclose([got.intercept, *got.coefficients], want[:3], atol=1e-8) and got.gradient < 1e-10
    effects = {r.post: r.effect for r in got.effects.collect()}
    assert np.allclose([effects[int(p) if p else None] for p in seen], want[3:], atol=1e-8)
    scored = got.score(df.limit(5).unionByName(df.limit(1).withColumn("post", F.lit(99))), "p")
    assert scored.columns == [*df.columns, "p"] and scored.filter("p > 0 and p < 1").count() == 6


def test_borders(spark):
    empty = spark.createDataFrame([], "x double, y int")
    got = fit_newton(empty, ["x"], "y")
    assert (got.intercept, got.coefficients, got.steps) == (0.0, (0.0,), 0)
    odd = spark.createDataFrame([(None, 0), (float("nan"), 1), (1.0, 1), (2.0, 0), (3.0, None)], "x double, y int")
    got = fit_newton(odd, ["x"], "y")
    want = dense(np.array([[1, 0], [1, 0], [1, 1], [1, 2.0]]), np.array([0, 1, 1, 0]), np.ones(4), np.zeros(2))
    assert np.allclose([got.intercept, *got.coefficients], want, atol=1e-8)
    apart = spark.createDataFrame([(-1.0, 0), (1.0, 1)], "x double, y int")
    assert fit_newton(apart, ["x"], "y", max_steps=6).steps <= 6
    with pytest.raises(ValueError):
        fit_newton(odd, ["x"], "y", group="x", group_ridge=0.0)
