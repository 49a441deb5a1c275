"""Logistic regression by Newton steps whose sums are DataFrame aggregates.

A step needs the gradient and the curvature, which add up over rows: one pass with map-side combining, and what reaches the
driver has the size of the square of the number of features. Effects of groups (one per post) have a diagonal block in the
curvature, so they are eliminated group by group: only their sums meet, and the effects stay a table, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _number(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.isnan(x), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


@dataclass(frozen=True)
class NewtonLogit:
    """``coefficients`` in the order of ``features``; ``effects`` (group, effect) where groups have their own.

    ``gradient`` is the largest derivative left, in the penalised loss per row; ``steps`` counts the accepted steps.
    """

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    group: str | None
    effects: DataFrame | None
    gradient: float
    steps: int

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """Probabilities; missing features count as 0, and a group not seen in training has effect 0."""
        z: Column = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            z = z + F.lit(weight) * _number(name)
        if self.effects is None:
            return df.withColumn(out, 1.0 / (1.0 + F.exp(-z)))
        known = self.effects.select(F.col(self.group).alias("_g"), F.col("effect").alias("_e"))
        joined = df.join(known, F.col(self.group).eqNullSafe(F.col("_g")), "left")
        return joined.withColumn(out, 1.0 / (1.0 + F.exp(-(z + F.coalesce("_e", F.lit(0.0)))))).drop("_g", "_e")


def fit_newton(
    df: DataFrame, features: Sequence[str], y: str, group: str | None = None, weight: str | None = None,
    ridge: float = 0.0, group_ridge: float = 1.0, max_steps: int = 25, tolerance: float = 1e-10,
) -> NewtonLogit:
    """Minimises the weighted logistic loss plus ``ridge``/2 per squared coefficient and ``group_ridge``/2 per squared effect.

    The intercept is free. Rows without a label are left out; a null group is a group. A step that would raise the loss is
    halved. Where classes are separable and nothing is penalised there is no minimum, and the steps end at ``max_steps``.
    An empty table gives zeros.
    """
    names = list(features)
    m = len(names) + 1
    if group is not None and group_ridge <= 0:
        raise ValueError("group effects beside an intercept need group_ridge > 0")
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, m)]]
    rows = df.filter(F.col(y).isNotNull()).select(
        F.col(y).cast("double").alias("_y"), (_number(weight) if weight else F.lit(1.0)).alias("_w"),
        *[_number(c).alias(f"_x{i}") for i, c in enumerate(names, 1)], *([F.col(group).alias("_g")] if group else []))
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    penalty = np.array([0.0] + [ridge] * (m - 1))

    def sums(beta: np.ndarray, effects: DataFrame | None, step: float) -> tuple[np.ndarray, np.ndarray, float, float, float, DataFrame | None]:
        """Gradient and curvature with the groups eliminated, loss, rows' weight, largest derivative, and the groups' sums."""
        z: Column = F.lit(float(beta[0]))
        for i in range(1, m):
            z = z + F.lit(float(beta[i])) * x[i]
        data = rows
        if group:
            if effects is None:
                data = data.withColumn("_a", F.lit(0.0))
            else:
                moved = effects.select(F.col("_g").alias("_h"), (F.col("_a") + step * F.col("_d")).alias("_a"))
                data = data.join(moved, F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
            z = z + F.col("_a")
        data = data.withColumn("_z", z).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_z"))))
        data = data.withColumn("_r", F.col("_w") * (F.col("_y") - F.col("_p"))).withColumn("_v", F.col("_w") * F.col("_p") * (1 - F.col("_p")))
        loss = F.col("_w") * (F.greatest("_z", F.lit(0.0)) - F.col("_y") * F.col("_z") + F.log1p(F.exp(-F.abs("_z"))))
        parts = [F.sum(loss).alias("_loss"), F.sum("_w").alias("_n")]
        parts += [F.sum(F.col("_r") * x[i]).alias(f"_b{i}") for i in range(m)]
        parts += [F.sum(F.col("_v") * x[i] * x[j]).alias(f"_s{i}_{j}") for i, j in upper]
        table = None
        if group is None:
            one = data.agg(*parts).first()
        else:
            table = materialise(data.groupBy("_g").agg(F.first("_a").alias("_a"), *parts), "newton")
            # a group's own derivative is the sum of its residuals, its curvature that of its weights, as x0 = 1
            own = F.col("_b0") - group_ridge * F.col("_a")
            bend = F.col("_s0_0") + group_ridge
            left = [F.col(f"_s0_{i}") for i in range(m)]
            one = table.agg(
                F.sum(F.col("_loss") + group_ridge / 2 * F.col("_a") * F.col("_a")).alias("_loss"), F.sum("_n").alias("_n"),
                F.max(F.abs(own)).alias("_own"), *[F.sum(f"_b{i}").alias(f"_q{i}") for i in range(m)],
                *[F.sum(F.col(f"_b{i}") - left[i] * own / bend).alias(f"_b{i}") for i in range(m)],
                *[F.sum(F.col(f"_s{i}_{j}") - left[i] * left[j] / bend).alias(f"_s{i}_{j}") for i, j in upper]).first()
        if not one["_n"]:
            return np.zeros(m), np.zeros((m, m)), 0.0, 0.0, 0.0, table
        pull = penalty * beta
        gradient = np.array([one[f"_b{i}"] for i in range(m)]) - pull
        bent = np.diag(penalty)
        for i, j in upper:
            bent[i, j] += one[f"_s{i}_{j}"]
            bent[j, i] = bent[i, j]
        whole = gradient if group is None else np.array([one[f"_q{i}"] for i in range(m)]) - pull
        most = max(np.abs(whole).max(), 0.0 if group is None else one["_own"])
        return gradient, bent, one["_loss"] + float(pull @ beta) / 2, one["_n"], most / one["_n"], table

    def directed(table: DataFrame | None, delta: np.ndarray) -> DataFrame | None:
        if table is None:
            return None
        own = F.col("_b0") - group_ridge * F.col("_a")
        for i in range(m):
            own = own - F.col(f"_s0_{i}") * F.lit(float(delta[i]))
        return table.select("_g", "_a", (own / (F.col("_s0_0") + group_ridge)).alias("_d"))

    beta, steps = np.zeros(m), 0
    gradient, bent, loss, total, most, table = sums(beta, None, 0.0)
    while total and most > tolerance and steps < max_steps:
        delta = np.linalg.lstsq(bent, gradient, rcond=None)[0]
        effects, size = directed(table, delta), 1.0
        while size > 1e-4:
            tried = sums(beta + size * delta, effects, size)
            if tried[2] <= loss + 1e-12 * abs(loss):
                break
            size /= 2
        else:
            break  # no shorter step helps: the sums' rounding is reached
        beta, steps = beta + size * delta, steps + 1
        gradient, bent, loss, total, most, table = tried
    effects = table.select(F.col("_g").alias(group), F.col("_a").alias("effect")) if table is not None else None
    return NewtonLogit(tuple(names), float(beta[0]), tuple(float(b) for b in beta[1:]), group, effects, float(most), steps)
