"""Boosted trees with any objective and monotone responses, grown from sums that Spark aggregates.

A row's features become bin numbers once. Each level of a tree is one aggregate: sums of the objective's first and second
derivative by node, feature and bin, combined map-side. It has as many rows as the model has nodes, features and bins,
whatever the size of the data, so the splits are chosen from it on the driver. Rows find their node by an expression made of
the splits so far; no row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .models import register_model

Objective = Callable[[Column, Column], tuple[Column, Column]]

#: Features whose rise may not lower the risk, by pattern.
RISING = (r"speed_std", r"vol_std", r"^accel_speed$", r"speed_pct_below_normal", r"crash_rate", r"curv_x_delta_speed")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def logistic(z: Column, y: Column) -> tuple[Column, Column]:
    """First and second derivative of the log loss by the margin."""
    p = sigmoid(z)
    return p - y, F.greatest(p * (1 - p), F.lit(1e-16))


def focal(alpha: float = 0.25, gamma: float = 2.0, step: float = 1e-4) -> Objective:
    """Derivatives of -a * (1 - q)^gamma * ln q, with q the probability of the row's own class; a is alpha for positives.

    The second one is a central difference of the first over ``step``, 1e-6 at least.
    """

    def slope(z: Column, y: Column) -> Column:
        # By the margin of the own class, q' = q * (1 - q); negatives turn the margin's sign.
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), sigmoid(z)))
        q = F.when(y == 1, p).otherwise(1 - p)
        own = F.pow(1 - q, F.lit(gamma)) * (gamma * q * F.log(q) - (1 - q))
        return F.when(y == 1, alpha * own).otherwise((alpha - 1) * own)

    def derivatives(z: Column, y: Column) -> tuple[Column, Column]:
        second = (slope(z + step, y) - slope(z - step, y)) / (2 * step)
        return slope(z, y), F.greatest(second, F.lit(1e-6))

    return derivatives


@dataclass(frozen=True)
class Node:
    """A split, bins up to ``cut`` of ``feature`` to the left, or a leaf if ``feature`` is None; ``value`` is the node's own."""

    value: float
    gain: float = 0.0
    feature: str | None = None
    cut: int = 0


Tree = dict[int, Node]  # by number: the root is 1, children of i are 2i and 2i + 1


@dataclass(frozen=True)
class BoostedTrees:
    features: tuple[str, ...]
    edges: Mapping[str, Sequence[float]]
    trees: tuple[Tree, ...]

    def _walk(self, tree: Tree, left: Callable[[Node], Column], out: Callable[[int], Column], i: int = 1) -> Column:
        if tree[i].feature is None:
            return out(i)
        return F.when(left(tree[i]), self._walk(tree, left, out, 2 * i)).otherwise(self._walk(tree, left, out, 2 * i + 1))

    def _left(self, node: Node) -> Column:
        x = F.col(node.feature).cast("double")
        missing = x.isNull() | F.isnan(x)
        return missing if node.cut == 0 else missing | (x <= float(self.edges[node.feature][node.cut - 1]))

    def margin(self) -> Column:
        total = F.lit(0.0)
        for tree in self.trees:
            total = total + self._walk(tree, self._left, lambda i, tree=tree: F.lit(tree[i].value))
        return total

    def __call__(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prob``; missing features go with the lowest values."""
        return df.withColumn("prob", sigmoid(self.margin()))

    def table(self) -> list[tuple[int, int, str | None, float | None, float, float]]:
        """(tree, node, feature, threshold, gain, value) of every node; no feature: a leaf; no threshold: missing values go left."""
        cut = lambda n: float(self.edges[n.feature][n.cut - 1]) if n.feature and n.cut else None
        return [(t, i, n.feature, cut(n), n.gain, n.value) for t, tree in enumerate(self.trees) for i, n in sorted(tree.items())]


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 64, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Some ``bins`` - 1 values of each feature that cut its rows into parts of about the same size; one pass."""
    shares = [i / bins for i in range(1, bins)]
    of = [F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, accuracy).alias(f) for f in features]
    row = df.agg(*of).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def _bin(x: Column, edges: Sequence[float]) -> Column:
    """0 for missing values, else one more than the number of edges below; a search tree of comparisons."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(x <= float(edges[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(search(0, len(edges))).cast("short")


def _choose(g: np.ndarray, h: np.ndarray, low: float, high: float, signs: np.ndarray, used: np.ndarray, l2: float, least_weight: float, least_gain: float):
    """The best (gain, feature, cut, left value, right value) of a node, or None; sums by feature and bin. First of equals."""

    def best_value(gs, hs):
        return np.clip(-gs / np.maximum(hs + l2, 1e-300), low, high)

    def loss(gs, hs, w):
        return gs * w + (hs + l2) * w * w / 2

    gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    total_g, total_h = g[0].sum(), h[0].sum()
    gr, hr = total_g - gl, total_h - hl
    left, right = best_value(gl, hl), best_value(gr, hr)
    gain = loss(total_g, total_h, best_value(total_g, total_h)) - loss(gl, hl, left) - loss(gr, hr, right)
    allowed = (hl >= least_weight) & (hr >= least_weight) & used[:, None] & (signs[:, None] * (right - left) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, c = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, c] > least_gain:
        return None
    return float(gain[f, c]), int(f), int(c), float(left[f, c]), float(right[f, c])


def fit_boosted(
    df: DataFrame, features: Sequence[str], y: str, objective: Objective = logistic, trees: int = 100, depth: int = 6, step: float = 0.05,
    bins: int = 64, edges: Mapping[str, Sequence[float]] | None = None, rising: Sequence[str] = (), falling: Sequence[str] = (),
    l2: float = 1.0, least_weight: float = 1.0, least_gain: float = 0.0, weight: str | None = None,
    key: str | None = None, subsample: float = 1.0, feature_share: float = 1.0, seed: int = 42, flush: int = 8,
) -> BoostedTrees:
    """Boosted trees on ``features`` of ``df``: its call scores rows.

    ``objective`` gives the first and second derivative by the margin, which starts at 0. A split's gain and a leaf's value
    are those of the second-order approximation with penalty ``l2``; values are multiplied by ``step``. Features that match a
    pattern of ``rising`` (``falling``) never lower (raise) the score: such splits are left out, and the middle of both
    children's values bounds all values below them. Rows of a tree are a ``subsample`` by a hash of ``key``, its features a
    ``feature_share`` by a seeded draw. Bins are quantiles unless ``edges`` are given; missing values lie below all. Each level
    is one job over the binned rows, and every ``flush`` trees their margins are written once. An empty table gives one leaf
    of value 0 per tree.
    """
    edges = {f: list(edges[f]) for f in features} if edges else quantile_edges(df, features, bins)
    sign = lambda f: 1 if any(re.search(p, f) for p in rising) else -1 if any(re.search(p, f) for p in falling) else 0
    signs = np.array([sign(f) for f in features])
    if subsample < 1 and key is None:
        raise ValueError("a subsample needs the key whose hash chooses its rows")
    width = max(map(len, edges.values()), default=0) + 2
    number = {f: i for i, f in enumerate(features)}
    columns = [_bin(F.col(f).cast("double"), edges[f]).alias(f"b{i}") for i, f in enumerate(features)]
    weights = F.col(weight).cast("double") if weight else F.lit(1.0)
    chosen = F.xxhash64(F.col(key)) if key else F.lit(0).cast("long")
    rows = materialise(df.select(*columns, F.col(y).cast("int").alias("y"), weights.alias("w"), chosen.alias("key"), F.lit(0.0).alias("z")), "binned")
    model = BoostedTrees(tuple(features), edges, ())
    pending = F.col("z")
    rng = np.random.default_rng(seed)
    left = lambda node: F.col(f"b{number[node.feature]}") <= node.cut
    for t in range(trees):
        used = np.zeros(len(features), bool)
        used[rng.permutation(len(features))[: max(1, round(feature_share * len(features)))]] = True
        at = rows.withColumn("z", pending)
        if subsample < 1:
            at = at.filter(F.pmod(F.xxhash64("key", F.lit(seed), F.lit(t)), F.lit(1 << 20)) < F.lit(int(subsample * (1 << 20))))
        g, h = objective(F.col("z"), F.col("y"))
        tree: Tree = {1: Node(0.0)}
        bounds = {1: (-np.inf, np.inf)}
        for level in range(depth):
            open_nodes = [i for i in tree if i >= 1 << level]
            if not open_nodes:
                break
            node = model._walk(tree, left, F.lit)
            cells = at.select(node.alias("node"), (g * F.col("w")).alias("g"), (h * F.col("w")).alias("h"), F.posexplode(F.array(*[f"b{i}" for i in range(len(features))])).alias("f", "bin"))
            sums = cells.filter(F.col("node") >= 1 << level).groupBy("node", "f", "bin").agg(F.sum("g"), F.sum("h")).collect()
            hist = {i: np.zeros((2, len(features), width)) for i in open_nodes}
            for i, f, b, gs, hs in sums:
                hist[i][:, f, b] = gs, hs
            for i in open_nodes:
                low, high = bounds[i]
                if level == 0 and sums:
                    total_g, total_h = hist[1][:, 0].sum(1)
                    tree[1] = Node(step * float(np.clip(-total_g / (total_h + l2), low, high)))
                found = _choose(*hist[i], low, high, signs, used, l2, least_weight, least_gain)
                if found is None:
                    continue
                gain, f, cut, lv, rv = found
                tree[i] = Node(tree[i].value, gain, features[f], cut)
                middle = (lv + rv) / 2
                for child, value, own in ((2 * i, lv, (low, middle) if signs[f] > 0 else (middle, high) if signs[f] < 0 else (low, high)),
                                          (2 * i + 1, rv, (middle, high) if signs[f] > 0 else (low, middle) if signs[f] < 0 else (low, high))):
                    tree[child], bounds[child] = Node(step * value), own
        pending = pending + model._walk(tree, left, lambda i, tree=tree: F.lit(tree[i].value))
        model = BoostedTrees(model.features, edges, (*model.trees, tree))
        if (t + 1) % flush == 0 and t + 1 < trees:
            rows, pending = materialise(rows.withColumn("z", pending), "binned"), F.col("z")
    return model


def fit_gbt_focal(df: DataFrame, features: Sequence[str], y: str, alpha: float = 0.25, gamma: float = 2.0, trees: int = 400, **options) -> BoostedTrees:
    """Boosted trees on the focal loss, which leaves easy rows little weight; classes are not weighted otherwise."""
    return fit_boosted(df, features, y, focal(alpha, gamma), trees, **options)


def fit_gbt_mono(df: DataFrame, features: Sequence[str], y: str, trees: int = 400, rising: Sequence[str] = RISING, **options) -> BoostedTrees:
    """Boosted trees on the log loss whose score never falls in features that match ``rising``; positives weigh the class ratio."""
    counts = df.agg(F.count(F.when(F.col(y) == 1, 1)).alias("p"), F.count(F.when(F.col(y) == 0, 1)).alias("n")).first()
    ratio = counts.n / counts.p if counts.p else 1.0
    weighted = df.withColumn("_ratio", F.when(F.col(y) == 1, F.lit(float(ratio))).otherwise(1.0))
    return fit_boosted(weighted, features, y, logistic, trees, rising=rising, weight="_ratio", **options)


register_model("gbt_focal", fit_gbt_focal)
register_model("gbt_mono", fit_gbt_mono)
