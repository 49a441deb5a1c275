"""Feature diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import exact_quantiles, mix, ordered_prefix, running, sample_rank, scatter
from ..session import materialise
from .aggregate import to_long
from .evaluate import average_precision


def outcome_class(df: DataFrame, y: str, score: str, threshold: float, out: str = "outcome") -> DataFrame:
    """TP, FP, FN or TN of each row at a threshold."""
    alarm, pos = F.col(score) >= threshold, F.col(y) == 1
    return df.withColumn(
        out, F.when(alarm & pos, "TP").when(alarm, "FP").when(pos, "FN").otherwise("TN"))


def feature_audit(
    df: DataFrame, features: Sequence[str], y: str, min_std: float = 0.01, max_zero: float = 0.95
) -> DataFrame:
    """Spread, zero and null shares, distinct values and class means per feature.

    ``low_variance`` marks features that barely vary or are almost always zero.
    """
    long = to_long(df, features, [y])
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    distinct = values.groupBy("column").agg(F.count("value").alias("n_unique"))
    v, n = F.col("value"), F.count(F.lit(1))
    stats = long.groupBy("column").agg(
        F.stddev_samp(v).alias("std"),
        (F.count(F.when(v == 0, 1)) / n).alias("zero_rate"),
        (F.count(F.when(v.isNull(), 1)) / n).alias("null_rate"),
        F.avg(F.when(F.col(y) == 1, v)).alias("mean_pos"),
        F.avg(F.when(F.col(y) == 0, v)).alias("mean_neg"),
    )
    return stats.join(distinct, "column").select(
        F.col("column").alias("feature"), "std", "zero_rate", "null_rate", "n_unique", "mean_pos", "mean_neg",
        F.abs(F.col("mean_pos") - F.col("mean_neg")).alias("mean_gap"),
        ((F.col("std") < min_std) | (F.col("zero_rate") > max_zero)).alias("low_variance"),
    )


def spearman(df: DataFrame, features: Sequence[str], high: float = 0.7) -> DataFrame:
    """Rank correlation of every pair of features and whether it is high.

    Runs a job; only the features × features matrix reaches the driver.
    """
    filled = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(filled).select("_v")
    matrix = Correlation.corr(vectors, "_v", "spearman").first()[0].toArray()
    rows = [
        (features[i], features[j], float(matrix[i, j]), bool(abs(matrix[i, j]) > high))
        for i in range(len(features)) for j in range(i + 1, len(features))
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, high boolean")


def cohens_d(df: DataFrame, features: Sequence[str], first: Column, second: Column, kind: str = "absolute") -> DataFrame:
    """Standardised difference of two groups of rows per feature.

    absolute: |difference| over the root mean of the population variances.
    pooled: signed difference over the pooled sample deviation, null below two rows.
    """
    marked = df.withColumn("_g", F.when(first, 1).when(second, 2)).filter("_g is not null")
    v = F.col("value")
    a, b = F.when(F.col("_g") == 1, v), F.when(F.col("_g") == 2, v)
    stats = to_long(marked, features, ["_g"]).groupBy("column").agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count(a).alias("n_a"), F.count(b).alias("n_b"),
        F.var_pop(a).alias("_pa"), F.var_pop(b).alias("_pb"), F.var_samp(a).alias("_sa"), F.var_samp(b).alias("_sb"),
    )
    gap = F.col("mean_a") - F.col("mean_b")
    if kind == "absolute":
        d = F.abs(gap) / (F.sqrt((F.col("_pa") + F.col("_pb")) / 2) + 1e-9)
    else:
        dof = F.greatest(F.lit(1), F.col("n_a") + F.col("n_b") - 2)
        sd = F.sqrt(((F.col("n_a") - 1) * F.col("_sa") + (F.col("n_b") - 1) * F.col("_sb")) / dof)
        d = F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (sd > 0), gap / sd)
    return stats.select(F.col("column").alias("feature"), d.alias("d"), "mean_a", "mean_b", "n_a", "n_b")


def ks_stat(df: DataFrame, features: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Largest gap between the two groups' cumulative shares per feature."""
    marked = df.withColumn("_g", F.when(first, 1).when(second, 2)).filter("_g is not null")
    long = to_long(marked, features, ["_g"]).filter("value is not null").select(
        "column", "value", (F.col("_g") == 1).cast("long").alias("_a"), (F.col("_g") == 2).cast("long").alias("_b"))
    steps = ordered_prefix(long, ["column"], "value", ["_a", "_b"])
    gap = F.abs(F.col("cum__a") / F.col("tot__a") - F.col("cum__b") / F.col("tot__b"))
    return steps.groupBy(F.col("column").alias("feature")).agg(F.max(gap).alias("ks"))


def outcome_means(df: DataFrame, features: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """Mean of each feature and rows per outcome."""
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f) for f in features])


def clipped_hist(df: DataFrame, value: str, bins: int = 30, low: float = 0.01, high: float = 0.99, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram after clipping to two quantiles of the whole column."""
    ends = exact_quantiles(df, [], value, {"lo": low, "hi": high})
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    placed = df.select(*by, F.least(F.greatest(F.col(value), lo), hi).alias("_x"), lo.alias("_lo"), hi.alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    spot = F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    return placed.filter("_x is not null").groupBy(*by, spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def standardise_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Centre and scale each dimension by its population deviation."""
    dims = df.select(F.posexplode(vec).alias("_d", "_x")).groupBy("_d").agg(
        F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s"))
    table = dims.agg(F.sort_array(F.collect_list(F.struct("_d", "m", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s")).alias("s"))))).scalar()
    return df.withColumn("_st", table).withColumn(
        vec, F.zip_with(vec, "_st", lambda x, p: (x - p["m"]) / p["s"])).drop("_st")


def _tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Halves of ``sample`` along its widest column, up to ``leaves``: column, split, children and leaf number of each node."""
    column, split, child, leaf, size = [0], [0.0], [[0, 0]], [-1], max(1, -(-len(sample) // leaves))
    todo, found = [(0, np.arange(len(sample)))], 0
    while todo:
        node, rows = todo.pop()
        spread = np.ptp(sample[rows], axis=0) if len(rows) else np.zeros(1)
        widest = int(spread.argmax())
        if len(rows) <= size or spread[widest] <= 0:
            leaf[node], found = found, found + 1
            continue
        x = sample[rows, widest]
        at = np.median(x)
        at = at if at < x.max() else x[x < x.max()].max()
        column[node], split[node], child[node] = widest, at, [len(leaf), len(leaf) + 1]
        for half in (rows[x <= at], rows[x > at]):
            todo.append((len(leaf), half))
            column, split, child, leaf = [*column, 0], [*split, 0.0], [*child, [0, 0]], [*leaf, -1]
    return np.array(column), np.array(split), np.array(child), np.array(leaf)


def _closest(x: np.ndarray, me: np.ndarray, bound: np.ndarray, pv: np.ndarray, ids: np.ndarray, k: int, skip_self: bool):
    """(row, neighbour, distance) of the ``k`` points nearest to each row within ``bound``; ties go to the smaller neighbour.

    Products rule most pairs out, with room for their rounding; the rest are measured by their differences.
    """
    squares = (pv**2).sum(axis=1)
    parts = []
    step = max(1, 4_000_000 // len(pv))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        own = (part**2).sum(axis=1)
        room = 1e-9 * (own + squares.max())
        near = own[:, None] + squares[None] - 2 * (part @ pv.T)
        if skip_self:
            near[me[i : i + step, None] == ids[None, :]] = np.inf
        limit = bound[i : i + step] ** 2
        if len(pv) > k and (near <= (limit + room)[:, None]).sum() > 32 * k * len(part):
            limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + room)
        rows, cols = np.nonzero(near <= (limit + room)[:, None])
        finite = np.isfinite(near[rows, cols])
        rows, cols = rows[finite], cols[finite]
        dist = np.sqrt(((part[rows] - pv[cols]) ** 2).sum(axis=1))
        order = np.lexsort((ids[cols], dist, rows))
        rows, cols, dist = rows[order], cols[order], dist[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append((rows[kept] + i, ids[cols[kept]], dist[kept]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def nearest(
    queries: DataFrame,
    points: DataFrame,
    key: str,
    vec: str,
    k: int = 1,
    skip_self: bool = False,
    pivots: int = 32,
    rows_per_block: int = 20_000,
    seed: int = 0,
) -> DataFrame:
    """Exact ``k`` nearest points of every query: (key, neighbour, distance, rank).

    A tree over a seeded sample (``pivots`` rows a cell) cuts space into cells,
    more of them for more points, and smaller ones in few dimensions. A query
    first meets the points of its own cell; their distances bound which other
    cells, by the box around their points, can hold a nearer one, and it visits
    only those. Of equal points only those with the smallest keys can be among
    the nearest, so copies cost nothing. Large cells and large sets of queries
    are cut into blocks of bounded size. The sample, the boxes and counts per
    cell reach the driver. Ties go to the smaller neighbour key; vectors with
    null, NaN or infinite entries have no neighbours and are none.
    """
    spark = points.sparkSession
    finite = F.forall(vec, lambda x: F.abs(x) < float("inf"))
    need = k + (1 if skip_self else 0)
    copies = Window.partitionBy(vec).orderBy(key)
    points = points.filter(finite).select(key, vec).withColumn("_copy", F.dense_rank().over(copies))
    points = materialise(points.filter(F.col("_copy") <= need).drop("_copy"), "points")
    queries = queries.filter(finite).select(key, vec)
    n, dims = points.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    if not n:
        return spark.createDataFrame([], f"{key} long, neighbour long, distance double, rank int")
    size = rows_per_block if dims > 8 else min(rows_per_block, max(500, int(2 * math.sqrt(n))))
    leaves = -(-n // size)
    drawn = sample_rank(points.withColumn("_h", mix(key, seed)), "_h", key, F.lit(leaves * pivots)).select(vec) if leaves > 1 else points.limit(1).select(vec)
    column, split, child, leaf = _tree(np.array([r[0] for r in drawn.collect()], float).reshape(-1, dims), leaves)

    def cell_of(x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while (leaf[at] < 0).any():
            at = np.where(leaf[at] < 0, child[at, (x[rows, column[at]] > split[at]).astype(int)], at)
        return leaf[at]

    def place(frames):
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(_cell=cell_of(np.stack(pdf[vec].to_numpy()).astype(float)).astype("int32"))

    kinds = f"{key} long, {vec} array<double>"
    placed = points.mapInPandas(place, f"{kinds}, _cell int")
    ends = [f(F.get(vec, F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    groups = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *ends).toPandas()
    cells, count = groups["_cell"].to_numpy(), groups["n"].to_numpy()
    low, high = (groups[[f"{name}{i}" for i in range(dims)]].to_numpy(float) for name in ("lo", "hi"))
    blocks = np.ones(int(leaf.max()) + 1, int)
    blocks[cells] = -(-count // rows_per_block)

    def shared_out(counted: DataFrame) -> np.ndarray:
        """How many blocks the queries of each cell are cut into."""
        tasks = np.ones(len(blocks), int)
        for cell, rows in counted.groupBy("_cell").agg(F.count(F.lit(1))).collect():
            tasks[cell] = -(-rows // (rows_per_block * int(blocks[cell])))
        return tasks

    def dealt(keys: pd.Series, salt: str) -> np.ndarray:
        return pd.util.hash_array(keys.to_numpy(), hash_key=salt.ljust(16)).astype(np.uint64) >> np.uint64(1)

    def stored(tasks: np.ndarray) -> DataFrame:
        def run(frames):
            for pdf in place(frames):
                pdf["_b"] = (dealt(pdf[key], "points") % blocks[pdf["_cell"]].astype(np.uint64)).astype("int32")
                times = tasks[pdf["_cell"]]
                out = pdf.loc[pdf.index.repeat(times)]
                out["_t"] = np.concatenate([np.arange(t) for t in times]).astype("int32")
                yield out

        return points.mapInPandas(run, f"{kinds}, _cell int, _b int, _t int")

    def first_calls(tasks: np.ndarray) -> DataFrame:
        def run(frames):
            for pdf in place(frames):
                pdf["_b"] = (dealt(pdf[key], "queries") % blocks[pdf["_cell"]].astype(np.uint64)).astype("int32")
                pdf["_t"] = (dealt(pdf[key], "tasks") % tasks[pdf["_cell"]].astype(np.uint64)).astype("int32")
                yield pdf

        return queries.mapInPandas(run, f"{kinds}, _cell int, _b int, _t int")

    def first_search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[[key, vec, "_cell", "_b"]].reset_index(drop=True)
        ids, dist, bound = [[] for _ in range(len(out))], [[] for _ in range(len(out))], np.full(len(out), np.inf)
        if len(left) and len(right):
            found = _closest(np.stack(left[vec].to_numpy()).astype(float), left[key].to_numpy(), bound,
                             np.stack(right[vec].to_numpy()).astype(float), right[key].to_numpy(), k, skip_self)
            for row, i, d in zip(*(c.tolist() for c in found)):
                ids[row].append(i)
                dist[row].append(d)
            bound = np.array([d[-1] if len(d) == k else np.inf for d in dist])
        return out.assign(_bound=bound, _ids=pd.Series(ids, dtype=object), _dist=pd.Series(dist, dtype=object))

    def visit(frames):
        for pdf in frames:
            step = max(1, 1_000_000 // len(cells))
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x = np.stack(part[vec].to_numpy()).astype(float)
                least, most = np.zeros((len(part), len(cells))), np.zeros((len(part), len(cells)))
                bound = part["_bound"].to_numpy(float, copy=True)
                short = np.isinf(bound)
                for j in range(dims):
                    under, over = low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]
                    least += np.maximum(np.maximum(under, over), 0) ** 2
                    if short.any():
                        most += np.maximum(-under, -over) ** 2
                if short.any():
                    order = np.argsort(most[short], axis=1)
                    filled = np.cumsum(count[order], axis=1) >= need
                    at = np.where(filled.any(axis=1), filled.argmax(axis=1), len(cells) - 1)
                    far = np.sqrt(np.take_along_axis(most[short], order, axis=1)[np.arange(short.sum()), at])
                    bound[short] = np.where(filled.any(axis=1), far * (1 + 1e-9) + 1e-12, np.inf)
                rows, cols = np.nonzero(np.sqrt(least) <= bound[:, None] * (1 + 1e-9) + 1e-12)
                times = blocks[cells[cols]]
                rows, cols = np.repeat(rows, times), np.repeat(cols, times)
                b = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, int)
                new = (cells[cols] != part["_cell"].to_numpy()[rows]) | (b != part["_b"].to_numpy()[rows])
                hit = part[[key, vec]].iloc[rows[new]]
                yield hit.assign(_bound=bound[rows[new]], _cell=cells[cols[new]].astype("int32"), _b=b[new].astype("int32"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in (key, "neighbour", "distance")})
        me = left[key].to_numpy()
        rows, ids, dist = _closest(np.stack(left[vec].to_numpy()).astype(float), me, left["_bound"].to_numpy(),
                                   np.stack(right[vec].to_numpy()).astype(float), right[key].to_numpy(), k, skip_self)
        return pd.DataFrame({key: me[rows], "neighbour": ids, "distance": dist})

    by = ["_cell", "_b", "_t"]
    tasks = shared_out(queries.mapInPandas(place, f"{kinds}, _cell int"))
    own = first_calls(tasks).groupBy(*by).cogroup(stored(tasks).groupBy(*by)).applyInPandas(
        first_search, f"{kinds}, _cell int, _b int, _bound double, _ids array<long>, _dist array<double>")
    own = materialise(own, "own_cell")
    near = own.select(key, F.explode(F.arrays_zip(F.col("_ids").alias("i"), F.col("_dist").alias("d"))).alias("_n"))
    near = near.select(key, F.col("_n.i").alias("neighbour"), F.col("_n.d").alias("distance"))
    if len(cells) > 1 or blocks.max() > 1:
        visits = materialise(own.mapInPandas(visit, f"{kinds}, _bound double, _cell int, _b int"), "visits")
        tasks = shared_out(visits)

        def deal(frames):
            for pdf in frames:
                yield pdf.assign(_t=(dealt(pdf[key], "tasks") % tasks[pdf["_cell"]].astype(np.uint64)).astype("int32"))

        others = visits.mapInPandas(deal, f"{kinds}, _bound double, _cell int, _b int, _t int")
        found = others.groupBy(*by).cogroup(stored(tasks).groupBy(*by)).applyInPandas(search, f"{key} long, neighbour long, distance double")
        near = near.unionByName(found)
    order = Window.partitionBy(key).orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nn_distance(df: DataFrame, key: str, vec: str, y: str, k: int = 5, per_positive: int | None = None, seed: int = 42) -> DataFrame:
    """Nearest-neighbour distances between the classes: (kind, key, distance, rank).

    pos_to_neg: ``k`` nearest negatives of every positive. neg_to_pos: nearest
    positive of every negative. neg_to_neg: nearest other negative of every
    negative, or of a seeded sample of ``per_positive`` of them per positive.
    """
    pos, neg = df.filter(F.col(y) == 1), df.filter(F.col(y) == 0)
    sample = neg
    if per_positive is not None:
        n_pos = pos.agg(F.count(F.lit(1)) * per_positive).scalar()
        sample = sample_rank(neg.withColumn("_h", mix(key, seed)), "_h", key, n_pos)
    parts = {
        "pos_to_neg": nearest(pos, neg, key, vec, k),
        "neg_to_pos": nearest(neg, pos, key, vec, 1),
        "neg_to_neg": nearest(sample, neg, key, vec, 1, skip_self=True),
    }
    out = None
    for kind, found in parts.items():
        part = found.select(F.lit(kind).alias("kind"), key, "distance", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def overlap_curve(df: DataFrame, distance: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent of rows within each distance."""
    rows = df.select(*by, distance, F.lit(1).cast("long").alias("_n"))
    steps = ordered_prefix(rows, by, distance, ["_n"])
    return steps.select(*by, distance, (100 * F.col("cum__n") / F.col("tot__n")).alias("pct"))


def pca_partitions(
    df: DataFrame, features: Sequence[str], key: str, outcome: str = "outcome"
) -> DataFrame:
    """Two principal components of the standardised features, fitted on all rows and given for all. Fits run jobs."""
    filled = df.select(key, outcome, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    vectors = VectorAssembler(inputCols=list(features), outputCol="_raw").transform(filled)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(vectors).transform(vectors)
    plane = PCA(k=2, inputCol="_x", outputCol="_pc").fit(scaled).transform(scaled)
    xy = vector_to_array("_pc")
    return plane.select(key, outcome, F.get(xy, F.lit(0)).alias("pc1"), F.get(xy, F.lit(1)).alias("pc2"))


def mean_importance(df: DataFrame, models: Sequence[Model], features: Sequence[str]) -> DataFrame:
    """Importance averaged over the members of an ensemble, ranked."""
    total = np.mean([m.featureImportances.toArray() for m in models], axis=0)
    order = np.argsort(-total, kind="stable")
    rows = [(features[i], float(total[i]), rank + 1) for rank, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int")


def permute_column(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """Shuffle one column among the rows.

    Rows are numbered once by key hash and once by another seed, and the value
    moves along equal numbers. Hash blocks are even in size, so both numberings
    are built in parallel.
    """
    def numbered(s: int, cols: list[str]) -> DataFrame:
        hashed = df.withColumn("_h", scatter(key, s))
        block = F.floor(F.col("_h") / F.lit(1 << 24)).cast("long")
        return running(hashed, [], ["_h", key], block, {"_i": F.lit(1)}).select("_i", *cols)

    rest = [c for c in df.columns if c != column]
    values = numbered(2 * seed + 1, [column])
    return numbered(2 * seed + 2, rest).join(values, "_i").select(*df.columns)


def permutation_importance(
    score, df: DataFrame, features: Sequence[str], key: str, y: str, repeats: int = 3, out: str = "prob"
) -> DataFrame:
    """Mean and deviation of the drop in average precision when a feature is shuffled.

    ``score`` maps a DataFrame to one with column ``out``. All shuffled copies
    are scored as one job.
    """
    base = average_precision(score(df), y, out).select("ap").scalar()
    trials = None
    for f in features:
        for r in range(repeats):
            part = score(permute_column(df, f, key, r)).select(
                F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col(y).alias("y"), F.col(out).alias("score"))
            trials = part if trials is None else trials.unionByName(part)
    aps = average_precision(trials, "y", "score", ["feature", "repeat"])
    drops = aps.select("feature", (base - F.col("ap")).alias("_drop"))
    return drops.groupBy("feature").agg(F.avg("_drop").alias("ap_drop"), F.stddev_pop("_drop").alias("sd"))


def partial_dependence(
    score, df: DataFrame, feature: str, key: str, points: int = 18, sample: int | None = None, seed: int = 1, out: str = "prob"
) -> DataFrame:
    """Mean score with the feature set to each of a few quantiles of itself.

    The mean is over all rows, or ``sample`` of them if given; each row is
    expanded over the grid by an array, not by a join.
    """
    qs = {f"q{i}": 0.02 + 0.96 * i / (points - 1) for i in range(points)}
    ends = exact_quantiles(df, [], feature, qs)
    grid = ends.select(F.array_sort(F.array_distinct(F.array(*[F.col(q) for q in qs])))).scalar()
    rows = df if sample is None else sample_rank(df.withColumn("_h", mix(key, seed)), "_h", key, F.lit(sample)).drop("_h")
    spread = rows.withColumn("grid", F.explode(grid)).withColumn(feature, F.col("grid"))
    return score(spread).groupBy("grid").agg(F.avg(out).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def leaf_support(model: Model, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """How many training rows share the leaves a row reaches, and the uncertainty.

    Uncertainty is 1 / (1 + ln(1 + mean support)). Leaf counts are one row per
    (tree, leaf).
    """
    model.setLeafCol("_leaf")
    leaves = lambda df, *keep: model.transform(df).select(*keep, F.posexplode(vector_to_array("_leaf")).alias("_tree", "_at"))
    counts = leaves(train).groupBy("_tree", "_at").agg(F.count(F.lit(1)).alias("_c"))
    reached = leaves(test, key).join(counts, ["_tree", "_at"], "left")
    support = F.coalesce("_c", F.lit(0))
    out = reached.groupBy(key).agg(F.avg(support).alias("support_mean"), F.min(support).alias("support_min"))
    return out.withColumn("uncertainty", 1.0 / (1.0 + F.log1p("support_mean")))
