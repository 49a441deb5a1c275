"""Sampling, classifiers and forecasters on ``pyspark.ml``.

Fits run Spark jobs. Sampling keeps exact counts through hash thresholds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import ordered_prefix, running, sample_rank, scatter
from .aggregate import apply_eb, eb_rate, profile_fit, profile_predict, residual_baseline, residualise, volume_factor
from .diagnose import nearest
from .evaluate import average_precision, confusion, operating_point, pr_curve, prf
from .filters import epoch_micros, fold_bounds, split_tail_days
from .newton import fit_newton
from .projections import issue_risk
from .windows import run_weights

Scorer = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Scorer]
MODELS: dict[str, Callable[..., Scorer]] = {}


def register_model(name: str, fit: Callable[..., Scorer]) -> None:
    """Add a classifier: ``fit(df, features, y, **options)`` returns a scorer."""
    MODELS[name] = fit


def build_model(name: str, df: DataFrame, features: Sequence[str], y: str, **options) -> Scorer:
    return MODELS[name](df, features, y, **options)


# Sampling.

def balanced_subset(df: DataFrame, y: str, key: str, ratio: float, seed: int) -> DataFrame:
    """All positives and exactly ``ratio`` negatives per positive (all, if fewer)."""
    n = df.select(F.floor(F.count(F.when(F.col(y) == 1, 1)) * ratio).cast("long")).scalar()
    negatives = df.filter(F.col(y) == 0).withColumn("_h", scatter(key, seed))
    return df.filter(F.col(y) == 1).unionByName(sample_rank(negatives, "_h", key, n).drop("_h"))


def subsample_negatives(df: DataFrame, y: str, key: str, total: int | Column, seed: int = 0) -> DataFrame:
    """All positives and negatives up to ``total`` rows in all."""
    n = df.select(F.greatest(F.lit(0), F.lit(total) - F.count(F.when(F.col(y) == 1, 1))).cast("long")).scalar()
    negatives = df.filter(F.col(y) == 0).withColumn("_h", scatter(key, seed))
    return df.filter(F.col(y) == 1).unionByName(sample_rank(negatives, "_h", key, n).drop("_h"))


def smote(df: DataFrame, features: Sequence[str], y: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic positives until the classes balance; ``synthetic`` marks them.

    A new row lies on the segment from a positive to one of its ``k`` nearest
    positives, at a seeded distance. New rows are dealt evenly to the positives.
    Original rows keep their key, new ones get a negative one.
    """
    cols = [F.col(f).cast("double").alias(f) for f in features]
    kept = df.select(key, F.col(y).cast("int").alias(y), *cols, F.lit(0).alias("synthetic"))
    pos = df.filter(F.col(y) == 1).select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    near = nearest(pos, pos, key, "_x", k, skip_self=True, seed=seed)
    near = near.join(pos.select(F.col(key).alias("neighbour"), F.col("_x").alias("_nx")), "neighbour")
    options = near.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "_nx"))).alias("_near"))
    missing = df.select(F.count(F.when(F.col(y) == 0, 1)) - F.count(F.when(F.col(y) == 1, 1))).scalar()
    hashed = pos.withColumn("_h", scatter(key, seed))
    dealt = running(hashed, [], ["_h", key], F.floor(F.col("_h") / F.lit(1 << 20)).cast("long"), {"cum__n": F.lit(1)}, totals=True)
    dealt = dealt.withColumnRenamed("tot_cum__n", "tot__n")
    dealt = dealt.join(options, key).withColumn("_missing", F.greatest(missing, F.lit(0)))
    share = F.floor(F.col("_missing") / F.col("tot__n")) + (
        F.col("cum__n") <= F.col("_missing") % F.col("tot__n")).cast("long")
    drawn = dealt.withColumn("_share", share).filter("_share > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_share"))))
    pick = F.pmod(F.xxhash64(key, "_i", F.lit(seed)), F.size("_near")).cast("int")
    u = F.pmod(F.xxhash64("_i", key, F.lit(seed + 1)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    mixed = F.zip_with("_x", F.get("_near", pick)["_nx"], lambda a, b: a + (b - a) * u)
    new_key = -(F.col("cum__n") + (F.col("_i") - 1) * F.col("tot__n"))
    made = drawn.select(new_key.alias("_key"), mixed.alias("_m")).select(
        F.col("_key").alias(key), F.lit(1).alias(y), *[F.get("_m", F.lit(i)).alias(f) for i, f in enumerate(features)],
        F.lit(1).alias("synthetic"))
    return kept.unionByName(made)


# Shared pieces.

def _filled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    for f in features:
        df = df.withColumn(f, F.coalesce(F.col(f).cast("double"), F.lit(0.0)))
    return df


def _counts(df: DataFrame, y: str) -> tuple[int, int]:
    row = df.agg(F.count(F.when(F.col(y) == 1, 1)), F.count(F.when(F.col(y) == 0, 1))).first()
    return row[0], row[1]


def class_weight(df: DataFrame, y: str, out: str = "_w") -> DataFrame:
    """Rows / (2 × rows of the class), so both classes weigh the same."""
    pos, neg = _counts(df, y)
    n = pos + neg
    return df.withColumn(out, F.when(F.col(y) == 1, n / (2 * max(pos, 1))).otherwise(n / (2 * max(neg, 1))))


def positive_weight(df: DataFrame, y: str, out: str = "_w", mult: float = 1.0) -> DataFrame:
    """Negatives per positive on positives, 1 on negatives."""
    pos, neg = _counts(df, y)
    return df.withColumn(out, F.when(F.col(y) == 1, mult * neg / max(pos, 1)).otherwise(1.0))


def model_scorer(model: PipelineModel, features: Sequence[str], out: str = "prob", drop: Sequence[str] = ()) -> Scorer:
    """Probability of the positive class, all other columns kept."""
    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(_filled(df, features))
        p = F.get(vector_to_array("probability"), F.lit(1))
        return scored.withColumn(out, p).select(*df.columns, out)

    score.model = model
    return score


def _fit(df: DataFrame, features: Sequence[str], stages: list) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    return Pipeline(stages=[assembler, *stages]).fit(_filled(df, features))


def _ap(df: DataFrame, y: str, score: str) -> float:
    row = average_precision(df, y, score).first()
    return float(row["ap"]) if row and row["ap"] is not None else float("-inf")


def cross_validate(df: DataFrame, ts: str, y: str, fit: Fit, folds: int = 3) -> float:
    """Mean average precision over forward-chaining folds along time."""
    values = []
    for train, test in forward_folds(df, ts, folds):
        if _counts(train, y)[0] and _counts(test, y)[0]:
            values.append(_ap(fit(train)(test), y, "prob"))
    return sum(values) / len(values) if values else float("-inf")


def forward_folds(df: DataFrame, ts: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """(earlier rows, next block) pairs; the few block bounds are collected once."""
    starts = dict(fold_bounds(df, ts, folds).collect())
    at, out = epoch_micros(ts), []
    for i in range(1, folds + 1):
        if i in starts:
            upto = min((b for f, b in starts.items() if f > i), default=None)
            test = df.filter(at >= starts[i]) if upto is None else df.filter((at >= starts[i]) & (at < upto))
            out.append((df.filter(at < starts[i]), test))
    return out


# Classifiers.

def fit_logit(
    df: DataFrame, features: Sequence[str], y: str, ts: str | None = None,
    grid: Sequence[float] = (0.001, 0.01, 0.1, 1, 10), max_iter: int = 100, folds: int = 3,
) -> Scorer:
    """Class-weighted logistic regression on standardised features.

    The inverse penalty is chosen by time-ordered validation when ``ts`` is given.
    """
    def fit_with(c: float) -> Fit:
        def fit(train: DataFrame) -> Scorer:
            pos, neg = _counts(train, y)  # also fixes the penalty's scale
            stages = [
                StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
                LogisticRegression(featuresCol="_z", labelCol=y, weightCol="_w", maxIter=max_iter,
                                   regParam=1.0 / (c * max(pos + neg, 1)), standardization=False),
            ]
            return model_scorer(_fit(class_weight(train, y), features, stages), features)

        return fit

    best = 1.0
    if ts is not None and len(grid) > 1:
        best = max(grid, key=lambda c: cross_validate(df, ts, y, fit_with(c), folds))
    return fit_with(best)(df)


def fit_logit_fixed(df: DataFrame, features: Sequence[str], y: str, group: str = "pk", c: float = 1.0, max_iter: int = 100) -> Scorer:
    """Logistic regression with one intercept per post."""
    pos, neg = _counts(df, y)
    data = class_weight(df, y).withColumn("_g", F.col(group).cast("string"))
    stages = [
        StringIndexer(inputCol="_g", outputCol="_gi", handleInvalid="keep"),
        OneHotEncoder(inputCol="_gi", outputCol="_go", dropLast=False),
        VectorAssembler(inputCols=["_x", "_go"], outputCol="_xg"),
        StandardScaler(inputCol="_xg", outputCol="_z"),
        LogisticRegression(featuresCol="_z", labelCol=y, weightCol="_w", maxIter=max_iter,
                           regParam=1.0 / (c * max(pos + neg, 1)), standardization=False),
    ]
    inner = model_scorer(_fit(data, features, stages), features)
    return lambda d: inner(d.withColumn("_g", F.col(group).cast("string"))).drop("_g")


# Candidate settings of the forest.
FOREST_GRID = (
    {"maxDepth": 12, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"},
    {"maxDepth": 16, "minInstancesPerNode": 5, "featureSubsetStrategy": "0.3"},
    {"maxDepth": 20, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt"},
)


def fit_forest(
    df: DataFrame, features: Sequence[str], y: str, ts: str | None = None, grid: Sequence[dict] = FOREST_GRID,
    trees: int = 200, folds: int = 3, seed: int = 42,
) -> Scorer:
    """Class-weighted random forest; settings chosen along time when ``ts`` is given."""
    def fit_with(options: dict) -> Fit:
        forest = RandomForestClassifier(featuresCol="_x", labelCol=y, weightCol="_w", numTrees=trees, seed=seed, **options)
        return lambda train: model_scorer(_fit(class_weight(train, y), features, [forest]), features)

    best = grid[0]
    if ts is not None and len(grid) > 1:
        best = max(grid, key=lambda g: cross_validate(df, ts, y, fit_with(g), folds))
    return fit_with(best)(df)


def fit_gbt(
    df: DataFrame, features: Sequence[str], y: str, weight: str | None = None,
    trees: int = 100, depth: int = 5, step: float = 0.05, subsample: float = 0.8, seed: int = 42,
) -> Scorer:
    """Boosted trees; positives weigh the class ratio unless ``weight`` is given."""
    data = positive_weight(df, y) if weight is None else df.withColumn("_w", F.col(weight))
    boost = GBTClassifier(featuresCol="_x", labelCol=y, weightCol="_w", maxIter=trees, maxDepth=depth,
                          stepSize=step, subsamplingRate=subsample, seed=seed)
    return model_scorer(_fit(data, features, [boost]), features)


def fit_gbt_smote(df: DataFrame, features: Sequence[str], y: str, key: str, k: int = 5, seed: int = 42, **options) -> Scorer:
    """Boosted trees on rows balanced by synthetic positives."""
    made = smote(df, features, y, key, k, seed).withColumn("_one", F.lit(1.0))
    return fit_gbt(made, features, y, weight="_one", seed=seed, **options)


def fit_gbt_two_stage(df: DataFrame, features: Sequence[str], y: str, gate: float = 0.5, **options) -> Scorer:
    """A refiner fitted on the screener's alarms replaces its score there."""
    first = fit_gbt(df, features, y, **options)
    alarms = first(df).filter(F.col("prob") >= gate).drop("prob")
    pos, neg = _counts(alarms, y)
    if not pos or not neg:
        return first
    second = fit_gbt(alarms, features, y, **options)

    def score(d: DataFrame) -> DataFrame:
        both = second(first(d).withColumnRenamed("prob", "_s1"))
        return both.withColumn("prob", F.when(F.col("_s1") >= gate, F.col("prob")).otherwise(F.col("_s1"))).drop("_s1")

    return score


def mean_scorer(members: Sequence[Scorer]) -> Scorer:
    """Mean score of an ensemble, in one pass over the rows."""
    def score(d: DataFrame) -> DataFrame:
        out, names = d, []
        for i, member in enumerate(members):
            out = member(out).withColumnRenamed("prob", f"_p{i}")
            names.append(f"_p{i}")
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        return out.withColumn("prob", total / len(names)).drop(*names)

    return score


def fit_bagging(
    df: DataFrame, features: Sequence[str], y: str, key: str, members: int = 10, ratio: float = 5.0, seed: int = 42, **options
) -> Scorer:
    """Boosted trees on balanced subsets, scores averaged."""
    fits = []
    for m in range(members):
        bag = balanced_subset(df, y, key, ratio, seed + m).withColumn("_one", F.lit(1.0))
        fits.append(fit_gbt(bag, features, y, weight="_one", seed=seed + m, **options))
    return mean_scorer(fits)


def oof_scores(
    df: DataFrame, features: Sequence[str], y: str, key: str, folds: int = 5, members: int = 5,
    ratio: float = 5.0, seed: int = 42, **options,
) -> DataFrame:
    """Screener score of every row from members that never saw it, as ``s1_score``.

    Folds are equal parts of each class in hash order.
    """
    hashed = df.select(F.col(y).cast("int").alias("_y"), scatter(key, seed).alias("_h"), F.lit(1).cast("long").alias("_n"))
    ranks = ordered_prefix(hashed, ["_y"], "_h", ["_n"])
    part = F.floor((F.col("cum__n") - F.col("_n")) * folds / F.col("tot__n")).cast("int")
    starts = ranks.groupBy("_y", part.alias("_fold")).agg(F.min("_h").alias("_start"))
    bounds = starts.agg(F.collect_list(F.struct("_y", "_start", "_fold")).alias("b")).scalar()
    passed = F.filter("_b", lambda b: (b["_y"] == F.col(y)) & (b["_start"] <= F.col("_h")))
    placed = df.withColumn("_b", bounds).withColumn("_h", scatter(key, seed))
    placed = placed.withColumn("_fold", F.array_max(F.transform(passed, lambda b: b["_fold"]))).drop("_b", "_h")
    out = None
    for i in range(folds):
        scorer = fit_bagging(placed.filter(F.col("_fold") != i), features, y, key, members, ratio, seed + 100 * i, **options)
        part = scorer(placed.filter(F.col("_fold") == i)).withColumnRenamed("prob", "s1_score")
        out = part if out is None else out.unionByName(part)
    return out


def supervisor_pool(oof: DataFrame, threshold: float) -> DataFrame:
    """Rows the screener flags, with its score as a feature."""
    return oof.filter(F.col("s1_score") >= threshold)


def fit_gbt_weighted(
    df: DataFrame, features: Sequence[str], y: str, loc: Sequence[str], ts: str, edge: float = 0.4, gap_minutes: int | None = None, **options
) -> Scorer:
    """Boosted trees with positives weighted by their place in the run."""
    pos, neg = _counts(df, y)
    weighed = run_weights(df, loc, ts, y, edge, gap_minutes, "_run_w")
    weighed = weighed.withColumn("_run_w", F.when(F.col(y) == 1, F.col("_run_w") * (neg / max(pos, 1))).otherwise(1.0))
    return fit_gbt(weighed, features, y, weight="_run_w", **options)


def fit_gbt_residual(
    df: DataFrame, features: Sequence[str], y: str, channels: Sequence[str], keys: Sequence[str], **options
) -> Scorer:
    """Boosted trees on departures from the median of the post and hour of week."""
    base = residual_baseline(df, keys, channels)
    used = [f"{f}_res" if f in channels else f for f in features]
    inner = fit_gbt(residualise(df, base, keys, channels), used, y, **options)
    return lambda d: inner(residualise(d, base, keys, channels)).select(*d.columns, "prob")


def fit_gbt_blocks(
    df: DataFrame, features: Sequence[str], y: str, pos: str, ts: str, members: int = 8, frac: float = 0.8, seed: int = 42, trees: int = 400, **options
) -> Scorer:
    """Members fitted on draws of whole (post, day) blocks without replacement."""
    keyed = df.withColumn("_block", F.xxhash64(F.col(pos), F.to_date(ts)))
    blocks = keyed.select("_block").distinct()
    n = blocks.select(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * frac)).cast("long")).scalar()
    fits = []
    for m in range(members):
        drawn = sample_rank(blocks.withColumn("_h", scatter("_block", seed + m)), "_h", "_block", n).select("_block")
        bag = keyed.join(drawn, "_block", "left_semi")
        if _counts(bag, y)[0]:
            fits.append(fit_gbt(bag, features, y, seed=seed + m, subsample=1.0, trees=max(trees // members, 1), **options))
    return mean_scorer(fits)


def fit_eb(df: DataFrame, keys: Sequence[str], y: str, m: float = 200.0) -> Scorer:
    """Historical rate of the cell's key, shrunken to the overall rate."""
    rates = eb_rate(df, keys, y, m)
    return lambda d: apply_eb(d, rates, keys, "prob")


@dataclass(frozen=True)
class SeasonalProfile:
    """Weekly profile per location with a recent volume correction."""

    tables: tuple[DataFrame, DataFrame, DataFrame]
    factor: DataFrame
    loc: tuple[str, ...]
    slot: tuple[str, ...]
    cols: tuple[str, ...]
    volume: tuple[str, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        return profile_predict(df, self.tables, self.loc, self.slot, self.cols, self.factor, self.volume)


def fit_profile(
    prior: DataFrame, recent: DataFrame, loc: Sequence[str], slot: Sequence[str], cols: Sequence[str],
    volume: Sequence[str], ref: str,
) -> SeasonalProfile:
    """Profile from the prior period, level from the recent one."""
    return SeasonalProfile(
        profile_fit(prior, loc, slot, cols), volume_factor(prior, recent, loc, ref),
        tuple(loc), tuple(slot), tuple(cols), tuple(volume))


def platt(calibration: DataFrame, y: str, score: str, max_iter: int = 100) -> Scorer:
    """Logistic recalibration of a score, fitted by Newton steps on a slice of its own."""
    fit = fit_newton(calibration, [score], y, max_steps=max_iter)
    return lambda df: fit.score(df, "calibrated")


def linear_scorer(coefficients: dict[str, float], intercept: float, out: str = "prob") -> Scorer:
    """Scores of a logistic model given by its numbers."""
    def score(df: DataFrame) -> DataFrame:
        z: Column = F.lit(float(intercept))
        for name, weight in coefficients.items():
            z = z + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        return df.withColumn(out, 1.0 / (1.0 + F.exp(-z)))

    return score


def load_scorer(path: str, features: Sequence[str]) -> Scorer:
    """Scorer of a saved pipeline."""
    return model_scorer(PipelineModel.load(path), features)


def score_window(
    scorer: Scorer, df: DataFrame, ts: str, start: str, end: str, keys: Sequence[str], y: str, threshold: float, mode: str = "forecast"
) -> DataFrame:
    """Frozen scores, alarms and labels of the rows in [start, end)."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = df.filter((F.col(ts) >= low) & (F.col(ts) < high))
    return issue_risk(scorer(inside), keys, "prob", y, threshold, mode)


def selection_score(df: DataFrame, y: str, score: str, metric: str = "ap", min_recall: float = 0.4, by: Sequence[str] = ()) -> DataFrame:
    """Value to maximise when choosing a model, as column ``value``.

    ap, f1 or f2 at 0.5, or the best precision at a recall floor (0 if out of reach).
    """
    if metric == "ap":
        return average_precision(df, y, score, by).select(*by, F.coalesce("ap", F.lit(0.0)).alias("value"))
    if metric in ("f1", "f2"):
        flagged = df.withColumn("_p", (F.col(score) >= 0.5).cast("int"))
        return prf(confusion(flagged, y, "_p", by)).select(*by, F.col(metric).alias("value"))
    if metric == "precision_at_recall":
        point = operating_point(pr_curve(df, y, score, by), min_recall, by)
        return point.select(*by, F.when(F.col("feasible"), F.col("precision")).otherwise(0.0).alias("value"))
    raise ValueError(f"unknown metric {metric}")


def choose(
    df: DataFrame, ts: str, y: str, candidates: dict[str, Fit], incumbent: str, frac: float = 0.2
) -> tuple[str, dict[str, float], Scorer]:
    """Candidate with the best average precision on the latest whole days.

    The incumbent wins ties; the winner is refitted on all rows. Returns its
    name, all values, and its scorer.
    """
    held = split_tail_days(df, ts, frac, "_held", "_rule").filter("_held = 1")
    cut = held.select(F.min(epoch_micros(ts))).first()[0]
    train, test = df.filter(epoch_micros(ts) < cut), df.filter(epoch_micros(ts) >= cut)
    if not _counts(test, y)[0]:
        return incumbent, {}, candidates[incumbent](df)
    order = [incumbent, *[c for c in candidates if c != incumbent]]
    values = {name: _ap(candidates[name](train)(test), y, "prob") for name in order}
    best = max(order, key=lambda name: values[name])
    return best, values, candidates[best](df)


def grid(**options: Sequence) -> list[dict]:
    """All combinations of a few listed settings."""
    return [dict(zip(options, values)) for values in product(*options.values())]


def fit_severity(
    df: DataFrame, features: Sequence[str], level: str, ts: str | None = None,
    settings: Sequence[dict] = ({"maxDepth": 8}, {"maxDepth": 12}), trees: int = 100, folds: int = 3, seed: int = 42,
) -> Scorer:
    """Multi-class forest for the affectation level; depth chosen by accuracy along time."""
    def fit_with(options: dict) -> PipelineModel:
        return lambda train: _fit(train.withColumn(level, F.col(level).cast("double")), features, [
            RandomForestClassifier(featuresCol="_x", labelCol=level, numTrees=trees, seed=seed, **options)])

    best = settings[0]
    if ts is not None and len(settings) > 1:
        pairs = forward_folds(df, ts, folds)

        def accuracy(options: dict) -> float:
            hits = []
            for train, test in pairs:
                scored = fit_with(options)(train).transform(_filled(test, features))
                hits.append(scored.agg(F.avg((F.col("prediction") == F.col(level)).cast("int"))).first()[0] or 0.0)
            return sum(hits) / max(len(hits), 1)

        best = max(settings, key=accuracy)
    model = fit_with(best)(df)

    def score(d: DataFrame) -> DataFrame:
        return model.transform(_filled(d, features)).select(*d.columns, F.col("prediction").cast("int").alias("level_hat"))

    return score


for _name, _fit_fn in {
    "logreg": fit_logit,
    "logreg_pk_effects": fit_logit_fixed,
    "random_forest": fit_forest,
    "gbdt_one_stage": fit_gbt,
    "gbdt_smote": fit_gbt_smote,
    "gbdt_two_stage": fit_gbt_two_stage,
    "balanced_bagging": fit_bagging,
    "gbdt_prox": fit_gbt_weighted,
    "gbdt_resid": fit_gbt_residual,
    "gbdt_block": fit_gbt_blocks,
}.items():
    register_model(_name, _fit_fn)
