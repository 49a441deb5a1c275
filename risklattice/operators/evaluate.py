"""Evaluation of (label, score) tables.

Everything that depends on a threshold is read from one table: the distinct
scores with their counts and running totals (``curve``). It is built with
map-side combining and block-wise running sums, for any number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import exact_quantiles, ordered_prefix
from ..session import materialise

KM_PER_CELL = 1.0
HOURS_PER_CELL = 5.0 / 60.0


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _flag(c: str) -> Column:
    return (F.col(c) > 0.5).cast("long")


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of true and false positives and negatives."""
    t, p = F.col(y) > 0.5, F.col(pred) > 0.5
    aggs = [
        F.count(F.when(p & t, 1)).alias("tp"), F.count(F.when(p & ~t, 1)).alias("fp"),
        F.count(F.when(~p & t, 1)).alias("fn"), F.count(F.when(~p & ~t, 1)).alias("tn"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, F2 and both readings of the false-alarm rate.

    ``far`` is the share of alarms that are false, ``fpr`` the share of
    negatives that are alarmed; empty denominators give 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    return (
        out.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("f2", _ratio(5 * tp, 5 * tp + fp + 4 * fn))
        .withColumn("far", _ratio(fp, tp + fp))
        .withColumn("fpr", _ratio(fp, fp + tn))
    )


def cumulative_by_score(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with counts and running totals from the highest score down."""
    rows = df.select(*by, F.col(score).alias("score"), F.lit(1).cast("long").alias("n"), _flag(y).alias("pos"))
    return ordered_prefix(rows, by, "score", ["n", "pos"], descending=True)


def pr_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every distinct score, tied scores together."""
    return cumulative_by_score(df, y, score, by).select(
        "*",
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        _ratio(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
    )


def decimate(curve: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` evenly spaced points of a curve, both ends kept."""
    steps = ordered_prefix(curve.withColumn("_one", F.lit(1).cast("long")), by, "score", ["_one"])
    at, last = F.col("cum__one") - 1, F.col("tot__one") - 1
    # the k-th kept index is floor(k * last / (n - 1)); at is kept if some k lands on it
    k = F.ceil(at * (n - 1) / F.greatest(last, F.lit(1)))
    kept = (F.floor(k * last / F.lit(n - 1)) == at) & (k <= n - 1) | (last < n)
    return curve.join(steps.filter(kept).select(*by, "score", at.alias("idx")), [*by, "score"])


def every_kth(curve: DataFrame, points: int, by: Sequence[str] = ()) -> DataFrame:
    """Every k-th point from the lowest score, k = max(1, N div points)."""
    steps = ordered_prefix(curve.withColumn("_one", F.lit(1).cast("long")), by, "score", ["_one"])
    k = F.greatest(F.lit(1), F.floor(F.col("tot__one") / points))
    kept = steps.filter((F.col("cum__one") - 1) % k == 0)
    return curve.join(kept.select(*by, "score"), [*by, "score"])


def ranking_metrics(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """n, positives, base rate, average precision, AUROC and lift in one pass."""
    curve = cumulative_by_score(df, y, score, by)
    neg, cum_neg = F.col("n") - F.col("pos"), F.col("cum_n") - F.col("cum_pos")
    aggs = [
        F.max("tot_n").alias("n"),
        F.max("tot_pos").alias("pos"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_ap"),
        F.sum(F.col("pos") * (neg / 2 - cum_neg)).alias("_u"),
    ]
    out = curve.groupBy(*by).agg(*aggs) if by else curve.agg(*aggs)
    p, q = F.col("pos"), F.col("n") - F.col("pos")
    base = p / F.col("n")
    return out.select(
        *by, "n", "pos", base.alias("base"),
        F.when(p > 0, F.col("_ap") / p).alias("ap"),
        F.when((p > 0) & (q > 0), (p * q + F.col("_u")) / (p * q)).alias("auroc"),
        F.when(p > 0, F.col("_ap") / p / base).alias("lift"),
    )


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under the precision–recall curve."""
    return ranking_metrics(df, y, score, by).select(*by, "n", "pos", "ap")


def auroc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties at one half."""
    return ranking_metrics(df, y, score, by).select(*by, "auroc")


def lift(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision over the base rate."""
    return ranking_metrics(df, y, score, by).select(*by, "base", "ap", "lift")


def brier(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the score clipped to [0, 1], and how far scores stray."""
    p = F.col(score)
    clipped = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    aggs = [
        F.avg(F.pow(clipped - _flag(y), 2)).alias("brier"),
        F.min(p).alias("score_min"),
        F.max(p).alias("score_max"),
        F.count(F.when((p < 0) | (p > 1), 1)).alias("outside"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def operating_point(curve: DataFrame, recall_floor: float, by: Sequence[str] = ()) -> DataFrame:
    """Highest precision at recall ≥ floor, lowest threshold among equals.

    Where the floor is out of reach, the highest recall.
    """
    row = F.struct("score", "precision", "recall", "cum_n", "cum_pos", "tot_pos")
    ok = F.when(F.col("recall") >= recall_floor, F.struct("precision", (-F.col("score")).alias("s")))
    aggs = [
        F.max_by(row, ok).alias("_ok"),
        F.max_by(row, F.struct("recall", (-F.col("score")).alias("s"))).alias("_any"),
    ]
    out = curve.groupBy(*by).agg(*aggs) if by else curve.agg(*aggs)
    best = F.coalesce("_ok", "_any")
    return out.select(
        *by, best["score"].alias("threshold"), best["precision"].alias("precision"),
        best["recall"].alias("recall"), best["cum_pos"].alias("tp"),
        (best["cum_n"] - best["cum_pos"]).alias("fp"), (best["tot_pos"] - best["cum_pos"]).alias("fn"),
        F.col("_ok").isNotNull().alias("feasible"),
    )


def _rates(df: DataFrame) -> DataFrame:
    one, eps = F.lit(1), F.lit(1e-12)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumn("precision", tp / F.greatest(tp + fp, one))
    out = out.withColumn("recall", tp / F.greatest(tp + fn, one))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", 2 * p * r / F.greatest(p + r, eps))
    return out.withColumn("f2", 5 * p * r / F.greatest(4 * p + r, eps))


def _pick(table: DataFrame, objective: str, feasible: Column, tie: Sequence[str], by: Sequence[str]) -> DataFrame:
    row = F.struct(*[c for c in table.columns if c not in by])
    order = F.struct(F.col(objective).alias("o"), *[(-F.col(c)).alias(f"t{i}") for i, c in enumerate(tie)])
    aggs = [F.max_by(row, F.when(feasible, order)).alias("_ok"), F.max_by(row, order).alias("_any")]
    out = table.groupBy(*by).agg(*aggs) if by else table.agg(*aggs)
    return out.select(*by, F.coalesce("_ok", "_any").alias("b"), F.col("_ok").isNotNull().alias("feasible")).select(
        *by, "b.*", "feasible"
    )


def sweep_threshold(
    df: DataFrame,
    y: str,
    score: str,
    grid: Sequence[float],
    objective: str = "recall",
    min_recall: float = 0.0,
    min_precision: float = 0.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Best threshold of an ascending grid under recall and precision floors.

    Each row only counts the grid values it reaches, so one aggregate over the
    data serves the whole grid. Without a feasible value the floors are dropped.
    """
    reached = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.col(score) >= g))
    counts = df.groupBy(*by, reached.alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_flag(y)).alias("pos")
    )
    table = counts.groupBy(*by).agg(
        *[F.sum(F.when(F.col("_k") > i, F.col("n")).otherwise(0)).alias(f"_n{i}") for i in range(len(grid))],
        *[F.sum(F.when(F.col("_k") > i, F.col("pos")).otherwise(0)).alias(f"_p{i}") for i in range(len(grid))],
        F.sum("pos").alias("_tot"),
    )
    each = F.array(*[
        F.struct(F.lit(float(g)).alias("threshold"), F.col(f"_p{i}").alias("tp"),
                 (F.col(f"_n{i}") - F.col(f"_p{i}")).alias("fp"), (F.col("_tot") - F.col(f"_p{i}")).alias("fn"))
        for i, g in enumerate(grid)
    ])
    rates = _rates(table.select(*by, F.explode(each).alias("g")).select(*by, "g.*").filter("tp + fp > 0"))
    feasible = (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)
    return _pick(rates, objective, feasible, ["threshold"], by)


def sweep_two_stage(
    df: DataFrame,
    y: str,
    s1: str,
    s2: str,
    grid1: Sequence[float],
    grid2: Sequence[float],
    objective: str = "f2",
    min_recall: float = 0.0,
    max_far: float = 1.0,
) -> DataFrame:
    """Best pair of thresholds when a cell alarms only if both stages reach theirs.

    Rows are counted by how many values of either grid they reach; every pair is
    then a suffix sum over that small table, at most (len+1)·(len+1) rows.
    """
    def reached(grid: Sequence[float], c: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.col(c) >= g))

    counts = df.groupBy(reached(grid1, s1).alias("i"), reached(grid2, s2).alias("j")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_flag(y)).alias("pos")
    )
    total = counts.agg(F.sum("pos").alias("p")).scalar()
    any1 = counts.filter("i > 0").select(F.max("i")).scalar()
    cells = counts.filter("i > 0 and j > 0").select(
        "n", "pos", F.explode(F.sequence(F.lit(1), F.col("i"))).alias("a"), "j"
    ).groupBy("a", "j").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    both = cells.select("a", F.explode(F.sequence(F.lit(1), F.col("j"))).alias("b"), "n", "pos").groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    every = counts.sparkSession.range(len(grid1) * len(grid2)).select(
        F.expr(f"cast(id div {len(grid2)} as int) + 1").alias("a"), F.expr(f"cast(id % {len(grid2)} as int) + 1").alias("b")
    )
    full = every.join(both, ["a", "b"], "left").fillna(0, subset=["n", "pos"]).filter(F.col("a") <= any1)
    g1 = F.array(*[F.lit(float(g)) for g in grid1])
    g2 = F.array(*[F.lit(float(g)) for g in grid2])
    table = _rates(full.select(
        F.get(g1, F.col("a") - 1).alias("s1"), F.get(g2, F.col("b") - 1).alias("s2"),
        F.col("pos").alias("tp"), (F.col("n") - F.col("pos")).alias("fp"), (total - F.col("pos")).alias("fn"),
    )).withColumn("far", F.col("fp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))
    feasible = (F.col("recall") >= min_recall) & (F.col("far") <= max_far)
    return _pick(table, objective, feasible, ["s1", "s2"], [])


def gate(df: DataFrame, s1: str, s2: str, threshold: float, out: str, keep_screener: bool = False) -> DataFrame:
    """Supervisor score where the screener reaches its threshold.

    Elsewhere 0 (cascade), or the screener's own score.
    """
    other = F.col(s1) if keep_screener else F.lit(0.0)
    return df.withColumn(out, F.when(F.col(s1) >= threshold, F.coalesce(F.col(s2), F.lit(0.0))).otherwise(other))


def tiers(
    curve: DataFrame,
    by: Sequence[str] = (),
    strict: float = 0.95,
    dispatch: float = 0.80,
    advisory: float = 0.50,
    km: float = KM_PER_CELL,
    hours: float = HOURS_PER_CELL,
) -> DataFrame:
    """Operating tiers with their counts, rates, captured share and exposure.

    strict/dispatch: highest recall at the precision target, else highest
    precision. balanced: highest F1. advisory: highest precision at the recall
    target, else recall closest to it. Equal candidates: lowest threshold.
    """
    p, r, low = F.col("precision"), F.col("recall"), -F.col("score")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r + 1e-12)).otherwise(0.0)
    row = F.struct("score", "precision", "recall", "cum_n", "cum_pos", "tot_n", "tot_pos")

    def best(order: Column, where: Column | None = None) -> Column:
        key = F.struct(order.alias("o"), low.alias("t"))
        return F.max_by(row, key if where is None else F.when(where, key))

    aggs = [
        best(r, p >= strict).alias("a_strict"), best(r, p >= dispatch).alias("a_dispatch"),
        best(f1).alias("a_balanced"), best(p, r >= advisory).alias("a_advisory"),
        best(p).alias("b_strict"), best(-F.abs(r - advisory)).alias("b_advisory"),
    ]
    picked = curve.groupBy(*by).agg(*aggs) if by else curve.agg(*aggs)
    names = {"strict": "b_strict", "dispatch": "b_strict", "balanced": "a_balanced", "advisory": "b_advisory"}
    each = F.array(*[
        F.struct(F.lit(k).alias("tier"), F.col(f"a_{k}").isNotNull().alias("attained"),
                 F.coalesce(f"a_{k}", other).alias("c"))
        for k, other in names.items()
    ])
    rows = picked.select(*by, F.explode(each).alias("t")).select(*by, "t.tier", "t.attained", "t.c.*")
    tp, flagged = F.col("cum_pos"), F.col("cum_n")
    fp, neg = flagged - tp, F.col("tot_n") - F.col("tot_pos")
    pr, rc = tp / F.greatest(flagged, F.lit(1)), tp / F.greatest(F.col("tot_pos"), F.lit(1))
    return rows.select(
        *by, "tier", "attained", F.col("score").alias("threshold"), pr.alias("precision"), rc.alias("recall"),
        (2 * pr * rc / F.greatest(pr + rc, F.lit(1e-9))).alias("f1"),
        (fp / F.greatest(neg, F.lit(1))).alias("fpr"), tp.alias("tp"), fp.alias("fp"), flagged.alias("flagged"),
        (flagged * km * hours).alias("exposure"), (100 * flagged / F.col("tot_n")).alias("flagged_pct"),
    )


def exposure_curve(curve: DataFrame, km: float = KM_PER_CELL, hours: float = HOURS_PER_CELL) -> DataFrame:
    """Road-hours flagged at every threshold."""
    return curve.withColumn("exposure", F.col("cum_n") * km * hours)


def calibration(df: DataFrame, y: str, score: str, bins: int = 10, closed: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and observed rate per equal-width bin of [0, 1).

    A score of exactly 1 falls outside unless ``closed``.
    """
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)])
    which = F.size(F.filter(edges, lambda e: F.col(score) >= e)) - 1
    inside = (F.col(score) >= 0) & ((F.col(score) <= 1) if closed else (F.col(score) < 1))
    return df.filter(inside).groupBy(*by, which.alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(_flag(y)).alias("observed"), F.count(F.lit(1)).alias("n")
    )


def common_days(df: DataFrame, contrast: Sequence[str], model: str, day: str) -> DataFrame:
    """Days on which every model of a contrast has rows."""
    seen = df.select(*contrast, model, day).distinct()
    models = seen.groupBy(*contrast).agg(F.countDistinct(model).alias("_m")) if contrast else seen.agg(F.countDistinct(model).alias("_m"))
    per_day = seen.groupBy(*contrast, day).agg(F.count(F.lit(1)).alias("_d"))
    if contrast:
        return per_day.join(models, list(contrast)).filter("_d = _m").select(*contrast, day)
    return per_day.filter(F.col("_d") == models.scalar()).select(day)


@lru_cache(maxsize=4)
def _multiplicities(days: int, reps: int, seed: int) -> np.ndarray:
    """How often each day is drawn in each replicate, shape (days, reps)."""
    r = np.arange(reps, dtype=np.int64)[:, None]
    d = np.arange(days, dtype=np.int64)[None, :]
    z = (r * 7919 + d * 104729 + seed * 31) % 1000003
    z = (z * 1103515245 + 12345) % 2147483648
    drawn = (z // 65536) % days
    out = np.zeros((days, reps))
    for rep in range(reps):
        out[:, rep] = np.bincount(drawn[rep], minlength=days)
    return out


def score_ranges(counts: DataFrame, by: Sequence[str], score: str, rows: int) -> DataFrame:
    """(``by``, ``score``, _range) for each score of a group: ranges from the highest down, of ``rows`` rows of ``counts`` each.

    A range goes on until its last score is complete, so it holds fewer than ``rows`` plus the rows of one score. Counts of
    equal scores add up map-side; running totals are taken inside value bins, whose totals are carried across.
    """
    cumulative = ordered_prefix(counts.select(*by, score, F.lit(1).cast("long").alias("_r")), by, score, ["_r"], descending=True)
    return cumulative.select(*by, score, F.floor((F.col("cum__r") - F.col("_r")) / rows).cast("long").alias("_range"))


def _totals_above(by: Sequence[str], part: str, n: int, seed: int):
    """Reads (by, part, _d, _days, _n, _p); for each part, per replicate, the rows and positives of all parts before it."""

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        weights = _multiplicities(int(pdf["_days"].iloc[0]), n, seed)
        rows, above_n, above_p = [], np.zeros(n), np.zeros(n)
        head = [pdf[c].iloc[0] for c in by]
        for b, own in pdf.groupby(part, sort=True):
            rows.append([*head, b, above_n.copy(), above_p.copy()])
            w = weights[own["_d"].to_numpy()]
            above_n += own["_n"].to_numpy() @ w
            above_p += own["_p"].to_numpy() @ w
        return pd.DataFrame(rows, columns=[*by, part, "_cn", "_cp"])

    return carry


def bootstrap_days(
    df: DataFrame, y: str, score: str, day: str, by: Sequence[str], n: int = 1000, seed: int = 12345,
    within: Sequence[str] = (), range_rows: int = 16_384,
) -> DataFrame:
    """Average precision and AUROC of day-block resamples shared by all groups.

    Days are numbered inside each value of ``within`` (a contrast, part of
    ``by``), so all groups of a contrast see the same resamples of its days.

    The data are reduced once to (group, day, score) counts. Those are cut into
    score ranges of equal count, however the scores are spread: a task holds one
    range, fewer than ``range_rows`` rows plus one per day, and all replicates as
    a matrix, starting from the totals of the ranges above it, so rows are never
    multiplied by the number of replicates. Totals are carried in two steps,
    across blocks of 4096 ranges and inside them. Rows without a score are left
    out, as are degenerate resamples; ``rep`` is the key.
    """
    by, within = list(by), list(within)
    days = df.select(*within, F.col(day).alias("_day")).distinct()
    numbered = Window.partitionBy(*within)
    listed = days.select(
        *within, "_day", (F.row_number().over(numbered.orderBy("_day")) - 1).alias("_d"),
        F.count(F.lit(1)).over(numbered).alias("_days"),
    )
    counts = materialise(
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, F.col(day).alias("_day"), F.col(score).cast("double").alias("_s"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(_flag(y)).alias("_p"))
        .join(listed, [*within, "_day"])
        .select(*by, "_d", "_s", "_n", "_p", "_days"), "score_counts")
    ranges = score_ranges(counts, by, "_s", range_rows)
    hist = counts.join(ranges, [*by, "_s"]).withColumn("_block", F.floor(F.col("_range") / 4096))
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hist.select(*by).schema.fields)
    prefix = f"{key_types}, " if by else ""

    def above(keys: list[str], part: str, types: str) -> DataFrame:
        totals = hist.groupBy(*keys, part, "_d", "_days").agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
        carried = totals.groupBy(*keys).applyInPandas(_totals_above(keys, part, n, seed), f"{types}{part} long, _cn array<double>, _cp array<double>")
        return carried

    def score_range(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        weights = _multiplicities(int(left["_days"].iloc[0]), n, seed)
        left = left.sort_values("_s", ascending=False, kind="stable")
        s = left["_s"].to_numpy()
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        day_of, num, pos = (left[c].to_numpy() for c in ("_d", "_n", "_p"))
        cn, cp = np.asarray(right["_cn"].iloc[0], float), np.asarray(right["_cp"].iloc[0], float)
        ap, u, tot_n, tot_p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        i = 0
        while i < len(starts):  # some 2048 rows at a time, and all of a score
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + 2048)))
            cut, end = starts[i:j], starts[j] if j < len(starts) else len(s)
            w = weights[day_of[cut[0] : end]]
            wn = np.add.reduceat(w * num[cut[0] : end, None], cut - cut[0])
            wp = np.add.reduceat(w * pos[cut[0] : end, None], cut - cut[0])
            run_n, run_p = cn + np.cumsum(wn, axis=0), cp + np.cumsum(wp, axis=0)
            ap += (wp * run_p / np.maximum(run_n, 1)).sum(axis=0)
            u += (wp * ((wn - wp) / 2 - (run_n - run_p))).sum(axis=0)
            cn, cp = run_n[-1], run_p[-1]
            tot_n, tot_p = tot_n + wn.sum(axis=0), tot_p + wp.sum(axis=0)
            i = j
        head = {c: left[c].iloc[0] for c in by}
        return pd.DataFrame({**head, "rep": np.arange(n), "_ap": ap, "_u": u, "_n": tot_n, "_p": tot_p})[
            [*by, "rep", "_ap", "_u", "_n", "_p"]
        ]

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = above(by, "_block", prefix).withColumnsRenamed({"_cn": "_bn", "_cp": "_bp"})
    inner = above([*by, "_block"], "_range", f"{prefix}_block long, ")
    plus = lambda a, b: F.zip_with(a, b, lambda x, z: x + z)
    carried = inner.join(blocks, [*by, "_block"]).select(*by, "_range", plus("_cn", "_bn").alias("_cn"), plus("_cp", "_bp").alias("_cp"))
    # a fixed number of tasks: adaptive coalescing goes by bytes, the work here is per range
    parts = (
        hist.repartition(tasks, *by, "_range").groupBy(*by, "_range")
        .cogroup(carried.repartition(tasks, *by, "_range").groupBy(*by, "_range"))
        .applyInPandas(score_range, f"{prefix}rep int, _ap double, _u double, _n double, _p double")
    )
    sums = parts.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in ("_ap", "_u", "_n", "_p")])
    p, q = F.col("_p"), F.col("_n") - F.col("_p")
    return sums.filter((p > 0) & (q > 0)).select(
        *by, "rep", (F.col("_ap") / p).alias("ap"), ((p * q + F.col("_u")) / (p * q)).alias("auroc")
    )


def bootstrap_ci(reps: DataFrame, by: Sequence[str], cols: Sequence[str] = ("ap", "auroc")) -> DataFrame:
    """2.5 % and 97.5 % points over replicates; a group holds one row per replicate."""
    aggs = []
    for c in cols:
        aggs += [F.percentile(c, F.lit(0.025)).alias(f"{c}_lo"), F.percentile(c, F.lit(0.975)).alias(f"{c}_hi")]
    return reps.groupBy(*by).agg(*aggs)


def paired_significance(reps: DataFrame, model: str, reference: str) -> DataFrame:
    """Mean advantage of the reference, share of replicates without one, and stars."""
    ref = reps.filter(F.col(model) == reference).select(
        "rep", F.col("ap").alias("_ap"), F.col("auroc").alias("_auc")
    )
    d, d2 = F.col("_ap") - F.col("ap"), F.col("_auc") - F.col("auroc")
    out = reps.filter(F.col(model) != reference).join(ref, "rep").groupBy(model).agg(
        F.avg(d).alias("d_ap"),
        F.avg((d <= 0).cast("int")).alias("p_ap"),
        F.avg((d2 <= 0).cast("int")).alias("p_auroc"),
    )
    stars = F.when(F.col("p_ap") < 0.01, "**").when(F.col("p_ap") < 0.05, "*").otherwise("")
    return out.withColumn("stars", stars)


def weighted_f1(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy and support-weighted F1 over any number of classes."""
    counts = df.groupBy(F.col(y).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    classes = counts.select(
        F.explode(F.array(
            F.struct(F.col("t").alias("c"), n.alias("support"), F.lit(0).cast("long").alias("said"),
                     F.when(F.col("t") == F.col("p"), n).otherwise(0).alias("right")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), n.alias("said"),
                     F.lit(0).cast("long").alias("right")),
        )).alias("x")
    ).groupBy("x.c").agg(*[F.sum(f"x.{k}").alias(k) for k in ("support", "said", "right")])
    f1 = _ratio(2 * F.col("right"), F.col("support") + F.col("said"))
    return classes.agg(
        F.sum("support").cast("long").alias("n"),
        (F.sum("right") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def quantile_of(df: DataFrame, value: str, q: float) -> Column:
    """Exact quantile of a whole column as a scalar subquery."""
    return exact_quantiles(df, [], value, {"q": q}).scalar()
