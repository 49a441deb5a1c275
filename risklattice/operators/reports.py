"""Tables built on the evaluation operators: contrasts, folds, months, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .evaluate import brier, confusion, prf, ranking_metrics


def active_arms(registry: DataFrame, arch: str = "arch", active: str = "active_graph") -> DataFrame:
    """Registry without withdrawn, data-quantity and superseded entries.

    An entry whose graph was inactive is superseded when another entry of its
    contrast and architecture had it active.
    """
    kept = registry.filter(F.coalesce(~F.col("role").isin("excluded", "data_quantity"), F.lit(True)))
    better = registry.filter(F.col(active)).select("contrast", arch).distinct().withColumn("_better", F.lit(True))
    flagged = kept.join(better, ["contrast", arch], "left")
    superseded = ~F.col(active) & F.coalesce(F.col("_better"), F.lit(False))
    return flagged.filter(~superseded).select(*registry.columns)


def arm_metrics(scores: DataFrame, key: str, y: str, score: str, pred: str) -> DataFrame:
    """n, positives, ranking quality, Brier score and frozen-threshold rates per model."""
    rank = ranking_metrics(scores, y, score, [key])
    square = brier(scores, y, score, [key]).select(key, "brier", "outside")
    frozen = prf(confusion(scores, y, pred, [key])).select(
        key, "precision", "recall", "f1", "f2", "far", "tp", "fp", "fn"
    )
    return rank.join(square, key).join(frozen, key)


def contrast_table(metrics: DataFrame, registry: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Every registry entry with its metrics, or PENDING; rank inside its contrast.

    ``mismatch`` marks contrasts whose models were scored on populations that
    differ by more than ``tolerance``. ``panel`` is forecaster, classifier or
    system by contrast, exactly one per entry.
    """
    joined = registry.join(metrics, "key", "left")
    contrast = Window.partitionBy("contrast")
    spread = (F.max("n").over(contrast) - F.min("n").over(contrast)) / F.max("n").over(contrast)
    order = contrast.orderBy(F.col("ap").desc_nulls_last(), F.col("key"))
    panel = F.when(F.col("contrast") == "C1", "forecaster").when(F.col("contrast") == "C2", "classifier").otherwise("system")
    return joined.select(
        "contrast", "key", "label", F.when(F.col("n").isNull(), "PENDING").otherwise("OK").alias("status"),
        "n", "pos", "ap", "auroc", "brier", "precision", "recall",
        F.coalesce(spread > tolerance, F.lit(False)).alias("mismatch"), panel.alias("panel"),
        F.when(F.col("ap").isNotNull(), F.row_number().over(order)).alias("rank"),
    )


def forecast_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R², bias, MAPE over non-zero truth, deviation of truth and n per channel.

    ``pairs`` maps a channel to (observed, forecast). One pass for all channels.
    """
    items = ", ".join(f"'{c}', cast({a} as double), cast({b} as double)" for c, (a, b) in pairs.items())
    long = df.selectExpr(*by, f"stack({len(pairs)}, {items}) as (channel, truth, guess)")
    ok = long.filter("truth is not null and guess is not null and not isnan(truth) and not isnan(guess)")
    e, t = F.col("guess") - F.col("truth"), F.col("truth")
    return ok.groupBy(*by, "channel").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(F.var_pop(t) > 0, 1 - F.avg(e * e) / F.var_pop(t)).alias("r2"),
        F.avg(e).alias("bias"),
        (F.avg(F.when(F.abs(t) > 1e-9, F.abs(e) / F.abs(t))) * 100).alias("mape_nz"),
        F.stddev_pop(t).alias("truth_sd"),
        F.count(F.lit(1)).alias("n"),
    )


def segment_map(pred: DataFrame, loc: Sequence[str], y: str, score: str, flag: str) -> DataFrame:
    """Counts, rates and local ranking quality per segment.

    Rates without a denominator and quality without both classes are null.
    """
    counts = confusion(pred, y, flag, loc)
    keys = [f"_k{i}" for i in range(len(loc))]
    named = pred.select(*[F.col(c).alias(k) for c, k in zip(loc, keys)], F.col(y).alias("_y"), F.col(score).alias("_s"))
    rank = ranking_metrics(named, "_y", "_s", keys).select(
        *[F.col(k).alias(c) for c, k in zip(loc, keys)], "n", F.col("pos").alias("_pos"), "ap", "lift"
    )
    both = (F.col("_pos") > 0) & (F.col("_pos") < F.col("n"))
    flagged = F.col("tp") + F.col("fp")
    return counts.join(rank, list(loc)).select(
        *loc, "n", F.col("_pos").alias("positives"), "tp", "fp", flagged.alias("flagged"),
        F.when(F.col("_pos") > 0, F.col("tp") / F.col("_pos")).alias("recall"),
        F.when(flagged > 0, F.col("tp") / flagged).alias("precision"),
        F.when(both, F.col("ap")).alias("ap"), F.when(both, F.col("lift")).alias("lift"),
    )


def _fold_quality(pred: DataFrame, fold: Column, name: str, y: str, score: str) -> DataFrame:
    rows = pred.select(fold.alias(name), F.col(y).alias("y"), F.col(score).alias("score"))
    return ranking_metrics(rows, "y", "score", [name]).filter("pos > 0")


def rolling_origin(pred: DataFrame, folds: DataFrame, ts: str, y: str, score: str, fmt: str = "yyyy-MM") -> DataFrame:
    """Quality per fold; folds without scores stay as pending rows.

    ``folds`` is a table with a ``fold`` key matching the formatted instant.
    """
    quality = _fold_quality(pred, F.date_format(ts, fmt), "fold", y, score)
    return folds.join(quality, "fold", "left").select(
        *folds.columns, "n", "pos", "base", "ap", "lift",
        F.when(F.col("ap").isNull(), "PENDING").otherwise("OK").alias("status"),
    )


def month_panel(metrics: DataFrame, key: str, month: str, months: Sequence[str]) -> DataFrame:
    """One row per model with average precision and lift per month side by side."""
    return metrics.groupBy(key).pivot(month, list(months)).agg(
        F.round(F.max("ap"), 4).alias("ap"), F.round(F.max("lift"), 1).alias("lift")
    )


def season_slices(
    pred: DataFrame, slices: Sequence[tuple[str, str, str]], ts: str, y: str, score: str, threshold: float
) -> DataFrame:
    """A frozen threshold applied to a few named periods; periods without positives drop out."""
    name = F.lit(None).cast("string")
    for label, start, end in reversed(list(slices)):
        inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
        name = F.when(inside, label).otherwise(name)
    rows = pred.select(name.alias("slice"), F.col(y).alias("y"), F.col(score).alias("score")).filter("slice is not null")
    rows = rows.withColumn("flag", (F.col("score") >= threshold).cast("int"))
    rank = ranking_metrics(rows, "y", "score", ["slice"]).filter("pos > 0")
    counts = confusion(rows, "y", "flag", ["slice"])
    one = F.lit(1)
    return rank.join(counts, "slice").select(
        "slice", "ap", "base", "lift",
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).alias("precision"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)).alias("recall"),
    )


def lead_sweep(pred: DataFrame, lead: str, y: str, score: str) -> DataFrame:
    """Quality per forecast lead; leads never scored are absent."""
    return ranking_metrics(pred, y, score, [lead]).select(lead, "base", "ap", "lift", "auroc")


def day_matrix(pred: DataFrame, ts: str, pos: str, y: str, score: str, day: str) -> DataFrame:
    """Highest score per post and time of day on one day.

    A day without rows or positives is replaced by the day with most positives.
    """
    per_day = pred.groupBy(F.to_date(ts).alias("_day")).agg(F.sum(y).alias("_pos"))
    wanted = F.lit(day).cast("date")
    asked = per_day.filter((F.col("_day") == wanted) & (F.col("_pos") > 0)).select(F.max("_day")).scalar()
    busiest = per_day.select(F.min_by("_day", F.struct((-F.col("_pos")).alias("a"), F.col("_day").alias("b")))).scalar()
    chosen = pred.filter(F.to_date(ts) == F.coalesce(asked, busiest))
    clock = F.hour(ts) + F.minute(ts) / 60
    return chosen.groupBy(F.col(pos), F.to_date(ts).alias("day"), clock.alias("clock")).agg(
        F.max(score).alias("score"), F.max(y).alias("y")
    )


def stage_summary(df: DataFrame, y: str, stages: dict[str, tuple[str, str]]) -> DataFrame:
    """Confusion, rates and average precision per stage and the change to the first.

    ``stages`` maps a name to (score column, 0/1 alarm column).
    """
    items = ", ".join(f"'{k}', cast({s} as double), cast({p} as int)" for k, (s, p) in stages.items())
    long = df.selectExpr(f"{y} as y", f"stack({len(stages)}, {items}) as (stage, score, pred)")
    table = prf(confusion(long, "y", "pred", ["stage"])).join(
        ranking_metrics(long, "y", "score", ["stage"]).select("stage", "ap"), "stage"
    )
    first = table.filter(F.col("stage") == next(iter(stages)))
    return table.select(
        "*", (F.col("fp") - first.select("fp").scalar()).alias("fp_change"),
        (F.col("precision") - first.select("precision").scalar()).alias("precision_change"),
        (F.col("recall") - first.select("recall").scalar()).alias("recall_change"),
    )


def metric_drift(stored: DataFrame, computed: DataFrame, key: str, metric: str, tolerance: float = 5e-4) -> DataFrame:
    """Stored and recomputed metric per key, which one to show, and whether they differ."""
    b = computed.select(key, F.col(metric).alias("recomputed"))
    joined = b.join(stored.select(key, F.col(metric).alias("stored")), key, "left")
    drift = F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) >= tolerance, F.lit(False))
    return joined.select(
        key, "stored", "recomputed", drift.alias("drift"),
        F.when(drift, F.col("stored")).otherwise(F.col("recomputed")).alias("shown"),
    )
