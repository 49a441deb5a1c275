"""Roll-ups, baselines, profiles and descriptive tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import exact_quantiles

ONE = F.lit


def _group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def agg_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean per composite key, collapsing repeats."""
    return _group(df, keys, [F.avg(c).alias(c) for c in cols])


def agg_max(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Maximum per key."""
    return _group(df, keys, [F.max(c).alias(c) for c in cols])


def geometry_rollup(
    raw: DataFrame, keys: Sequence[str], post: str, radius: str, up: str, down: str
) -> DataFrame:
    """Curvature and slope per whole post and direction from readings every tenth.

    Half-way posts and angles round to even. Class shares are counts divided by
    the number of distinct tenths.
    """
    long = raw.selectExpr(
        *keys, f"cast(bround({post}) as int) as post", f"{post} as _raw", f"{radius} as _r",
        f"stack(2, 'cre', {up}, 'dec', {down}) as (sen, _s)",
    )
    r, s = F.abs("_r"), F.col("_s")
    pitch = F.bround(F.degrees(F.asin(s / 100)), 2)
    aggs = [
        F.sum(F.abs(s)).alias("slope_cum"),
        F.abs(F.max(s)).alias("slope_rise"),
        F.abs(F.min(s)).alias("slope_drop"),
        F.sum((r > 1300).cast("long")).alias("curve_light"),
        F.sum(((r > 300) & (r <= 1300)).cast("long")).alias("curve_regular"),
        F.sum((r <= 300).cast("long")).alias("curve_heavy"),
        F.sum(2 * math.pi / r).alias("curve_cum"),
        F.sum(F.abs(F.bround(F.degrees(F.atan(100 / F.col("_r"))), 2))).alias("ang_curv"),
        F.sum(F.when(pitch >= 0, pitch)).alias("ang_pend_pos"),
        F.sum(F.when(pitch < 0, pitch)).alias("ang_pend_neg"),
        F.countDistinct(F.floor(F.round(F.col("_raw") * 10, 4)) % 10).alias("segment"),
    ]
    out = long.groupBy(*keys, "post", "sen").agg(*aggs)
    for c in ("curve_light", "curve_regular", "curve_heavy"):
        out = out.withColumn(c, F.bround(F.coalesce(F.col(c), ONE(0)) / F.col("segment"), 2))
    return out.fillna(0)


def spread_list(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, prefix: str
) -> DataFrame:
    """The first ``n`` values per group in ``n`` columns, null where there are fewer."""
    window = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= n)
    return first.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rn") == i + 1, F.col(value))).alias(f"{prefix}{i}") for i in range(n)]
    )


def baseline_stats(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], ts: str | None = None, cutoff: str | None = None
) -> DataFrame:
    """Mean and sample deviation per key before ``cutoff``."""
    if cutoff is not None:
        df = df.filter(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return _group(df, keys, aggs)


def baseline_rate(
    df: DataFrame, keys: Sequence[str], label: str, out: str, ts: str | None = None, cutoff: str | None = None
) -> DataFrame:
    """Share of positives per key before ``cutoff``."""
    if cutoff is not None:
        df = df.filter(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    return _group(df, keys, [(F.sum(label) / F.count(label)).alias(out)])


def free_flow(df: DataFrame, pos: Sequence[str], speed: str, q: float = 0.85, out: str = "v_ff") -> DataFrame:
    """Exact upper quantile of speed by position."""
    return exact_quantiles(df, pos, speed, {out: q})


def coarsen_hour(df: DataFrame, hour: str, slots_per_hour: int = 1) -> DataFrame:
    """Reduce a slot index with so many slots per hour to hours."""
    return df.withColumn(hour, F.floor(F.col(hour) / slots_per_hour).cast("int"))


def eb_rate(df: DataFrame, keys: Sequence[str], label: str, m: float = 200.0) -> DataFrame:
    """Rates per key shrunken towards the overall rate ``p0`` by ``m`` pseudo-rows."""
    cells = df.groupBy(*keys).agg(F.sum(label).alias("_s"), F.count(F.lit(1)).alias("_n"))
    cells = cells.withColumn("p0", cells.select(F.sum("_s") / F.sum("_n")).scalar())
    rate = (F.col("_s") + F.lit(float(m)) * F.col("p0")) / (F.col("_n") + F.lit(float(m)))
    return cells.select(*keys, rate.alias("rate"), "p0")


def apply_eb(df: DataFrame, rates: DataFrame, keys: Sequence[str], out: str = "score") -> DataFrame:
    """Attach shrunken rates; keys never seen get the overall rate."""
    p0 = rates.select(F.max("p0")).scalar()
    joined = df.join(rates.select(*keys, "rate"), list(keys), "left")
    return joined.withColumn(out, F.coalesce("rate", p0)).drop("rate")


def profile_fit(
    df: DataFrame, loc: Sequence[str], slot: Sequence[str], cols: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean per (location, slot), per location and overall.

    The coarser tables are rolled up from the finest one's sums and counts.
    """
    sums = [F.sum(c).alias(f"_s_{c}") for c in cols] + [F.count(c).alias(f"_n_{c}") for c in cols]
    fine = df.groupBy(*loc, *slot).agg(*sums)
    names = [f"_{k}_{c}" for c in cols for k in "sn"]
    means = [(F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), ONE(0))).alias(c) for c in cols]
    by_loc = fine.groupBy(*loc).agg(*[F.sum(x).alias(x) for x in names])
    overall = fine.agg(*[F.sum(x).alias(x) for x in names])
    return fine.select(*loc, *slot, *means), by_loc.select(*loc, *means), overall.select(*means)


def volume_factor(
    prior: DataFrame, recent: DataFrame, loc: Sequence[str], ref: str, low: float = 0.25, high: float = 4.0
) -> DataFrame:
    """Recent over prior level per location, gaps filled by the median, clipped."""
    a = prior.groupBy(*loc).agg(F.avg(ref).alias("prior_lvl"))
    b = recent.groupBy(*loc).agg(F.avg(ref).alias("recent_lvl"))
    both = a.join(b, list(loc), "full_outer")
    raw = F.when(F.col("prior_lvl") != 0, F.col("recent_lvl") / F.col("prior_lvl"))
    both = both.withColumn("_f", raw)
    median = exact_quantiles(both, [], "_f", {"m": 0.5}).scalar()
    fill = F.when(median > 0, median).otherwise(1.0)
    factor = F.least(F.greatest(F.coalesce("_f", fill), F.lit(low)), F.lit(high))
    return both.select(*loc, "prior_lvl", "recent_lvl", factor.alias("vol_factor"))


def profile_predict(
    df: DataFrame,
    model: tuple[DataFrame, DataFrame, DataFrame],
    loc: Sequence[str],
    slot: Sequence[str],
    cols: Sequence[str],
    factor: DataFrame | None = None,
    volume_cols: Sequence[str] = (),
    suffix: str = "_hat",
) -> DataFrame:
    """Profile value of the slot, else of the location, else overall.

    ``factor`` rescales the volume channels; locations without one use the
    median of the known factors.
    """
    fine, by_loc, overall = model
    out = df.join(fine.select(*loc, *slot, *[F.col(c).alias(f"_f_{c}") for c in cols]), [*loc, *slot], "left")
    out = out.join(by_loc.select(*loc, *[F.col(c).alias(f"_l_{c}") for c in cols]), list(loc), "left")
    if factor is not None:
        out = out.join(factor.select(*loc, F.col("vol_factor").alias("_v")), list(loc), "left")
        median = exact_quantiles(factor, [], "vol_factor", {"m": 0.5}).scalar()
    for c in cols:
        value = F.coalesce(F.col(f"_f_{c}"), F.col(f"_l_{c}"), overall.select(c).scalar(), F.lit(0.0))
        if factor is not None and c in volume_cols:
            value = value * F.coalesce(F.col("_v"), median, F.lit(1.0))
        out = out.withColumn(f"{c}{suffix}", value)
    return out.select(*df.columns, *[f"{c}{suffix}" for c in cols])


def residual_baseline(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Exact medians per key and overall, for each column."""
    by_key, overall = None, None
    for c in cols:
        a = exact_quantiles(df, keys, c, {f"{c}_med": 0.5})
        b = exact_quantiles(df, [], c, {f"{c}_med": 0.5})
        by_key = a if by_key is None else by_key.join(a, list(keys), "full_outer")
        overall = b if overall is None else overall.withColumn(f"{c}_med", b.scalar())
    return by_key, overall


def residualise(
    df: DataFrame, baseline: tuple[DataFrame, DataFrame], keys: Sequence[str], cols: Sequence[str], suffix: str = "_res"
) -> DataFrame:
    """Departure of each column from its median for the key, else overall."""
    by_key, overall = baseline
    out = df.join(by_key, list(keys), "left")
    for c in cols:
        base = F.coalesce(F.col(f"{c}_med"), overall.select(f"{c}_med").scalar())
        out = out.withColumn(f"{c}{suffix}", F.col(c) - base)
    return out.drop(*[f"{c}_med" for c in cols])


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) rows, one per column of the input."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(cols)}, {pairs}) as (column, value)")


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range, quartiles and share of zeros per column."""
    long = to_long(df, cols).filter("value is not null")
    stats = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg((F.col("value") == 0).cast("int")).alias("zero_share"),
    )
    quartiles = exact_quantiles(long, ["column"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return stats.join(quartiles, "column")


def lattice_summary(
    raw: DataFrame, clean: DataFrame, direction: str, pos: str, ts: str, label: str
) -> DataFrame:
    """One row: posts, directions, segments, span, sizes before and after, base rate."""
    before = raw.select(F.count(F.lit(1))).scalar()
    rate = F.sum(label) / F.count(F.lit(1))
    return clean.agg(
        F.countDistinct(pos).alias("posts"), F.countDistinct(direction).alias("directions"),
        F.countDistinct(direction, pos).alias("segments"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.count(F.lit(1)).alias("rows_clean"), F.sum(label).cast("long").alias("positives"),
        rate.alias("base_rate"),
        F.bround(F.sum(1 - F.col(label)) / F.sum(label)).cast("long").alias("imbalance"),
    ).withColumn("rows_raw", before)


def rate_by(df: DataFrame, key: Column, name: str, label: str) -> DataFrame:
    """Rows, positives and base rate (percent) per key."""
    return df.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("pos"),
        (100 * F.sum(label) / F.count(F.lit(1))).alias("rate_pct"),
    )


def month_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quality_report(
    df: DataFrame, keys: Sequence[str], categorical: Sequence[str], imputed: Sequence[str], counted: Sequence[str]
) -> DataFrame:
    """Long table (check, column, value): nulls, distinct categories, imputed and
    non-zero shares per column, and rows beyond the first of a repeated key."""
    n = F.count(F.lit(1))
    aggs = [F.struct(F.lit("nulls").alias("check"), F.lit(c).alias("column"),
                     F.count(F.when(F.col(c).isNull(), 1)).cast("double").alias("value")) for c in df.columns]
    aggs += [F.struct(F.lit("distinct").alias("check"), F.lit(c).alias("column"),
                      F.countDistinct(c).cast("double").alias("value")) for c in categorical]
    aggs += [F.struct(F.lit("imputed_share").alias("check"), F.lit(c).alias("column"),
                      (F.sum(c) / n).cast("double").alias("value")) for c in imputed]
    aggs += [F.struct(F.lit("nonzero_share").alias("check"), F.lit(c).alias("column"),
                      (F.count(F.when(F.col(c) != 0, 1)) / n).cast("double").alias("value")) for c in counted]
    checks = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    repeated = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(
        F.lit("duplicate_rows").alias("check"), F.lit("*").alias("column"),
        F.sum("_x").cast("double").alias("value"))
    return checks.unionByName(repeated)


def daily_rollup(pred: DataFrame, day: str, score: str, flag: str, y: str) -> DataFrame:
    """Rows, mean and highest score, alarms and positives per day."""
    return pred.groupBy(day).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
        F.sum(flag).cast("long").alias("alarms"), F.sum(y).cast("long").alias("positives"))


def bucket_counts(df: DataFrame, key: str, domain: int, outcome: str) -> DataFrame:
    """Rows per outcome and bucket 0…domain-1, empty buckets as 0."""
    counts = df.groupBy(outcome, key).agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(outcome).agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias("_m"))
    full = per.select(outcome, "_m", F.explode(F.sequence(F.lit(0), F.lit(domain - 1))).alias(key))
    return full.select(outcome, key, F.coalesce(F.try_element_at("_m", F.col(key)), F.lit(0).cast("long")).alias("n"))


def fit_scaler(train: DataFrame, cols: Sequence[str], kind: str = "minmax") -> DataFrame:
    """One row per column with ``shift`` and ``scale``; constant columns keep scale 1."""
    long = to_long(train, cols)
    if kind == "minmax":
        stats = long.groupBy("column").agg(F.min("value").alias("shift"), (F.max("value") - F.min("value")).alias("_d"))
    else:
        stats = long.groupBy("column").agg(F.avg("value").alias("shift"), F.stddev_pop("value").alias("_d"))
    return stats.select("column", "shift", F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d")).alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], suffix: str = "_sc") -> DataFrame:
    """(x − shift) / scale with the fitted values as scalars."""
    out = df
    for c in cols:
        row = scaler.filter(F.col("column") == c)
        out = out.withColumn(
            f"{c}{suffix}", (F.col(c) - row.select("shift").scalar()) / row.select("scale").scalar()
        )
    return out


def average_scores(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """Mean of the members' scores."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return df.withColumn(out, total / len(cols))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of the first row per key."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def mode_of(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key, the smallest among equals."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(value, F.struct((-F.col("_n")).alias("c"), F.col(value).alias("v"))).alias(out)
    return _group(counts, keys, [best])


def argmax_key(df: DataFrame, key: str, value: Column, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Key with the largest total, the first among equals."""
    sums = df.groupBy(*keys, key).agg(F.sum(value).alias("_v"))
    best = F.min_by(key, F.struct((-F.col("_v")).alias("a"), F.col(key).alias("b"))).alias(out)
    return _group(sums, keys, [best, F.max("_v").cast("long").alias(f"{out}_total")])
