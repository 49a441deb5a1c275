"""Lag, rolling, neighbour and calendar features, and the whole feature build.

Frames are positional per location. All bounded frames of one build share a
single pass over (location, block of days) with a few carried rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.ordered import dealt, exact_quantiles, over_blocks, over_tiles, running
from ..functions.timeparts import POSTS_PER_BAND, band, day_chunk, epoch_seconds

BLOCK_DAYS = 7
EPS = 1e-3

# Hot posts, rush hours and peak hours of the study corridor.
HOT_POSTS = (124, 125, 126, 149, 150)
EVENING_RUSH = (17, 18)
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
LAG_STEPS = (1, 2, 4)
ROLL_WINDOWS = (2, 4)


# Expressions over the ordered window of one location.

def lag_exprs(w: WindowSpec, c: str, steps: Sequence[int], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_lag{k}": F.lag(c, k).over(w) for k in steps}


def std_expr(w: WindowSpec, c: str, n: int) -> Column:
    """Sample deviation of the last ``n`` rows; null below two values."""
    return F.stddev_samp(c).over(w.rowsBetween(-(n - 1), 0))


def mean_expr(w: WindowSpec, c: str, n: int) -> Column:
    return F.avg(c).over(w.rowsBetween(-(n - 1), 0))


def _floor_abs(c: str | Column, eps: float = EPS) -> Column:
    return F.greatest(F.abs(F.col(c) if isinstance(c, str) else c), F.lit(eps))


def _per_location(df: DataFrame, loc: Sequence[str], ts: str, exprs, before: int, uses: Sequence[str]) -> DataFrame:
    return over_blocks(df, loc, [ts], day_chunk(ts, BLOCK_DAYS), exprs, before, uses=uses)


# Single operators.

def lags(df: DataFrame, loc: Sequence[str], ts: str, c: str, steps: Sequence[int] = LAG_STEPS, prefix: str = "") -> DataFrame:
    """Value 1, 2 and 4 rows earlier."""
    return _per_location(df, loc, ts, lambda w: lag_exprs(w, c, steps, prefix or c), max(steps), [c])


def deltas(df: DataFrame, loc: Sequence[str], ts: str, c: str, step_minutes: int = 5) -> DataFrame:
    """Change over one and two rows, and the first per minute."""
    def exprs(w):
        one = F.col(c) - F.lag(c, 1).over(w)
        return {"delta_1": one, "delta_2": F.col(c) - F.lag(c, 2).over(w), "accel": one / max(step_minutes, 1)}

    return _per_location(df, loc, ts, exprs, 2, [c])


def rolling_std(df: DataFrame, loc: Sequence[str], ts: str, c: str, windows: Sequence[int] = ROLL_WINDOWS) -> DataFrame:
    """Sample deviation of the last ``n`` rows for each window."""
    return _per_location(df, loc, ts, lambda w: {f"{c}_std_{n}": std_expr(w, c, n) for n in windows}, max(windows) - 1, [c])


def rolling_mean(df: DataFrame, loc: Sequence[str], ts: str, c: str, windows: Sequence[int] = (4,)) -> DataFrame:
    """Mean of the last ``n`` rows for each window."""
    return _per_location(df, loc, ts, lambda w: {f"{c}_mean_{n}": mean_expr(w, c, n) for n in windows}, max(windows) - 1, [c])


def rolling_cv(df: DataFrame, loc: Sequence[str], ts: str, c: str, n: int = 2) -> DataFrame:
    """Rolling deviation over the guarded magnitude of the value."""
    return _per_location(df, loc, ts, lambda w: {f"{c}_cv_{n}": std_expr(w, c, n) / _floor_abs(c)}, n - 1, [c])


def spatial_gradient(df: DataFrame, keys: Sequence[str], pos: str, channels: dict[str, str], down: Sequence[str] = ()) -> DataFrame:
    """Difference to the previous present post, and for ``down`` to the next one.

    ``channels`` maps a column to its output prefix; ``keys`` are instant, road
    and direction. Long networks are cut into bands of posts.
    """
    def exprs(w):
        out = {}
        for c, prefix in channels.items():
            out[f"{prefix}_grad_up"] = F.col(c) - F.lag(c).over(w)
            if c in down:
                out[f"{prefix}_grad_dn"] = F.lead(c).over(w) - F.col(c)
        return out

    return over_blocks(df, keys, [pos], band(pos, POSTS_PER_BAND), exprs, 1, 1 if down else 0, list(channels))


def zscore(df: DataFrame, base: DataFrame, keys: Sequence[str], c: str, prefix: str, low: float = -1.5) -> DataFrame:
    """Standardised departure from the baseline and a flag for low values.

    A missing or tiny deviation counts as 0.001.
    """
    joined = df.join(base.select(*keys, F.col(f"{c}_mean").alias("_mu"), F.col(f"{c}_std").alias("_sd")), list(keys), "left")
    z = (F.col(c) - F.col("_mu")) / F.greatest(F.coalesce("_sd", F.lit(EPS)), F.lit(EPS))
    out = joined.withColumn(f"{prefix}_zscore", z)
    flag = F.coalesce((F.col(f"{prefix}_zscore") < low).cast("int"), F.lit(0))
    return out.withColumn(f"{prefix}_pct_below_normal", flag).drop("_mu", "_sd")


def regime_expr(speed: str, free: Column) -> Column:
    v = F.col(speed)
    return F.when(v > 0.85 * free, 0).when(v > 0.70 * free, 1).otherwise(2).cast("int")


def flow_regime(df: DataFrame, free: DataFrame, pos: Sequence[str], speed: str, level: str = "v_ff") -> DataFrame:
    """0 free, 1 reduced, 2 congested against the free-flow level of the post.

    Posts without a level use the overall median speed.
    """
    median = exact_quantiles(df, [], speed, {"m": 0.5}).scalar()
    joined = df.join(free, list(pos), "left")
    return joined.withColumn("flow_regime", regime_expr(speed, F.coalesce(F.col(level), median))).drop(level)


def occupancy(df: DataFrame, flow: str, speed: str, out: str = "occ_proxy") -> DataFrame:
    """Flow over guarded speed."""
    return df.withColumn(out, F.col(flow) / _floor_abs(speed))


def long_lag(df: DataFrame, loc: Sequence[str], ts: str, cols: Sequence[str], minutes: int, suffix: str = "_lagged") -> DataFrame:
    """Values exactly ``minutes`` earlier at the same location; rows without one drop.

    An equi-join on the shifted instant, so holes in the grid do not shift it.
    """
    earlier = df.select(
        *loc, (F.col(ts) + F.make_dt_interval(mins=F.lit(minutes))).alias(ts),
        *[F.col(c).alias(f"{c}{suffix}") for c in cols],
    )
    return df.join(earlier, [*loc, ts]).dropna(subset=[f"{c}{suffix}" for c in cols])


def group_position(df: DataFrame, loc: Sequence[str], ts: str) -> DataFrame:
    """0-based position from the start and from the end of the location, and its size."""
    out = running(df, loc, [ts], day_chunk(ts, BLOCK_DAYS), {"_rn": F.lit(1)}, totals=True)
    return out.select(
        *df.columns, (F.col("_rn") - 1).alias("pos_start"), (F.col("tot__rn") - F.col("_rn")).alias("pos_end"),
        F.col("tot__rn").alias("group_size"),
    )


def history(df: DataFrame, loc: Sequence[str], ts: str, cols: Sequence[str], length: int, out: str = "history") -> DataFrame:
    """The ``length`` rows that end one row before each row, oldest first.

    Rows without a full history are left out. Put a window id among ``loc`` to
    keep histories inside one window.
    """
    def exprs(w):
        return {out: F.collect_list(F.struct(*cols)).over(w.rowsBetween(-length, -1))}

    return _per_location(df, loc, ts, exprs, length, cols).filter(F.size(out) == length)


def run_weights(
    df: DataFrame, loc: Sequence[str], ts: str, y: str, edge: float = 0.4, gap_minutes: int | None = None, out: str = "weight"
) -> DataFrame:
    """Weight 1 at the centre of a run of positives, ``edge`` at its ends, linear between.

    A run ends at a silence above ``gap_minutes``; without it all positives of a
    location form one run. Negatives and single positives weigh 1.
    """
    block = day_chunk(ts, BLOCK_DAYS)

    def breaks(w):
        before = epoch_seconds(F.lag(ts).over(w))
        if gap_minutes is None:
            return {"_new": before.isNull().cast("int")}
        return {"_new": F.coalesce((epoch_seconds(ts) - before > gap_minutes * 60).cast("int"), F.lit(1))}

    positives = df.filter(F.col(y) > 0).select(*loc, ts)
    marked = over_blocks(positives, loc, [ts], block, breaks, 1)
    placed = running(marked, loc, [ts], block, {"_run": F.col("_new"), "_k": F.lit(1)})
    runs = placed.groupBy(*loc, "_run").agg(F.min("_k").alias("_k0"), F.count(F.lit(1)).alias("_n"))
    centre = (F.col("_n") - 1) / 2
    fall = F.abs(F.col("_k") - F.col("_k0") - centre) / centre
    weighed = placed.join(runs, [*loc, "_run"]).select(
        *loc, ts, F.when(F.col("_n") > 1, 1.0 - (1.0 - edge) * fall).otherwise(1.0).alias(out)
    )
    return df.join(weighed, [*loc, ts], "left").withColumn(out, F.coalesce(out, F.lit(1.0)))


def interactions(df: DataFrame, pos: str, hour: str, hot: Sequence[int] = HOT_POSTS, rush: Sequence[int] = EVENING_RUSH) -> DataFrame:
    """Post × hour products and hot-zone flags; cyclic products where those exist."""
    out = df.withColumn("pk_x_hor", F.col(pos).cast("double") * F.col(hour))
    if {"hor_sin", "hor_cos"} <= set(df.columns):
        out = out.withColumn("pk_x_hor_sin", F.col(pos) * F.col("hor_sin"))
        out = out.withColumn("pk_x_hor_cos", F.col(pos) * F.col("hor_cos"))
    zone = F.col(pos).isin(list(hot))
    out = out.withColumn("is_pk_hot_zone", zone.cast("int"))
    return out.withColumn("pk_hot_x_evening_rush", (zone & F.col(hour).isin(list(rush))).cast("int"))


def geometry_interactions(df: DataFrame, curve: str, slopes: Sequence[str], speed: str, delta: str | None = None) -> DataFrame:
    """Curvature and steepest slope times speed, curvature times its change."""
    steep = F.greatest(*[F.abs(F.col(s)) for s in slopes]) if len(slopes) > 1 else F.abs(F.col(slopes[0]))
    out = df.withColumn("curv_x_speed", F.col(curve).cast("double") * F.col(speed))
    out = out.withColumn("pend_x_speed", steep * F.col(speed))
    return out.withColumn("curv_x_delta_speed", F.col(curve).cast("double") * F.col(delta)) if delta else out


def cyclic(df: DataFrame, cycles: dict[str, tuple[str, float]]) -> DataFrame:
    """Sine and cosine of each column over its period; ``{prefix: (column, period)}``."""
    out = df
    for prefix, (c, period) in cycles.items():
        angle = F.lit(2 * math.pi) * F.col(c).cast("double") / F.lit(float(period))
        out = out.withColumn(f"{prefix}_sin", F.sin(angle)).withColumn(f"{prefix}_cos", F.cos(angle))
    return out


def calendar_flags(df: DataFrame, hour: str, weekday: str) -> DataFrame:
    """Peak-hour and weekend flags."""
    return df.withColumn("is_peak_hour", F.col(hour).isin(list(PEAK_HOURS)).cast("int")).withColumn(
        "is_weekend", (F.col(weekday) >= 5).cast("int")
    )


def weather_signals(
    df: DataFrame, precip: str, temp: str, cloud: str, gust: str, wind: str, precip_far: str,
    curve: str | None = None, descent: str | None = None, speed: str | None = None,
) -> DataFrame:
    """Rain, frost, visibility and gust signals and their products with geometry and speed."""
    def flag(c: Column) -> Column:
        return F.coalesce(c.cast("int"), F.lit(0))

    p, t = F.col(precip), F.col(temp)
    out = df.select(
        "*",
        flag(p > 0.1).alias("is_raining"),
        flag(p > 2.5).alias("is_heavy_rain"),
        flag((t >= -2.0) & (t <= 2.0)).alias("temp_near_freezing"),
        flag((F.col(cloud) > 80.0) & (p > 0.1)).alias("low_visibility_proxy"),
        (F.col(gust) - F.col(wind)).alias("wind_gust_excess"),
        (p - F.col(precip_far)).alias("precip_change_1d_vs_3d"),
    )
    if curve:
        out = out.withColumn("wet_curve_risk", F.col("is_raining") * F.abs(F.col(curve)))
        out = out.withColumn("cold_curve_risk", F.col("temp_near_freezing") * F.abs(F.col(curve)))
    if descent:
        out = out.withColumn("wet_descent_risk", F.col("is_raining") * F.abs(F.col(descent)))
    if speed:
        out = out.withColumn("wet_speed", F.col("is_raining") * F.col(speed))
    return out


@dataclass(frozen=True)
class FeatureConfig:
    """Column names of the input and the groups to build."""

    loc: tuple[str, ...] = ("via", "sen", "pk")
    pos: str = "pk"
    ts: str = "dat"
    hour: str = "hor"
    weekday: str = "diaSem"
    month: str = "mes"
    speed: str = "mean_speed"
    volume: str = "intTot"
    heavy: str = "intP"
    label: str = "ACCIDENT"
    special: str | None = "mob_esp"
    curve: str | None = "ang_curv"
    slopes: tuple[str, ...] = ("ang_pend_pos", "ang_pend_neg")
    weather: dict = field(default_factory=dict)
    step_minutes: int = 5
    off: frozenset[str] = frozenset()

    @property
    def baseline_keys(self) -> list[str]:
        return [self.pos, self.hour, self.weekday]


def baseline_columns(df: DataFrame, cfg: FeatureConfig, boundary: str) -> DataFrame:
    """``df`` with the groups zscore, rates and regime: departures from what its post, hour and weekday had before ``boundary``.

    Rows are dealt once, by those keys, and baselines are windows over them, so no table of baselines is joined to wide
    rows. The free-flow level of a post comes along as a row for each of its hours and weekdays. Rows with a null key have
    no baseline, as in a join.
    """
    on = lambda g: g not in cfg.off
    v, q, keys = cfg.speed, cfg.volume, cfg.baseline_keys
    past = F.col(cfg.ts) < F.lit(boundary).cast("timestamp_ntz")
    earlier = df.filter(past)
    rows = df.withColumn("_own", F.lit(True)).withColumn("_ff", F.lit(None).cast("double"))
    if on("regime"):
        free = exact_quantiles(earlier, [cfg.pos], v, {"_ff": 0.85}).filter(F.col(cfg.pos).isNotNull())
        slots = F.broadcast(df.select(cfg.hour, cfg.weekday).distinct())
        rows = rows.unionByName(free.crossJoin(slots), allowMissingColumns=True)

    def of(keys: Sequence[str], agg: Callable[[Column], Column], c: Column) -> Column:
        known = F.lit(True)
        for k in keys:
            known &= F.col(k).isNotNull()
        return F.when(known, agg(F.when(past, c)).over(Window.partitionBy(*keys)))

    def rate(keys: Sequence[str]) -> Column:
        return F.coalesce(F.try_divide(of(keys, F.sum, F.col(cfg.label)), of(keys, F.count, F.lit(1))), F.lit(0.0))

    def departure(c: str) -> Column:
        sd = F.coalesce(of(keys, F.stddev_samp, F.col(c)), F.lit(EPS))
        return (F.col(c) - of(keys, F.avg, F.col(c))) / F.greatest(sd, F.lit(EPS))

    columns = {}
    if on("zscore"):
        columns |= {"speed_zscore": departure(v), "vol_zscore": departure(q)}
    if on("rates"):
        columns["pk_crash_rate"] = rate(keys)
        if cfg.special:
            columns["pk_crash_rate_mob"] = rate([*keys, cfg.special])
    if on("regime"):
        median = exact_quantiles(earlier, [], v, {"m": 0.5}).scalar()
        free = F.max("_ff").over(Window.partitionBy(*keys))
        columns["flow_regime"] = regime_expr(v, F.coalesce(free, median))
    kept = [c for c in df.columns if c not in columns]
    out = dealt(rows, keys).select(*kept, "_own", *[c.alias(name) for name, c in columns.items()])
    return out.filter("_own").drop("_own")


def build_features(df: DataFrame, cfg: FeatureConfig, boundary: str) -> DataFrame:
    """All feature groups; baselines and rates see only rows before ``boundary``.

    Wide rows are dealt twice: by the keys of the baselines, and to tiles of
    instants and posts for every lag, rolling frame and neighbour. Group names in ``cfg.off`` are skipped:
    variability, differences, lags, rates, gradient, zscore, regime, heavy,
    geometry, flags, cyclic, weather.
    """
    on = lambda g: g not in cfg.off
    v, q, h = cfg.speed, cfg.volume, cfg.heavy
    share = (F.col(q) - F.col(h)) / _floor_abs(q)

    def frames(w):
        x = {}
        if on("lags"):
            x |= lag_exprs(w, v, LAG_STEPS, "speed") | lag_exprs(w, q, (1, 2), "vol")
        if on("differences"):
            x["delta_speed_1"] = F.col(v) - F.lag(v, 1).over(w)
            x["delta_speed_2"] = F.col(v) - F.lag(v, 2).over(w)
            x["delta_vol_1"] = F.col(q) - F.lag(q, 1).over(w)
            x["accel_speed"] = x["delta_speed_1"] / max(cfg.step_minutes, 1)
        if on("variability"):
            x |= {f"speed_std_{n}": std_expr(w, v, n) for n in ROLL_WINDOWS}
            x["speed_mean_4"] = mean_expr(w, v, 4)
            x["vol_std_2"] = std_expr(w, q, 2)
            x["speed_cv_2"] = x["speed_std_2"] / _floor_abs(v)
            x["vol_cv_2"] = x["vol_std_2"] / _floor_abs(q)
        if on("heavy"):
            x["hv_fraction"] = share
            x["hv_fraction_lag1"] = F.lag(share, 1).over(w)
        return x

    def neighbours(w):
        if not on("gradient"):
            return {}
        return {
            "speed_grad_up": F.col(v) - F.lag(v).over(w), "speed_grad_dn": F.lead(v).over(w) - F.col(v),
            "vol_grad_up": F.col(q) - F.lag(q).over(w),
        }

    based = baseline_columns(df, cfg, boundary) if any(map(on, ("zscore", "rates", "regime"))) else df
    block, strip = day_chunk(cfg.ts, BLOCK_DAYS), band(cfg.pos, POSTS_PER_BAND)
    uses = list(dict.fromkeys([v, q, h]))
    out = over_tiles(based, cfg.loc, cfg.pos, cfg.ts, block, strip, frames, neighbours, max(LAG_STEPS), uses, df)
    if on("zscore"):
        out = out.withColumn("speed_pct_below_normal", F.coalesce((F.col("speed_zscore") < -1.5).cast("int"), F.lit(0)))
    if on("rates"):
        out = out.withColumn("pk_crash_rate_log", F.log1p("pk_crash_rate"))
    if on("regime"):
        out = occupancy(out, q, v)
    if on("geometry") and cfg.curve:
        out = geometry_interactions(out, cfg.curve, cfg.slopes, v, "delta_speed_1" if on("differences") else None)
    if on("flags"):
        out = out.withColumn("is_peak_hour", F.col(cfg.hour).isin(list(PEAK_HOURS)).cast("int"))
    if on("cyclic"):
        out = cyclic(out, {"hor": (cfg.hour, 24), "diaSem": (cfg.weekday, 7), "mes": (cfg.month, 12)})
    if on("weather") and cfg.weather:
        out = weather_signals(out, **cfg.weather, curve=cfg.curve, descent=cfg.slopes[-1], speed=v)
    return out


def build_covariate_features(
    df: DataFrame, loc: Sequence[str], ts: str, cols: Sequence[str], keys: Sequence[str], weekday: str, boundary: str
) -> DataFrame:
    """Lags, rolling statistics and departures of the weather forecast, calendar shape.

    New columns start with ``cov_``.
    """
    def frames(w):
        x = {}
        for c in cols:
            x |= lag_exprs(w, c, LAG_STEPS, f"cov_{c}")
            x[f"cov_{c}_d1"] = F.col(c) - F.lag(c, 1).over(w)
            for n in (4, 12):
                x[f"cov_{c}_mean_{n}"] = mean_expr(w, c, n)
                x[f"cov_{c}_std_{n}"] = std_expr(w, c, n)
        return x

    out = _per_location(df, loc, ts, frames, 11, cols)
    past = df.filter(F.col(ts) < F.lit(boundary).cast("timestamp_ntz"))
    aggs = [F.avg(c).alias(f"_m_{c}") for c in cols] + [F.stddev_samp(c).alias(f"_s_{c}") for c in cols]
    out = out.join(past.groupBy(*keys).agg(*aggs), list(keys), "left")
    for c in cols:
        sd = F.greatest(F.coalesce(F.col(f"_s_{c}"), F.lit(EPS)), F.lit(EPS))
        out = out.withColumn(f"cov_{c}_zscore", (F.col(c) - F.col(f"_m_{c}")) / sd)
    out = out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])
    angle = F.lit(2 * math.pi) * F.dayofyear(ts) / F.lit(365.25)
    return out.select(
        "*", F.sin(angle).alias("cov_doy_sin"), F.cos(angle).alias("cov_doy_cos"),
        (F.col(weekday) >= 5).cast("int").alias("cov_is_weekend"),
    )
