"""Imputation along time and propagation of detector flow along road sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import dealt, exact_quantiles, mix, sample_rank
from ..functions.timeparts import day_chunk, epoch_seconds

EPSILON = 1e-6
BLOCK_DAYS = 7


def flag_missing(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    """1 where any of the columns is null."""
    return df.withColumn(out, F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0)))


def interpolate(
    df: DataFrame, loc: Sequence[str], ts: str, cols: Sequence[str], block: Column | None = None
) -> DataFrame:
    """Fill nulls linearly by row position between neighbours of one location.

    Values are held flat before the first and after the last known one. Inside
    a block of days the neighbours come from windows; across blocks the last and
    first known values of each block are carried over a per-block table.
    """
    loc = list(loc)
    block = day_chunk(ts, BLOCK_DAYS) if block is None else block
    inside = Window.partitionBy(*loc, "_block").orderBy(ts)
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is looking back along the reversed order: frames that end at
    # the current row grow row by row, frames that start there are rebuilt each time
    ahead = Window.partitionBy(*loc, "_block").orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(df.withColumn("_block", block), [*loc, "_block"]).withColumn("_at", F.row_number().over(inside).cast("long"))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).cast("double").alias("v")))

    def moved(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.at") + F.col("_o")).alias("at"), F.col(f"{c}.v").alias("v")))

    # one row per (location, block): its size and its first and last known values
    edges = placed.groupBy(*loc, "_block").agg(
        F.count(F.lit(1)).alias("_size"),
        *[F.max(known(c)).alias(f"_e_{c}") for c in cols], *[F.min(known(c)).alias(f"_b_{c}") for c in cols],
    )
    blocks = Window.partitionBy(*loc).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*loc).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offset = edges.withColumn("_o", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    offset = offset.select(
        *loc, "_block", "_o", *[moved(f"_e_{c}").alias(f"_e_{c}") for c in cols], *[moved(f"_b_{c}").alias(f"_b_{c}") for c in cols]
    )
    carry = offset.select(
        *loc, "_block", "_o",
        *[F.last(f"_e_{c}", ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in cols],
        *[F.last(f"_b_{c}", ignorenulls=True).over(later).alias(f"_n_{c}") for c in cols],
    )
    near = placed.select(
        *df.columns, "_block", "_at",
        *[F.last(known(c), ignorenulls=True).over(back).alias(f"_l_{c}") for c in cols],
        *[F.last(known(c), ignorenulls=True).over(ahead).alias(f"_h_{c}") for c in cols],
    ).join(carry, [*loc, "_block"])
    filled = {}
    for c in cols:
        lo, hi = F.coalesce(moved(f"_l_{c}"), F.col(f"_p_{c}")), F.coalesce(moved(f"_h_{c}"), F.col(f"_n_{c}"))
        here = F.col("_at") + F.col("_o")
        slope = (hi["v"] - lo["v"]) * (here - lo["at"]) / (hi["at"] - lo["at"])
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(lo["v"] + slope)
        )
    return near.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def section_stats(
    det: DataFrame, keys: Sequence[str], ts: str, flow: str, speed: str, n_ts: int | None = None, seed: int = 42
) -> DataFrame:
    """Flow mean, deviation and variation and mean speed: over all instants, or ``n_ts`` sampled ones if given."""
    if n_ts is not None:
        instants = det.select(ts).distinct().withColumn("_k", epoch_seconds(ts))
        instants = instants.withColumn("_h", mix("_k", seed))
        det = det.join(sample_rank(instants, "_h", "_k", F.lit(n_ts)).select(ts), ts, "left_semi")
    out = det.groupBy(*keys).agg(
        F.avg(flow).alias("flow_mean"), F.stddev_samp(flow).alias("flow_std"), F.avg(speed).alias("speed_mean")
    )
    return out.withColumn("flow_cv", F.col("flow_std") / (F.col("flow_mean") + EPSILON))


def calibrate_decay(
    stats: DataFrame, keys: Sequence[str], cv: str = "flow_cv", geometry: Sequence[str] = (), out: str = "alpha"
) -> DataFrame:
    """Decay per (section, direction) between 0.015 and 0.040 per kilometre.

    Flow variation weighs 0.6, geometry (curvature 0.5, slopes 0.25 each, scaled
    by their maxima) 0.4. Several sensors of a section are averaged.
    """
    q95 = exact_quantiles(stats, [], cv, {"q": 0.95}).scalar()
    # a sensor with a single reading has no variation and sets no decay
    flow_part = F.when(F.col(cv).isNotNull(), F.least(F.col(cv) / (q95 + EPSILON), F.lit(1.0)))
    geo_part = F.lit(0.0)
    for weight, c in zip((0.5, 0.25, 0.25), geometry):
        top = stats.select(F.max(c)).scalar()
        geo_part = geo_part + weight * F.coalesce(F.col(c), F.lit(0)) / (top + EPSILON)
    alpha = F.lit(0.015) + F.lit(0.025) * (0.6 * flow_part + 0.4 * geo_part)
    return stats.groupBy(*keys).agg(F.avg(alpha).alias(out))


def attach_decay(df: DataFrame, alphas: DataFrame, keys: Sequence[str], alpha: str = "alpha") -> DataFrame:
    """Join the calibrated decay; sections without one get 0.025."""
    return df.join(alphas, list(keys), "left").withColumn(alpha, F.coalesce(alpha, F.lit(0.025)))


def propagate_flow(
    df: DataFrame, flow: str, heavy: str, sensor_speed: str, target_speed: str, alpha: str, distance: str
) -> DataFrame:
    """Flow and heavy flow carried from the sensor to a target position.

    Density q / v decays exponentially with distance and is multiplied by the
    speed at the target; the heavy share is kept.
    """
    density = F.col(flow) / (F.col(sensor_speed) + EPSILON)
    total = density * F.exp(-F.col(alpha) * F.col(distance)) * F.col(target_speed)
    share = F.col(heavy) / (F.col(flow) + EPSILON)
    return df.withColumn("flow_prop", total).withColumn("heavy_prop", share * F.col("flow_prop"))


def bound_flow(
    df: DataFrame, flow: str, heavy: str, flow_prop: str = "flow_prop", heavy_prop: str = "heavy_prop", deviation: float = 0.5
) -> DataFrame:
    """Clip carried flows to ± ``deviation`` of the sensor's; light flow is the rest."""
    def clip(value: str, ref: str) -> Column:
        low, high = F.col(ref) * (1 - deviation), F.col(ref) * (1 + deviation)
        return F.least(F.greatest(F.col(value), low), high)

    out = df.withColumn("flow_out", clip(flow_prop, flow)).withColumn("heavy_out", clip(heavy_prop, heavy))
    return out.withColumn("light_out", F.greatest(F.col("flow_out") - F.col("heavy_out"), F.lit(0.0)))


def balance_check(df: DataFrame) -> DataFrame:
    """Whether total = light + heavy on every row."""
    ok = F.col("flow_out") == F.col("light_out") + F.col("heavy_out")
    return df.agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("balanced"), F.count(F.lit(1)).alias("n"))


def lane_count(df: DataFrame, loc: Sequence[str], lanes: str, out: str = "lanes") -> DataFrame:
    """Highest lane number per location, unknown counted as one lane."""
    return df.groupBy(*loc).agg(F.max(F.coalesce(F.col(lanes).cast("int"), F.lit(1))).alias(out))
