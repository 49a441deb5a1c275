"""From raw measures to the complete segment-interval table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import dealt
from ..operators import impute, joins, projections, sets


def propagate_detectors(
    detector: DataFrame,
    speed: DataFrame,
    sections: DataFrame,
    road: Sequence[str],
    ts: str,
    pos: str,
    x: str,
    section: str,
    lo: str,
    hi: str,
    flow: str = "flow",
    heavy: str = "heavy",
    speed_at: str = "target",
    n_ts: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Detector flow carried to every whole post of its section.

    Speeds come from ``speed`` at the sensor's post and, unless ``speed_at`` is
    ``"sensor"``, at the target post. Where several sensors reach a post the
    largest flow is kept, one row per (road, position, instant).
    """
    keys = [*road, ts]
    det = joins.locate_section(detector, sections, x, section, lo, hi).filter(F.col(section).isNotNull())
    det = joins.attach_sensor_speed(det, speed.withColumnRenamed("speed", "_vs"), keys, x, pos)
    stats = impute.section_stats(det, [section, x, *road], ts, flow, "_vs", n_ts, seed)
    decay = impute.calibrate_decay(stats, [section, *road])
    # at one place and sensor speed the largest flow stays the largest at every post, so the others need not be spread
    det = sets.dedup_prefer(det, [*keys, section, lo, hi, x, "_vs"], [flow], [])
    spread = joins.expand_section(impute.attach_decay(det, decay, [section, *road]), lo, hi, pos)
    spread = spread.withColumn("_dist", F.abs(F.col(pos) - F.col(x)))
    if speed_at == "target":
        spread = spread.join(speed.withColumnRenamed("speed", "_vt"), [*keys, pos], "left")
    else:
        spread = spread.withColumn("_vt", F.col("_vs"))
    moved = impute.propagate_flow(spread, flow, heavy, "_vs", "_vt", "alpha", "_dist")
    bounded = impute.bound_flow(moved, flow, heavy)
    kept = sets.dedup_prefer(bounded, [*keys, pos], ["flow_out"], ["_dist", x])
    return kept.select(*keys, pos, F.col("flow_out").alias(flow), F.col("heavy_out").alias(heavy))


def assemble(
    lattice: DataFrame,
    speed: DataFrame,
    flow: DataFrame,
    log: DataFrame,
    calendar: DataFrame,
    geometry: DataFrame,
    loc: Sequence[str],
    ts: str,
    label_cols: Sequence[str],
    flow_cols: Sequence[str],
) -> DataFrame:
    """Lattice with imputed speed and flow, labels, calendar and geometry.

    One lazy plan: each measure is collapsed to the key before its join, and
    both measures are interpolated in one pass per location.
    """
    keys = [*loc, ts]
    cells = joins.attach_measure(dealt(lattice, keys), speed, keys, [F.avg("speed").alias("speed")])
    cells = joins.attach_measure(cells, flow, keys, [F.max(c).alias(c) for c in flow_cols])
    cells = impute.flag_missing(cells, ["speed"], "speed_imputation")
    cells = impute.flag_missing(cells, flow_cols, "flow_imputation")
    cells = impute.interpolate(cells, loc, ts, ["speed", *flow_cols])
    cells = joins.attach_labels(cells, log, keys, label_cols)
    cells = joins.attach_calendar(cells, calendar, ts, ["special"]).drop("day")
    cells = joins.attach_geometry(cells, geometry, loc)
    return projections.calendar_parts(cells, ts)


def write_cells(cells: DataFrame, path: str, ts: str, loc: Sequence[str]) -> None:
    """Parquet by month; rows of a location lie together and in time order."""
    stamped = cells.withColumn("month", F.date_format(ts, "yyyy-MM"))
    spread = stamped.repartition("month", *loc).sortWithinPartitions("month", *loc, ts)
    spread.write.partitionBy("month").parquet(path)
