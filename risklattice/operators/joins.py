"""Lattice construction and the joins that attach measures to it.

No join here carries a broadcast hint: Spark broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold`` and sort-merges beyond it, with
adaptive skew splitting for hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import GRID_ROWS
from ..functions.timeparts import POSTS_PER_BAND, band, epoch_seconds, hour_start, minute_number

STEPS_PER_BLOCK = 1024


def build_lattice(
    segments: DataFrame, start: str, end: str, step_minutes: int, ts: str = "t"
) -> DataFrame:
    """Every segment at every instant of the half-open range [start, end).

    Each segment is first expanded to blocks of instants, which are spread over
    all tasks before they are expanded to single instants: a network of few
    segments with a long record still runs in parallel. Blocks meet their
    instants in a join, as Spark takes an exploded table to be no larger than
    the one before and would broadcast the whole lattice in later joins. The
    instants carry the number of rows, by which ``dealt`` finds its tasks.
    """
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    span = epoch_seconds(last) - epoch_seconds(first)
    steps = F.ceil(span / F.lit(step_minutes * 60)).cast("long")
    blocks = F.ceil(steps / F.lit(STEPS_PER_BLOCK)).cast("long")
    spark = segments.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("_b") * STEPS_PER_BLOCK + F.col("_i")
    instant = first + F.make_dt_interval(mins=(at * step_minutes).cast("int"))
    rows = segments.agg(F.count(F.lit(1)) * F.greatest(F.lit(0), F.first(steps))).first()[0]
    return (
        segments.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .repartition(tasks, *segments.columns, "_b")
        .crossJoin(spark.range(STEPS_PER_BLOCK).withColumnRenamed("id", "_i"))
        .filter(at < steps)
        .select(*segments.columns, instant.alias(ts, metadata={GRID_ROWS: rows or 0}))
    )


def attach_measure(
    lattice: DataFrame, fact: DataFrame, keys: Sequence[str], aggs: Sequence[Column]
) -> DataFrame:
    """Left join of ``fact`` collapsed to one row per key, so no row multiplies."""
    return lattice.join(fact.groupBy(*keys).agg(*aggs), list(keys), "left")


def attach_hourly(
    lattice: DataFrame, hourly: DataFrame, ts: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Attach values that hold for a whole hour to every instant in it."""
    right = hourly.withColumnRenamed(ts, "_hour")
    return lattice.withColumn("_hour", hour_start(ts)).join(right, [*keys, "_hour"], "left").drop("_hour")


def attach_labels(
    lattice: DataFrame, log: DataFrame, keys: Sequence[str], label_cols: Sequence[str]
) -> DataFrame:
    """Left join of a sparse log; its label columns become 0 where absent."""
    return lattice.join(log, list(keys), "left").fillna(0, subset=list(label_cols))


def attach_calendar(df: DataFrame, calendar: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """Attach day-level flags; ordinary days get 0."""
    return (
        df.withColumn("day", F.to_date(ts))
        .join(calendar.select("day", *cols), "day", "left")
        .fillna(0, subset=list(cols))
    )


def attach_geometry(df: DataFrame, geometry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach static attributes by location."""
    return df.join(geometry, list(keys), "left")


def locate_section(
    points: DataFrame, sections: DataFrame, x: str, section: str, lo: str, hi: str
) -> DataFrame:
    """First section (in ``section`` order) whose closed interval holds ``x``.

    Sections are listed under every whole unit they touch; a point looks up its
    own unit, so each point meets only nearby sections and never multiplies.
    Adds ``section``, ``lo`` and ``hi``, null where nothing matches.
    """
    carried = [c for c in sections.columns if c not in (section, lo, hi)]
    unit = F.explode(F.sequence(F.floor(lo).cast("long"), F.floor(hi).cast("long")))
    listed = (
        sections.withColumn("_u", unit)
        .groupBy("_u")
        .agg(F.sort_array(F.collect_list(F.struct(section, lo, hi, *carried))).alias("_s"))
    )
    inside = F.filter("_s", lambda s: (F.col(x) >= s[lo]) & (F.col(x) <= s[hi]))
    return (
        points.withColumn("_u", F.floor(x).cast("long"))
        .join(listed, "_u", "left")
        .withColumn("_hit", F.get(inside, F.lit(0)))
        .select(*points.columns, *[F.col(f"_hit.{c}").alias(c) for c in sections.columns])
    )


def expand_section(df: DataFrame, lo: str, hi: str, pos: str) -> DataFrame:
    """One row per whole unit in [ceil(lo), floor(hi)]; none where that is empty."""
    first, last = F.ceil(lo).cast("long"), F.floor(hi).cast("long")
    return df.filter(first <= last).withColumn(pos, F.explode(F.sequence(first, last)))


def attach_sensor_speed(
    detector: DataFrame, speed: DataFrame, keys: Sequence[str], x: str, pos: str
) -> DataFrame:
    """Attach the speed at the truncated position of each detector reading."""
    right = speed.withColumnRenamed(pos, "_pos")
    left = detector.withColumn("_pos", F.col(x).cast("long"))
    return left.join(right, [*keys, "_pos"], "left").drop("_pos")


def neighbour_context(
    df: DataFrame, channels: Sequence[str], keys: Sequence[str], pos: str
) -> DataFrame:
    """Values at position -1 (``_up``) and +1 (``_dn``) at the same instant and direction.

    The own value stands in where the neighbour is absent; ``_grad_`` columns
    hold the difference to it. Rows must be unique per (keys, position), keys are
    not null and positions whole. One shuffle by keys and band of posts: a row at
    the edge of its band also goes to the next one, so a road of any length is cut.
    """
    home = band(pos, POSTS_PER_BAND)
    reach = F.array_distinct(F.array_compact(F.array(home, band(F.col(pos) - 1, POSTS_PER_BAND), band(F.col(pos) + 1, POSTS_PER_BAND))))
    # a null position has no band and no neighbour, but stays
    dealt = df.withColumn("_home", home).withColumn("_band", F.explode_outer(reach))
    w = Window.partitionBy(*keys, "_band").orderBy(pos)
    near = {"up": (F.lag, -1), "dn": (F.lead, 1)}
    found = {}
    for side, (step, shift) in near.items():
        there = step(pos).over(w) == F.col(pos) + shift
        found |= {f"_{side}_{c}": F.when(there, step(c).over(w)) for c in channels}
    out = dealt.select("*", *[v.alias(k) for k, v in found.items()]).filter(F.col("_band").eqNullSafe(F.col("_home")))
    for side in near:
        for c in channels:
            out = out.withColumn(f"{c}_{side}", F.coalesce(f"_{side}_{c}", c))
            out = out.withColumn(f"{c}_grad_{side}", F.col(f"{c}_{side}") - F.col(c))
    return out.drop("_home", "_band", *found)


def corridor_edges(df: DataFrame, direction: str, ts: str, pos: str, node: str) -> DataFrame:
    """Edges between co-temporal cells at adjacent positions of one direction.

    Both orientations are produced; a cell without any neighbour gets a loop.
    """
    here = df.select(direction, ts, pos, F.col(node).alias("src"))
    there = df.select(direction, ts, (F.col(pos) - 1).alias(pos), F.col(node).alias("dst"))
    forward = here.join(there, [direction, ts, pos]).select("src", "dst")
    linked = forward.select(
        F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    ).select("e.src", "e.dst")
    lonely = here.join(linked.select("src"), "src", "left_anti")
    return linked.unionByName(lonely.select("src", F.col("src").alias("dst")))


def attach_baseline(
    df: DataFrame, base: DataFrame, keys: Sequence[str], defaults: dict[str, Column] | None = None
) -> DataFrame:
    """Left join of a per-key baseline; ``defaults`` fill columns of unseen keys."""
    out = df.join(base, list(keys), "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), value))
    return out


def assign_incident(
    cells: DataFrame,
    incidents: DataFrame,
    direction: str,
    ts: str,
    pos: str,
    key: str,
    tolerance: int = 2,
    lead_minutes: int = 0,
    band_width: int = 16,
    match: Column | None = None,
) -> DataFrame:
    """Lowest incident whose footprint holds a cell, with minutes from its onset.

    Incidents are listed under each (day, position band) they touch; a cell has
    exactly one, so the range condition is checked only against nearby
    incidents. ``lead_minutes`` widens the match before the onset, where the
    minutes are negative. ``match`` names the cells to assign, usually the
    positives. Cells without a match keep nulls; ``key`` is unique.
    """
    start = F.col("tmin") - F.make_dt_interval(mins=F.lit(lead_minutes))
    low, high = F.col("pkmin") - tolerance, F.col("pkmax") + tolerance
    days = F.sequence(F.to_date(start), F.to_date("tmax"))
    bands = F.sequence(F.floor(low / band_width).cast("long"), F.floor(high / band_width).cast("long"))
    listed = (
        incidents.select(
            F.col(direction), "incident_id", "tmin", "tmax", start.alias("_from"),
            low.alias("_low"), high.alias("_high"), F.explode(days).alias("_day"), bands.alias("_bands"),
        )
        .withColumn("_band", F.explode("_bands"))
        .drop("_bands")
    )
    placed = (cells if match is None else cells.filter(match)).select(
        key, direction, ts, pos, F.to_date(ts).alias("_day"),
        F.floor(F.col(pos) / band_width).cast("long").alias("_band"),
    )
    inside = (
        (F.col(pos) >= F.col("_low")) & (F.col(pos) <= F.col("_high"))
        & (F.col(ts) >= F.col("_from")) & (F.col(ts) <= F.col("tmax"))
    )
    minutes = minute_number(ts) - minute_number("tmin")
    chosen = (
        placed.join(listed, [direction, "_day", "_band"])
        .filter(inside)
        .groupBy(key)
        .agg(F.min(F.struct("incident_id", minutes.alias("mins_from_onset"))).alias("_m"))
        .select(key, "_m.incident_id", "_m.mins_from_onset")
    )
    return cells.join(chosen, key, "left")


def attach_features(pred: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring features back to scored cells on the full key."""
    return pred.join(features, list(keys), "left")


def merge_stages(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Screener and supervisor scores of the same cells; unscored supervisor → null."""
    return first.join(second, list(keys), "left")


def reconcile_codes(
    a: DataFrame, b: DataFrame, code_a: str, code_b: str, attr_a: str, attr_b: str, tolerance: float
) -> DataFrame:
    """For each code of ``a`` the first code of ``b`` whose attribute is within ``tolerance``.

    Attributes are cut into tolerance-wide bins; only equal or adjacent bins meet.
    """
    left = a.select(code_a, attr_a).withColumn(
        "_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                      lambda k: F.floor(F.col(attr_a) / tolerance).cast("long") + k))
    )
    right = b.select(
        F.col(code_b).alias("_code"), F.col(attr_b).alias("_attr"),
        F.floor(F.col(attr_b) / tolerance).cast("long").alias("_bin"),
    )
    near = left.join(right, "_bin").filter(F.abs(F.col(attr_a) - F.col("_attr")) < tolerance)
    return near.groupBy(code_a).agg(F.min("_code").alias(code_b))


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts: rows and distinct keys on either side and in common."""
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    right = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return left.join(right, list(keys), "full_outer").agg(
        total(F.col("_a")).alias("rows_a"),
        total(F.col("_b")).alias("rows_b"),
        F.count("_a").alias("keys_a"),
        F.count("_b").alias("keys_b"),
        F.count(F.when(both, 1)).alias("keys_both"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("keys_only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("keys_only_b"),
        total(F.when(both, F.col("_a"))).alias("rows_a_matched"),
        total(F.when(both, F.col("_b"))).alias("rows_b_matched"),
    )
