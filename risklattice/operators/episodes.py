"""Runs of flags, precursor windows, incidents and alarm episodes.

History of one location is processed in blocks of days with the rows just
outside carried along, so long or crowded locations spread over tasks. Grids
are regular: one row per (location, step).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import over_blocks, running, with_overlap
from ..functions.timeparts import day_chunk, epoch_seconds
from .evaluate import average_precision

BLOCK_DAYS = 7


def _bridged(wide: DataFrame, keys: Sequence[str], ts: str, flag: str, gap: int, out: str) -> DataFrame:
    window = Window.partitionBy(*keys, "_block").orderBy(ts)
    at = F.when(F.col(flag) == 1, F.col("_at"))
    wide = wide.withColumn("_at", F.row_number().over(window))
    if gap <= 0:
        return wide.withColumn(out, F.coalesce(F.col(flag), F.lit(0)).cast("int"))
    wide = wide.withColumn("_p", F.max(at).over(window.rowsBetween(-gap, -1)))
    wide = wide.withColumn("_n", F.min(at).over(window.rowsBetween(1, gap)))
    near = F.coalesce(F.col("_n") - F.col("_p") - 1 <= gap, F.lit(False))
    return wide.withColumn(out, ((F.col(flag) == 1) | near).cast("int")).drop("_p", "_n")


def close_gaps(
    df: DataFrame, keys: Sequence[str], ts: str, flag: str, gap: int, out: str = "closed"
) -> DataFrame:
    """Set ``out`` to 1 on flagged rows and on interior zero runs of at most ``gap`` rows."""
    wide = with_overlap(df, keys, [ts], day_chunk(ts, BLOCK_DAYS), gap, gap)
    done = _bridged(wide, keys, ts, flag, gap, out)
    return done.filter("_own").select(*df.columns, out)


def episodes(
    df: DataFrame, keys: Sequence[str], ts: str, flag: str, step_minutes: int
) -> DataFrame:
    """Maximal runs of 1 per location: start, end and duration (both ends counted)."""
    block = day_chunk(ts, BLOCK_DAYS)

    def edges(w):
        on = F.col(flag) == 1
        return {
            "_first": on & (F.coalesce(F.lag(flag).over(w), F.lit(0)) == 0),
            "_last": on & (F.coalesce(F.lead(flag).over(w), F.lit(0)) == 0),
        }

    marked = over_blocks(df.select(*keys, ts, flag), keys, [ts], block, edges, 1, 1)
    bounds = marked.filter("_first or _last").select(*keys, ts, "_first", "_last")
    return _close_runs(bounds, keys, ts, step_minutes)


def _close_runs(bounds: DataFrame, keys: Sequence[str], ts: str, step_minutes: int) -> DataFrame:
    """Pair each first row with its last row; ``bounds`` holds only those."""
    extra = [c for c in bounds.columns if c not in (*keys, ts, "_first", "_last")]

    def ends(w):
        return {"end": F.when(F.col("_last"), F.col(ts)).otherwise(F.lead(ts).over(w))}

    paired = over_blocks(bounds, keys, [ts], day_chunk(ts, BLOCK_DAYS), ends, 0, 1)
    minutes = (epoch_seconds("end") - epoch_seconds("start")) / 60 + step_minutes
    return (
        paired.filter("_first")
        .withColumnRenamed(ts, "start")
        .select(*keys, "start", "end", minutes.cast("long").alias("duration_min"), *extra)
    )


@dataclass(frozen=True)
class PrecursorConfig:
    """Window placement settings; minutes are converted to steps of the grid."""

    step_minutes: int = 5
    lookback_minutes: int = 60
    tag_minutes: int = 30
    drop_ratio: float = 0.70
    min_speed: float = 60.0
    persistence: int = 2
    min_baseline: int = 4
    merge_gap_minutes: int = 20
    anchor_before: bool = True
    adaptive_only: bool = False
    multi_signal: bool = False
    std_mult: float = 2.0
    grad_drop: float = 20.0
    occupancy_mult: float = 1.5

    @property
    def lookback(self) -> int:
        return max(1, round(self.lookback_minutes / self.step_minutes))

    @property
    def tag(self) -> int:
        return max(1, round(self.tag_minutes / self.step_minutes))

    @property
    def gap(self) -> int:
        return max(0, round(self.merge_gap_minutes / self.step_minutes))


def lookback(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    flag: str,
    speed: str,
    flow: str | None,
    cfg: PrecursorConfig,
) -> DataFrame:
    """One row per episode of the gap-bridged flag with the readings before it.

    ``pre`` lists (t, speed, occupancy) of up to ``cfg.lookback`` rows before the
    start, cut at the end of the previous episode. One shuffle serves bridging,
    run detection and the look-back list.
    """
    occupancy = (
        F.col(flow) / F.greatest(F.col(speed), F.lit(1e-3)) if flow else F.lit(None)
    ).cast("double")
    slim = df.select(*keys, ts, flag, F.col(speed).cast("double").alias("_v"), occupancy.alias("_o"))
    wide = with_overlap(
        slim, keys, [ts], day_chunk(ts, BLOCK_DAYS), cfg.lookback + cfg.gap, cfg.gap + 1
    )
    wide = _bridged(wide, keys, ts, flag, cfg.gap, "_c")
    window = Window.partitionBy(*keys, "_block").orderBy(ts)
    entry = F.struct(F.col(ts).alias("t"), F.col("_v").alias("v"), F.col("_o").alias("o"), F.col("_c").alias("c"))
    on = F.col("_c") == 1
    rows = wide.select(
        *keys,
        ts,
        "_own",
        (on & (F.coalesce(F.lag("_c").over(window), F.lit(0)) == 0)).alias("_first"),
        (on & (F.coalesce(F.lead("_c").over(window), F.lit(0)) == 0)).alias("_last"),
        F.collect_list(entry).over(window.rowsBetween(-cfg.lookback, -1)).alias("_h"),
    ).filter("_own and (_first or _last)")
    used = F.coalesce(
        F.array_max(F.transform("_h", lambda x, i: F.when(x["c"] == 1, i + 1).otherwise(0))), F.lit(0)
    )
    pre = F.slice("_h", used + 1, F.greatest(F.size("_h"), F.lit(1)))
    bounds = rows.select(*keys, ts, "_first", "_last", F.when(F.col("_first"), pre).alias("pre"))
    return _close_runs(bounds, keys, ts, cfg.step_minutes)


def _first_where(size: Column, test) -> Column:
    hits = F.filter(
        F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.coalesce(test(i), F.lit(False)),
    )
    return F.get(hits, F.lit(0))


def _mean_of(items: Column, field: str) -> Column:
    values = F.filter(F.transform(items, lambda x: x[field]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def speed_drop_onset(starts: DataFrame, cfg: PrecursorConfig) -> DataFrame:
    """Baseline of the earlier half of ``pre`` and the first sustained drop below it.

    Adds ``baseline``, ``threshold`` (null at congested baselines) and ``drop``,
    the index in ``pre`` of the first of ``cfg.persistence`` low readings.
    """
    n = F.size("pre")
    head = F.greatest(F.lit(1), F.floor(n / 2).cast("int"))
    total = F.aggregate(F.slice("pre", 1, head), F.lit(0.0), lambda a, x: a + x["v"])
    out = starts.withColumn("baseline", F.when(n >= cfg.min_baseline, total / head))
    out = out.withColumn(
        "threshold", F.when(F.col("baseline") > cfg.min_speed, F.col("baseline") * cfg.drop_ratio)
    )

    def sustained(i: Column) -> Column:
        span = F.slice("pre", i + 1, F.lit(cfg.persistence))
        return F.forall(span, lambda x: F.coalesce(x["v"] < F.col("threshold"), F.lit(False)))

    return out.withColumn("drop", _first_where(n - (cfg.persistence - 1), sustained))


def multi_signal_onset(starts: DataFrame, cfg: PrecursorConfig) -> DataFrame:
    """Move ``drop`` to the earliest of: sustained drop, variability spike, one-step
    deceleration, occupancy spike. Short look-backs keep the drop as it is."""
    n = F.size("pre")
    head = F.greatest(F.lit(2), F.floor(n / 2).cast("int"))
    v = lambda i: F.get("pre", i)["v"]
    spread = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("cast(array() as array<int>)")),
        lambda i: F.struct((F.abs(v(i) - v(i - 1)) / F.sqrt(F.lit(2.0))).alias("s")),
    )
    out = starts.withColumn("_spread", spread)
    out = out.withColumn("_sb", _mean_of(F.slice("_spread", F.lit(1), head - 1), "s"))
    out = out.withColumn("_ob", _mean_of(F.slice("pre", F.lit(1), head), "o"))
    spike = _first_where(
        n, lambda i: (i > 0) & (F.col("_sb") > 0)
        & (F.get("_spread", i - 1)["s"] > cfg.std_mult * F.greatest(F.col("_sb"), F.lit(1.0)))
    )
    brake = _first_where(n, lambda i: (i > 0) & (v(i) - v(i - 1) <= -abs(cfg.grad_drop)))
    dense = _first_where(
        n, lambda i: (F.col("_ob") > 0) & (F.get("pre", i)["o"] > cfg.occupancy_mult * F.col("_ob"))
    )
    earliest = F.least(F.col("drop"), spike, brake, dense)
    enough = n >= max(4, cfg.min_baseline)
    return out.withColumn("drop", F.when(enough, earliest).otherwise(F.col("drop"))).drop(
        "_spread", "_sb", "_ob"
    )


def place_window(starts: DataFrame, cfg: PrecursorConfig) -> DataFrame:
    """Window [w_start, w_end) as indices in ``pre``, its method and lead minutes."""
    n = F.size("pre")
    found = F.col("drop").isNotNull()
    fallback = F.lit(not cfg.adaptive_only) & (n > 0)
    if cfg.anchor_before:
        begin, finish = F.greatest(F.lit(0), F.col("drop") - cfg.tag), F.col("drop")
    else:
        begin, finish = F.col("drop"), F.least(F.col("drop") + cfg.tag, n)
    out = starts.withColumn(
        "w_start",
        F.when(found, begin).when(fallback, F.greatest(F.lit(0), n - cfg.tag)).otherwise(0),
    )
    out = out.withColumn("w_end", F.when(found, finish).when(fallback, n).otherwise(0))
    out = out.withColumn("method", F.when(found, "adaptive").when(fallback, "fallback"))
    steps = F.when(F.col("method") == "fallback", F.col("w_end") - F.col("w_start")).otherwise(
        n - F.col("w_start")
    )
    return out.withColumn(
        "lead_min", F.when(F.col("w_end") > F.col("w_start"), (steps * cfg.step_minutes).cast("long"))
    )


def tag_precursors(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    flag: str,
    speed: str,
    flow: str | None = None,
    cfg: PrecursorConfig | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Relabel cells from "in progress" to "shortly before", and list the episodes.

    Returns (cells, events). Cells gain ``orig_<flag>``, ``method``, ``lead_min``
    and ``anchor``; windows never reach into another episode, so no cell is
    claimed twice.
    """
    cfg = cfg or PrecursorConfig()
    starts = speed_drop_onset(lookback(df, keys, ts, flag, speed, flow, cfg), cfg)
    if cfg.multi_signal:
        starts = multi_signal_onset(starts, cfg)
    placed = place_window(starts, cfg)
    events = placed.select(
        *keys, "start", "end", "duration_min", "baseline", "threshold", "method", "lead_min",
        (F.size("pre") * cfg.step_minutes).cast("long").alias("lookback_available_min"),
    )
    span = F.slice("pre", F.col("w_start") + 1, F.greatest(F.col("w_end") - F.col("w_start"), F.lit(0)))
    tagged = placed.select(
        *keys, F.explode(F.transform(span, lambda x: x["t"])).alias(ts), "method", "lead_min",
        F.col("start").alias("anchor"),
    )
    cells = (
        df.withColumnRenamed(flag, f"orig_{flag}")
        .join(tagged, [*keys, ts], "left")
        .withColumn(flag, F.col("anchor").isNotNull().cast("int"))
    )
    return cells, events


def footprints(stamps: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Lowest and highest position stamped per (direction, instant)."""
    return stamps.groupBy(*keys).agg(F.min(pos).alias("pkmin"), F.max(pos).alias("pkmax"))


def build_incidents(
    foot: DataFrame, direction: str, ts: str, hours: int = 2, tolerance: int = 2
) -> DataFrame:
    """Merge successive footprints of a direction into numbered incidents.

    A footprint joins the current incident when at most ``hours`` after its last
    one and within ``tolerance`` of the span accumulated so far. Long silences
    split the direction into independent sessions first, and footprints away from
    everything their session has touched split these again; a part holds at most
    one footprint per instant, so its size is set by the calendar, not by the
    number of stamps, and is folded in place.
    """
    block = day_chunk(ts, 30)
    limit = hours * 3600

    def silence(w):
        before = epoch_seconds(F.lag(ts).over(w))
        return {"_new": F.coalesce((epoch_seconds(ts) - before > limit).cast("int"), F.lit(1))}

    split = over_blocks(foot, [direction], [ts], block, silence, 1, 0)
    numbered = running(split, [direction], [ts], block, {"_session": F.col("_new")})
    # A footprint off all that its session has touched so far starts an incident whatever the fold would say.
    session = Window.partitionBy(direction, "_session").orderBy(ts)
    so_far = session.rowsBetween(Window.unboundedPreceding, -1)
    off = (F.col("pkmax") < F.min("pkmin").over(so_far) - tolerance) | (F.col("pkmin") > F.max("pkmax").over(so_far) + tolerance)
    numbered = numbered.withColumn("_off", F.coalesce(off.cast("int"), F.lit(0)))
    numbered = numbered.withColumn("_part", F.sum("_off").over(session.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(F.col(ts).alias("t"), F.col("pkmin").alias("lo"), F.col("pkmax").alias("hi"))
    sessions = numbered.groupBy(direction, "_session", "_part").agg(F.sort_array(F.collect_list(item)).alias("_f"))
    span = "struct<tmin:timestamp_ntz,tmax:timestamp_ntz,lo:bigint,hi:bigint>"
    empty = F.expr(
        f"struct(cast(array() as array<{span}>) as done, cast(null as {span}) as cur)"
    )

    def fold(acc: Column, x: Column) -> Column:
        cur = acc["cur"]
        same = (
            cur.isNotNull()
            & (x["hi"] >= cur["lo"] - tolerance)
            & (x["lo"] <= cur["hi"] + tolerance)
        )
        grown = F.struct(
            cur["tmin"].alias("tmin"), x["t"].alias("tmax"),
            F.least(cur["lo"], x["lo"]).cast("long").alias("lo"),
            F.greatest(cur["hi"], x["hi"]).cast("long").alias("hi"),
        )
        fresh = F.struct(
            x["t"].alias("tmin"), x["t"].alias("tmax"),
            x["lo"].cast("long").alias("lo"), x["hi"].cast("long").alias("hi"),
        )
        done = F.when(same | cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur)))
        return F.struct(done.alias("done"), F.when(same, grown).otherwise(fresh).alias("cur"))

    folded = sessions.select(
        direction, F.explode(F.aggregate("_f", empty, fold, lambda a: F.concat(a["done"], F.array(a["cur"])))).alias("i")
    ).select(direction, "i.tmin", "i.tmax", F.col("i.lo").alias("pkmin"), F.col("i.hi").alias("pkmax"))
    ranked = running(folded, [direction], ["tmin"], day_chunk("tmin", 30), {"_k": F.lit(1)})
    sizes = folded.groupBy(direction).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(direction, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    return ranked.join(sizes, direction).select(
        (F.col("_o") + F.col("_k") - 1).alias("incident_id"), direction, "tmin", "tmax", "pkmin", "pkmax"
    )


def alarm_episodes(
    pred: DataFrame,
    keys: Sequence[str],
    ts: str,
    score: str,
    threshold: float,
    step_minutes: int,
    gap: int = 1,
    hit: str = "incident_id",
) -> DataFrame:
    """Flagged cells per segment joined while at most ``gap`` steps are missing."""
    block = day_chunk(ts, BLOCK_DAYS)
    flagged = pred.filter(F.col(score) >= threshold).select(*keys, ts, hit)
    limit = step_minutes * 60 * (gap + 1)

    def breaks(w):
        before = epoch_seconds(F.lag(ts).over(w))
        return {"_new": F.coalesce((epoch_seconds(ts) - before > limit).cast("int"), F.lit(1))}

    marked = over_blocks(flagged, keys, [ts], block, breaks, 1, 0)
    runs = running(marked, keys, [ts], block, {"episode": F.col("_new")})
    return runs.groupBy(*keys, "episode").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col(hit).isNotNull()).alias("hit"),
    )


def event_scorecard(
    pred: DataFrame,
    incidents: DataFrame,
    tiers: dict[str, float],
    keys: Sequence[str],
    ts: str,
    y: str,
    score: str,
    step_minutes: int,
    gap: int = 1,
) -> DataFrame:
    """One row per tier: interval, incident and episode level counts and rates.

    ``pred`` carries ``incident_id`` and ``mins_from_onset``. Per incident only
    the best score, and the best one before onset, decide whether it is caught.
    """
    p, pos = F.col(score), F.col(y) == 1
    totals = pred.agg(
        F.count(F.when(pos, 1)).alias("_pos"),
        *[F.count(F.when(pos & (p >= t), 1)).alias(f"_tp_{k}") for k, t in tiers.items()],
        *[F.count(F.when(~pos & (p >= t), 1)).alias(f"_fp_{k}") for k, t in tiers.items()],
    )
    best = (
        pred.filter(pos & F.col("incident_id").isNotNull())
        .groupBy("incident_id")
        .agg(F.max(p).alias("_any"), F.max(F.when(F.col("mins_from_onset") < 0, p)).alias("_pre"))
    )
    caught = best.agg(
        *[F.count(F.when(F.col("_any") >= t, 1)).alias(f"_any_{k}") for k, t in tiers.items()],
        *[F.count(F.when(F.col("_pre") >= t, 1)).alias(f"_pre_{k}") for k, t in tiers.items()],
    )
    found = incidents.agg(F.count(F.lit(1)).alias("c")).scalar()
    out = None
    for name, threshold in tiers.items():
        runs = alarm_episodes(pred, keys, ts, score, threshold, step_minutes, gap).agg(
            F.struct(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("hit"), 1)).alias("h")).alias("s")
        )
        tp, fp = F.col(f"_tp_{name}"), F.col(f"_fp_{name}")
        row = totals.select(
            F.lit(name).alias("tier"), F.lit(threshold).alias("threshold"), "_pos",
            tp.alias("_tp"), fp.alias("_fp"), found.alias("incidents"),
            caught.select(F.struct(F.col(f"_any_{name}").alias("a"), F.col(f"_pre_{name}").alias("b"))).scalar().alias("_c"),
            runs.scalar().alias("_e"),
        )
        out = row if out is None else out.unionByName(row)
    one = F.lit(1)

    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b, one)

    return out.select(
        "tier", "threshold",
        share(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("interval_precision"),
        share(F.col("_tp"), F.col("_pos")).alias("interval_recall"),
        "incidents",
        F.col("_c.a").alias("incidents_caught"),
        share(F.col("_c.a"), F.col("incidents")).alias("incident_recall"),
        F.col("_c.b").alias("incidents_caught_before_onset"),
        share(F.col("_c.b"), F.col("incidents")).alias("incident_recall_pre_onset"),
        F.col("_e.n").alias("episodes"),
        F.col("_e.h").alias("episodes_on_an_incident"),
        share(F.col("_e.h"), F.col("_e.n")).alias("episode_precision"),
        share(F.col("_e.n") - F.col("_e.h"), F.col("incidents")).alias("false_episodes_per_incident"),
    )


def pre_onset_ap(pred: DataFrame, y: str, score: str) -> DataFrame:
    """Average precision when only cells before the onset count as positive.

    Positives at or after the onset are left out altogether.
    """
    late = (F.col(y) == 1) & F.coalesce(F.col("mins_from_onset") >= 0, F.lit(False))
    early = (F.col(y) == 1) & F.coalesce(F.col("mins_from_onset") < 0, F.lit(False))
    kept = pred.filter(~late).select(early.cast("int").alias("y"), F.col(score).alias("score"))
    return average_precision(kept, "y", "score")
