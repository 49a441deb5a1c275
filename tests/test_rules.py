"""Worked examples with answers fixed by the rules, on small hand-written frames."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from risklattice.operators import episodes, evaluate, filters, impute, joins, projections, sets, windows
from risklattice.operators.episodes import PrecursorConfig

T0 = datetime(2025, 6, 1, 8, 0)


def series(spark, flags, speeds=None, start=T0, step=5, pk=120):
    speeds = speeds or [100.0] * len(flags)
    rows = [("AP", 0, pk, start + timedelta(minutes=step * i), int(f), v) for i, (f, v) in enumerate(zip(flags, speeds))]
    return spark.createDataFrame(rows, "via string, sen int, pk int, dat timestamp_ntz, y int, v double")


LOC = ["via", "sen", "pk"]


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_gap_bridge(spark):
    flags = [0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]
    out = episodes.close_gaps(series(spark, flags), LOC, "dat", "y", 4)
    assert column(out, "closed", "dat") == [0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0]


def test_gap_bridge_across_blocks(spark):
    """A gap that straddles a block of days is bridged all the same."""
    start = datetime(2025, 6, 4, 23, 45)  # day blocks turn at 2025-06-05 00:00
    flags = [1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    out = episodes.close_gaps(series(spark, flags, start=start), LOC, "dat", "y", 4)
    assert column(out, "closed", "dat") == [1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]


def test_fragments_two_episodes(spark):
    flags = [0] * 30
    for minute in (75, 95, 140):
        flags[minute // 5] = 1
    cells = episodes.close_gaps(series(spark, flags), LOC, "dat", "y", 4)
    out = episodes.episodes(cells, LOC, "dat", "closed", 5).orderBy("start").collect()
    assert [(r.start, r.end) for r in out] == [
        (T0 + timedelta(minutes=75), T0 + timedelta(minutes=95)), (T0 + timedelta(minutes=140),) * 2]
    assert [r.duration_min for r in out] == [25, 5]


@pytest.mark.parametrize("persistence, start", [(2, 14), (1, 9)])
def test_single_dip(spark, persistence, start):
    speeds = [100.0] * 16
    speeds[9] = 50.0
    speeds[14:16] = [50.0, 40.0]
    flags = [0] * 16 + [1]
    cfg = PrecursorConfig(persistence=persistence, lookback_minutes=80)
    starts = episodes.lookback(series(spark, flags, speeds + [20.0]), LOC, "dat", "y", "v", None, cfg)
    assert episodes.speed_drop_onset(starts, cfg).first()["drop"] == start


@pytest.mark.parametrize("adaptive_only, method", [(False, "fallback"), (True, None)])
def test_congested(spark, adaptive_only, method):
    cfg = PrecursorConfig(adaptive_only=adaptive_only)
    frame = series(spark, [0] * 12 + [1], [50.0] * 13)
    cells, events = episodes.tag_precursors(frame, LOC, "dat", "y", "v", None, cfg)
    event = events.first()
    assert event.method == method and event.threshold is None
    tagged = cells.filter("y = 1").count()
    assert tagged == (0 if adaptive_only else 6)
    assert event.lead_min == (None if adaptive_only else 30)


def test_two_close_episodes(spark):
    flags = [0] * 12 + [1] * 2 + [0] * 6 + [1]
    _, events = episodes.tag_precursors(series(spark, flags), LOC, "dat", "y", "v")
    rows = events.orderBy("start").collect()
    assert [r.lookback_available_min for r in rows] == [60, 30]


def test_dup_volume(spark):
    rows = [(1, 0, 50), (1, 1, 10), (2, 0, 5), (2, 0, 9), (2, 0, None)]
    frame = spark.createDataFrame(rows, "k int, y int, q int")
    out = sets.dedup_prefer(frame, ["k"], ["y", "q"], ["q"]).orderBy("k").collect()
    assert [(r.k, r.y, r.q) for r in out] == [(1, 1, 10), (2, 0, 9)]


def stamps(spark, rows):
    return spark.createDataFrame(
        [(0, T0 + timedelta(minutes=m), lo, hi) for m, lo, hi in rows], "sen int, dat timestamp_ntz, pkmin int, pkmax int")


def test_span_growth(spark):
    foot = stamps(spark, [(0, 100, 106), (60, 100, 101), (120, 107, 108)])
    out = episodes.build_incidents(foot, "sen", "dat").collect()
    assert [(r.incident_id, r.pkmin, r.pkmax) for r in out] == [(0, 100, 108)]


def test_time_break(spark):
    out = episodes.build_incidents(stamps(spark, [(0, 100, 100), (125, 100, 100)]), "sen", "dat")
    assert sorted(r.incident_id for r in out.collect()) == [0, 1]


def test_interp_edges(spark):
    frame = series(spark, [0] * 6, [None, None, 10.0, None, 30.0, None])
    assert column(impute.interpolate(frame, LOC, "dat", ["v"]), "v", "dat") == [10, 10, 10, 20, 30, 30]


def test_interp_across_blocks(spark):
    """Neighbours several blocks away are found."""
    frame = series(spark, [0] * 5, [0.0, None, None, None, 40.0], step=10 * 24 * 60)
    assert column(impute.interpolate(frame, LOC, "dat", ["v"]), "v", "dat") == [0, 10, 20, 30, 40]


SCORES = [(0.9, 1), (0.9, 0), (0.5, 1), (0.5, 0), (0.1, 0)]


def test_ties_pr(spark):
    frame = spark.createDataFrame(SCORES, "s double, y int")
    assert evaluate.pr_curve(frame, "y", "s").count() == 3
    assert evaluate.average_precision(frame, "y", "s").first().ap == pytest.approx(0.5)


def test_floor_pick(spark):
    frame = spark.createDataFrame([(0.8, 1), (0.8, 0), (0.6, 1), (0.6, 0), (0.2, 0)], "s double, y int")
    point = evaluate.operating_point(evaluate.pr_curve(frame, "y", "s"), 0.4).first()
    assert point.threshold == pytest.approx(0.6) and point.feasible


def test_unreachable_floor_takes_highest_recall(spark):
    frame = spark.createDataFrame(SCORES, "s double, y int")
    point = evaluate.operating_point(evaluate.pr_curve(frame, "y", "s"), 1.5).first()
    assert point.recall == 1.0 and point.threshold == pytest.approx(0.1) and not point.feasible


def test_tail_days(spark):
    rows = [(T0 + timedelta(days=d, minutes=m),) for d, n in enumerate((10, 10, 3, 2)) for m in range(n)]
    frame = spark.createDataFrame(rows, "dat timestamp_ntz")
    held = filters.split_tail_days(frame, "dat", 0.2).filter("held = 1")
    assert sorted({r.dat.day for r in held.collect()}) == [3, 4]


def test_tail_days_falls_back_to_positions(spark):
    rows = [(T0 + timedelta(days=d, minutes=m),) for d in range(2) for m in range(5)]
    held = filters.split_tail_days(spark.createDataFrame(rows, "dat timestamp_ntz"), "dat", 0.2).filter("held = 1")
    assert held.count() == 2


def test_boundary(spark):
    windows_ = spark.createDataFrame(
        [(datetime(2024, 6, 1), datetime(2024, 7, 1)), (datetime(2025, 5, 1), datetime(2025, 6, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert filters.resolve_boundary(windows_, "a", "b").first().boundary == datetime(2025, 5, 19)
    assert filters.resolve_boundary(windows_, "a", "b", override="2025-05-20 12:00").first().boundary == datetime(2025, 5, 20)


def test_sections_touching(spark):
    sections = spark.createDataFrame([(0, 0.0, 10.0), (1, 10.0, 20.0)], "s int, lo double, hi double")
    points = spark.createDataFrame([(10.0,), (10.5,), (20.5,)], "x double")
    out = joins.locate_section(points, sections, "x", "s", "lo", "hi").orderBy("x").collect()
    assert [r.s for r in out] == [0, 1, None]


def test_empty_side_fails(spark):
    with pytest.raises(ValueError):
        filters.split_by_time(series(spark, [0, 0]), "dat", "2030-01-01", check=True)


def test_lattice_is_half_open_and_long(spark):
    segments = spark.createDataFrame([(1,), (2,)], "pk int")
    out = joins.build_lattice(segments, "2025-01-01", "2025-01-11", 5)
    got = out.agg(F.count("*"), F.min("t"), F.max("t"), F.countDistinct("t")).first()
    assert tuple(got) == (2 * 2880, datetime(2025, 1, 1), datetime(2025, 1, 10, 23, 55), 2880)


def test_first_decimal_guard(spark):
    frame = spark.createDataFrame([(144.3,), (120.7,), (195.0,), (0.6,)], "x double")
    assert [r[0] for r in frame.select(projections.first_decimal("x")).collect()] == [3, 7, 0, 6]


def test_run_weights_by_location(spark):
    frame = series(spark, [1, 0, 1, 0, 1, 0])
    assert column(windows.run_weights(frame, LOC, "dat", "y", 0.4), "weight", "dat") == pytest.approx([0.4, 1, 1, 1, 0.4, 1])


def test_calibration_leaves_out_one(spark):
    frame = spark.createDataFrame([(1.0, 1), (0.95, 1), (0.0, 0)], "s double, y int")
    assert sorted(r.bin for r in evaluate.calibration(frame, "y", "s").collect()) == [0, 9]
    assert evaluate.calibration(frame, "y", "s", closed=True).agg(F.sum("n")).first()[0] == 3


def test_tiers_fall_back(spark):
    frame = spark.createDataFrame([(0.9, 0), (0.8, 1), (0.7, 0), (0.6, 0)], "s double, y int")
    out = {r.tier: r for r in evaluate.tiers(evaluate.pr_curve(frame, "y", "s")).collect()}
    assert not out["strict"].attained and out["strict"].threshold == pytest.approx(0.8)
    assert out["advisory"].attained and out["advisory"].precision == pytest.approx(0.5)


def test_slot_unit_must_be_named(spark):
    from risklattice.operators.projections import slot_to_minute

    df = spark.createDataFrame([(0,), (7,), (11,), (None,)], "m int")
    values = lambda unit: [r.m for r in slot_to_minute(df, "m", unit).collect()]
    assert values("slot") == values("guess") == [0, 35, 55, None] and values("minute") == [0, 5, 10, None]
    with pytest.raises(ValueError):
        slot_to_minute(df, "m", "hour")


def test_risk_map_rates_follow_the_place(spark):
    from risklattice.plans.risk_map import rank_by_history

    rows = [(p, d, f"2024-01-{day:02d} 08:00:00") for p in (1, 2) for d in (0, 1) for day in (1, 8, 15)]
    lattice = spark.createDataFrame(rows, "pos int, dir int, s string").selectExpr("pos", "dir", "cast(s as timestamp_ntz) as t")
    fact = lattice.filter("pos = 1 and dir = 0").withColumn("label", F.lit(1))
    both = rank_by_history(lattice, fact, ["pos", "dir"], "t", "label", "2024-01-15", m=1.0).first()
    post = rank_by_history(lattice, fact, ["pos", "dir"], "t", "label", "2024-01-15", m=1.0, place=["pos"]).first()
    assert (both.n, both.ap) == (4, 1.0) and post.ap == 0.5  # by post alone, both directions tie
