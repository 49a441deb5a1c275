"""Queries of episodes, precursor windows, incidents and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeparts import hour_start
from ..operators import episodes as EP
from ..operators import joins as J
from ..session import materialise
from . import views as V
from .aggregates import rounded
from .joins import INCIDENTS_SQL, ROAD, incidents
from .oracle import CTES, sql
from .registry import query
from .views import LOC

CFG = EP.PrecursorConfig(
    step_minutes=60, lookback_minutes=360, tag_minutes=180, min_speed=30.0, merge_gap_minutes=60)

CTES["closed"] = (("traffic",), """
    select *, case when label = 1 or n1 - p1 - 1 <= 1 then 1 else 0 end as c from (
      select *, max(case when label = 1 then i end) over (partition by dir, pos order by i rows between unbounded preceding and 1 preceding) as p1,
             min(case when label = 1 then i end) over (partition by dir, pos order by i rows between 1 following and unbounded following) as n1
      from (select dir, pos, t, label, v, flow, flow / greatest(v, 0.001) as occ,
                   row_number() over (partition by dir, pos order by t) as i from traffic))""")
CTES["runs"] = (("closed",), """
    select s.*, (select min(e.i) from ends e where e.dir = s.dir and e.pos = s.pos and e.i >= s.i) as ei
    from (select * from marks where c = 1 and coalesce(pc, 0) = 0) s""")
CTES["marks"] = (("closed",), """
    select *, lag(c) over (partition by dir, pos order by i) as pc, lead(c) over (partition by dir, pos order by i) as nc,
           max(case when c = 1 then i end) over (partition by dir, pos order by i rows between unbounded preceding and 1 preceding) as prev_end from closed""")
CTES["ends"] = (("marks",), "select dir, pos, i, t from marks where c = 1 and coalesce(nc, 0) = 0")
CTES["runs"] = (("marks", "ends"), """
    select s.dir, s.pos, s.i, s.t as start, s.prev_end, min(e.i) as ei, min(e.t) as "end"
    from marks s join ends e on e.dir = s.dir and e.pos = s.pos and e.i >= s.i
    where s.c = 1 and coalesce(s.pc, 0) = 0 group by all""")
CTES["pre"] = (("runs", "closed"), """
    select r.dir, r.pos, r.i as s, p.t, p.v, p.occ, row_number() over w - 1 as k, count(*) over (partition by r.dir, r.pos, r.i) as n,
           abs(p.v - lag(p.v) over w) / sqrt(2) as sd, p.v - lag(p.v) over w as dv
    from runs r join closed p on p.dir = r.dir and p.pos = r.pos and p.i between greatest(r.i - 6, coalesce(r.prev_end, 0) + 1) and r.i - 1
    window w as (partition by r.dir, r.pos, r.i order by p.i)""")
CTES["levels"] = (("pre",), """
    select *, case when baseline > 30 then baseline * 0.7 end as threshold from (
      select dir, pos, s, max(n) as n, case when max(n) >= 4 then avg(v) filter (k < greatest(1, n // 2)) end as baseline,
             avg(sd) filter (k < greatest(2, n // 2)) as sb, avg(occ) filter (k < greatest(2, n // 2)) as ob from pre group by dir, pos, s)""")
CTES["drops"] = (("pre", "levels"), """
    select dir, pos, s, min(k) filter (below and coalesce(nb, false)) as dropped,
           least(min(k) filter (below and coalesce(nb, false)), min(k) filter (n >= 4 and sb > 0 and sd > 2 * greatest(sb, 1)),
                 min(k) filter (n >= 4 and dv <= -20), min(k) filter (n >= 4 and ob > 0 and occ > 1.5 * ob)) as multi
    from (select p.*, l.sb, l.ob, coalesce(p.v < l.threshold, false) as below, lead(coalesce(p.v < l.threshold, false)) over (partition by p.dir, p.pos, p.s order by k) as nb
          from pre p join levels l on p.dir = l.dir and p.pos = l.pos and p.s = l.s) group by dir, pos, s""")
CTES["windows"] = (("runs", "levels", "drops"), """
    select r.*, coalesce(l.n, 0) as n, baseline, threshold, dropped, multi,
           case when dropped is not null then 'adaptive' when coalesce(l.n, 0) > 0 then 'fallback' end as method,
           case when dropped is not null then greatest(0, dropped - 3) when l.n > 0 then greatest(0, l.n - 3) else 0 end as ws,
           case when dropped is not null then dropped when l.n > 0 then l.n else 0 end as we
    from runs r left join levels l on r.dir = l.dir and r.pos = l.pos and r.i = l.s
         left join drops x on r.dir = x.dir and r.pos = x.pos and r.i = x.s""")


def grid(spark, d):
    return V.traffic(spark, d).select("pos", "dir", "t", "label", "v", "flow")


def starts(spark, d):
    return EP.lookback(grid(spark, d), LOC, "t", "label", "v", "flow", CFG)


@query("l01_close_gaps", sql("closed", "select pos, dir, t, label, c as closed from closed"))
def l01(spark, d):
    return EP.close_gaps(grid(spark, d).select("pos", "dir", "t", "label"), LOC, "t", "label", 1)


@query("l02_episodes", sql("fact", """
    , m as (select dir, pos, t, label, row_number() over w as i, lag(label, 1, 0) over w as pl, lead(label, 1, 0) over w as nl from fact window w as (partition by dir, pos order by t)),
    s as (select dir, pos, t, row_number() over (partition by dir, pos order by t) as k from m where label = 1 and pl = 0),
    e as (select dir, pos, t, row_number() over (partition by dir, pos order by t) as k from m where label = 1 and nl = 0)
    select s.dir, s.pos, s.t as start, e.t as "end", date_diff('minute', s.t, e.t) + 60 as duration_min from s join e using (dir, pos, k)"""))
def l02(spark, d):
    return EP.episodes(V.fact(spark, d), LOC, "t", "label", 60)


@query("l03_lookback", sql("windows pre", """
    select w.dir, w.pos, w.start, w."end", date_diff('minute', w.start, w."end") + 60 as duration_min, w.n as available,
           round(coalesce(p.v, 0), 6) as v_sum, p.t as first_t from windows w
    left join (select dir, pos, s, sum(v) as v, min(t) as t from pre group by all) p on p.dir = w.dir and p.pos = w.pos and p.s = w.i"""))
def l03(spark, d):
    out = starts(spark, d)
    return out.select(
        "dir", "pos", "start", "end", "duration_min", F.size("pre").cast("long").alias("available"),
        F.round(F.aggregate("pre", F.lit(0.0), lambda a, x: a + x["v"]), 6).alias("v_sum"),
        F.get("pre", F.lit(0))["t"].alias("first_t"))


@query("l04_speed_drop_onset", sql("windows", """
    select dir, pos, start, round(baseline, 6) as baseline, round(threshold, 6) as threshold, cast(dropped as integer) as "drop" from windows"""))
def l04(spark, d):
    out = EP.speed_drop_onset(starts(spark, d), CFG).select("dir", "pos", "start", "baseline", "threshold", "drop")
    return rounded(out, "baseline", "threshold")


@query("l05_multi_signal_onset", sql("windows", """
    select dir, pos, start, cast(coalesce(case when n >= 4 then multi end, dropped) as integer) as "drop" from windows"""))
def l05(spark, d):
    out = EP.multi_signal_onset(EP.speed_drop_onset(starts(spark, d), CFG), CFG)
    return out.select("dir", "pos", "start", "drop")


@query("l06_place_window", sql("windows", """
    select dir, pos, start, cast(ws as integer) as w_start, cast(we as integer) as w_end, method,
           case when we > ws then (case when method = 'fallback' then we - ws else n - ws end) * 60 end as lead_min from windows"""))
def l06(spark, d):
    out = EP.place_window(EP.speed_drop_onset(starts(spark, d), CFG), CFG)
    return out.select("dir", "pos", "start", "w_start", "w_end", "method", "lead_min")


@query("l07_tag_precursors", sql("windows pre traffic", """
    , tagged as (select w.dir, w.pos, p.t, w.method, case when method = 'fallback' then we - ws else w.n - ws end * 60 as lead_min, w.start as anchor
                 from windows w join pre p on p.dir = w.dir and p.pos = w.pos and p.s = w.i and p.k >= ws and p.k < we)
    select c.pos, c.dir, c.t, c.label as orig_label, cast(g.t is not null as integer) as label, g.method, g.lead_min, g.anchor
    from traffic c left join tagged g on c.dir = g.dir and c.pos = g.pos and c.t = g.t"""))
def l07(spark, d):
    cells, _ = EP.tag_precursors(grid(spark, d), LOC, "t", "label", "v", "flow", CFG)
    return cells.select("pos", "dir", "t", "orig_label", "label", "method", "lead_min", "anchor")


@query("l07_precursor_events", sql("windows", """
    select dir, pos, start, "end", date_diff('minute', start, "end") + 60 as duration_min, round(baseline, 6) as baseline, round(threshold, 6) as threshold, method,
           case when we > ws then (case when method = 'fallback' then we - ws else n - ws end) * 60 end as lead_min, n * 60 as lookback_available_min from windows"""))
def l07_events(spark, d):
    _, events = EP.tag_precursors(grid(spark, d), LOC, "t", "label", "v", "flow", CFG)
    return rounded(events, "baseline", "threshold")


@query("l08_footprints", sql("located", """
    select dir, date_trunc('hour', ts) as t, min(pos) as pkmin, max(pos) as pkmax from located where event_type = 'error' group by all"""))
def l08(spark, d):
    stamps = V.located(spark, d).filter("event_type = 'error'").select(
        "dir", "pos", hour_start("ts").alias("t"))
    return EP.footprints(stamps, ["dir", "t"], "pos")


@query("l09_build_incidents", sql("located", ", " + INCIDENTS_SQL + "select incident_id, dir, tmin, tmax, pkmin, pkmax from incidents"))
def l09(spark, d):
    return incidents(spark, d)


CTES["matched"] = (("scores",), """
    select *, date_trunc('hour', ts) as t, case when y = 1 and event_id % 3 > 0 then pos // 10 end as incident_id from scores""")


def scored(spark, d):
    """Scores with hourly instants; two thirds of the positives belong to an incident."""
    s = V.scores(spark, d)
    return s.withColumn("t", hour_start("ts")).withColumn(
        "incident_id", F.expr("case when y = 1 and event_id % 3 > 0 then pos div 10 end"))


@query("l10_alarm_episodes", sql("matched", """
    , f as (select dir, pos, ts, incident_id, case when epoch_us(ts) // 1000000 - epoch_us(lag(ts) over w) // 1000000 <= 36000 then 0 else 1 end as nw
            from matched where pa >= 0.05 window w as (partition by dir, pos order by ts, event_id)),
    r as (select *, sum(nw) over (partition by dir, pos order by ts rows unbounded preceding) as episode from f)
    select dir, pos, cast(episode as bigint) as episode, min(ts) as start, max(ts) as "end", count(*) as n, bool_or(incident_id is not null) as hit from r group by dir, pos, episode"""))
def l10(spark, d):
    return EP.alarm_episodes(scored(spark, d), LOC, "ts", "pa", 0.05, 300, gap=1)


def assigned(spark, d):
    cells = V.scores(spark, d).select("event_id", F.expr(ROAD), "pos", F.col("ts").alias("t"), "y", "pb")
    return J.assign_incident(cells, incidents(spark, d), "dir", "t", "pos", "event_id", lead_minutes=60, match=F.col("y") == 1)


ASSIGNED_SQL = ", " + INCIDENTS_SQL + """,
    a as (select s.event_id, s.dir, s.pos, s.ts, s.y, s.pb, min(i.incident_id) as incident_id,
                 arg_min(date_diff('minute', i.tmin, s.ts), i.incident_id) as mins
          from scores s left join incidents i on s.y = 1 and s.pos // 25 * 2 + s.dir = i.dir and s.pos >= i.pkmin - 2
               and s.pos <= i.pkmax + 2 and s.ts >= i.tmin - interval 60 minute and s.ts <= i.tmax group by all)"""


def _card(name, thr):
    return f"""select '{name}' as tier, cast({thr} as double) as threshold,
      round(count(*) filter (pb >= {thr} and y = 1) / cast(greatest(count(*) filter (pb >= {thr}), 1) as double), 6) as interval_precision,
      round(count(*) filter (pb >= {thr} and y = 1) / cast(greatest(count(*) filter (y = 1), 1) as double), 6) as interval_recall,
      (select count(*) from incidents) as incidents, count(distinct incident_id) filter (pb >= {thr}) as incidents_caught,
      count(distinct incident_id) filter (pb >= {thr} and mins < 0) as incidents_caught_before_onset,
      (select count(*) from runs where thr = {thr}) as episodes, (select count(*) from runs where thr = {thr} and hit) as hits from a"""


RUNS_SQL = """, flagged as (select thr, dir, pos, ts, incident_id, lag(ts) over (partition by thr, dir, pos order by ts) as p from a, (select unnest([0.9, 0.5]) as thr) where pb >= thr),
    stepped as (select *, sum(case when epoch_us(ts) // 1000000 - epoch_us(p) // 1000000 <= 36000 then 0 else 1 end) over (partition by thr, dir, pos order by ts) as run from flagged),
    runs as (select thr, dir, pos, run, bool_or(incident_id is not null) as hit from stepped group by all)"""


@query("l11_event_scorecard", sql("located scores", ASSIGNED_SQL + RUNS_SQL + """
    select tier, threshold, interval_precision, interval_recall, incidents, incidents_caught, round(incidents_caught / cast(greatest(incidents, 1) as double), 6) as incident_recall,
           incidents_caught_before_onset, round(incidents_caught_before_onset / cast(greatest(incidents, 1) as double), 6) as incident_recall_pre_onset,
           episodes, hits as episodes_on_an_incident, round(hits / cast(greatest(episodes, 1) as double), 6) as episode_precision,
           round((episodes - hits) / cast(greatest(incidents, 1) as double), 6) as false_episodes_per_incident
    from (""" + _card("dispatch", 0.9) + " union all " + _card("advisory", 0.5) + ")"))
def l11(spark, d):
    pred = materialise(assigned(spark, d), "scored-cells")
    found = materialise(incidents(spark, d), "incidents")
    out = EP.event_scorecard(pred, found, {"dispatch": 0.9, "advisory": 0.5}, LOC, "t", "y", "pb", 300)
    return rounded(out, "interval_precision", "interval_recall", "incident_recall", "incident_recall_pre_onset",
                   "episode_precision", "false_episodes_per_incident")


@query("l12_pre_onset_ap", sql("located scores", ASSIGNED_SQL + """,
    k as (select pb as score, case when y = 1 and mins < 0 then 1 else 0 end as y from a where not (y = 1 and coalesce(mins >= 0, false))),
    g as (select score, count(*) as n, sum(y) as p from k group by score),
    c as (select *, sum(n) over w as cn, sum(p) over w as cp from g window w as (order by score desc))
    select cast(sum(n) as bigint) as n, cast(sum(p) as bigint) as pos, round(sum(p * cp / cast(cn as double)) / nullif(sum(p), 0), 6) as ap from c"""))
def l12(spark, d):
    return rounded(EP.pre_onset_ap(assigned(spark, d), "y", "pb"), "ap")
