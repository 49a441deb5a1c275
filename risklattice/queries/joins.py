"""Queries of the join family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeparts import hour_start
from ..operators import episodes as ep
from ..operators import joins as J
from . import views as V
from .oracle import sql
from .registry import query
from .views import LOC, r6


@query("j01_build_lattice", sql("lattice", """
    select pos, dir, count(*) as n, count(distinct t) as instants, min(t) as first, max(t) as last
    from lattice group by all"""))
def j01(spark, d):
    return V.lattice(spark, d).groupBy(*LOC).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("instants"),
        F.min("t").alias("first"), F.max("t").alias("last"))


@query("j02_attach_measure", sql("lattice fact", """
    select l.pos, l.dir, l.t, f.flow, round(f.speed, 6) as speed from lattice l left join fact f
    on l.pos = f.pos and l.dir = f.dir and l.t = f.t"""))
def j02(spark, d):
    raw = V.located(spark, d).select(
        *LOC, hour_start("ts").alias("t"), "value")
    n = F.count(F.lit(1))
    aggs = [n.alias("flow"), r6(F.sum(V.money("value")).cast("double") / n).alias("speed")]
    return J.attach_measure(V.lattice(spark, d), raw, [*LOC, "t"], aggs)


@query("j03_attach_hourly", sql("located hourly_weather", """
    select e.event_id, round(h.precip, 6) as precip, round(h.temp, 6) as temp
    from located e left join hourly_weather h on date_trunc('hour', e.ts) = h.t"""))
def j03(spark, d):
    hourly = V.hourly_weather(spark, d).withColumnRenamed("t", "ts")
    out = J.attach_hourly(V.located(spark, d), hourly, "ts")
    return out.select("event_id", r6("precip").alias("precip"), r6("temp").alias("temp"))


@query("j04_attach_labels", sql("cells", "select pos, dir, t, label, flow, heavy from cells"))
def j04(spark, d):
    out = J.attach_labels(V.lattice(spark, d), V.fact(spark, d), [*LOC, "t"], ["label", "flow", "heavy"])
    return out.select("pos", "dir", "t", "label", "flow", "heavy")


@query("j05_attach_calendar", sql("calendar", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as date) as day,
           coalesce(special, 0) as special
    from lineitem left join calendar on cast(l_shipdate as date) = day"""))
def j05(spark, d):
    lines = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return J.attach_calendar(lines, V.calendar(spark, d), "l_shipdate", ["special"]).drop("l_shipdate")


@query("j06_attach_geometry", sql("geometry", """
    select l_orderkey, l_linenumber, l_partkey, round(radius, 6) as radius, up
    from lineitem left join geometry on l_partkey = partkey"""))
def j06(spark, d):
    lines = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("partkey"))
    geo = V.geometry(spark, d).select("partkey", r6("radius").alias("radius"), "up")
    return J.attach_geometry(lines, geo, ["partkey"]).drop("partkey")


@query("j07_locate_section", sql("detector section", """
    select d.orderkey, d.line, d.partkey, d.x, min(s.k) as k, min(s.lo) as lo, min(s.hi) as hi, count(distinct d.t) as days
    from detector d left join section s on d.x between s.lo and s.hi
    group by d.orderkey, d.line, d.partkey, d.x"""))
def j07(spark, d):
    out = J.locate_section(V.detector(spark, d), V.section(spark, d), "x", "k", "lo", "hi")
    return out.groupBy("orderkey", "line", "partkey", "x").agg(
        F.min("k").alias("k"), F.min("lo").alias("lo"), F.min("hi").alias("hi"),
        F.countDistinct("t").alias("days"))


@query("j08_expand_section", sql("detector section", """
    select k, pos, count(*) as n, round(sum(abs(pos - x)), 4) as distance
    from (select k, x, unnest(generate_series(cast(ceil(lo) as bigint), cast(floor(hi) as bigint))) as pos
          from (select d.x, d.orderkey, d.line, d.partkey, d.suppkey, d.t, d.q, d.dir, min(s.k) as k, min(s.lo) as lo, min(s.hi) as hi
                from detector d join section s on d.x between s.lo and s.hi group by all))
    group by all"""))
def j08(spark, d):
    found = J.locate_section(V.detector(spark, d), V.section(spark, d), "x", "k", "lo", "hi").filter("k is not null")
    out = J.expand_section(found, "lo", "hi", "pos")
    return out.groupBy("k", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs(F.col("pos") - F.col("x"))), 4).alias("distance"))


@query("j09_attach_sensor_speed", sql("detector", """
    select d.orderkey, d.line, d.partkey, d.x, round(s.speed, 6) as speed
    from detector d left join (select dir, cast(floor(x) as bigint) as p,
         cast(sum(cast(q as decimal(18,4))) as double) / count(*) as speed from detector group by all) s on d.dir = s.dir and cast(floor(d.x) as bigint) = s.p"""))
def j09(spark, d):
    det = V.detector(spark, d)
    speed = det.groupBy("dir", F.floor("x").cast("long").alias("pos")).agg(
        r6(F.sum(F.col("q").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("speed"))
    out = J.attach_sensor_speed(det, speed, ["dir"], "x", "pos")
    return out.select("orderkey", "line", "partkey", "x", "speed")


@query("j10_neighbour_context", sql("traffic", """
    , m as materialized (select pos, dir, t, flow, v from traffic)
    select a.pos, a.dir, a.t, coalesce(u.flow, a.flow) as flow_up,
           coalesce(u.flow, a.flow) - a.flow as flow_grad_up, coalesce(n.flow, a.flow) as flow_dn,
           coalesce(n.flow, a.flow) - a.flow as flow_grad_dn, round(coalesce(u.v, a.v), 6) as v_up,
           round(coalesce(u.v, a.v) - a.v, 6) as v_grad_up, round(coalesce(n.v, a.v), 6) as v_dn,
           round(coalesce(n.v, a.v) - a.v, 6) as v_grad_dn
    from m a
    left join m u on u.dir = a.dir and u.t = a.t and u.pos = a.pos - 1
    left join m n on n.dir = a.dir and n.t = a.t and n.pos = a.pos + 1"""))
def j10(spark, d):
    base = V.traffic(spark, d).select("pos", "dir", "t", "flow", "v")
    out = J.neighbour_context(base, ["flow", "v"], ["dir", "t"], "pos")
    return out.select("pos", "dir", "t", *[c for c in out.columns if c.startswith("flow_")],
                      *[r6(c).alias(c) for c in out.columns if c.startswith("v_")])


@query("j11_corridor_edges", sql("fact", """
    , node as (select *, cast(epoch(t) as bigint) * 4000 + pos * 2 + dir as id from fact),
    e as (select a.id as src, b.id as dst from node a join node b
          on a.dir = b.dir and a.t = b.t and b.pos = a.pos + 1)
    select src, dst from e union all select dst, src from e
    union all select id, id from node where id not in (select src from e union select dst from e)"""))
def j11(spark, d):
    node = V.fact(spark, d).withColumn("id", F.expr(
        "(unix_date(to_date(t)) * 86400L + hour(t) * 3600L) * 4000L + pos * 2 + dir"))
    return J.corridor_edges(node, "dir", "t", "pos", "id")


@query("j13_attach_baseline", sql("cells", """
    , b as (select pos, hour, dow, sum(flow) / cast(count(*) as double) as mean_flow from cells
            where t < timestamp '2024-01-06' group by all)
    select c.pos, c.dir, c.t, round(coalesce(b.mean_flow, 0), 6) as mean_flow
    from cells c left join b on c.pos = b.pos and c.hour = b.hour and c.dow = b.dow"""))
def j13(spark, d):
    cells = V.cells(spark, d)
    base = cells.filter("t < timestamp_ntz'2024-01-06'").groupBy("pos", "hour", "dow").agg(
        (F.sum("flow") / F.count(F.lit(1))).alias("mean_flow"))
    out = J.attach_baseline(cells, base, ["pos", "hour", "dow"], {"mean_flow": F.lit(0.0)})
    return out.select("pos", "dir", "t", r6("mean_flow").alias("mean_flow"))


INCIDENTS_SQL = """
    stamp as (select distinct cast(pos // 25 * 2 + dir as integer) as dir, pos, date_trunc('hour', ts) as t from located
              where event_type = 'error'),
    foot as (select dir, t, min(pos) as lo, max(pos) as hi,
                    row_number() over (partition by dir order by t) as i from stamp group by dir, t),
    walk as (
      with recursive w as (
        select dir, i, t as tmax, lo as plo, hi as phi, 1 as num from foot where i = 1
        union all
        select f.dir, f.i, f.t,
               case when same then least(w.plo, f.lo) else f.lo end,
               case when same then greatest(w.phi, f.hi) else f.hi end,
               case when same then w.num else w.num + 1 end
        from w join (select * from foot) f on f.dir = w.dir and f.i = w.i + 1,
             lateral (select f.t - w.tmax <= interval 2 hour
                      and not (f.hi < w.plo - 2 or f.lo > w.phi + 2) as same))
      select * from w),
    incident as (select w.dir, w.num, min(f.t) as tmin, max(f.t) as tmax, min(f.lo) as pkmin, max(f.hi) as pkmax
                 from walk w join foot f on f.dir = w.dir and f.i = w.i group by w.dir, w.num),
    incidents as (select dir, num, row_number() over (order by dir, tmin) - 1 as incident_id, tmin, tmax, pkmin, pkmax from incident)"""


# Incidents lie on roads of 25 posts by direction, so that more posts make more of them.
ROAD = "cast(pos div 25 * 2 + dir as int) as dir"


def incidents(spark, d):
    stamps = V.located(spark, d).filter("event_type = 'error'").select(
        F.expr(ROAD), "pos", hour_start("ts").alias("t")).distinct()
    return ep.build_incidents(ep.footprints(stamps, ["dir", "t"], "pos"), "dir", "t", hours=2, tolerance=2)


@query("j14_assign_incident", sql("located scores", ", " + INCIDENTS_SQL + """
    select s.event_id, min(i.incident_id) as incident_id,
           arg_min(date_diff('minute', i.tmin, s.ts), i.incident_id) as mins_from_onset
    from scores s left join incidents i on s.y = 1 and s.pos // 25 * 2 + s.dir = i.dir and s.pos >= i.pkmin - 2
         and s.pos <= i.pkmax + 2 and s.ts >= i.tmin - interval 60 minute and s.ts <= i.tmax
    where s.y = 1 group by s.event_id"""))
def j14(spark, d):
    cells = V.scores(spark, d).filter("y = 1").select("event_id", F.expr(ROAD), "pos", F.col("ts").alias("t"))
    out = J.assign_incident(cells, incidents(spark, d), "dir", "t", "pos", "event_id", lead_minutes=60)
    return out.select("event_id", "incident_id", "mins_from_onset")


@query("j15_attach_features", sql("scores cells", """
    select s.event_id, round(s.pa, 6) as pa, c.flow, c.heavy from scores s left join cells c
    on s.pos = c.pos and s.dir = c.dir and date_trunc('hour', s.ts) = c.t"""))
def j15(spark, d):
    pred = V.scores(spark, d).select(
        "event_id", "pos", "dir", hour_start("ts").alias("t"), r6("pa").alias("pa"))
    out = J.attach_features(pred, V.cells(spark, d).select(*LOC, "t", "flow", "heavy"), [*LOC, "t"])
    return out.select("event_id", "pa", "flow", "heavy")


@query("j16_merge_stages", sql("scores", """
    select event_id, y, round(pa, 6) as s1, round(pb, 6) as s2 from scores"""))
def j16(spark, d):
    s = V.scores(spark, d)
    return J.merge_stages(
        s.select("event_id", "y", r6("pa").alias("s1")),
        s.select("event_id", r6("pb").alias("s2")), ["event_id"])


@query("j17_reconcile_codes", sql("", """
    with a as (select s_suppkey as code_a, s_acctbal as va from supplier),
         b as (select c_custkey as code_b, c_acctbal + 0.25 as vb from customer)
    select code_a, min(code_b) as code_b from a join b on abs(va - vb) < 1.5 group by 1"""))
def j17(spark, d):
    a = V.table(spark, d, "supplier").selectExpr("s_suppkey as code_a", "s_acctbal as va")
    b = V.table(spark, d, "customer").selectExpr("c_custkey as code_b", "c_acctbal + 0.25D as vb")
    return J.reconcile_codes(a, b, "code_a", "code_b", "va", "vb", 1.5)


@query("j18_key_overlap", sql("", """
    with a as (select l_orderkey as k, count(*) as n from lineitem group by 1),
         b as (select o_orderkey as k, count(*) as n from orders group by 1)
    select cast(sum(a.n) as bigint) as rows_a, cast(sum(b.n) as bigint) as rows_b,
           count(a.k) as keys_a, count(b.k) as keys_b,
           count(*) filter (a.k is not null and b.k is not null) as keys_both,
           count(*) filter (b.k is null) as keys_only_a, count(*) filter (a.k is null) as keys_only_b,
           cast(sum(a.n) filter (b.k is not null) as bigint) as rows_a_matched,
           cast(sum(b.n) filter (a.k is not null) as bigint) as rows_b_matched
    from a full outer join b on a.k = b.k"""))
def j18(spark, d):
    a = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    b = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return J.key_overlap(a, b, ["k"])
