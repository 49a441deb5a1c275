"""Queries of the imputation and flow propagation families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import joins as J
from . import views as V
from .oracle import CTES, sql
from .registry import query
from .views import LOC, r6


@query("i01_flag_missing", sql("lattice fact", """
    select l.pos, l.dir, l.t, case when f.speed is null or f.label is null then 1 else 0 end as imputed
    from lattice l left join fact f on l.pos = f.pos and l.dir = f.dir and l.t = f.t"""))
def i01(spark, d):
    joined = V.lattice(spark, d).join(V.fact(spark, d), [*LOC, "t"], "left")
    return I.flag_missing(joined, ["speed", "label"], "imputed").select("pos", "dir", "t", "imputed")


CTES["filled"] = (("cells",), """
    select pos, dir, t, label, flow, speed,
           case when speed is not null then speed when lo is null then hv when hi is null then lv
                else lv + (hv - lv) * (i - lo) / cast(hi - lo as double) end as full_speed
    from (select *, max(lo0) over (partition by dir, pos order by i rows unbounded preceding) as lo,
                 min(hi0) over (partition by dir, pos order by i rows between current row and unbounded following) as hi,
                 last_value(speed ignore nulls) over (partition by dir, pos order by i rows unbounded preceding) as lv,
                 first_value(speed ignore nulls) over (partition by dir, pos order by i rows between current row and unbounded following) as hv
          from (select *, case when speed is not null then i end as lo0, case when speed is not null then i end as hi0
                from (select *, row_number() over (partition by dir, pos order by t) as i from cells)))""")


@query("i02_interpolate", sql("filled", "select pos, dir, t, round(full_speed, 9) as speed from filled"))
def i02(spark, d):
    cells = V.cells(spark, d).select("pos", "dir", "t", "speed")
    return I.interpolate(cells, LOC, "t", ["speed"]).select("pos", "dir", "t", F.round("speed", 9).alias("speed"))


def sensed(spark, d):
    """Detector readings placed in sections, with a speed and a lane."""
    det = V.detector(spark, d).withColumn("v", F.expr("cast(40 + (partkey * 7) % 80 as double)"))
    det = det.withColumn("lane", F.expr("nullif(line % 4, 0)"))
    return J.locate_section(det, V.section(spark, d), "x", "k", "lo", "hi")


CTES["sensed"] = (("detector", "section"), """
    select d.*, cast(40 + (d.partkey * 7) % 80 as double) as v, nullif(d.line % 4, 0) as lane,
           case when d.x <= 10 then 0 when d.x <= 20 then 1 when d.x <= 30 then 2 when d.x <= 40 then 3 when d.x <= 50 then 4 else 5 end as k
    from detector d""")
CTES["section_stats"] = (("sensed",), """
    select k, dir, avg(q) as flow_mean, stddev_samp(q) as flow_std, avg(v) as speed_mean,
           stddev_samp(q) / (avg(q) + 0.000001) as flow_cv from sensed group by k, dir""")
CTES["decay"] = (("section_stats",), """
    select k, dir, 0.015 + 0.025 * 0.6 * least(flow_cv / ((select quantile_cont(flow_cv, 0.95) from section_stats) + 0.000001), 1) as alpha
    from section_stats""")


def _stats(spark, d):
    return I.section_stats(sensed(spark, d), ["k", "dir"], "t", "q", "v")


@query("c01_section_stats", sql("section_stats", """
    select k, dir, round(flow_mean, 4) as flow_mean, round(flow_std, 4) as flow_std,
           round(speed_mean, 6) as speed_mean, round(flow_cv, 6) as flow_cv from section_stats"""))
def c01(spark, d):
    return _stats(spark, d).select(
        "k", "dir", F.round("flow_mean", 4).alias("flow_mean"), F.round("flow_std", 4).alias("flow_std"),
        r6("speed_mean").alias("speed_mean"), r6("flow_cv").alias("flow_cv"))


@query("c02_calibrate_decay", sql("decay", "select k, dir, round(alpha, 9) as alpha from decay"))
def c02(spark, d):
    out = I.calibrate_decay(_stats(spark, d), ["k", "dir"])
    return out.select("k", "dir", F.round("alpha", 9).alias("alpha"))


def propagated(spark, d):
    alphas = I.calibrate_decay(_stats(spark, d), ["k", "dir"])
    rows = I.attach_decay(sensed(spark, d), alphas, ["k", "dir"])
    rows = J.expand_section(rows.filter("k is not null"), "lo", "hi", "pos")
    rows = rows.withColumn("dist", F.abs(F.col("pos") - F.col("x")))
    rows = rows.withColumn("vt", F.expr("cast(50 + (partkey + pos) % 60 as double)"))
    return I.propagate_flow(rows, "q", "qh", "v", "vt", "alpha", "dist")


CTES["propagated"] = (("sensed", "decay"), """
    select *, q / (v + 0.000001) * exp(-alpha * dist) * vt as flow_prop,
           qh / (q + 0.000001) * (q / (v + 0.000001) * exp(-alpha * dist) * vt) as heavy_prop
    from (select *, abs(pos - x) as dist, cast(50 + (partkey + pos) % 60 as double) as vt
          from (select s.*, coalesce(a.alpha, 0.025) as alpha,
                       unnest(generate_series(s.k * 10, s.k * 10 + 10)) as pos
                from sensed s left join decay a on s.k = a.k and s.dir = a.dir where s.k is not null))""")


@query("c03_propagate_flow", sql("propagated", """
    select orderkey, count(*) as n, cast(sum(cast(floor(flow_prop * 1000 + 0.5) as bigint)) as bigint) as flow_prop,
           cast(sum(cast(floor(heavy_prop * 1000 + 0.5) as bigint)) as bigint) as heavy_prop
    from propagated group by orderkey"""))
def c03(spark, d):
    def total(c):
        return F.sum(F.floor(F.col(c) * 1000 + 0.5)).alias(c)

    return propagated(spark, d).groupBy("orderkey").agg(
        F.count(F.lit(1)).alias("n"), total("flow_prop"), total("heavy_prop"))


@query("c04_bound_flow", sql("propagated", """
    select pos, dir, count(*) as n, count(*) filter (light = 0) as no_light,
           count(*) filter (abs(total - q * 1.5) < 1e-9) as at_top,
           cast(sum(cast(round(total, 6) as decimal(18,6))) as double) as total
    from (select *, greatest(total - heavy, 0) as light from (
          select *, least(greatest(flow_prop, q * 0.5), q * 1.5) as total,
                 least(greatest(heavy_prop, qh * 0.5), qh * 1.5) as heavy from propagated)) group by pos, dir"""))
def c04(spark, d):
    out = I.bound_flow(propagated(spark, d), "q", "qh")
    return out.groupBy("pos", "dir").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("light_out") == 0, 1)).alias("no_light"),
        F.count(F.when(F.abs(F.col("flow_out") - F.col("q") * 1.5) < 1e-9, 1)).alias("at_top"),
        F.sum(F.round("flow_out", 6).cast("decimal(18,6)")).cast("double").alias("total"))


@query("c05_lane_count", sql("sensed", """
    select k, dir, cast(max(coalesce(lane, 1)) as integer) as lanes from sensed group by k, dir"""))
def c05(spark, d):
    return I.lane_count(sensed(spark, d), ["k", "dir"], "lane")
