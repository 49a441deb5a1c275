"""Queries of the aggregation family and the profile lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeparts import hour_start
from ..operators import aggregate as A
from . import views as V
from .oracle import CTES, sql
from .registry import query
from .views import LOC, r6

CUT = "2024-01-21 00:00:00"


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("a01_agg_mean", sql("located", """
    select pos, dir, date_trunc('hour', ts) as t, round(avg(value), 6) as value from located group by all"""))
def a01(spark, d):
    raw = V.located(spark, d).select(*LOC, hour_start("ts").alias("t"), "value")
    return rounded(A.agg_mean(raw, ["pos", "dir", "t"], ["value"]), "value")


@query("a02_agg_max", sql("geometry", """
    select brand, size, max(radius) as radius, max(up) as up, max(down) as down from geometry group by all"""))
def a02(spark, d):
    return A.agg_max(V.geometry(spark, d), ["brand", "size"], ["radius", "up", "down"])


@query("a03_geometry_rollup", sql("geometry", """
    , long as (select brand, cast(round_even(post, 0) as integer) as post, post as raw, radius, 'cre' as sen, up as s from geometry
               union all select brand, cast(round_even(post, 0) as integer), post, radius, 'dec', down from geometry),
    g as (select brand, post, sen, sum(abs(s)) as slope_cum, abs(max(s)) as slope_rise, abs(min(s)) as slope_drop,
           count(*) filter (abs(radius) > 1300) as cl, count(*) filter (abs(radius) > 300 and abs(radius) <= 1300) as cr,
           count(*) filter (abs(radius) <= 300) as ch, sum(2 * pi() / abs(radius)) as curve_cum,
           sum(abs(round_even(degrees(atan(100 / radius)), 2))) as ang_curv,
           sum(case when s >= 0 then round_even(degrees(asin(s / 100)), 2) end) as ang_pend_pos,
           sum(case when s < 0 then round_even(degrees(asin(s / 100)), 2) end) as ang_pend_neg,
           count(distinct cast(floor(round(raw * 10, 4)) as bigint) % 10) as segment from long group by brand, post, sen)
    select brand, post, sen, slope_cum, slope_rise, slope_drop, round(cl / segment, 4) as curve_light_r,
           round(coalesce(curve_cum, 0), 6) as curve_cum, round(coalesce(ang_curv, 0), 4) as ang_curv,
           round(coalesce(ang_pend_pos, 0), 4) as ang_pend_pos, round(coalesce(ang_pend_neg, 0), 4) as ang_pend_neg,
           segment, cl, cr, ch from g"""))
def a03(spark, d):
    out = A.geometry_rollup(V.geometry(spark, d), ["brand"], "post", "radius", "up", "down")
    n = F.col("segment")
    counts = V.geometry(spark, d).select("brand", F.expr("cast(bround(post) as int) as post"), F.abs("radius").alias("r")).groupBy("brand", "post").agg(
        F.count(F.when(F.col("r") > 1300, 1)).alias("cl"),
        F.count(F.when((F.col("r") > 300) & (F.col("r") <= 1300), 1)).alias("cr"),
        F.count(F.when(F.col("r") <= 300, 1)).alias("ch"))
    out = out.join(counts, ["brand", "post"]).filter(
        (F.abs(F.col("curve_light") - F.col("cl") / n) <= 0.005001)
        & (F.abs(F.col("curve_regular") - F.col("cr") / n) <= 0.005001)
        & (F.abs(F.col("curve_heavy") - F.col("ch") / n) <= 0.005001))
    return out.select(
        "brand", "post", "sen", "slope_cum", "slope_rise", "slope_drop",
        F.round(F.col("cl") / n, 4).alias("curve_light_r"), r6("curve_cum").alias("curve_cum"),
        *[F.round(c, 4).alias(c) for c in ("ang_curv", "ang_pend_pos", "ang_pend_neg")], "segment", "cl", "cr", "ch")


@query("a04_spread_list", sql("geometry", "select brand, size, " + ", ".join(
    f"max(case when rn = {i + 1} then radius end) as radius_{i}" for i in range(10)) + """
    from (select *, row_number() over (partition by brand, size order by partkey) as rn from geometry) group by all"""))
def a04(spark, d):
    return A.spread_list(V.geometry(spark, d), ["brand", "size"], ["partkey"], "radius", 10, "radius_")


@query("a05_baseline_stats", sql("traffic", f"""
    select pos, hour, dow, round(avg(v), 6) as v_mean, round(stddev_samp(v), 6) as v_std,
           round(avg(flow), 6) as flow_mean, round(stddev_samp(flow), 6) as flow_std
    from traffic where t < timestamp '{CUT}' group by all"""))
def a05(spark, d):
    out = A.baseline_stats(V.traffic(spark, d), ["pos", "hour", "dow"], ["v", "flow"], "t", CUT)
    return rounded(out, "v_mean", "v_std", "flow_mean", "flow_std")


@query("a06_baseline_rate", sql("cells", f"""
    select pos, hour, dow, round(sum(label) / cast(count(*) as double), 6) as rate
    from cells where t < timestamp '{CUT}' group by all"""))
def a06(spark, d):
    return rounded(A.baseline_rate(V.cells(spark, d), ["pos", "hour", "dow"], "label", "rate", "t", CUT), "rate")


@query("a07_free_flow", sql("traffic", "select pos, round(quantile_cont(v, 0.85), 6) as v_ff from traffic group by pos"))
def a07(spark, d):
    return rounded(A.free_flow(V.traffic(spark, d), ["pos"], "v"), "v_ff")


@query("a08_eb_rate", sql("cells", f"""
    , p as (select sum(label) / cast(count(*) as double) as p0 from cells where t < timestamp '{CUT}')
    select pos, hour, dow, round((sum(label) + 200 * p0) / (count(*) + 200), 6) as rate, round(p0, 6) as p0
    from cells, p where t < timestamp '{CUT}' group by pos, hour, dow, p0"""))
def a08(spark, d):
    train = V.cells(spark, d).filter(f"t < timestamp_ntz'{CUT}'")
    train = A.coarsen_hour(train, "hour", 1)
    return rounded(A.eb_rate(train, ["pos", "hour", "dow"], "label"), "rate", "p0")


@query("a09_profile_fit", sql("traffic", """
    select dir, pos, dow, hour, round(avg(v), 9) as v, round(avg(flow), 9) as flow from traffic group by all
    union all select dir, pos, null, null, round(avg(v), 9), round(avg(flow), 9) from traffic group by all
    union all select null, null, null, null, round(avg(v), 9), round(avg(flow), 9) from traffic"""))
def a09(spark, d):
    fine, by_loc, overall = A.profile_fit(V.traffic(spark, d), LOC, ["dow", "hour"], ["v", "flow"])
    out = fine.unionByName(by_loc, allowMissingColumns=True).unionByName(overall, allowMissingColumns=True)
    return rounded(out, "v", "flow", digits=9)


def _halves(spark, d):
    cells = V.traffic(spark, d)
    return cells.filter(f"t < timestamp_ntz'{CUT}'"), cells.filter(f"t >= timestamp_ntz'{CUT}'")


CTES["vol_factor"] = (("traffic",), f"""
    select dir, pos, prior_lvl, recent_lvl, least(greatest(coalesce(f, median(f) over ()), 0.25), 4) as vol_factor
    from (select *, recent_lvl / nullif(prior_lvl, 0) as f from
      (select dir, pos, sum(flow) filter (t < timestamp '{CUT}') / cast(count(*) filter (t < timestamp '{CUT}') as double) as prior_lvl,
              sum(flow) filter (t >= timestamp '{CUT}') / cast(count(*) filter (t >= timestamp '{CUT}') as double) as recent_lvl
       from traffic group by dir, pos))""")


@query("a10_volume_factor", sql("vol_factor", """
    select dir, pos, round(prior_lvl, 6) as prior_lvl, round(recent_lvl, 6) as recent_lvl,
           round(vol_factor, 6) as vol_factor from vol_factor"""))
def a10(spark, d):
    prior, recent = _halves(spark, d)
    return rounded(A.volume_factor(prior, recent, LOC, "flow"), "prior_lvl", "recent_lvl", "vol_factor")


PROFILE_SQL = f"""
    , fine as (select dir, pos, dow, hour, avg(v) as v, avg(flow) as flow from traffic
               where t < timestamp '{CUT}' group by all),
    loc as (select dir, pos, avg(v) as v, avg(flow) as flow from traffic
            where t < timestamp '{CUT}' group by all),
    pred as (select c.pos, c.dir, c.t, c.v, c.flow, coalesce(f.v, l.v) as v_hat,
           coalesce(f.flow, l.flow) * vol_factor as flow_hat
    from traffic c left join fine f on c.dir = f.dir and c.pos = f.pos and c.dow = f.dow and c.hour = f.hour
         left join loc l on c.dir = l.dir and c.pos = l.pos join vol_factor x on c.dir = x.dir and c.pos = x.pos
    where c.t >= timestamp '{CUT}')"""


def profile_forecast(spark, d):
    prior, recent = _halves(spark, d)
    fitted = A.profile_fit(prior, LOC, ["dow", "hour"], ["v", "flow"])
    factor = A.volume_factor(prior, recent, LOC, "flow")
    return A.profile_predict(recent, fitted, LOC, ["dow", "hour"], ["v", "flow"], factor, ["flow"])


@query("j12_profile_predict", sql("traffic vol_factor", PROFILE_SQL + """
    select pos, dir, t, round(v_hat, 9) as v_hat, round(flow_hat, 9) as flow_hat from pred"""))
def j12(spark, d):
    out = profile_forecast(spark, d).select("pos", "dir", "t", "v_hat", "flow_hat")
    return rounded(out, "v_hat", "flow_hat", digits=9)


@query("a11_residual_baseline", sql("traffic", f"""
    , m as (select pos, dow * 24 + hour as how, median(v) as mv, median(flow) as mf from traffic where t < timestamp '2024-01-06' group by all),
    g as (select median(v) as gv, median(flow) as gf from traffic where t < timestamp '2024-01-06')
    select c.pos, c.dir, c.t, round(c.v - coalesce(mv, gv), 6) as v_res, round(c.flow - coalesce(mf, gf), 6) as flow_res
    from traffic c left join m on c.pos = m.pos and c.dow * 24 + c.hour = m.how, g"""))
def a11(spark, d):
    cells = V.traffic(spark, d).withColumn("how", F.col("dow") * 24 + F.col("hour"))
    base = A.residual_baseline(cells.filter("t < timestamp_ntz'2024-01-06'"), ["pos", "how"], ["v", "flow"])
    out = A.residualise(cells, base, ["pos", "how"], ["v", "flow"])
    return rounded(out.select("pos", "dir", "t", "v_res", "flow_res"), "v_res", "flow_res")


@query("a12_describe_columns", "select * from (" + " union all ".join(f"""
    select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd,
           round(min({c}), 4) as min, round(max({c}), 4) as max, round(avg(case when {c} = 0 then 1 else 0 end), 6) as zero_share,
           round(quantile_cont({c}, 0.25), 4) as p25, round(median({c}), 4) as median, round(quantile_cont({c}, 0.75), 4) as p75
    from lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def a12(spark, d):
    out = A.describe_columns(V.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    out = rounded(out, "mean", "sd", "min", "max", "p25", "median", "p75", digits=4)
    return rounded(out, "zero_share")


@query("a13_lattice_summary", sql("cells located", """
    select count(distinct pos) as posts, count(distinct dir) as directions, count(distinct pos * 2 + dir) as segments,
           min(t) as first, max(t) as last, count(*) as rows_clean, cast(sum(label) as bigint) as positives,
           round(sum(label) / cast(count(*) as double), 6) as base_rate,
           cast(round_even(sum(1 - label) / cast(sum(label) as double), 0) as bigint) as imbalance,
           (select count(*) from located) as rows_raw from cells"""))
def a13(spark, d):
    out = A.lattice_summary(V.located(spark, d), V.cells(spark, d), "dir", "pos", "t", "label")
    return rounded(out, "base_rate")


@query("a14_rate_by", """
    select strftime(l_shipdate, '%Y-%m') as month, count(*) as n, cast(sum(r) as bigint) as pos, round(100 * sum(r) / cast(count(*) as double), 6) as rate_pct
    from (select l_shipdate, case when l_returnflag = 'R' then 1 else 0 end as r from lineitem) group by 1""")
def a14(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("r", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(A.rate_by(rows, A.month_of("l_shipdate"), "month", "r"), "rate_pct")


@query("a15_quality_report", sql("cells", """
    , x as (select *, case when speed is null then 1 else 0 end as imputed from cells)
    select 'nulls' as check, c as "column", cast(n as double) as value from (unpivot (select
       count(*) - count(pos) as pos, count(*) - count(dir) as dir, count(*) - count(t) as t, count(*) - count(flow) as flow,
       count(*) - count(speed) as speed, count(*) - count(imputed) as imputed from x) on pos, dir, t, flow, speed, imputed into name c value n)
    union all select 'distinct', 'dir', cast(count(distinct dir) as double) from x
    union all select 'imputed_share', 'imputed', round(sum(imputed) / cast(count(*) as double), 6) from x
    union all select 'nonzero_share', 'flow', round(count(*) filter (flow <> 0) / cast(count(*) as double), 6) from x
    union all select 'duplicate_rows', '*', cast(sum(n - 1) as double) from (select count(*) as n from x group by pos, dir, t)"""))
def a15(spark, d):
    cells = V.cells(spark, d).select("pos", "dir", "t", "flow", "speed", F.col("speed").isNull().cast("int").alias("imputed"))
    return rounded(A.quality_report(cells, ["pos", "dir", "t"], ["dir"], ["imputed"], ["flow"]), "value")


@query("a16_daily_rollup", sql("scores", """
    select day, count(*) as n, round(avg(pa), 6) as mean_score, round(max(pa), 6) as max_score,
           cast(sum(case when pa >= 0.1 then 1 else 0 end) as bigint) as alarms, cast(sum(y) as bigint) as positives
    from scores group by day"""))
def a16(spark, d):
    pred = V.scores(spark, d).withColumn("flag", (F.col("pa") >= 0.1).cast("int"))
    return rounded(A.daily_rollup(pred, "day", "pa", "flag", "y"), "mean_score", "max_score")


@query("a17_bucket_counts", sql("scores", """
    , o as (select *, case when pa >= 0.5 then case when y = 1 then 'TP' else 'FP' end
                      else case when y = 1 then 'FN' else 'TN' end end as outcome from scores)
    select k.outcome, cast(h.h as integer) as hour, count(o.event_id) as n
    from (select distinct outcome from o) k cross join (select unnest(range(24)) as h) h
    left join o on o.outcome = k.outcome and o.hour = h.h group by all"""))
def a17(spark, d):
    from ..operators.diagnose import outcome_class
    return A.bucket_counts(outcome_class(V.scores(spark, d), "y", "pa", 0.5), "hour", 24, "outcome")


@query("a18_fit_scaler", sql("scores", """
    , tr as (select * from scores where day < date '2024-01-21')
    select event_id, round((pa - (select min(pa) from tr)) / (select max(pa) - min(pa) from tr), 6) as pa_mm,
           round((pb - (select avg(pb) from tr)) / (select stddev_pop(pb) from tr), 6) as pb_sd from scores"""))
def a18(spark, d):
    s = V.scores(spark, d)
    train = s.filter("day < date'2024-01-21'")
    out = A.apply_scaler(s, A.fit_scaler(train, ["pa"], "minmax"), ["pa"], "_mm")
    out = A.apply_scaler(out, A.fit_scaler(train, ["pb"], "standard"), ["pb"], "_sd")
    return rounded(out.select("event_id", "pa_mm", "pb_sd"), "pa_mm", "pb_sd")


@query("a19_average_scores", sql("scores", "select event_id, round((pa + pb + pc) / 3, 6) as score from scores"))
def a19(spark, d):
    out = A.average_scores(V.scores(spark, d), ["pa", "pb", "pc"], "score")
    return rounded(out.select("event_id", "score"), "score")


@query("a20_first_mode_argmax", sql("scores", """
    , f as (select pos, dir, event_id as first_event, round(pa, 6) as first_pa from
            (select *, row_number() over (partition by pos, dir order by ts, event_id) as rn from scores) where rn = 1),
    m as (select pos, dir, hour as mode_hour from (select pos, dir, hour, row_number() over
            (partition by pos, dir order by count(*) desc, hour) as rn from scores group by pos, dir, hour) where rn = 1),
    a as (select pos, dir, day as worst_day, cast(s as bigint) as worst_day_total from (select pos, dir, day, sum(y) as s, row_number() over
            (partition by pos, dir order by sum(y) desc, day) as rn from scores group by pos, dir, day) where rn = 1)
    select * from f join m using (pos, dir) join a using (pos, dir)"""))
def a20(spark, d):
    s = V.scores(spark, d)
    first = A.first_by(s, ["pos", "dir"], ["ts", "event_id"], ["event_id", "pa"]).select(
        "pos", "dir", F.col("event_id").alias("first_event"), r6("pa").alias("first_pa"))
    mode = A.mode_of(s, ["pos", "dir"], "hour", "mode_hour")
    worst = A.argmax_key(s, "day", F.col("y"), "worst_day", ["pos", "dir"])
    return first.join(mode, ["pos", "dir"]).join(worst, ["pos", "dir"])
