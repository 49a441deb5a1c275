"""Queries of the window and feature family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import mix, sample_rank
from ..operators import aggregate as A
from ..operators import evaluate as E
from ..operators import sets
from ..operators import windows as W
from ..session import materialise
from . import views as V
from .aggregates import rounded
from .oracle import CTES, sql
from .registry import query
from .views import LOC, r6

CUT = "2024-01-21 00:00:00"
OVER = "(partition by dir, pos order by t)"


def cells(spark, d):
    return V.traffic(spark, d).select("pos", "dir", "t", "v", "flow")


@query("w01_lags", sql("traffic", f"""
    select pos, dir, t, v, flow, lag(v, 1) over w as speed_lag1, lag(v, 2) over w as speed_lag2, lag(v, 4) over w as speed_lag4
    from traffic window w as {OVER}"""))
def w01(spark, d):
    return W.lags(cells(spark, d), LOC, "t", "v", prefix="speed")


@query("w02_deltas", sql("traffic", f"""
    select pos, dir, t, flow, round(v, 6) as v, round(v - lag(v, 1) over w, 6) as delta_1, round(v - lag(v, 2) over w, 6) as delta_2,
           round((v - lag(v, 1) over w) / 60, 6) as accel from traffic window w as {OVER}"""))
def w02(spark, d):
    return rounded(W.deltas(cells(spark, d), LOC, "t", "v", 60), "v", "delta_1", "delta_2", "accel")


@query("w03_rolling_std", sql("traffic", f"""
    select pos, dir, t, round(stddev_samp(v) over ({OVER[1:-1]} rows between 1 preceding and current row), 6) as v_std_2,
           round(stddev_samp(v) over ({OVER[1:-1]} rows between 3 preceding and current row), 6) as v_std_4 from traffic"""))
def w03(spark, d):
    return rounded(W.rolling_std(cells(spark, d), LOC, "t", "v"), "v_std_2", "v_std_4").select("pos", "dir", "t", "v_std_2", "v_std_4")


@query("w04_rolling_mean", sql("traffic", f"""
    select pos, dir, t, round(avg(v) over ({OVER[1:-1]} rows between 3 preceding and current row), 9) as v_mean_4,
           round(avg(v) over ({OVER[1:-1]} rows between 11 preceding and current row), 9) as v_mean_12 from traffic"""))
def w04(spark, d):
    out = W.rolling_mean(cells(spark, d), LOC, "t", "v", (4, 12)).select("pos", "dir", "t", "v_mean_4", "v_mean_12")
    return rounded(out, "v_mean_4", "v_mean_12", digits=9)


@query("w05_rolling_cv", sql("traffic", f"""
    select pos, dir, t, round(stddev_samp(v) over ({OVER[1:-1]} rows between 1 preceding and current row) / greatest(abs(v), 0.001), 6) as v_cv_2 from traffic"""))
def w05(spark, d):
    return rounded(W.rolling_cv(cells(spark, d), LOC, "t", "v").select("pos", "dir", "t", "v_cv_2"), "v_cv_2")


@query("w06_spatial_gradient", sql("traffic", """
    select pos, dir, t, round(v - lag(v) over w, 6) as speed_grad_up, round(lead(v) over w - v, 6) as speed_grad_dn,
           flow - lag(flow) over w as vol_grad_up from traffic window w as (partition by t, dir order by pos)"""))
def w06(spark, d):
    rows = V.traffic(spark, d).select("pos", "dir", "t", "v", "flow")
    out = W.spatial_gradient(rows, ["t", "dir"], "pos", {"v": "speed", "flow": "vol"}, ["v"])
    return rounded(out.select("pos", "dir", "t", "speed_grad_up", "speed_grad_dn", "vol_grad_up"), "speed_grad_up", "speed_grad_dn")


@query("w07_zscore", sql("traffic", f"""
    , b as (select pos, hour, dow, avg(v) as mu, stddev_samp(v) as sd from traffic where t < timestamp '{CUT}' group by all)
    select c.pos, c.dir, c.t, round((v - mu) / greatest(coalesce(sd, 0.001), 0.001), 6) as speed_zscore,
           coalesce(cast((v - mu) / greatest(coalesce(sd, 0.001), 0.001) < -1.5 as integer), 0) as speed_pct_below_normal
    from traffic c left join b on c.pos = b.pos and c.hour = b.hour and c.dow = b.dow"""))
def w07(spark, d):
    rows = V.traffic(spark, d)
    base = A.baseline_stats(rows, ["pos", "hour", "dow"], ["v"], "t", CUT)
    out = W.zscore(rows, base, ["pos", "hour", "dow"], "v", "speed")
    return rounded(out.select("pos", "dir", "t", "speed_zscore", "speed_pct_below_normal"), "speed_zscore")


@query("w08_flow_regime", sql("traffic", f"""
    , f as (select pos, quantile_cont(v, 0.85) as ff from traffic where t < timestamp '{CUT}' group by pos)
    select c.pos, c.dir, c.t, case when v > 0.85 * coalesce(ff, (select median(v) from traffic)) then 0
           when v > 0.70 * coalesce(ff, (select median(v) from traffic)) then 1 else 2 end as flow_regime
    from traffic c left join f on c.pos = f.pos"""))
def w08(spark, d):
    rows = cells(spark, d)
    free = A.free_flow(rows.filter(f"t < timestamp_ntz'{CUT}'"), ["pos"], "v")
    return W.flow_regime(rows, free, ["pos"], "v").select("pos", "dir", "t", "flow_regime")


@query("w09_occupancy", sql("traffic", "select pos, dir, t, round(flow / greatest(abs(v), 0.001), 6) as occ_proxy from traffic"))
def w09(spark, d):
    return rounded(W.occupancy(cells(spark, d), "flow", "v").select("pos", "dir", "t", "occ_proxy"), "occ_proxy")


@query("w10_long_lag", sql("fact", """
    select a.pos, a.dir, a.t, a.flow, round(b.speed, 6) as speed_lagged, b.flow as flow_lagged
    from fact a join fact b on a.pos = b.pos and a.dir = b.dir and a.t = b.t + interval 72 hour"""))
def w10(spark, d):
    out = W.long_lag(V.fact(spark, d), LOC, "t", ["speed", "flow"], 72 * 60)
    return out.select("pos", "dir", "t", "flow", r6("speed_lagged").alias("speed_lagged"), "flow_lagged")


@query("w11_group_position", sql("fact", """
    select pos, dir, t, row_number() over w - 1 as pos_start, count(*) over (partition by dir, pos) - row_number() over w as pos_end,
           count(*) over (partition by dir, pos) as group_size from fact window w as (partition by dir, pos order by t)"""))
def w11(spark, d):
    return W.group_position(V.fact(spark, d).select("pos", "dir", "t"), LOC, "t")


REST = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("w12_dedup_prefer", f"""
    select l_orderkey, l_linenumber, {", ".join(REST)}, l_extendedprice from (select *, row_number() over (partition by l_orderkey, l_linenumber
      order by case when l_returnflag = 'R' then 1 else 0 end desc, l_extendedprice desc, {", ".join(REST)}) as rn from lineitem) where rn = 1""")
def w12(spark, d):
    rows = V.dups(spark, d).withColumn("_r", (F.col("l_returnflag") == "R").cast("int"))
    return sets.dedup_prefer(rows, ["l_orderkey", "l_linenumber"], ["_r", "l_extendedprice"], REST).drop("_r")


@query("w13_dedup", """
    select user_id, event_type, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn
    from events) where rn = 1""")
def w13(spark, d):
    out = sets.dedup(V.table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("w14_history", sql("traffic", """
    select pos, dir, t, n, round(v_sum, 6) as v_sum, round(v_first, 6) as v_first, cast(flow_sum as bigint) as flow_sum from (
      select pos, dir, t, count(*) over w as n, sum(v) over w as v_sum, first_value(v) over w as v_first, sum(flow) over w as flow_sum
      from traffic window w as (partition by dir, pos order by t rows between 12 preceding and 1 preceding)) where n = 12"""))
def w14(spark, d):
    out = W.history(cells(spark, d), LOC, "t", ["v", "flow"], 12)
    return out.select(
        "pos", "dir", "t", F.size("history").cast("long").alias("n"),
        r6(F.aggregate("history", F.lit(0.0), lambda a, x: a + x["v"])).alias("v_sum"),
        r6(F.get("history", F.lit(0))["v"]).alias("v_first"),
        F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x["flow"]).alias("flow_sum"))


@query("w15_run_weights", sql("cells", """
    , p as (select *, case when epoch(t) - epoch(lag(t) over (partition by dir, pos order by t)) <= 7200 then 0 else 1 end as nw from cells where label = 1),
    r as (select *, sum(nw) over (partition by dir, pos order by t rows unbounded preceding) as run from p),
    k as (select *, row_number() over (partition by dir, pos, run order by t) - 1 as i, count(*) over (partition by dir, pos, run) as n from r)
    select c.pos, c.dir, c.t, round(coalesce(case when n > 1 then 1 - 0.6 * abs(i - (n - 1) / cast(2 as double)) / ((n - 1) / cast(2 as double)) end, 1), 6) as weight
    from cells c left join k on c.pos = k.pos and c.dir = k.dir and c.t = k.t"""))
def w15(spark, d):
    out = W.run_weights(V.cells(spark, d).select("pos", "dir", "t", "label"), LOC, "t", "label", 0.4, 120)
    return rounded(out.select("pos", "dir", "t", "weight"), "weight")


@query("w16_cumulative_by_score", sql("curve", """
    select model, round(score, 9) as score, n, cast(pos as bigint) as pos, cast(cum_n as bigint) as cum_n, cast(cum_pos as bigint) as cum_pos,
           cast(tot_n as bigint) as tot_n, cast(tot_pos as bigint) as tot_pos from curve"""))
def w16(spark, d):
    return rounded(E.cumulative_by_score(V.long_scores(spark, d), "y", "score", ["model"]), "score", digits=9)


@query("w17_rank_sample", """
    select event_id from events order by (event_id % 4294967296 * 2654435761::hugeint + 7 * 40503) % 4294967296, event_id limit 1234""")
def w17(spark, d):
    rows = V.table(spark, d, "events").select("event_id", mix("event_id", 7).alias("_h"))
    return sample_rank(rows, "_h", "event_id", F.lit(1234)).select("event_id")


@query("w18_interactions", sql("traffic", """
    , x as (select *, cast(pos % 13 as double) as curve, cast(pos % 5 as double) as up, -cast(pos % 7 as double) as down, v - 50 as dv from traffic)
    select pos, dir, t, cast(pos as double) * hour as pk_x_hor, cast(pos in (24, 25, 49) as integer) as is_pk_hot_zone,
           cast(pos in (24, 25, 49) and hour in (17, 18) as integer) as pk_hot_x_evening_rush, round(curve * v, 6) as curv_x_speed,
           round(greatest(abs(up), abs(down)) * v, 6) as pend_x_speed, round(curve * dv, 6) as curv_x_delta_speed from x"""))
def w18(spark, d):
    rows = V.traffic(spark, d).selectExpr(
        "*", "cast(pos % 13 as double) as curve", "cast(pos % 5 as double) as up", "-cast(pos % 7 as double) as down", "v - 50 as dv")
    out = W.geometry_interactions(rows, "curve", ["up", "down"], "v", "dv")
    out = W.interactions(out, "pos", "hour", hot=(24, 25, 49))
    out = out.select("pos", "dir", "t", "pk_x_hor", "is_pk_hot_zone", "pk_hot_x_evening_rush", "curv_x_speed", "pend_x_speed", "curv_x_delta_speed")
    return rounded(out, "curv_x_speed", "pend_x_speed", "curv_x_delta_speed")


@query("w19_cyclic", """
    select event_id, round(sin(2 * pi() * hour(ts) / 24), 6) as hor_sin, round(cos(2 * pi() * hour(ts) / 24), 6) as hor_cos,
           round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) as "diaSem_sin", round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) as "diaSem_cos",
           round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) as doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) as doy_cos,
           cast(hour(ts) in (7, 8, 9, 17, 18, 19, 20) as integer) as is_peak_hour, cast(isodow(ts) >= 6 as integer) as is_weekend from events""")
def w19(spark, d):
    rows = V.table(spark, d, "events").select(
        "event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("dow"), F.dayofyear("ts").alias("doy"))
    out = W.calendar_flags(W.cyclic(rows, {"hor": ("hour", 24), "diaSem": ("dow", 7), "doy": ("doy", 365.25)}), "hour", "dow")
    out = out.drop("hour", "dow", "doy")
    return rounded(out, *[c for c in out.columns if c.endswith(("_sin", "_cos"))])


WEATHER = dict(precip="precip", temp="temp", cloud="cloud", gust="gust", wind="wind", precip_far="precip3")


@query("w20_weather_signals", sql("traffic hourly_weather", """
    select c.pos, c.dir, c.t, cast(precip > 0.1 as integer) as is_raining, cast(precip > 2.5 as integer) as is_heavy_rain,
           cast(temp between -2 and 2 as integer) as temp_near_freezing, cast(cloud > 80 and precip > 0.1 as integer) as low_visibility_proxy,
           gust - wind as wind_gust_excess, round(precip - precip3, 6) as precip_change_1d_vs_3d,
           cast(precip > 0.1 as integer) * cast(pos % 13 as double) as wet_curve_risk, cast(temp between -2 and 2 as integer) * cast(pos % 13 as double) as cold_curve_risk,
           cast(precip > 0.1 as integer) * cast(pos % 7 as double) as wet_descent_risk, round(cast(precip > 0.1 as integer) * v, 6) as wet_speed
    from traffic c join hourly_weather h on c.t = h.t"""))
def w20(spark, d):
    rows = V.traffic(spark, d).join(V.hourly_weather(spark, d), "t").selectExpr(
        "*", "cast(pos % 13 as double) as curve", "-cast(pos % 7 as double) as down")
    out = W.weather_signals(rows, **WEATHER, curve="curve", descent="down", speed="v")
    out = out.select("pos", "dir", "t", *[c for c in out.columns if c not in rows.columns])
    return rounded(out, "precip_change_1d_vs_3d", "wet_speed")


CTES["road"] = (("traffic", "hourly_weather"), """
    select c.pos as pk, c.dir as sen, 0 as via, c.t as dat, c.hour as hor, c.dow as "diaSem", cast(month(c.t) as integer) as mes,
           c.v as mean_speed, c.flow as "intTot", c.heavy as "intP", c.label as "ACCIDENT", cast(day(c.t) % 7 = 0 as integer) as mob_esp,
           cast(pos % 13 as double) as ang_curv, cast(pos % 5 as double) as ang_pend_pos, -cast(pos % 7 as double) as ang_pend_neg,
           h.precip, h.temp, h.gust, h.wind, h.cloud, h.precip3 from traffic c join hourly_weather h on c.t = h.t""")


def road(spark, d):
    """Cells under the usual column names with geometry and weather."""
    return V.traffic(spark, d).join(V.hourly_weather(spark, d), "t").selectExpr(
        "pos as pk", "dir as sen", "0 as via", "t as dat", "hour as hor", "dow as diaSem", "month(t) as mes", "v as mean_speed",
        "flow as intTot", "heavy as intP", "label as ACCIDENT", "cast(day(t) % 7 = 0 as int) as mob_esp",
        "cast(pos % 13 as double) as ang_curv", "cast(pos % 5 as double) as ang_pend_pos", "-cast(pos % 7 as double) as ang_pend_neg",
        "precip", "temp", "gust", "wind", "cloud", "precip3")


FEATURES = [
    "speed_lag1", "speed_lag4", "vol_lag2", "delta_speed_1", "delta_speed_2", "delta_vol_1", "accel_speed", "speed_std_2", "speed_std_4",
    "speed_mean_4", "vol_std_2", "speed_cv_2", "vol_cv_2", "hv_fraction", "hv_fraction_lag1", "speed_grad_up", "speed_grad_dn", "vol_grad_up",
    "speed_zscore", "speed_pct_below_normal", "vol_zscore", "pk_crash_rate", "pk_crash_rate_log", "pk_crash_rate_mob", "flow_regime",
    "occ_proxy", "curv_x_speed", "pend_x_speed", "curv_x_delta_speed", "is_peak_hour", "hor_sin", "diaSem_cos", "mes_sin", "is_raining",
    "is_heavy_rain", "temp_near_freezing", "low_visibility_proxy", "wind_gust_excess", "precip_change_1d_vs_3d", "wet_curve_risk",
    "wet_descent_risk", "wet_speed", "cold_curve_risk"]
WHOLE = {"speed_pct_below_normal", "flow_regime", "is_peak_hour", "is_raining", "is_heavy_rain", "temp_near_freezing", "low_visibility_proxy",
         "vol_lag2", "delta_vol_1", "vol_grad_up"}


def feature_frame(spark, d):
    stored = materialise(road(spark, d).sortWithinPartitions("dat"), "road")
    return W.build_features(stored, W.FeatureConfig(weather=WEATHER, step_minutes=60), CUT)


@query("w21_build_features", sql("road", f"""
    , b as (select pk, hor, "diaSem", avg(mean_speed) as vm, stddev_samp(mean_speed) as vs, avg("intTot") as qm, stddev_samp("intTot") as qs,
                   sum("ACCIDENT") / cast(count(*) as double) as rate from road where dat < timestamp '{CUT}' group by all),
    bm as (select pk, hor, "diaSem", mob_esp, sum("ACCIDENT") / cast(count(*) as double) as rate_mob from road where dat < timestamp '{CUT}' group by all),
    ff as (select pk, quantile_cont(mean_speed, 0.85) as v_ff from road where dat < timestamp '{CUT}' group by pk),
    x as (select *, lag(mean_speed, 1) over l as l1, lag(mean_speed, 2) over l as l2, lag(mean_speed, 4) over l as l4, lag("intTot", 1) over l as q1, lag("intTot", 2) over l as q2,
             stddev_samp(mean_speed) over (partition by via, sen, pk order by dat rows between 1 preceding and current row) as s2,
             stddev_samp(mean_speed) over (partition by via, sen, pk order by dat rows between 3 preceding and current row) as s4,
             avg(mean_speed) over (partition by via, sen, pk order by dat rows between 3 preceding and current row) as m4,
             stddev_samp("intTot") over (partition by via, sen, pk order by dat rows between 1 preceding and current row) as qs2,
             ("intTot" - "intP") / greatest(abs("intTot"), 0.001) as hv,
             mean_speed - lag(mean_speed) over g as gu, lead(mean_speed) over g - mean_speed as gd, "intTot" - lag("intTot") over g as qu
          from road window l as (partition by via, sen, pk order by dat), g as (partition by dat, via, sen order by pk))
    select pk, sen, dat, round(l1, 6) as speed_lag1, round(l4, 6) as speed_lag4, q2 as vol_lag2, round(mean_speed - l1, 6) as delta_speed_1,
           round(mean_speed - l2, 6) as delta_speed_2, "intTot" - q1 as delta_vol_1, round((mean_speed - l1) / 60, 6) as accel_speed, round(s2, 6) as speed_std_2,
           round(s4, 6) as speed_std_4, round(m4, 9) as speed_mean_4, round(qs2, 6) as vol_std_2, round(s2 / greatest(abs(mean_speed), 0.001), 6) as speed_cv_2,
           round(qs2 / greatest(abs("intTot"), 0.001), 4) as vol_cv_2, round(hv, 6) as hv_fraction,
           round(lag(hv) over (partition by via, sen, pk order by dat), 6) as hv_fraction_lag1,
           round(gu, 6) as speed_grad_up, round(gd, 6) as speed_grad_dn, qu as vol_grad_up,
           round((mean_speed - vm) / greatest(coalesce(vs, 0.001), 0.001), 6) as speed_zscore,
           coalesce(cast((mean_speed - vm) / greatest(coalesce(vs, 0.001), 0.001) < -1.5 as integer), 0) as speed_pct_below_normal,
           round(("intTot" - qm) / greatest(coalesce(qs, 0.001), 0.001), 6) as vol_zscore, round(coalesce(rate, 0), 6) as pk_crash_rate,
           round(ln(1 + coalesce(rate, 0)), 6) as pk_crash_rate_log, round(coalesce(rate_mob, 0), 6) as pk_crash_rate_mob,
           case when mean_speed > 0.85 * v_ff then 0 when mean_speed > 0.70 * v_ff then 1 else 2 end as flow_regime,
           round("intTot" / greatest(abs(mean_speed), 0.001), 6) as occ_proxy, round(ang_curv * mean_speed, 6) as curv_x_speed,
           round(greatest(abs(ang_pend_pos), abs(ang_pend_neg)) * mean_speed, 6) as pend_x_speed, round(ang_curv * (mean_speed - l1), 6) as curv_x_delta_speed,
           cast(hor in (7, 8, 9, 17, 18, 19, 20) as integer) as is_peak_hour, round(sin(2 * pi() * hor / 24), 6) as hor_sin,
           round(cos(2 * pi() * "diaSem" / 7), 6) as "diaSem_cos", round(sin(2 * pi() * mes / 12), 6) as mes_sin,
           cast(precip > 0.1 as integer) as is_raining, cast(precip > 2.5 as integer) as is_heavy_rain, cast(temp between -2 and 2 as integer) as temp_near_freezing,
           cast(cloud > 80 and precip > 0.1 as integer) as low_visibility_proxy, gust - wind as wind_gust_excess, round(precip - precip3, 6) as precip_change_1d_vs_3d,
           cast(precip > 0.1 as integer) * abs(ang_curv) as wet_curve_risk, cast(precip > 0.1 as integer) * abs(ang_pend_neg) as wet_descent_risk,
           round(cast(precip > 0.1 as integer) * mean_speed, 6) as wet_speed, cast(temp between -2 and 2 as integer) * abs(ang_curv) as cold_curve_risk
    from x left join b using (pk, hor, "diaSem") left join bm using (pk, hor, "diaSem", mob_esp) left join ff using (pk)"""))
def w21(spark, d):
    out = feature_frame(spark, d).select("pk", "sen", "dat", *FEATURES)
    out = rounded(out, *[c for c in FEATURES if c not in WHOLE | {"speed_mean_4", "vol_cv_2", "wet_curve_risk", "wet_descent_risk", "cold_curve_risk", "wind_gust_excess"}])
    return rounded(rounded(out, "speed_mean_4", digits=9), "vol_cv_2", digits=4)


@query("w22_covariate_features", sql("road", f"""
    , b as (select pk, hor, "diaSem", avg(temp) as tm, stddev_samp(temp) as ts, avg(gust) as gm, stddev_samp(gust) as gs from road where dat < timestamp '{CUT}' group by all),
    x as (select *, lag(temp, 1) over l as t1, lag(temp, 4) over l as t4, lag(gust, 1) over l as g1,
             avg(temp) over (partition by via, sen, pk order by dat rows between 11 preceding and current row) as tm12,
             stddev_samp(temp) over (partition by via, sen, pk order by dat rows between 11 preceding and current row) as ts12,
             stddev_samp(gust) over (partition by via, sen, pk order by dat rows between 3 preceding and current row) as gs4
          from road window l as (partition by via, sen, pk order by dat))
    select pk, sen, dat, round(t1, 6) as cov_temp_lag1, round(t4, 6) as cov_temp_lag4, round(temp - t1, 6) as cov_temp_d1, round(gust - g1, 6) as cov_gust_d1,
           round(tm12, 6) as cov_temp_mean_12, round(ts12, 6) as cov_temp_std_12, round(gs4, 6) as cov_gust_std_4,
           round((temp - tm) / greatest(coalesce(ts, 0.001), 0.001), 6) as cov_temp_zscore, round((gust - gm) / greatest(coalesce(gs, 0.001), 0.001), 6) as cov_gust_zscore,
           round(sin(2 * pi() * dayofyear(dat) / 365.25), 6) as cov_doy_sin, round(cos(2 * pi() * dayofyear(dat) / 365.25), 6) as cov_doy_cos,
           cast("diaSem" >= 5 as integer) as cov_is_weekend from x left join b using (pk, hor, "diaSem")"""))
def w22(spark, d):
    out = W.build_covariate_features(road(spark, d), ["via", "sen", "pk"], "dat", ["temp", "gust"], ["pk", "hor", "diaSem"], "diaSem", CUT)
    names = ["cov_temp_lag1", "cov_temp_lag4", "cov_temp_d1", "cov_gust_d1", "cov_temp_mean_12", "cov_temp_std_12", "cov_gust_std_4",
             "cov_temp_zscore", "cov_gust_zscore", "cov_doy_sin", "cov_doy_cos"]
    return rounded(out.select("pk", "sen", "dat", *names, "cov_is_weekend"), *names)
