"""Queries of the projection and encoder family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import projections as P
from . import views as V
from .oracle import sql
from .registry import query
from .views import LOC, r6


@query("p01_encode", """select l_orderkey, l_linenumber, l_partkey, case l_linestatus when 'F' then 0 when 'O' then 1 else 1 end as l_linestatus,
    case l_returnflag when 'A' then 7 when 'R' then 9 else 5 end as l_returnflag from lineitem""")
def p01(spark, d):
    lines = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")
    out = P.encode(lines, "l_linestatus", {"F": 0, "O": 1}, 1)
    return P.encode(out, "l_returnflag", {"A": 7, "R": 9}, 5)


@query("p02_make_dat", "select event_id, date_trunc('minute', ts) as dat from events")
def p02(spark, d):
    parts = V.table(spark, d, "events").select(
        "event_id", F.year("ts").alias("anyo"), F.lpad(F.month("ts").cast("string"), 2, "0").alias("mes"),
        F.day("ts").alias("dia"), F.hour("ts").alias("hor"), F.minute("ts").cast("string").alias("min"))
    return P.make_dat(parts, "anyo", "mes", "dia", "hor", "min").select("event_id", "dat")


@query("p03_calendar_parts", """select event_id, cast(year(ts) as integer) as anyo, cast(month(ts) as integer) as mes, cast(day(ts) as integer) as dia,
    cast(isodow(ts) - 1 as integer) as "diaSem", cast(hour(ts) as integer) as hor, cast(minute(ts) // 5 * 5 as integer) as "5min" from events""")
def p03(spark, d):
    return P.calendar_parts(V.table(spark, d, "events").select("event_id", "ts"), "ts").drop("ts")


@query("p04_slot_to_minute", "select event_id, cast(minute(ts) // 5 * 5 as integer) as slots, cast(minute(ts) // 5 * 5 as integer) as minutes from events")
def p04(spark, d):
    raw = V.table(spark, d, "events").select(
        "event_id", F.floor(F.minute("ts") / 5).alias("slots"), F.minute("ts").alias("minutes"))
    return P.slot_to_minute(P.slot_to_minute(raw, "slots", "slot"), "minutes", "minute")


@query("p05_standardise_types", """select l_orderkey, l_linenumber, l_partkey, cast(trunc(l_quantity * 1.3) as integer) as q,
    round_even(l_tax * 1.37, 3) as tax from lineitem""")
def p05(spark, d):
    raw = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.expr("l_quantity * 1.3D").alias("q"), F.expr("l_tax * 1.37D").alias("tax"))
    return P.standardise_types(raw, ["q"], {"tax": 3})


@query("p06_trunc_pos", sql("detector geometry", """
    select partkey, cast(trunc(post) as integer) as pos, cast(floor(round(post * 10, 4)) as integer) % 10 as tenth from geometry"""))
def p06(spark, d):
    return V.geometry(spark, d).select("partkey", P.trunc_pos("post").alias("pos"), P.first_decimal("post").alias("tenth"))


@query("p07_feature_matrix", """select o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1) || case when o_orderkey % 3 = 0 then 'x' else '' end as double), 0) as prio,
    o_totalprice as price, cast(0 as double) as absent from orders""")
def p07(spark, d):
    raw = V.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"),
        F.expr("concat(substr(o_orderpriority, 1, 1), case when o_orderkey % 3 = 0 then 'x' else '' end)").alias("prio"))
    return P.feature_matrix(raw, ["prio", "price", "absent"], ["o_orderkey"])


@query("p08_severity", "select l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_tax, 6) as sev from lineitem")
def p08(spark, d):
    out = P.severity(V.table(spark, d, "lineitem"), "l_quantity", "l_tax", "sev")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r6("sev").alias("sev"))


@query("p09_light_share", sql("cells", """
    select pos, dir, t, flow - heavy as light, round((flow - heavy) / greatest(abs(flow), 0.001), 6) as light_share from cells"""))
def p09(spark, d):
    out = P.light_share(V.cells(spark, d), "flow", "heavy")
    return out.select("pos", "dir", "t", "light", r6("light_share").alias("light_share"))


@query("p10_select_features", sql("traffic", "select pos, dir, t, hour, flow, cast(label as double) / 2 as s1_score from traffic"))
def p10(spark, d):
    cells = V.traffic(spark, d).withColumn("s1_score", F.col("label") / 2)
    features = ["hour", "dow", "v", "flow", "heavy", "hidx"]
    kept = P.select_features(features, drop=["heavy"], whitelist=["hour", "flow", "hidx", "heavy"],
                             keep_only=["hour"], prefixes=["fl"], extra=["s1_score"])
    blocks = P.split_blocks(["pk_crash_rate", "ang_curv", "hor_sin", "mean_speed", "flow", "zone"])
    if list(blocks) != ["site", "geometry", "calendar", "traffic", "other"]:
        raise AssertionError(blocks)
    return cells.select("pos", "dir", "t", *kept)


@query("p11_strata", sql("scores", """
    select event_id, cast((pos - (select min(pos) from scores)) // 5 * 8 + hour // 3 as bigint) as strata from scores"""))
def p11(spark, d):
    s = V.scores(spark, d)
    low = s.select(F.min("pos")).scalar()
    return s.select("event_id", P.strata("pos", "hour", low).alias("strata"))


@query("p12_load_scores", sql("scores", """
    select event_id, day, y as y_true, round(pa, 6) as y_score, case when pb > 0.5 then 1 else 0 end as y_pred
    from scores where event_id % 13 <> 0 and day >= date '2024-01-05' and day < date '2024-01-25'"""))
def p12(spark, d):
    raw = V.scores(spark, d).select(
        "event_id", "ts", F.col("y").cast("string").alias("y"),
        F.when(F.col("event_id") % 13 != 0, F.col("pa")).alias("pa"), F.col("pb").alias("pred"))
    out = P.load_scores(raw, "ts", "y", "pa", "pred", "2024-01-05", "2024-01-25")
    return out.withColumn("y_score", F.round("y_score", 6))


@query("p13_one_hot", """select distinct cast(o_orderdate as date) as day, cast(o_orderstatus = 'F' as integer) as "o_orderstatus_F",
    cast(o_orderstatus = 'O' as integer) as "o_orderstatus_O", cast(o_orderstatus = 'P' as integer) as "o_orderstatus_P" from orders""")
def p13(spark, d):
    raw = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return P.one_hot(raw, {"o_orderstatus": P.categories(raw, "o_orderstatus")}, ["day"])


@query("p14_substitute_channels", sql("traffic", """
    , l as (select *, lag(v, 72) over (partition by dir, pos order by t) as v_lag from traffic)
    select pos, dir, t, 'lagged' as mode, round(v_lag, 6) as v_in, null as v_diff from l where v_lag is not null
    union all select pos, dir, t, 'union', round(v, 6), round(flow + 1.5 - v, 6) from l"""))
def p14(spark, d):
    cells = V.traffic(spark, d).select("pos", "dir", "t", "v", (F.col("flow") + F.lit(1.5)).alias("v_hat"))
    lagged = P.substitute_channels(cells, ["v"], "lagged", LOC, "t", 72)
    union = P.substitute_channels(cells, ["v"], "union")
    return lagged.select("pos", "dir", "t", F.lit("lagged").alias("mode"), r6("v_in").alias("v_in"), F.lit(None).cast("double").alias("v_diff")).unionByName(
        union.select("pos", "dir", "t", F.lit("union").alias("mode"), r6("v_in").alias("v_in"), r6("v_diff").alias("v_diff")))


@query("p15_issue_risk", sql("scores", """
    select pos, dir, event_id, round(pc, 6) as accident_probability, case when pc >= 0.8 then 1 else 0 end as accident_pred_binary,
           y as "ACCIDENT_real", 'forecast' as mode from scores"""))
def p15(spark, d):
    out = P.issue_risk(V.scores(spark, d), ["pos", "dir", "event_id"], "pc", "y", 0.8, "forecast")
    return out.withColumn("accident_probability", F.round("accident_probability", 6))


@query("p16_instant_keys", """select event_id, cast(strftime(ts, '%Y%m%d') as bigint) as day_key,
    cast(strftime(ts, '%Y%m%d%H%M') as bigint) as instant_key from events""")
def p16(spark, d):
    parts = P.calendar_parts(V.table(spark, d, "events").select("event_id", "ts"), "ts", 1)
    return parts.select("event_id", P.day_key("anyo", "mes", "dia").alias("day_key"),
                        P.instant_key("anyo", "mes", "dia", "hor", "1min").alias("instant_key"))


@query("p17_dense_ids", """
    select k, row_number() over (order by k) - 1 as id from (select distinct l_partkey * 3 as k from lineitem union select p_partkey from part)""")
def p17(spark, d):
    a = V.table(spark, d, "lineitem").select((F.col("l_partkey") * 3).alias("k"))
    b = V.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return P.dense_ids([a, b], "k", "id")
