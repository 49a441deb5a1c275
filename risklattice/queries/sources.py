"""Queries of the scan, source and sink family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import predictions as P
from ..sources import tables as S
from . import views as V
from .oracle import sql
from .registry import query
from .views import r6

LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_shipdate"
SCHEMA = (
    "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_returnflag string, l_shipdate timestamp_ntz"
)


def _lines(spark, d):
    return V.table(spark, d, "lineitem").select(*[c.strip() for c in LINES.split(",")])


@query("s01_read_table", f"select {LINES} from lineitem")
def s01(spark, d):
    path = scratch_path(spark, "lines-csv")
    S.write_csv(_lines(spark, d), path)
    return S.read_table(spark, path, SCHEMA)


@query("s02_scan_lattice", f"""select {LINES} from lineitem where l_quantity between 10 and 20
    and l_shipdate >= timestamp '1997-01-01' and l_shipdate < timestamp '1998-01-01'""")
def s02(spark, d):
    out = S.scan_lattice(spark, f"{d}/lineitem.parquet", "l_quantity", (10, 20), "l_shipdate", ("1997-01-01", "1998-01-01"))
    return out.select(*[c.strip() for c in LINES.split(",")])


@query("s03_scan_columns", "select l_orderkey, l_discount from lineitem where l_shipdate < timestamp '1996-01-01'")
def s03(spark, d):
    return S.scan_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_discount"],
                          F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))


@query("s04_out_of_core", """select l_returnflag, count(*) as n, cast(sum(l_linenumber) as bigint) as lines
    from lineitem where l_shipdate >= timestamp '1996-01-01' group by 1""")
def s04(spark, d):
    scan = S.scan_columns(spark, f"{d}/lineitem.parquet", ["l_returnflag", "l_linenumber"],
                          F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return scan.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("s05_normalise_columns", """select event_id, cast(year(ts) as integer) as anyo, cast(minute(ts) // 15 * 15 as integer) as "15min",
    cast(minute(ts) // 15 * 15 as integer) as min, cast(minute(ts) // 15 * 15 // 5 * 5 as integer) as "5min" from events""")
def s05(spark, d):
    raw = V.table(spark, d, "events").select(
        "event_id", F.year("ts").alias("Any"), (F.floor(F.minute("ts") / 15) * 15).cast("int").alias("15min"))
    return S.normalise_columns(raw, 5)


def _store_rows(spark, d):
    return V.long_scores(spark, d).select(
        F.col("pos").alias("pk"), F.col("dir").alias("sen"), F.col("ts").alias("dat"), "y",
        F.col("score").alias("prob"), (F.col("score") >= 0.5).cast("int").alias("pred_binary"),
        F.col("model").alias("model_key"))


@query("s06_prediction_store", sql("long_scores", """
    select cast(pos as integer) as pk, cast(dir as integer) as sen, ts as dat, cast(y as tinyint) as y,
           round(cast(cast(score as float) as double), 6) as prob,
           cast(case when score >= 0.5 then 1 else 0 end as tinyint) as pred_binary, model as model_key
    from long_scores where model = 'pb'"""))
def s06(spark, d):
    path = scratch_path(spark, "predictions")
    P.write_predictions(_store_rows(spark, d), path)
    out = P.read_predictions(spark, path, "pb")
    return out.withColumn("prob", F.round(F.col("prob").cast("double"), 6))


@query("s07_write_csv", sql("scores", "select day, count(*) as n, cast(sum(y) as bigint) as pos from scores group by day"))
def s07(spark, d):
    path = scratch_path(spark, "daily-csv")
    daily = V.scores(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    S.write_csv(daily, path)
    return spark.read.schema("day date, n long, pos long").option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)


@query("s08_read_registry", sql("registry", """
    select key, contrast, label, gnn, is_proposed, proposed_key, role from registry"""))
def s08(spark, d):
    path = scratch_path(spark, "registry")
    rows = V.registry(spark, d).select("key", "contrast", "label", "gnn", "is_proposed", "proposed_key", "role")
    listed = rows.groupBy(F.expr("cast(substr(key, 2) as bigint) div 50")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    listed.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return P.read_registry(spark, path).select(*rows.columns)


@query("s09_select_run", """
    with runs as (select o_custkey % 50 as key, o_orderkey,
        case when o_orderkey % 7 = 0 then 'simulation_benchmark_' || o_orderkey
             when o_orderkey % 7 = 1 then 'simulation_' || o_orderkey || '_win' || strftime(o_orderdate, '%Y%m%d') || strftime(o_orderdate + interval 90 day, '%Y%m%d')
             else 'simulation_' || o_orderkey || '_tr' || strftime(o_orderdate - interval 300 day, '%Y%m%d') || '-' || strftime(o_orderdate, '%Y%m%d')
                  || '_sim' || strftime(o_orderdate, '%Y%m%d') || '-' || strftime(o_orderdate + interval (o_orderkey % 200) day, '%Y%m%d') end as name from orders),
    dated as (select *, regexp_extract(name, '_tr(\\d{8})-(\\d{8})_sim(\\d{8})-(\\d{8})$', 1) as a1,
        coalesce(nullif(regexp_extract(name, '_tr(\\d{8})-(\\d{8})_sim(\\d{8})-(\\d{8})$', 3), ''), nullif(regexp_extract(name, '_win(\\d{8})_?(\\d{8})$', 1), '')) as s,
        coalesce(nullif(regexp_extract(name, '_tr(\\d{8})-(\\d{8})_sim(\\d{8})-(\\d{8})$', 4), ''), nullif(regexp_extract(name, '_win(\\d{8})_?(\\d{8})$', 2), '')) as e from runs),
    c as (select *, case when coalesce(s <= '19970601' and e >= '19970701', false) then 1 else 0 end as covers from dated)
    select key, name, nullif(a1, '') as tr_start, s as sim_start, e as sim_end, covers
    from (select *, row_number() over (partition by key order by covers desc,
        case when covers = 1 then cast(e as bigint) - cast(s as bigint) end nulls last,
        case when covers = 1 then name end nulls last, name desc) as rn from c) where rn = 1""")
def s09(spark, d):
    day = F.col("o_orderdate")
    stamp = F.col("o_orderkey").cast("string")

    def plus(days):
        return F.date_add(F.to_date(day), days)

    name = (
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("simulation_benchmark_"), stamp))
        .when(F.col("o_orderkey") % 7 == 1, F.concat(
            F.lit("simulation_"), stamp, F.lit("_win"), F.date_format(day, "yyyyMMdd"), F.date_format(plus(90), "yyyyMMdd")))
        .otherwise(P.run_name(F.lit("simulation"), stamp, [
            plus(-300), day, day, plus((F.col("o_orderkey") % 200).cast("int"))])))
    runs = V.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("key"), name.alias("name"))
    return P.select_run(runs, ["key"], "name", "19970601", "19970701").select(
        "key", "name", "tr_start", "sim_start", "sim_end", "covers")


@query("s10_latest_per_key", """
    select pos, channel, event_id, stale from (select user_id as pos, event_type as channel, event_id, coalesce(value > 50, true) as stale,
           row_number() over (partition by user_id, event_type order by case when ts >= timestamp '2024-01-15' then 1 else 0 end desc, value desc, event_id desc) as rn
    from events) where rn = 1""")
def s10(spark, d):
    runs = V.table(spark, d, "events").select(
        F.col("user_id").alias("pos"), F.col("event_type").alias("channel"), "event_id", "value",
        F.expr("case when ts >= timestamp_ntz'2024-01-15' then 1 else 0 end").alias("after_fix"), F.lit(50.0).alias("stored"))
    out = P.latest_per_key(runs, ["pos", "channel"], ["after_fix", "value", "event_id"])
    return out.select("pos", "channel", "event_id", P.is_stale("stored", "value").alias("stale"))


@query("s11_store_manifest", sql("long_scores", """
    select model as model_key, count(*) as n_rows, min(ts) as date_min, max(ts) as date_max,
           count(*) filter (ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20') as eval_rows,
           cast(sum(y) filter (ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20') as bigint) as eval_pos
    from long_scores group by 1"""))
def s11(spark, d):
    return P.store_manifest(_store_rows(spark, d), "2024-01-10", "2024-01-20")
