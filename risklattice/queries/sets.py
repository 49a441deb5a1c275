"""Queries of orders, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets as T
from . import views as V
from .oracle import sql
from .registry import query
from .views import LOC, r6


@query("t01_canonical", sql("cells", "select dir, pos, t, flow, label from cells"))
def t01(spark, d):
    return T.canonical(V.cells(spark, d).select("dir", "pos", "t", "flow", "label"), LOC, "t")


@query("t02_time_major", sql("cells", "select t, pos, dir, flow from cells"))
def t02(spark, d):
    return T.time_major(V.cells(spark, d).select("t", "pos", "dir", "flow"), "t", ["pos", "dir"])


@query("t03_top_k", sql("scores", "select event_id, round(pb, 6) as pb from scores order by scores.pb desc, event_id limit 25"))
def t03(spark, d):
    return T.top_k(V.scores(spark, d), "pb", 25, ["event_id"]).select("event_id", r6("pb").alias("pb"))


@query("t04_best_row", sql("scores", """
    select pos, dir, event_id, round(pa, 6) as pa from (select *, row_number() over
           (partition by pos, dir order by pa desc, event_id) as rn from scores where pb >= 0.5) where rn = 1"""))
def t04(spark, d):
    out = T.best_row(V.scores(spark, d), ["pos", "dir"], [F.col("pa").desc(), F.col("event_id")], F.col("pb") >= 0.5)
    return out.select("pos", "dir", "event_id", r6("pa").alias("pa"))


@query("t05_union", sql("scores", """
    select event_id, 'early' as part, round(pa, 6) as pa, null as pb from scores where day < date '2024-01-10'
    union all select event_id, 'late', null, round(pb, 6) from scores where day >= date '2024-01-20'"""))
def t05(spark, d):
    s = V.scores(spark, d)
    early = s.filter("day < date'2024-01-10'").select("event_id", F.lit("early").alias("part"), r6("pa").alias("pa"))
    late = s.filter("day >= date'2024-01-20'").select("event_id", F.lit("late").alias("part"), r6("pb").alias("pb"))
    return T.union([early, late])


@query("t06_common_keys", """
    select cast(o_orderdate as date) as day from orders intersect select cast(l_shipdate as date) from lineitem""")
def t06(spark, d):
    a = V.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    b = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return T.common_keys([a, b], ["day"])


@query("t07_missing_keys", sql("registry arm_scores", """
    select distinct key from registry where key not in (select key from arm_scores)"""))
def t07(spark, d):
    return T.missing_keys(V.registry(spark, d), V.arm_scores(spark, d), ["key"])
