"""Queries of filters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as FL
from . import views as V
from .oracle import sql
from .registry import query
from .views import LOC


@query("f01_between_dates", sql("scores", "select event_id from scores where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'"))
def f01(spark, d):
    return FL.between_dates(V.scores(spark, d), "ts", "2024-01-05", "2024-01-12").select("event_id")


@query("f02_between_pos", sql("detector", "select orderkey, line, partkey, x from detector where x between 10.02 and 20.05"))
def f02(spark, d):
    return FL.between_pos(V.detector(spark, d), "x", 10.02, 20.05).select("orderkey", "line", "partkey", "x")


@query("f03_filter_windows", sql("scores", """
    select event_id, 'once' as form, case when ts < timestamp '2024-01-10' then 0 else 1 end as window_id from scores
    where (ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-10') or (ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-15')
    union all select event_id, 'each', 0 from scores where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-10'
    union all select event_id, 'each', 1 from scores where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-15'"""))
def f03(spark, d):
    s = V.scores(spark, d).select("event_id", "ts")
    windows = [("2024-01-03", "2024-01-10"), ("2024-01-08", "2024-01-15")]
    once = FL.filter_windows(s, "ts", windows, "window_id").withColumn("form", F.lit("once"))
    each = FL.filter_windows(s, "ts", windows, "window_id", repeat=True).withColumn("form", F.lit("each"))
    return once.unionByName(each).select("event_id", "form", "window_id")


@query("f04_drop_warmup", sql("fact", """
    select pos, dir, t from (select *, row_number() over (partition by pos, dir order by t) as rn from fact) where rn > 12 and speed >= 0"""))
def f04(spark, d):
    return FL.drop_warmup(V.fact(spark, d), LOC, "t", 12, "speed").select("pos", "dir", "t")


BOUNDARY_SQL = """
    with w as (select year(o_orderdate) as y, min(o_orderdate) as a, max(o_orderdate) as b from orders group by 1),
    c as (select *, sum(epoch(b) - epoch(a)) over (order by a rows unbounded preceding) as cum, epoch(b) - epoch(a) as len,
          sum(epoch(b) - epoch(a)) over () * 0.8 as target from w)
    select date_trunc('day', a + to_seconds(cast(target - cum + len as bigint))) as boundary from c where cum >= target order by cum limit 1"""


@query("f05_resolve_boundary", BOUNDARY_SQL)
def f05(spark, d):
    windows = V.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return FL.resolve_boundary(windows, "a", "b", 0.8)


@query("f06_split_by_time", sql("scores", """
    select event_id, case when ts < timestamp '2024-01-25' then 'train' else 'test' end as side from scores"""))
def f06(spark, d):
    train, test = FL.split_by_time(V.scores(spark, d), "ts", "2024-01-25", check=True)
    return train.select("event_id", F.lit("train").alias("side")).unionByName(test.select("event_id", F.lit("test").alias("side")))


@query("f07_split_tail_days", """
    with days as (select cast(l_shipdate as date) as day, count(*) as n from lineitem group by 1),
    h as (select day, coalesce(sum(n) over (order by day desc rows between unbounded preceding and 1 preceding), 0) < sum(n) over () * 0.2 as held from days)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(held as integer) as held, 'days' as rule from lineitem join h on cast(l_shipdate as date) = day""")
def f07(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return FL.split_tail_days(rows, "l_shipdate", 0.2).drop("l_shipdate")


@query("f08_split_per_location", sql("fact", """
    select pos, dir, t, cast(row_number() over (partition by pos, dir order by t) <= floor(count(*) over (partition by pos, dir) * 0.8) as integer) as train from fact"""))
def f08(spark, d):
    return FL.split_per_location(V.fact(spark, d), LOC, "t", 0.8).select("pos", "dir", "t", "train")


@query("f09_time_folds", """
    select event_id, cast(least(3, floor((rank() over (order by ts) - 1) * 4 / cast(count(*) over () as double))) as integer) as fold from events""")
def f09(spark, d):
    return FL.time_folds(V.table(spark, d, "events"), "ts", 3).select("event_id", "fold")


@query("f10_split_quantile", """
    select event_id, cast(epoch_us(ts) <= (select quantile_cont(epoch_us(ts), 0.8) from events) as integer) as train from events""")
def f10(spark, d):
    return FL.split_quantile(V.table(spark, d, "events"), "ts", 0.8).select("event_id", "train")


@query("f11_split_three", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when s < 0.7 then 'train' when s < cast(0.7 as double) + cast(0.1 as double) then 'calibration' else 'test' end as part
    from (select *, (rank() over (order by l_shipdate) - 1) / cast(count(*) over () as double) as s from lineitem)""")
def f11(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return FL.split_three(rows, "l_shipdate").drop("l_shipdate")


@query("f12_split_tail_or_stratified", sql("scores", """
    , r as (select event_id, y, (rank() over (order by ts) - 1) >= floor(count(*) over () * 0.8) as tail,
            row_number() over (partition by y order by (event_id % 4294967296 * 2654435761::hugeint + 42 * 40503) % 4294967296)
              <= round_even(count(*) over (partition by y) * 0.2, 0) as pick from scores)
    select event_id, 'tail' as kind, cast(tail as integer) as held from r
    union all select event_id, 'class', cast(pick as integer) from r"""))
def f12(spark, d):
    s = V.scores(spark, d).select("event_id", "ts", "y")
    tail = FL.split_tail_or_stratified(s, "ts", "event_id", "y", 0.2, 2)
    poor = FL.split_tail_or_stratified(s, "ts", "event_id", "y", 0.2, 10**12)
    return tail.select("event_id", "held", F.col("rule").alias("kind")).unionByName(poor.select("event_id", "held", F.col("rule").alias("kind")))
