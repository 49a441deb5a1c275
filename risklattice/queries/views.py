"""The inputs of FIXTURES.md part B, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import dealt
from ..functions.timeparts import hour_start
from ..operators import joins

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
LOC = ["dir", "pos"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def located(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.expr("user_id div 2").alias("pos"),
        F.expr("cast(user_id % 2 as int)").alias("dir"),
        "event_id",
        "ts",
        "event_type",
        "value",
    )


def seg(spark: SparkSession, d: str) -> DataFrame:
    return located(spark, d).select("pos", "dir").distinct()


def lattice(spark: SparkSession, d: str) -> DataFrame:
    return joins.build_lattice(seg(spark, d), START, END, 60, ts="t")


def fact(spark: SparkSession, d: str) -> DataFrame:
    return (
        located(spark, d)
        .groupBy("pos", "dir", hour_start("ts").alias("t"))
        .agg(
            F.count(F.lit(1)).alias("flow"),
            (F.sum(money("value")).cast("double") / F.count(F.lit(1))).alias("speed"),
            F.sum((F.col("event_type") == "purchase").cast("long")).alias("heavy"),
            F.max((F.col("event_type") == "error").cast("int")).alias("label"),
        )
    )


def hour_index(ts: str = "t") -> Column:
    return F.expr(f"(unix_date(to_date({ts})) - 19723) * 24L + hour({ts})")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Lattice with measures: flow and label 0 where nothing was seen, speed null."""
    joined = joins.attach_labels(
        dealt(lattice(spark, d), [*LOC, "t"]), fact(spark, d), [*LOC, "t"], ["label", "flow", "heavy"]
    )
    return joined.select(
        "pos",
        "dir",
        "t",
        "flow",
        "heavy",
        "speed",
        "label",
        F.hour("t").alias("hour"),
        F.weekday("t").alias("dow"),
        hour_index().alias("hidx"),
    )


def traffic(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a speed ``v`` everywhere: a fixed pattern fills what was not seen."""
    return cells(spark, d).withColumn(
        "v", F.coalesce("speed", F.expr("cast(40 + (pos * 37 + hidx * 11) % 97 as double)"))
    )


def hourly_weather(spark: SparkSession, d: str) -> DataFrame:
    """Weather by hour: a row per instant of the fixed range, however many locations there are, so joins broadcast it."""
    hours = lattice(spark, d).select("t").distinct().withColumn("i", hour_index())
    return F.broadcast(hours).select(
        "t",
        F.expr("cast(i % 17 as double) / 10").alias("precip"),
        F.expr("10 + cast(i % 24 as double) / 2 - cast(i % 53 as double) / 3").alias("temp"),
        F.expr("cast(i % 40 as double)").alias("gust"),
        F.expr("cast(i % 31 as double)").alias("wind"),
        F.expr("cast(i % 101 as double)").alias("cloud"),
        F.expr("cast(i % 13 as double) / 10").alias("precip3"),
    )


def scores(spark: SparkSession, d: str) -> DataFrame:
    return located(spark, d).select(
        "event_id",
        "pos",
        "dir",
        "ts",
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
        F.weekday("ts").alias("dow"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        (F.col("value") / 500.0).alias("pa"),
        F.expr("cast((event_id * 7919) % 1009 as double) / 1009").alias("pb"),
        F.expr("cast((event_id * 104729) % 997 as double) / 997").alias("pc"),
    )


def long_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).selectExpr(
        "event_id", "pos", "dir", "ts", "day", "hour", "y",
        "stack(3, 'pa', pa, 'pb', pb, 'pc', pc) as (model, score)",
    )


def detector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        (F.col("l_quantity") + F.col("l_discount")).alias("x"),
        F.col("l_linestatus").alias("dir"),
        F.col("l_shipdate").alias("t"),
        (F.col("l_extendedprice") / 100).alias("q"),
        (F.col("l_extendedprice") / 100 * F.col("l_tax")).alias("qh"),
    )


def section(spark: SparkSession, d: str) -> DataFrame:
    """Touching closed sections [10k, 10k+10] that cover the positions present."""
    spans = table(spark, d, "lineitem").select(F.expr("cast(floor(l_quantity / 10) as int)").alias("k"))
    return spans.distinct().select(
        "k", F.expr("cast(10 * k as double)").alias("lo"), F.expr("cast(10 * k + 10 as double)").alias("hi")
    )


def dups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("special"))
    )


def geometry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"),
        F.expr("nullif(p_retailprice - 1000, 0)").alias("radius"),
        F.expr("cast(p_partkey % 21 - 10 as double)").alias("up"),
        F.expr("-cast(p_partkey % 21 - 10 as double)").alias("down"),
        F.expr("cast(p_partkey % 100 as double) / 10").alias("post"),
    )


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Run registry with one entry per supplier, and one without scores per nation; contrasts by nation."""
    base = table(spark, d, "supplier").select(
        F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("key"),
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("C"), F.expr("cast(s_nationkey % 4 as string)")).alias("contrast"),
        F.concat(F.lit("arm "), F.col("s_name")).alias("label"),
        F.expr("concat('g', cast(s_suppkey % 7 as string))").alias("gnn"),
        F.expr("cast(s_suppkey % 9 as int)").alias("arch"),
        F.expr("s_suppkey % 2 = 0").alias("active_graph"),
        F.expr(
            "case s_suppkey % 11 when 3 then 'excluded' when 5 then 'data_quantity' end"
        ).alias("role"),
    )
    pending = table(spark, d, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"),
        (F.lit(1_000_000_000) + F.col("n_nationkey")).cast(base.schema["id"].dataType).alias("id"),
        F.concat(F.lit("C"), F.expr("cast(n_nationkey % 4 as string)")).alias("contrast"),
        F.concat(F.lit("arm "), F.col("n_name")).alias("label"),
        F.expr("concat('g', cast(n_nationkey % 7 as string))").alias("gnn"),
        F.expr("cast(n_nationkey % 9 as int)").alias("arch"),
        F.expr("n_nationkey % 2 = 0").alias("active_graph"),
        F.lit(None).cast("string").alias("role"),
    )
    base = base.unionByName(pending)
    lead = base.groupBy("contrast").agg(F.min("id").alias("lead_id"))
    return base.join(lead, "contrast").select(
        *base.columns,
        (F.col("id") == F.col("lead_id")).alias("is_proposed"),
        F.concat(F.lit("M"), F.col("lead_id").cast("string")).alias("proposed_key"),
    )


def arm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored cells per registry entry: a supplier's lines. Nations' entries have none."""
    return (
        table(spark, d, "lineitem")
        .select(
            F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("key"),
            (F.col("l_returnflag") == "R").cast("int").alias("y"),
            F.expr("cast((l_orderkey * 31 + l_partkey * 17) % 1000 as double) / 1000").alias("score"),
            F.expr("cast(l_quantity > 40 as int)").alias("pred"),
            F.to_date("l_shipdate").alias("day"),
        )
    )


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(
        "doc_id", F.col("toxic").alias("y"), (1 - F.col("quality")).alias("pred")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.expr("transform(embedding, x -> cast(x as double))").alias("vec"),
        (F.col("label") == 0).cast("int").alias("y"),
    )
