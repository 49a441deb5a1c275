"""Small helpers that several operators of this package use."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(*parts: Column) -> Column:
    """A 52-bit number from the MD5 of the parts; null counts as a value of its own. Other engines can compute it too."""
    spelled = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *spelled)), 1, 13), 16, 10).cast("long")


def row_id(df: DataFrame) -> Column:
    """A name for each row, never null, by its doc_id and a hash of all its columns: rows of one name are copies."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64(*[F.col(c) for c in df.columns])))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_total(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], size: str, out: str, coarse: int = 1024) -> DataFrame:
    """Sum of ``size`` over all earlier rows of the group, where order is (bucket, *order); buckets are numbers.

    No group is sorted in one task: rows add up inside their bucket, buckets inside blocks of ``coarse``, and the blocks'
    totals give each block its start.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(size).alias("total__"))
    if coarse:  # the buckets are numbers, and many: they are added up in blocks first
        blocks = totals.withColumn("block__", F.floor(F.col(bucket) / coarse))
        starts = running_total(blocks, group, "block__", [bucket], "total__", "begin__", coarse=0)
        starts = starts.select(*[F.col(k).alias(f"{k}__") for k in keys], F.col("begin__").alias("start__"))
    else:
        before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.withColumn("start__", F.coalesce(F.sum("total__").over(before), F.lit(0)))
        starts = starts.select(*[F.col(k).alias(f"{k}__") for k in keys], "start__")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("own__", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys])
    return own.join(starts, same).withColumn(out, (F.col("start__") + F.col("own__")).cast("long")).drop("own__", "start__", *[f"{k}__" for k in keys])
