"""Orders, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical(df: DataFrame, loc: Sequence[str], ts: str) -> DataFrame:
    """Location first, then time. For sinks only: operators never rely on row order."""
    return df.orderBy(*loc, ts)


def time_major(df: DataFrame, ts: str, loc: Sequence[str]) -> DataFrame:
    """Time first, then location. For sinks only."""
    return df.orderBy(ts, *loc)


def top_k(df: DataFrame, value: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest value; ``k`` is the size of a report."""
    return df.orderBy(F.col(value).desc(), *ties).limit(k)


def best_row(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], where: Column | None = None
) -> DataFrame:
    """First row per group among those that meet ``where``."""
    kept = df if where is None else df.filter(where)
    window = Window.partitionBy(*by).orderBy(*order)
    return kept.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows by column name; columns a frame lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Keys present in every frame."""
    return reduce(lambda a, b: a.intersect(b), [f.select(*keys) for f in frames])


def missing_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order (a group limit is applied map-side)."""
    return best_row(df, keys, [F.col(o) for o in order])


def dedup_prefer(
    df: DataFrame, keys: Sequence[str], prefer: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One whole row per key: highest of each preference in turn, then ``order``."""
    return best_row(df, keys, [*[F.col(p).desc_nulls_last() for p in prefer], *[F.col(o) for o in order]])
