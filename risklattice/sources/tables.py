"""Delimited and Parquet tables with explicit schemas and pushed filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Column names under which inputs carry the interval, finest first.
INTERVAL_COLUMNS = ("5min", "10min", "15min", "30min", "45min", "60min")
YEAR_ALIASES = {"Any": "anyo"}


def read_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    drop_malformed: bool = True,
) -> DataFrame:
    """Delimited text with a header; rows that do not fit the schema are skipped."""
    return (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("encoding", encoding)
        .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE")
        .schema(schema)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> None:
    """Delimited text with a header, one file per partition."""
    df.write.option("sep", sep).option("header", True).option("encoding", encoding).csv(path)


def scan_lattice(
    spark: SparkSession,
    path: str,
    pos: str | None = None,
    pos_range: tuple[float, float] | None = None,
    ts: str | None = None,
    date_range: tuple[str, str] | None = None,
) -> DataFrame:
    """Parquet scan with a closed position range and a half-open date range.

    The conditions are on raw columns, so they reach the row groups.
    """
    df = spark.read.parquet(path)
    if pos_range is not None:
        df = df.filter((F.col(pos) >= pos_range[0]) & (F.col(pos) <= pos_range[1]))
    if date_range is not None:
        low, high = (F.lit(x).cast(df.schema[ts].dataType) for x in date_range)
        df = df.filter((F.col(ts) >= low) & (F.col(ts) < high))
    return df


def scan_columns(spark: SparkSession, path: str, cols: Sequence[str], predicate: Column | None = None) -> DataFrame:
    """Selected columns of the rows that meet a predicate. Large files are split
    by Spark, so chunked reading needs nothing else."""
    df = spark.read.parquet(path)
    return (df if predicate is None else df.filter(predicate)).select(*cols)


def normalise_columns(df: DataFrame, resolution: int = 5, ts: str | None = None) -> DataFrame:
    """Usual names: year as ``anyo``, a ``min`` column, and ``<resolution>min``.

    The minute comes from ``min``, else the first interval column present, else
    the timestamp, else 0.
    """
    for alias, name in YEAR_ALIASES.items():
        if alias in df.columns:
            df = df.withColumnRenamed(alias, name)
    if "min" not in df.columns:
        found = next((c for c in INTERVAL_COLUMNS if c in df.columns), None)
        if found:
            minute = F.col(found)
        elif ts and ts in df.columns:
            minute = F.minute(ts)
        else:
            minute = F.lit(0)
        df = df.withColumn("min", minute.cast("int"))
    step = f"{resolution}min"
    if step not in df.columns:
        df = df.withColumn(step, (F.floor(F.col("min") / resolution) * resolution).cast("int"))
    return df
