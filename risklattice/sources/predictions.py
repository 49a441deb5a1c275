"""The prediction store, the run registry and the choice among runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import best_row

# The store's schema and the two spellings of a run folder's dates.
STORE_SCHEMA = (
    "pk int, sen int, dat timestamp_ntz, y tinyint, prob float, pred_binary tinyint, model_key string"
)
RUN_NAME = r"_tr(\d{8})-(\d{8})_sim(\d{8})-(\d{8})$"
RUN_NAME_OLD = r"_win(\d{8})_?(\d{8})$"
REGISTRY_SCHEMA = (
    "key string, contrast string, label string, version string, kind string, gnn string, xgb string, "
    "run string, is_proposed boolean, proposed_key string, role string, paper_id string, reported_in string"
)


def write_predictions(df: DataFrame, path: str, mode: str = "error") -> None:
    """Scored cells in compact types, one directory per model, snappy.

    Rows are spread by model and day before writing, so that a large model is
    written by many tasks and no task opens a file per model.
    """
    compact = df.select(
        F.coalesce(F.col("pk"), F.lit(-1)).cast("int").alias("pk"),
        F.coalesce(F.col("sen"), F.lit(-1)).cast("int").alias("sen"),
        F.col("dat").cast("timestamp_ntz").alias("dat"),
        F.coalesce(F.col("y"), F.lit(0)).cast("tinyint").alias("y"),
        F.col("prob").cast("float").alias("prob"),
        F.coalesce(F.col("pred_binary"), F.lit(0)).cast("tinyint").alias("pred_binary"),
        "model_key",
    )
    spread = compact.repartition("model_key", F.to_date("dat")).sortWithinPartitions("model_key", "pk", "sen", "dat")
    spread.write.mode(mode).option("compression", "snappy").partitionBy("model_key").parquet(path)


def read_predictions(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The store, or one model of it (only that directory is read)."""
    df = spark.read.schema(STORE_SCHEMA).parquet(path)
    return df if key is None else df.filter(F.col("model_key") == key)


def read_registry(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """Run registry: a JSON array of objects; ``override`` replaces the file."""
    return spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(override or path)


def parse_run_name(name: str | Column) -> list[Column]:
    """tr_start, tr_end, sim_start, sim_end out of a run folder's name; null if untagged."""
    c = F.col(name) if isinstance(name, str) else name

    def part(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))

    return [
        part(RUN_NAME, 1).alias("tr_start"),
        part(RUN_NAME, 2).alias("tr_end"),
        F.coalesce(part(RUN_NAME, 3), part(RUN_NAME_OLD, 1)).alias("sim_start"),
        F.coalesce(part(RUN_NAME, 4), part(RUN_NAME_OLD, 2)).alias("sim_end"),
    ]


def run_name(prefix: Column, stamp: Column, dates: Sequence[Column]) -> Column:
    """Canonical run folder name; unknown dates become eight zeros."""
    tr_a, tr_b, sim_a, sim_b = [
        F.coalesce(F.date_format(d, "yyyyMMdd"), F.lit("00000000")) for d in dates
    ]
    return F.concat(prefix, F.lit("_"), stamp, F.lit("_tr"), tr_a, F.lit("-"), tr_b, F.lit("_sim"), sim_a, F.lit("-"), sim_b)


def select_run(runs: DataFrame, keys: Sequence[str], name: str, eval_start: str, eval_end: str) -> DataFrame:
    """Per key the narrowest run that covers the evaluation period, else the last by name."""
    dated = runs.select("*", *parse_run_name(name))
    covers = (F.col("sim_start") <= eval_start) & (F.col("sim_end") >= eval_end)
    dated = dated.withColumn("covers", F.coalesce(covers, F.lit(False)).cast("int"))
    width = F.when(F.col("covers") == 1, F.col("sim_end").cast("long") - F.col("sim_start").cast("long"))
    order = [
        F.col("covers").desc(), width.asc_nulls_last(),
        F.when(F.col("covers") == 1, F.col(name)).asc_nulls_last(), F.col(name).desc(),
    ]
    return best_row(dated, keys, order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the given order, e.g. (after the fix, written at)."""
    return best_row(df, keys, [F.col(o).desc() for o in order])


def is_stale(stored: str, newest: str) -> Column:
    """A stored value is stale when its run is newer, or when there is no run."""
    return F.coalesce(F.col(newest) > F.col(stored), F.lit(True))


def store_manifest(df: DataFrame, start: str, end: str, key: str = "model_key", ts: str = "dat", y: str = "y") -> DataFrame:
    """Rows, period and evaluation rows and positives per model."""
    inside = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("date_min"), F.max(ts).alias("date_max"),
        F.count(F.when(inside, 1)).alias("eval_rows"),
        F.coalesce(F.sum(F.when(inside, F.col(y))), F.lit(0)).cast("long").alias("eval_pos"),
    )
