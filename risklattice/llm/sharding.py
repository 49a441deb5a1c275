"""Rendezvous hashing: each record goes to the shard whose weighted hash with the record's key is the highest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import code, fresh, running_total


def _bid(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's bid for the key: -weight / ln(u) for u uniform in (0, 1). The highest bid wins in proportion to weight."""
    u = (code(key, shard) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -weight / F.log(u)


def assign(records: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """``records`` with ``shard`` (0 to n-1) and ``grown_shard``, the place once a shard of ``grown_weight`` is added.

    Key, shard number and weights alone decide, so a changed weight moves only the records that the changed shard wins or
    loses, and one more shard takes records only into itself. There is no shuffle. A null key counts as one key; rows with
    equal keys share a shard; an empty table gives an empty one. Existing columns named ``shard`` or ``grown_shard`` are
    replaced. Without ``grown_weight``, ``grown_shard`` is null.
    """
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    bids = F.transform(shards, lambda s: F.struct(_bid(F.col(key), s["shard"], s["weight"]).alias("bid"), s["shard"].alias("shard")))
    best = fresh(records, "best__")
    out = records.withColumn(best, F.array_max(bids))
    extra = len(weights)
    grown = F.lit(None).cast("int") if grown_weight is None else F.when(
        _bid(F.col(key), F.lit(extra), F.lit(float(grown_weight))) > F.col(f"{best}.bid"), F.lit(extra)).otherwise(F.col(f"{best}.shard"))
    return out.withColumn("shard", F.col(f"{best}.shard")).withColumn("grown_shard", grown.cast("int")).drop(best)


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_weight: float | None = 1.0, buckets: int = 4096) -> DataFrame:
    """Shard, and gapless place in it, of every row of ``docs`` (doc_id, text): the listing by which shards are written.

    Equal rows are counted before the shuffle, so that one repeated record costs one row per task. Inside a shard, places
    follow ``buckets`` ranges of a hash and then doc_id, text checksum and size; each range is numbered apart from the
    others, so no task sorts a shard. Null text has size 1 and checksum 0; a null doc_id is a key of its own.
    """
    digests = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).cast("long").alias("text_crc32"))
    distinct = digests.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = assign(distinct, "doc_id", weights, grown_weight).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    slots = running_total(placed, ["shard"], "bucket", ["doc_id", "text_crc32", "size"], "copies", "first")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("slot"), "grown_shard")


def write_shards(records: DataFrame, path: str) -> None:
    """Write ``records`` that carry ``shard`` to one folder per shard; a shard is split over tasks by its rows' hash."""
    spread = F.pmod(F.xxhash64(*[c for c in records.columns if c != "shard"]), F.lit(16))
    records.repartition("shard", spread).write.partitionBy("shard").parquet(path)
