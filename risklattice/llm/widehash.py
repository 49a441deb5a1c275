"""Near duplicates by similarity: wide SimHash fingerprints, a pigeonring filter over their segments, and a check of the texts.

64 bits and two differing ones tell copies with hardly an edit. Texts that share four fifths of their five-word shingles
differ more, so here a fingerprint has 256 bits, made of each distinct word once; at that similarity some 17 bits differ if
single words were replaced, and some 37 if a block was added or cut off. Fingerprints are no bound on the similarity: they
join large groups by few pairs, and the join of ``jaccard`` finds every pair that is still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.session import materialise

from . import jaccard
from .shared import fresh, row_id

SEGMENTS, WORDS = 32, 4  # one segment is a byte; a fingerprint is four 64-bit words
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def wide_fingerprint(text: bytes | None) -> bytes:
    """256 bits, each set if it is in over half of the hashes of the distinct words, A-Z lower-cased; no words give zeros."""
    words = set((text or b"").translate(_LOWER).split())
    if not words:
        return bytes(SEGMENTS)
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    many = (base[:, None] ^ _MIX) * _MIX[::-1]
    many = (many ^ (many >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    many ^= many >> np.uint64(32)
    ones = np.unpackbits(many.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).tobytes()


def within_ring(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Whether ``bits`` bits differ at most, tested on chains first.

    If so few differ on a ring of m segments, some start sees at most l * bits / m in its first l segments for every l. Pairs
    without such a chain go before their distances are added up.
    """
    each = np.bitwise_count(a ^ b).astype(np.int64)
    total = np.concatenate([np.zeros((len(each), 1), np.int64), np.concatenate([each, each], axis=1).cumsum(axis=1)], axis=1)
    alive = np.ones((len(each), SEGMENTS), bool)
    for length in range(1, SEGMENTS + 1):
        alive &= total[:, length : length + SEGMENTS] - total[:, :SEGMENTS] <= length * bits // SEGMENTS
    chained = alive.any(axis=1)
    chained[chained] = each[chained].sum(axis=1) <= bits
    return chained


def _keys(fp: Column, segments: int) -> Column:
    """A key for each place on the ring: ``segments`` consecutive segments, and the place."""
    ring = F.concat(fp, fp)
    return F.array(*[F.xxhash64(F.substring(ring, place + 1, segments), F.lit(place)) for place in range(SEGMENTS)])


def fingerprints(texts: DataFrame) -> DataFrame:
    """(id, fp) of ``texts`` (set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([wide_fingerprint(t.as_py()) for t in batch.column(1)], pa.binary())], names=["id", "fp"])

    return texts.select("set_id", "text").mapInArrow(run, "id long, fp binary")


def candidates(marked: DataFrame, bits: int, segments: int = 3) -> DataFrame:
    """Pairs (a, b) of ids of ``marked`` (id, fp) with ``segments`` equal segments in a row, within ``bits`` bits of each other.

    Equal fingerprints are one first: each id meets the smallest id that has its own. Under a key a fingerprint meets the one
    with the smallest id only, so pairs grow with the ids, whatever share of them has a key. They join most of a group; what
    they leave apart is found by ``jaccard.joined_sets``.
    """
    distinct = materialise(marked.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    equal = marked.join(distinct.select(F.col("fp").alias("fp__"), F.col("id").alias("least")), F.col("fp") == F.col("fp__"))
    equal = equal.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    keyed = distinct.select("id", F.explode(_keys(F.col("fp"), segments)).alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    pairs = keyed.join(least.withColumnRenamed("key", "key__"), F.col("key") == F.col("key__")).filter("id <> least")
    pairs = pairs.select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    left = distinct.select(F.col("id").alias("a__"), F.col("fp").alias("fa"))
    right = distinct.select(F.col("id").alias("b__"), F.col("fp").alias("fb"))
    both = pairs.join(left, F.col("a") == F.col("a__")).join(right, F.col("b") == F.col("b__")).select("a", "b", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SEGMENTS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(within_ring(a, b, bits)))

    return both.mapInArrow(run, "a long, b long").union(equal)


def similar_texts(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 40, segments: int = 3, rounds: int = 2) -> DataFrame:
    """(text_hash, group) for each text of ``docs`` (doc_id, text), by its XXH64: equal groups are linked.

    Links are pairs whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` hundredths or more. Two
    sources of candidates: fingerprints, which join most of a group by few pairs but miss some, and the blocked product of
    ``jaccard``, which misses none, whatever the edit. Texts without words are linked to equal ones only. Null is the empty text.
    """
    rows = materialise(jaccard.incidence(docs, width, percent), "incidence")
    shared = materialise(jaccard.shared_columns(rows, percent), "shared")
    texts = materialise(jaccard.texts_of(docs, rows, shared), "texts")
    marked = materialise(fingerprints(texts), "wide")
    links = jaccard.similar_pairs(candidates(marked, bits, segments), texts, width, percent)
    reached = jaccard.joined_sets(rows, shared, texts, width, percent, links, rounds).withColumnRenamed("component", "comp__")
    known = rows.select("text_hash", "set_id").distinct().join(reached, F.col("set_id") == F.col("node"), "left")
    return known.select("text_hash", F.coalesce("comp__", "set_id", "text_hash").alias("group"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each group of similar texts, with all its columns: that of the smallest doc_id.

    Equal texts are one group. Of rows that agree in doc_id the one with the smallest hash of all columns stays; null ids
    come last. Texts without words are equal to each other only where they are equal. An empty table stays empty.
    """
    groups = materialise(similar_texts(docs.select("doc_id", "text"), **how), "similar")
    row, text = fresh(docs, "row__"), fresh(docs, "text__")
    tagged = docs.withColumn(row, row_id(docs)).withColumn(text, F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    first = tagged.groupBy(F.col(text).alias("own")).agg(F.min(place).alias("first"))
    grouped = first.join(groups, F.col("own") == F.col("text_hash"))
    kept = grouped.groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias(fresh(docs, "kept__")))
    one = tagged.join(kept, F.col(row) == F.col(kept.columns[0]), "left_semi")
    return one.dropDuplicates([row]).select(*docs.columns)
