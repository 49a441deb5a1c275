"""Near duplicates by SimHash: candidates from chains of equal segments, pruned by the pigeonring, then the Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.session import materialise

from .components import components

BITS, SEGMENTS = 64, 8
WIDTH = BITS // SEGMENTS
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is set if it is set in over half of the shingles' XXH64 hashes.

    A-Z are lower-cased and words are what ASCII white space leaves. Repeated shingles count each time; fewer words than
    ``shingle`` make one shingle; no words, or null, give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text); fp is the fingerprint's 64 bits as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t, shingle, seed) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _rotated(fp, bits: int):
    """The fingerprint turned left by so many bits, for Spark columns."""
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


def chain(max_bits: int) -> tuple[int, int]:
    """Segments that must be equal at the head of some chain, and those after them that may differ in one bit in all.

    With at most d differing bits on a ring of m segments, some start sees at most l*d/m differing bits in its first l
    segments, for every l. Below m/d segments that is none, below 2m/d it is one.
    """
    clean = ceil(SEGMENTS / max_bits) - 1
    return clean, min(SEGMENTS, ceil(2 * SEGMENTS / max_bits) - 1) - clean


def _keys(fp: Column, max_bits: int) -> Column:
    """Values of which two fingerprints within ``max_bits`` share one at least: start, half, clean head, one half of what follows.

    One differing bit at most lies in the segments that follow the head, so one of their two halves is equal as well.
    """
    clean, follow = chain(max_bits)
    first = follow // 2
    out = []
    for start in range(SEGMENTS):
        turned = _rotated(fp, start * WIDTH)
        head = F.shiftrightunsigned(turned, BITS - clean * WIDTH)
        for half, (skip, length) in enumerate(((0, first), (first, follow - first))):
            rest = F.shiftrightunsigned(F.shiftleft(turned, (clean + skip) * WIDTH), BITS - length * WIDTH) if length else F.lit(0).cast("long")
            # start and half in the lowest bits; equal keys of equal start and half are equal segments unless 64 bits clash
            out.append(F.xxhash64(head, rest, F.lit(2 * start + half)))
    return F.array(*out)


def _within_chains(difference: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether some chain of segments keeps all its budgets: at most floor(l * d / m) bits in its first l segments."""
    each = np.bitwise_count(difference.view(np.uint8).reshape(-1, SEGMENTS)).astype(np.int64)
    ring = np.concatenate([each, each], axis=1).cumsum(axis=1)
    ring = np.concatenate([np.zeros((len(each), 1), np.int64), ring], axis=1)
    budget = np.arange(1, SEGMENTS + 1) * max_bits // SEGMENTS
    kept = np.zeros(len(each), bool)
    for start in range(SEGMENTS):
        kept |= (ring[:, start + 1 : start + 1 + SEGMENTS] - ring[:, start : start + 1] <= budget).all(axis=1)
    return kept


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def _pairs(keys: np.ndarray, fps: np.ndarray, max_bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of one key. Runs longer than ``most`` are left out."""
    _, lengths = _runs(keys)
    small = np.repeat(lengths <= most, lengths)
    keys, fps = keys[small], fps[small]
    found = []
    for step in range(1, min(most, len(keys))):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        difference = fps[at] ^ fps[at + step]
        chained = _within_chains(difference, max_bits)
        at, difference = at[chained], difference[chained]
        at = at[np.bitwise_count(difference) <= max_bits]
        found.append((fps[at], fps[at + step]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _candidates(max_bits: int, most: int):
    """Reads (key, fp) in order of key; writes links (a, b), and (a, null) for fingerprints of a key that has too many."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), right], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        large = None  # the key whose run has outgrown ``most``; its fingerprints go on at once and are not kept
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if large is not None:
                same = keys == large
                if same.any():
                    yield out(fps[same], None)
                    keys, fps = keys[~same], fps[~same]
            starts, lengths = _runs(keys)
            over = np.repeat(lengths > most, lengths)
            if over.any():
                yield out(fps[over], None)
                large = keys[over][-1]
                keys, fps = keys[~over], fps[~over]
                starts, _ = _runs(keys)
            if len(starts):
                done = starts[-1]  # the last run may go on in the next batch
                yield out(*_pairs(keys[:done], fps[:done], max_bits, most))
                keys, fps = keys[done:], fps[done:]
        yield out(*_pairs(keys, fps, max_bits, most))

    return run


def _ball(fp: Column, max_bits: int) -> Column:
    """Values that two fingerprints share if and only if they differ in at most ``max_bits`` (1 or 2) bits.

    For two bits: everything within one bit of the fingerprint. For one bit: the fingerprint without bit j, and j.
    """
    flags = [1 << j if j < 63 else -(1 << 63) for j in range(BITS)]
    if max_bits == 1:
        return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(~f)), F.lit(j)) for j, f in enumerate(flags)])
    return F.array(fp, *[fp.bitwiseXOR(F.lit(f).cast("long")) for f in flags])


def links(distinct: DataFrame, max_bits: int = 2, most: int = 64) -> DataFrame:
    """(a, b) for fingerprints of ``distinct`` (fp) within ``max_bits`` (1 or 2) bits, enough of them to join what is linked.

    Fingerprints meet under keys made of a chain's equal head and half of what follows. Up to ``most`` under a key are
    compared with each other: chain budgets first, then the full Hamming distance. Where a key has more, comparing all would
    be quadratic, so its fingerprints go under all values within one bit instead. Those under one value are within two bits
    of each other, and each is linked to the smallest: as exact, and linear.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    keyed = distinct.select(F.explode(_keys(F.col("fp"), max_bits)).alias("key"), "fp")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_candidates(max_bits, most), "a long, b long")
    found = materialise(found.distinct(), "candidates")
    near = found.filter("b is not null")
    balls = found.filter("b is null").select(F.explode(_ball(F.col("a"), max_bits)).alias("value"), F.col("a").alias("fp"))
    least = balls.groupBy("value").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most")
    starred = balls.join(least.select(F.col("value").alias("shared"), "least"), F.col("value") == F.col("shared"))
    return near.union(starred.filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42, most: int = 64) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text); other columns are not carried.

    component_id is the smallest doc_id that links reach, the row's own included. Equal fingerprints are one node from the
    start, so copies cost nothing. Null and empty texts have fingerprint 0, which is linked like any other. Null ids are
    passed over for component_id (null only if the whole component has null ids). Repeated rows are kept.
    """
    marked = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    reached = materialise(components(links(distinct.select("fp"), max_bits, most)), "components")
    member = distinct.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = member.join(named, "component").select(F.col("fp").alias("fp__"), "component_id")
    return marked.join(placed, F.col("fp") == F.col("fp__")).select("doc_id", "fp", "component_id")

