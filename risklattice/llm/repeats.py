"""Removal of repeated byte strings across documents by bucket-pointer refinement of the suffixes that can matter.

Texts stay where one shuffle puts them. What travels is small: hashes of sampled q-grams (the initial buckets), then the
bytes around those whose bucket holds different surroundings (refined byte by byte), then ranges to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import materialise

from .bpr import classes, first_of, gram_hashes, runs, stretches

CHUNK = 1 << 20  # bytes of text, and windows, that a task works on at a time
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Plan:
    """``buckets``: tasks' shares of the sampled q-grams; ``fine``: parts of each, so that bytes are refined in small lots.
    ``crowded``: q-grams too frequent to be refined in one task."""

    length: int
    gram: int
    buckets: int
    crowded: frozenset[int]
    fine: int = 16


# A sampled stretch: text number, first and last start of its windows, anchor's hash, hash of its bytes.
STRETCH = np.dtype([("text", "<i8"), ("first", "<i4"), ("last", "<i4"), ("key", "<u8"), ("content", "<u8")])
# A range of window starts of a text.
RANGE = np.dtype([("text", "<i8"), ("first", "<i4"), ("last", "<i4")])
# A range whose bytes are wanted, and its q-gram.
WANT = np.dtype([("text", "<i8"), ("first", "<i4"), ("last", "<i4"), ("key", "<u8")])
# A window of a crowded stretch, by 128 bits of hash.
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("text", "<i8"), ("start", "<i4")])
BLOCKS = "bucket int, kind int, block binary"


def _blocks(bucket: np.ndarray, kind: int, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, rows of the bucket)."""
    if not len(rows):
        return []
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    return [(int(b), kind, part.tobytes()) for b, part in zip(bucket[np.concatenate(([0], cut))], np.split(rows, cut))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        names=["bucket", "kind", "block"])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes one after the other, and where each begins and the last ends."""
    whole = texts.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _window_chunks(offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts of windows that lie inside one text, and the rows of their texts, in chunks; a long text is cut, losing none."""
    for low in range(0, int(offsets[-1]), CHUNK):
        starts = np.arange(low, min(low + CHUNK, int(offsets[-1])))
        row = np.searchsorted(offsets, starts, side="right") - 1
        inside = starts + length <= offsets[row + 1]
        yield starts[inside], row[inside]


def _sample(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, plan: Plan) -> np.ndarray:
    """The stretches of a batch of texts."""
    found = []
    for starts, _ in _window_chunks(offsets, plan.length):
        # Neighbouring windows of different texts would be one run: a text's last window and the next one's first are
        # ``length`` apart, so they never are.
        first, last, key, content = stretches(data, starts, plan.length, plan.gram)
        row = np.searchsorted(offsets, first, side="right") - 1
        rows = np.zeros(len(first), STRETCH)
        rows["text"], rows["first"], rows["last"] = text[row], first - offsets[row], last - offsets[row]
        rows["key"], rows["content"] = key, content
        found.append(rows)
    return np.concatenate(found) if found else np.zeros(0, STRETCH)


def _first_stretches(rows: np.ndarray) -> np.ndarray:
    """Whether each stretch is the first of those with its key and bytes."""
    order = np.lexsort((rows["first"], rows["text"], rows["content"], rows["key"]))
    key, content = rows["key"][order], rows["content"][order]
    first = np.zeros(len(rows), bool)
    if len(rows):
        first[order[np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))]] = True
    return first


def _ranges(rows: np.ndarray, kind: np.dtype = RANGE) -> np.ndarray:
    out = np.zeros(len(rows), kind)
    for name in kind.names:
        out[name] = rows[name]
    return out


SAMPLED, REMOVED, BYTES, WINDOWS, WANTED = range(5)


def _buckets(rows: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch's bucket, and whether its q-gram is crowded: then its bytes share in deciding the bucket."""
    crowded = np.isin(rows["key"], np.fromiter(plan.crowded, np.uint64, len(plan.crowded))) if plan.crowded else np.zeros(len(rows), bool)
    mixed = rows["key"] ^ np.where(crowded, rows["content"], np.uint64(0))
    return (mixed % np.uint64(plan.buckets)).astype(np.int32), crowded


def _emit_samples(plan: Plan):
    """Reads (no, text); writes blocks of stretches by bucket. Of equal ones in a batch the first goes on, the rest are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(1))
            rows = _sample(data, offsets, batch.column(0).to_numpy(), plan)
            first = _first_stretches(rows)
            again = _ranges(rows[~first])
            bucket, _ = _buckets(rows[first], plan)
            made = _blocks(bucket, SAMPLED, rows[first]) + _blocks((again["text"] % plan.buckets).astype(np.int32), REMOVED, again)
            yield _batch(made)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Blocks of one bucket at a time, by kind, from rows in order of bucket."""
    current, held = None, {}
    for batch in batches:
        for bucket, kind, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != current:
                if held:
                    yield current, held
                current, held = bucket, {}
            held.setdefault(kind, []).append(block.as_py())
    if held:
        yield current, held


def _rows(blocks: list[bytes] | None, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blocks or []), kind)


def _by_text(rows: np.ndarray, bucket: int, kind: int) -> list[tuple]:
    """(text, bucket, kind, block of ranges) for each text."""
    if not len(rows):
        return []
    rows = rows[np.argsort(rows["text"], kind="stable")]
    cut = np.flatnonzero(rows["text"][1:] != rows["text"][:-1]) + 1
    heads = np.concatenate(([0], cut))
    return [(int(t), bucket, kind, part.tobytes()) for t, part in zip(rows["text"][heads], np.split(rows, cut))]


def _text_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
        pa.array([r[3] for r in rows], pa.binary())], names=["no", "bucket", "kind", "block"])


def _sort_samples(plan: Plan):
    """Reads a bucket's stretches; writes, by text, those to remove and those whose q-gram has other surroundings too.

    All but the first of equal stretches are removed. The first ones of a q-gram with more than one kind of surroundings
    share some windows perhaps, which their bytes must tell. A q-gram with one kind needs nothing more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            rows = _rows(held.get(SAMPLED), STRETCH)
            first = _first_stretches(rows)
            heads = rows[first]
            _, crowded = _buckets(heads, plan)
            _, which, kinds = np.unique(heads["key"], return_inverse=True, return_counts=True)
            several = (kinds[which] > 1) & ~crowded if len(heads) else np.zeros(0, bool)
            removed = np.concatenate((_ranges(rows[~first]), _rows(held.get(REMOVED), RANGE)))
            yield _text_batch(
                _by_text(removed, bucket, REMOVED) + _by_text(_ranges(heads[several], WANT), bucket, WANTED) + _by_text(_ranges(heads[crowded], WANT), -1, WANTED))

    return run


def _emit_bytes(plan: Plan):
    """Reads (no, text, wanted ranges by bucket); writes the bytes of those ranges to their buckets, and crowded ones' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, windows = [], []
            parts: dict[int, list[bytes]] = {}
            for no, text, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for hit in hits.as_py():
                    if hit["kind"] != WANTED:
                        continue
                    for _, first, last, key in np.frombuffer(hit["block"], WANT).tolist():
                        piece = data[first : last + plan.length]
                        if hit["bucket"] >= 0:
                            head = np.array([(no, first, last)], RANGE).tobytes()
                            parts.setdefault(key % (plan.buckets * plan.fine), []).append(head + piece.tobytes())
                            continue
                        rows = np.zeros(last - first + 1, WINDOW)
                        rows["a"], rows["b"] = gram_hashes(piece, plan.length), gram_hashes(piece, plan.length, 1)
                        rows["text"], rows["start"] = no, np.arange(first, last + 1)
                        windows.append(rows)
            made += [(b, BYTES, b"".join(p)) for b, p in parts.items()]
            rows = np.concatenate(windows) if windows else np.zeros(0, WINDOW)
            first = _first_windows(rows)
            made += _blocks((rows["a"][first] % np.uint64(plan.buckets)).astype(np.int32), WINDOWS, rows[first])
            again = _window_ranges(rows[~first])
            made += _blocks((again["text"] % plan.buckets).astype(np.int32), REMOVED, again)
            yield _batch(made)

    return run


def _first_windows(rows: np.ndarray) -> np.ndarray:
    order = np.lexsort((rows["start"], rows["text"], rows["b"], rows["a"]))
    a, b = rows["a"][order], rows["b"][order]
    first = np.zeros(len(rows), bool)
    if len(rows):
        first[order[np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))]] = True
    return first


def _window_ranges(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), RANGE)
    out["text"], out["first"], out["last"] = rows["text"], rows["start"], rows["start"]
    return out


def _pieces(blocks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a bucket, and for each window its place there, its text and its start in it."""
    raw = np.frombuffer(b"".join(blocks), np.uint8)
    heads, at = [], 0
    while at < len(raw):
        text, first, last = np.frombuffer(raw[at : at + RANGE.itemsize].tobytes(), RANGE)[0]
        heads.append((at + RANGE.itemsize, text, first, last))
        at += RANGE.itemsize + int(last) - int(first) + length
    place, text, first, last = (np.array(x, np.int64) for x in zip(*heads))
    sizes = last - first + 1
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return raw, np.repeat(place, sizes) + inside, np.repeat(text, sizes), np.repeat(first, sizes) + inside


def _refine(plan: Plan):
    """Reads a bucket's bytes; refines its suffixes to full length and writes, by text, the windows that are not the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            removed = [_rows(held.get(REMOVED), RANGE)]
            if BYTES in held:
                data, place, text, start = _pieces(held[BYTES], plan.length)
                again = ~first_of(classes(data, place, plan.length), text, start)
                rows = np.zeros(int(again.sum()), RANGE)
                rows["text"], rows["first"], rows["last"] = text[again], start[again], start[again]
                removed.append(rows)
            if WINDOWS in held:
                rows = _rows(held[WINDOWS], WINDOW)
                removed.append(_window_ranges(rows[~_first_windows(rows)]))
            yield _text_batch(_joined(np.concatenate(removed), bucket))

    return run


def _joined(rows: np.ndarray, bucket: int) -> list[tuple]:
    """Ranges by text, with neighbouring windows made one range."""
    single = rows[rows["first"] == rows["last"]]
    single = single[np.lexsort((single["first"], single["text"]))]
    new = np.ones(len(single), bool)
    new[1:] = (single["text"][1:] != single["text"][:-1]) | (single["first"][1:] != single["first"][:-1] + 1)
    heads = np.flatnonzero(new)
    made = np.zeros(len(heads), RANGE)
    made["text"], made["first"] = single["text"][heads], single["first"][heads]
    made["last"] = single["first"][np.append(heads[1:], len(single)) - 1] if len(heads) else made["first"]
    return _by_text(np.concatenate((made, rows[rows["first"] != rows["last"]])), bucket, REMOVED)


def _cut(length: int):
    """Reads (no, text, removed ranges); writes counts and the hash of the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for no, text, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                blocks = [h["block"] for h in (hits.as_py() or []) if h["kind"] == REMOVED]
                if not blocks:
                    out.append((no, 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                rows = _rows(blocks, RANGE)
                depth = np.zeros(len(data) + 1, np.int64)
                np.add.at(depth, rows["first"], 1)
                np.add.at(depth, rows["last"].astype(np.int64) + length, -1)
                gone = depth.cumsum()[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((no, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["no", "n_removed", "n_spans", "kept_sha256"])

    return run


def _numbered(texts: DataFrame) -> DataFrame:
    """(digest, first_id, no): each distinct text's number in order of its first document, null ids last, then of the digest.

    Rows are sorted by ranges, numbered inside each, and moved by the sizes of the ranges before.
    """
    ranged = texts.repartitionByRange(F.col("first_id").isNull(), "first_id", "digest").sortWithinPartitions(F.col("first_id").isNull(), "first_id", "digest")
    placed = materialise(ranged.withColumn("range", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "texts")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("range").alias("range__"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(sizes, F.col("range") == F.col("range__")).select("digest", "first_id", (F.col("before") + F.col("at")).alias("no"))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _crowded(texts: DataFrame, length: int, gram: int, most: int, one_in: int) -> frozenset[int]:
    """Hashes of the q-grams that more than ``most`` stretches have, as far as one text in ``one_in`` shows.

    The list is as long as the number of stretches over ``most`` at most. It decides where work is done, not the result.
    """
    some = texts.filter(F.pmod(F.crc32(F.encode("digest", "UTF-8")), F.lit(one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column(0))
            rows = _sample(data, offsets, np.zeros(batch.num_rows, np.int64), Plan(length, gram, 1, frozenset()))
            key, n = np.unique(rows["key"][_first_stretches(rows)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    counted = some.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return frozenset(r.key & ((1 << 64) - 1) for r in counted.filter(F.col("n") * one_in > most).collect())


def remove_repeats(
    docs: DataFrame, length: int = 100, gram: int = 20, per_bucket: int = 1_000_000, least_buckets: int = 64,
    crowded: int = 250_000, one_in: int = 64,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text), its bytes in UTF-8.

    Removed are all bytes covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id, or in the
    same text before. Null ids come after all others; texts of one id stand in the order of their MD5; rows that agree in
    both come one after the other. Null text is empty. Other columns are not carried.

    Distinct texts are shuffled once, by their MD5. Each window of ``length`` bytes has an anchor, its least ``gram``-gram,
    and windows in a row share anchors, so one row stands for some forty windows. Anchors are the initial buckets; equal
    surroundings are settled there. Where surroundings differ, their bytes are fetched and refined in a part of the anchor's bucket.
    Equal stretches are reduced to one in each batch before they travel. A q-gram with more than ``crowded`` stretches is
    not refined in one task: its windows are compared one by one, by 128-bit hashes, spread over all buckets.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), _digest(F.col("text")).alias("digest"))
    sizes = marked.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    rows = sizes.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"))
    numbered = _numbered(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    windows = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(least_buckets, int(windows * 2 / (length - gram + 2) / per_bucket))
    plan = Plan(length, gram, buckets, _crowded(marked, length, gram, crowded, one_in))
    texts = marked.groupBy("digest").agg(F.first("text").alias("text"))
    placed = texts.join(numbered.select(F.col("digest").alias("digest__"), "no"), F.col("digest") == F.col("digest__")).select("no", "digest", "text")

    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.repartition("bucket").sortWithinPartitions("bucket")

    def to_texts(hits: DataFrame) -> DataFrame:
        """Each text's hits in one list, no longer than the text, with the text's digest."""
        grouped = hits.groupBy("no").agg(F.collect_list(F.struct("bucket", "kind", "block")).alias("hits"))
        named = grouped.join(numbered.select(F.col("no").alias("no__"), F.col("digest").alias("hit__")), F.col("no") == F.col("no__"))
        return named.select("hit__", "hits")

    by_text = "no long, bucket int, kind int, block binary"
    sampled = dealt(placed.select("no", "text").mapInArrow(_emit_samples(plan), BLOCKS)).mapInArrow(_sort_samples(plan), by_text)
    wanted = to_texts(sampled.filter(F.col("kind") == WANTED))
    fetched = placed.join(wanted, F.col("digest") == F.col("hit__")).select("no", "text", "hits").mapInArrow(_emit_bytes(plan), BLOCKS)
    refined = dealt(fetched).mapInArrow(_refine(plan), by_text)
    removed = to_texts(sampled.filter(F.col("kind") == REMOVED).union(refined))
    kept = placed.join(removed, F.col("digest") == F.col("hit__"), "left").select("no", "text", "hits").mapInArrow(
        _cut(length), "no long, n_removed long, n_spans long, kept_sha256 string")
    first = kept.join(numbered.select(F.col("no").alias("no__"), F.col("digest").alias("digest__"), "first_id"), F.col("no") == F.col("no__"))
    told = rows.join(first, F.col("digest") == F.col("digest__"))
    each = told.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    own = (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("copy") == 1)) | (F.col("n_bytes") < length)
    return each.select(
        "doc_id", "n_bytes", F.when(own, F.col("n_removed")).otherwise(F.col("n_bytes")).alias("n_removed"),
        F.when(own, F.col("n_spans")).otherwise(F.lit(1)).cast("long").alias("n_spans"),
        F.when(own, F.col("kept_sha256")).otherwise(F.lit(EMPTY)).alias("kept_sha256"))
