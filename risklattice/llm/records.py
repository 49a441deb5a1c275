"""Length-delimited binary files of token ids: frames with masked checksums, and an index file beside each for random reads.

A frame is: length of the data (8 bytes), masked CRC-32C of the length (4), data, masked CRC-32C of the data (4); all
numbers little-endian. The data is one byte that tells whether the document has an id, the id (8 bytes), and the tokens, 2
bytes each, or 4 where the vocabulary asks for it. An index entry is: offset of the frame, length of its data, document id,
whether there is one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .crc import crc32c, masked
from .tokens import encoder, spread

HEAD, FOOT, META = 12, 4, 9
INDEX = np.dtype([("offset", "<i8"), ("size", "<i8"), ("doc_id", "<i8"), ("has_id", "u1")])
BLOCK = 8 << 20  # bytes of data that a reader or writer works on at a time


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors reach, and the folder's path on it."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def frames(doc_ids: np.ndarray, has_id: np.ndarray, ids: np.ndarray, sizes: np.ndarray, width: int) -> tuple[bytes, np.ndarray]:
    """The frames of all documents one after the other, and the length of each one's data."""
    data = META + sizes * width
    total = HEAD + data + FOOT
    starts = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint8)
    whole = lambda at, values: out.__setitem__(at[:, None] + np.arange(values.itemsize), values.view(np.uint8).reshape(-1, values.itemsize))
    lengths = data.astype("<u8")
    whole(starts, lengths)
    eight = np.arange(len(sizes)) * 8
    whole(starts + 8, masked(crc32c(lengths.view(np.uint8), eight, np.full(len(sizes), 8))).astype("<u4"))
    out[starts + HEAD] = has_id
    whole(starts + HEAD + 1, doc_ids.astype("<i8"))
    tokens = ids.astype("<u2" if width == 2 else "<u4").view(np.uint8)
    out[spread(starts + HEAD + META, sizes * width)] = tokens
    whole(starts + HEAD + data, masked(crc32c(out, starts + HEAD, data)).astype("<u4"))
    return out.tobytes(), data


def _write(path: str, tokenizer: str, end_id: int, width: int):
    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of some BLOCK / 2 bytes of text: a text's words, pieces and ids take many times its size."""
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // (BLOCK // 2)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        encode = encoder(tokenizer).encode
        part = TaskContext.get().partitionId()
        name, temporary = f"{folder}/part-{part:06d}", f"{folder}/_{part:06d}-{uuid.uuid4().hex}"
        n_records = n_ids = offset = 0
        with store.open_output_stream(f"{temporary}.rec") as data, store.open_output_stream(f"{temporary}.idx") as index:
            for batch in batches:
                for block in blocks(batch):
                    ids, counts = encode(block.column(1))
                    sizes = counts + 1
                    ends = np.cumsum(sizes)
                    full = np.full(int(ends[-1]), end_id, np.uint32)
                    full[np.delete(np.arange(len(full)), ends - 1)] = ids
                    has_id = pc.is_valid(block.column(0)).to_numpy(zero_copy_only=False)
                    doc_ids = pc.fill_null(block.column(0), 0).to_numpy(zero_copy_only=False)
                    raw, lengths = frames(doc_ids, has_id, full, sizes, width)
                    data.write(raw)
                    entries = np.zeros(len(sizes), INDEX)
                    total = HEAD + lengths + FOOT
                    entries["offset"], entries["size"] = offset + np.cumsum(total) - total, lengths
                    entries["doc_id"], entries["has_id"] = doc_ids, has_id
                    index.write(entries.tobytes())
                    n_records, n_ids, offset = n_records + len(sizes), n_ids + len(full), offset + len(raw)
        # A task that runs twice writes the same bytes; whichever comes last takes the name.
        for kind in ("idx", "rec"):
            with suppress(FileNotFoundError, OSError):
                store.move(f"{temporary}.{kind}", f"{name}.{kind}")
            if store.get_file_info(f"{temporary}.{kind}").type != fs.FileType.NotFound:  # stores that do not replace
                store.delete_file(f"{name}.{kind}")
                store.move(f"{temporary}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_records": [n_records], "n_ids": [n_ids], "n_bytes": [offset]})

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int, order: list[Column] | None = None) -> None:
    """Encode each row of ``docs`` (doc_id, text), append ``end_id``, and write files in order of doc_id, or of ``order``.

    Files are ranges of the order, numbered in it; ``_parts`` in the folder lists them, a Parquet table with one row for
    each. Rows that tie are spread over files by a hash of the text and their place in the input. Null text is empty, null
    ids come first, an empty table gives an empty folder. ``path`` must be a new folder that all executors reach. Texts are
    shuffled once, and encoded after that, once.
    """
    store, folder = _store(path)
    store.create_dir(folder)
    width = 2 if encoder(tokenizer).full.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    keys = [c.alias(f"order__{i}") for i, c in enumerate(order or [F.col("doc_id")])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys, F.xxhash64("text").alias("tie__"), F.monotonically_increasing_id().alias("place__"))
    by = [c for c in rows.columns if c.endswith("__") or c.startswith("order__")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text")
    ranged.mapInArrow(_write(path, tokenizer, end_id, width), "part int, n_records long, n_ids long, n_bytes long").withColumn(
        "width", F.lit(width)).write.parquet(f"{path}/_parts")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``, the number of ids in all files before. The table has one row for each file."""
    listed = spark.read.schema("part int, n_records long, n_ids long, n_bytes long, width int").parquet(f"{path}/_parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _dealt(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The list of files over as many tasks as files: its rows are too small for Spark to see the work behind them."""
    listed = parts(spark, path)
    return listed.select(*columns).repartition(max(1, listed.count()), "part")


def _checked(raw: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> None:
    """Raise unless every frame's length and both its checksums are right."""
    number = lambda at, kind: raw[at[:, None] + np.arange(np.dtype(kind).itemsize)].copy().view(kind).ravel()
    if (number(offsets, "<u8") != sizes).any():
        raise ValueError("a frame's length is not that of the index")
    if (number(offsets + 8, "<u4") != masked(crc32c(raw, offsets, np.full(len(sizes), 8)))).any():
        raise ValueError("a length's checksum is wrong")
    if (number(offsets + HEAD + sizes, "<u4") != masked(crc32c(raw, offsets + HEAD, sizes))).any():
        raise ValueError("a record's checksum is wrong")


def _ids(raw: np.ndarray, offset: int, size: int, width: int) -> np.ndarray:
    return raw[offset + HEAD + META : offset + HEAD + size].copy().view("<u2" if width == 2 else "<u4").astype("<u4")


def _blocks(path: str, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A file's index entries and bytes, some BLOCK bytes at a time, with offsets from the block's start, all checked."""
    store, folder = _store(path)
    with store.open_input_file(f"{folder}/part-{part:06d}.idx") as f:
        index = np.frombuffer(f.read(), INDEX)
    with store.open_input_stream(f"{folder}/part-{part:06d}.rec") as f:
        block = index["offset"] // BLOCK
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(index)] if len(index) else []
        for a, b in zip(cuts, cuts[1:]):
            entries = index[a:b].copy()
            first, last = entries["offset"][0], entries["offset"][-1] + HEAD + entries["size"][-1] + FOOT
            raw = np.frombuffer(f.read(int(last - first)), np.uint8)
            entries["offset"] -= first
            _checked(raw, entries["offset"], entries["size"])
            yield entries, raw


def _rows(entries: np.ndarray) -> pa.Array:
    return pa.array(entries["doc_id"], mask=entries["has_id"] == 0)


def read_records(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, and with ``ids`` the ids) of every record, read from the files and checked.

    A file is read by one task, in blocks. start counts the ids of all records before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["start"]
                for entries, raw in _blocks(path, row["part"]):
                    lists = [_ids(raw, o, s, row["width"]) for o, s in zip(entries["offset"].tolist(), entries["size"].tolist())]
                    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                    columns = {
                        "doc_id": _rows(entries), "start": start + np.cumsum(sizes) - sizes, "n_tokens": sizes,
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64()), "part": pa.array(np.full(len(lists), row["part"], np.int32))}
                    if ids:
                        columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_pydict(columns)

    return _dealt(spark, path, "part", "start", "width").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int" + ", ids array<int>" * ids)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, width, offset, size, doc_id) of every record, from the index files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/part-{row['part']:06d}.idx") as f:
                    entries = np.frombuffer(f.read(), INDEX)
                n = len(entries)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(n, row["part"], np.int32)), "width": pa.array(np.full(n, row["width"], np.int32)),
                    "offset": entries["offset"].copy(), "size": entries["size"].copy(), "doc_id": _rows(entries)})

    return _dealt(spark, path, "part", "width").mapInArrow(run, "part int, width int, offset long, size long, doc_id long")


def read_shuffled(spark: SparkSession, path: str, seed: int, partitions: int) -> DataFrame:
    """(doc_id, ids) in an order that the seed decides: index entries are shuffled, and each task reads its records by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/part-{row['part']:06d}.rec") as f:
                    raw = np.frombuffer(f.read_at(HEAD + row["size"] + FOOT, row["offset"]), np.uint8)
                _checked(raw, np.zeros(1, np.int64), np.array([row["size"]]))
                found.append((row["doc_id"], _ids(raw, 0, row["size"], row["width"])))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in found], pa.int64()), "ids": pa.array([x for _, x in found], pa.list_(pa.int32()))})

    order = F.xxhash64(F.lit(seed), "part", "offset")
    mixed = read_index(spark, path).withColumn("order__", order).repartition(partitions, "order__").sortWithinPartitions("order__")
    return mixed.drop("order__").mapInArrow(run, "doc_id long, ids array<int>")
