from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from risklattice.llm import records as R
from risklattice.llm.crc import crc32c, masked
from risklattice.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", None, " \n", "Don't WE'LL 's'S x'tt ''re", "naïve Ça É é a b x y 日本語 テスト İI ǅ ß ẞ ΣΑΣ", "<|endoftext|> a<|startoftext|>b <|x|>",
    "a\x1cb \x85c\u0085d e", "½ x²3 1234 a1b2", "don’t 😀👍🏽 !!'s !!", "\x00\x01 ​", "ª º ʰ ɐ ŉ ŀ", "é É.x ́", "word " * 3000 + "x" * 5000,
]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


PLAIN = Tokenizer.from_file(PATH)


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    assert crc32c(b"123456789", np.array([0]), np.array([9]))[0] == 0xE3069283
    data = np.random.default_rng(0).integers(0, 256, 3000, dtype=np.uint8)
    sizes = np.array([4, 5, 63, 64, 65, 128, 1000, 777])
    starts = np.arange(8) * 200
    assert crc32c(data, starts, sizes).tolist() == [slow_crc(data[s : s + n].tobytes()) for s, n in zip(starts, sizes)]


def test_words_give_the_ids_of_whole_texts():
    encoder = WordEncoder(PATH, most=50)  # small memory, cleared on the way
    for texts in (HARD, HARD[::-1], []):
        ids, sizes = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [plain(t) for t in texts]


def test_round_trip(spark, tmp_path):
    rows = [(i * 7 % 101, t) for i, t in enumerate(HARD * 3)] + [(None, "no id"), (5, "twice"), (5, "twice"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie__", F.lit("own")).withColumn("part", F.lit(1)).repartition(4)
    path = str(tmp_path / "out")
    R.write_records(docs, path, PATH, 1)
    got = sorted(R.read_records(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in got) == sorted((d or -1, (*plain(t), 1)) for d, t in rows)
    mixed = R.read_shuffled(spark, path, 3, 4).collect()
    assert sorted((r.doc_id or -1, tuple(r.ids)) for r in mixed) == sorted((d or -1, (*plain(t), 1)) for d, t in rows)
    assert [r.doc_id for r in mixed] != [r.doc_id for r in got]


def test_other_order_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", -i) for i in range(30)], "doc_id long, text string, at int")
    path = str(tmp_path / "out")
    R.write_records(docs, path, PATH, 1, order=[F.col("at")])
    assert [r.doc_id for r in sorted(R.read_records(spark, path).collect(), key=lambda r: r.start)] == list(range(29, -1, -1))
    file = next((tmp_path / "out").glob("part-*.rec"))
    raw = bytearray(file.read_bytes())
    assert int.from_bytes(raw[8:12], "little") == masked(np.array([slow_crc(raw[:8])], np.uint32))[0]
    raw[30] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        R.read_records(spark, path).count()


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    R.write_records(docs, str(tmp_path / "out"), PATH, 1)
    assert R.read_records(spark, str(tmp_path / "out")).count() == 0
