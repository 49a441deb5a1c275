from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from risklattice.llm import sharding


def documents(spark, n=600):
    rows = [(i, f"text {i % 90} é") for i in range(n)] + [(n, None), (n + 1, ""), (None, "x"), (5, "text 5 é"), (5, "text 5 é")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("own"))


def test_contract(spark):
    docs = documents(spark)
    got = sharding.shard_documents(docs).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"key"}
    by_shard = Counter(r.shard for r in got)
    assert set(by_shard) == set(range(8)) and min(by_shard.values()) > 30
    for s, n in by_shard.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.grown_shard in (r.shard, 8) for r in got) and 30 < sum(r.grown_shard == 8 for r in got) < 130
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert all(len({r.shard for r in got if r.doc_id == i}) == 1 for i in (None, 5))


def test_growth_and_weights(spark):
    docs = documents(spark)
    nine = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", [1.0] * 9).collect()}
    grown = {r.doc_id: r.grown_shard for r in sharding.shard_documents(docs).collect()}
    assert nine == grown
    even = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", [1, 1]).collect()}
    heavy = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", [1, 3]).collect()}
    assert all(heavy[d] == 1 for d in even if even[d] == 1) and 380 < sum(heavy.values()) < 520


def test_empty_and_files(spark, tmp_path):
    docs = documents(spark)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    placed = sharding.assign(docs, "doc_id", [1.0, 1.0])
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
