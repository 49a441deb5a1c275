from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from risklattice.llm import language as L

SYLLABLES = {"en": "the ing and of th er".split(), "fr": "é le que eau la ç".split(), "de": "ü sch ein ß und ch".split()}


def sample(n=240):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(int(rng.integers(2, 60))))
        rows.append((i, text if i % 5 else text.upper() + "!!", lang))
    return rows


def test_held_out_rows_are_told(spark):
    rows = sample() + [(1000, None, "en"), (1001, "", "fr"), (1002, "12 %% 7", None), (None, "the ing ander", "en"), (1003, "x" * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("own")).withColumn("rank", F.lit(1))
    model = L.fit(docs)
    out = L.predict(docs, model).withColumn("held", L.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows)
    langs = {d: x for d, _, x in rows}
    held = [r for r in out if r.held and r.doc_id < 1000]
    assert {r.doc_id for r in held} == {d for d in range(240) if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    assert not any(r.rejected for r in out if r.doc_id is not None and r.doc_id < 1000)
    told = {r.doc_id: r for r in out}
    for d in (1000, 1001, 1002):
        assert (told[d].lang_pred, told[d].score, told[d].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in out)
    kept = L.keep_accepted(docs, model)
    assert kept.columns == docs.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})


def test_distance_rejects_other_scripts(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, lang string")
    model = L.fit(docs)
    far = spark.createDataFrame([(1, "これは日本語の文章です" * 5), (2, "the ing and of")], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in L.predict(far, model).collect()} == {1: True, 2: False}


def test_sample_is_bounded_and_labels_are_not_inputs(spark):
    rows = sample(60) + [(7, "the same row", "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L._sample(docs, L.Settings(sample_rows=30)).groupBy("lang").count().agg(F.max("count")).first()[0] <= 10
    model = L.fit(docs)
    a = {(r.doc_id, r.lang_pred) for r in L.predict(docs, model).collect()}
    b = {(r.doc_id, r.lang_pred) for r in L.predict(docs.withColumn("lang", F.lit("xx")), model).collect()}
    assert a == b


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert L.predict(docs, model).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [(r.lang_pred, r.rejected) for r in L.predict(one, model).collect()] == [("und", True)]
