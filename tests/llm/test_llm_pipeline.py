from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C
from risklattice.llm import queries
from risklattice.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    rng = np.random.default_rng(8)
    parts = {"en": "the ing and of th er".split(), "fr": "é le que eau la ç".split()}
    say = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))
    rows = [(i, say(("en", "fr")[i % 2], 40), ("en", "fr")[i % 2], ("a", "b", None)[i % 3]) for i in range(90)]
    leak = say("en", 20)  # in the document's own language, so that only the benchmark stage has reason to drop it
    rows += [(200, rows[3][1], "fr", "a"), (201, rows[3][1], "fr", "b"), (202, None, "en", "a"), (203, "12 34", "en", "a"), (204, say("en", 60) + " " + leak, "en", "a"),
             (205, rows[4][1], "en", "b"), (205, rows[4][1], "en", "b"), (None, say("en", 30), "en", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(1, leak)], "item_id long, text string")


def test_stages(spark, tmp_path):
    docs, benchmark = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in C.STAGES[:-1]:
        at = materialise(stage(spark, at, str(tmp_path)), name)
        assert at.columns == COLUMNS
        seen.append({r.doc_id for r in at.collect()})
    ids = {r.doc_id for r in docs.collect()}
    assert seen[0] == ids - {202, 203}
    assert seen[1] == seen[0] - {200, 201, 205}
    assert seen[2] == seen[1] - {204} and seen[3] == seen[2]
    out = sorted(C.STAGES[-1][1](spark, at, str(tmp_path)).collect(), key=lambda r: r.start)
    stored = at.orderBy("_metadata.file_name", "_metadata.row_index").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in stored]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r, s in zip(out, stored):
        assert r.ids_crc32 == zlib.crc32(np.array([*tokenizer.encode(s.text, add_special_tokens=False).ids, 1], "<u4").tobytes())
    whole = C.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.ids_crc32) for r in whole} == {(r.doc_id, r.ids_crc32) for r in out}


def test_empty(spark, tmp_path):
    docs, benchmark = documents(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_queries_read_their_tables(spark):
    for name, query in queries.QUERIES.items():
        assert name.startswith("op") and query(spark, "/root/testdata/sf0.001").limit(1).count() == 1, name


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
