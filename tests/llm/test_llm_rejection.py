"""What no sampled language resembles is rejected at any length, and short texts of sampled languages stay."""

from __future__ import annotations

import numpy as np

from risklattice.llm import language as L

FOLDER = "/root/testdata/sf0.01"


def rejected(spark, texts, model):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return np.array([r.rejected for r in L.predict(frame, model).orderBy("doc_id").collect()])


def test_unseen_languages_and_noise_go_short_texts_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    odd = [(-1 - i, "x", lang) for i, lang in enumerate(("en", "fr", "de", "es") * 3)]  # short rows, wrongly labelled
    for left in ("en", "es"):
        seen = [r for r in rows if r[2] != left] + odd
        model = L.fit(spark.createDataFrame([r for r in seen if r[2] != left], "doc_id long, text string, lang string"))
        unseen = [t for _, t, lang in rows if lang == left and len(t) > 300]
        assert rejected(spark, unseen, model).mean() > 0.95
    model = L.fit(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"))
    rng = np.random.default_rng(3)

    def noise(first, last, n):
        return " ".join("".join(map(chr, rng.integers(first, last, int(rng.integers(2, 10))))) for _ in range(n))

    scripts = [(0x430, 0x450), (0xAC00, 0xD7A0), (0x4E00, 0x9FA0), (0x61, 0x7B)]
    assert rejected(spark, [noise(*s, n) for s in scripts for n in (50, 100, 1000)], model).all()
    assert rejected(spark, [t for _, t, _ in rows], model).mean() < 0.01
    short = [" ".join(t.split()[5 : 5 + n]) for _, t, _ in rows if len(t.split()) > 60 for n in (4, 8, 16)]
    assert rejected(spark, short, model).mean() < 0.03
