from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from risklattice.llm import sketch as S


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def sample():
    rng = np.random.default_rng(9)
    say = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 500, n))
    texts = [say(int(n)) for n in rng.integers(1, 300, 60)] + ["", "one", "a b c d", "é😀 x", say(20_000)]
    return [(3 * i, t) for i, t in enumerate(texts)]


def test_edits_and_likeness(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own")).withColumn("half", F.lit("own")).repartition(5)
    got = {r.doc_id: r for r in S.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, (doc_id, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(abs(r.near_edited - likeness(text, edited)))
        errors.append(abs(r.near_next - likeness(text, other)))
        n = len(shingles(text))
        assert abs(r.n_shingles - n) <= (0.3 * n if n >= S.SIZE else 0)
    assert np.mean(errors) < 0.02 and max(errors) < 0.15


def test_rows_that_need_care(spark):
    rows = [(None, None), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (2, "")]
    got = S.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.n_chars == 11}) == 1 and len({r.edited_sha256 for r in got if r.n_chars == 11}) == 1
    empty = [r for r in got if r.n_chars == 0]
    assert all(r.fingerprint == "" and r.near_edited == 1.0 for r in empty)
    assert S.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = S.edited_fingerprints(spark.createDataFrame([(4, "x y z w")], "doc_id long, text string")).first()
    assert alone.next_id == 4 and alone.near_next == 1.0


def test_merge_of_parts(spark):
    texts = [t for _, t in sample()[:40]]
    parts = spark.createDataFrame([("all", t) for t in texts] + [("none", ""), (None, "a b c d e")], "name string, text string")
    parts = parts.withColumn("sketch", S.sketch(S.shingle_hashes(S.word_hashes(F.col("text")))))
    whole = {r.name: r.sketch for r in S.merge_parts(parts, "name").collect()}
    hashes = sorted({h for r in parts.filter("name = 'all'").select(S.shingle_hashes(S.word_hashes(F.col("text"))).alias("h")).collect() for h in r.h})
    assert whole["all"] == hashes[: S.SIZE] and whole["none"] == [] and len(whole[None]) == 1


def test_containment(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    row = spark.createDataFrame([(long, " ".join(long.split()[:2000]))], "a string, b string").select(
        *[S.sketch(S.shingle_hashes(S.word_hashes(F.col(c))), 512).alias(c) for c in "ab"])
    r = row.select(S.containment(F.col("b"), F.col("a"), 512).alias("in_a"), S.containment(F.col("a"), F.col("b"), 512).alias("in_b")).first()
    assert r.in_a > 0.85 and abs(r.in_b - 0.5) < 0.1
