from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from risklattice.llm import bpr, repeats


def slow(rows, length):
    """Rows in order of (null last, doc_id, md5); every window seen before marks its bytes."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest())):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def told(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


def sample(seed=1):
    rng = np.random.default_rng(seed)
    words = ["alpha", "bé", "gamma", "d", "epsilon", "ζ", "eta"]
    say = lambda n: " ".join(rng.choice(words, n))
    line, passage = "this line stands in many documents, ", say(60)
    rows = [(i, say(30) + line + say(20) + (passage if i % 3 == 0 else "") + say(int(rng.integers(1, 40)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(5, rows[5][1]), (5, rows[5][1]), (5, rows[6][1] + "x")]
    rows += [(None, rows[7][1]), (None, None), (200, None), (201, ""), (202, "short"), (203, "a" * 3000), (204, "ab" * 900 + "a" * 500), (205, say(4000))]
    return rows


def test_equals_plain_search(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("no", F.lit("own")).withColumn("digest", F.lit("own"))
    for length, gram in ((100, 20), (40, 12)):
        assert told(repeats.remove_repeats(docs, length, gram, least_buckets=5)) == slow(rows, length)


def test_crowded_grams_take_the_other_way(spark):
    rows = sample(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert told(repeats.remove_repeats(docs, 60, 20, least_buckets=7, crowded=3, one_in=1)) == slow(rows, 60)


def test_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 777)
    rows = sample(3)
    texts = [t or "" for _, t in rows]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    plan = repeats.Plan(100, 20, 4, frozenset())
    found = repeats._sample(data, offsets, np.arange(len(rows)), plan)
    windows = sorted((int(r["text"]), s) for r in found for s in range(int(r["first"]), int(r["last"]) + 1))
    assert windows == [(i, s) for i, t in enumerate(texts) for s in range(len(t.encode()) - 99)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(docs).count() == 0


def test_classes_are_windows():
    rng = np.random.default_rng(3)
    for _ in range(60):
        length, n = int(rng.choice([8, 9, 16, 33, 100])), int(rng.integers(100, 500))
        data = rng.integers(97, 97 + int(rng.choice([1, 2, 3])), n).astype(np.uint8)
        data = np.concatenate((data, data[: n // 2]))
        starts = np.flatnonzero(rng.random(len(data) - length + 1) < 0.7)
        got = bpr.classes(data, starts, length).tolist()
        windows = [data[s : s + length].tobytes() for s in starts]
        assert len(set(zip(got, windows))) == len(set(got)) == len(set(windows))
