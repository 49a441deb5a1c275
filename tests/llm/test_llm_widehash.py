from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from risklattice.llm import widehash as W


def sample(seed=6):
    """Documents with edits from none to many, short ones, and a crowd of near copies."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    common = np.array("the of and in to a is".split())

    def say(n):
        return np.where(rng.random(n) < 0.4, rng.choice(common, n), rng.choice(vocabulary, n))

    texts = []
    for _ in range(25):
        base = say(int(rng.integers(8, 400)))
        texts.append(" ".join(base))
        for share in (0.0, 0.003, 0.01, 0.02, 0.05):
            texts.append(" ".join(np.where(rng.random(len(base)) < share, rng.choice(vocabulary, len(base)), base)))
    crowd = say(300)
    texts += [" ".join([*crowd[:i], "x", *crowd[i + 1 :]]) for i in range(0, 300, 3)]
    return [*texts, "", "word", "Word", "the of", "of the"]


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def groups(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) / len(x | y) if x or y else 1.0) >= 0.8:
            i, j = find(a), find(b)
            root[max(i, j)] = min(i, j)
    return {find(i) for i in range(len(texts))}


def test_one_of_each_group_stays(spark):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("own")).withColumn("group", F.lit(1))
    kept = W.keep_one(docs)
    assert kept.columns == docs.columns
    got, want = {r.doc_id for r in kept.collect()}, groups(texts)
    assert got == want


def test_crowded_keys_make_few_pairs(spark):
    texts = sample()
    marked = W.fingerprints(spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "set_id long, text binary"))
    pairs = {(r.a, r.b) for r in W.candidates(marked, 40).collect()}
    assert pairs and all(a < b for a, b in pairs) and len(pairs) < len(texts) * 33
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    crowd = {find(i) for i in range(150, 250)}
    assert len(crowd) == 1


def test_links_leave_less_to_the_product(spark, monkeypatch):
    """What fingerprints have joined doesn't count as apart, so the product looks at fewer sets; the groups are the same."""
    docs = spark.createDataFrame(list(enumerate(sample())), "doc_id long, text string")
    looked, neighbours, candidates = [], W.jaccard.neighbour_pairs, W.candidates

    def counted(met, *rest):
        looked.append(met.count())
        return neighbours(met, *rest)

    monkeypatch.setattr(W.jaccard, "neighbour_pairs", counted)
    groups_of = lambda: {(r.text_hash, r.group) for r in W.similar_texts(docs).collect()}
    found, first = groups_of(), looked[0]
    monkeypatch.setattr(W, "candidates", lambda *how: candidates(*how).limit(0))
    looked.clear()
    assert groups_of() == found and first < 0.9 * looked[0]


def test_ring_filter_is_the_distance():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (500, 32), dtype=np.uint8)
    b = a.copy()
    for i in range(500):
        for bit in rng.integers(0, 256, int(rng.integers(0, 80))):
            b[i, bit // 8] ^= 1 << (bit % 8)
    distance = np.bitwise_count(a ^ b).sum(1)
    for bits in (0, 17, 40):
        assert (W.within_ring(a, b, bits) == (distance <= bits)).all()


def test_rows_that_need_care(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, None, "y"), (3, "", "y"), (4, "q " * 90_000, "z"), (None, "alone", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    named = docs.withColumns({"row__": F.lit("own"), "TEXT__": F.lit(5), "kept__": F.lit(6), "group": F.lit(7)})
    assert {(r["row__"], r["TEXT__"], r["kept__"], r["group"]) for r in W.keep_one(named).collect()} == {("own", 5, 6, 7)}
    kept = sorted(((r.doc_id, r.source) for r in W.keep_one(docs).collect()), key=repr)
    assert kept == [(1, "x"), (2, "y"), (4, "z"), (None, "n")]
    assert W.keep_one(docs.limit(0)).count() == 0
