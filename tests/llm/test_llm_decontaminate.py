from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from risklattice.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def slow(docs, items, window=13, share=0.8):
    """Best window of each item in each document, over all shifts."""
    out = {}
    for doc_id, text in docs:
        d = words(text)
        for item_id, item in items:
            t = words(item)
            size = min(window, len(t))
            if not t:
                continue
            for shift in range(-len(t), len(d)):
                agree = [0 <= shift + k < len(d) and d[shift + k] == w for k, w in enumerate(t)]
                for s in range(len(t) - size + 1):
                    n = sum(agree[s : s + size])
                    if n >= np.ceil(share * size - 1e-9):
                        out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), n)
    return out


def sample():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, say(int(rng.integers(13, 30)))) for i in range(12)] + [(50, say(4)), (51, say(7)), (52, []), (None, say(15))]
    items += [(100 + n, say(n)) for n in range(1, 13)]
    docs = []
    for i in range(60):
        own = say(int(rng.integers(0, 60)))
        taken = list(items[i % len(items)][1])
        for _ in range(i // 20):  # up to two substitutions
            if len(taken) >= 13:
                taken[int(rng.integers(0, len(taken)))] = "changed"
        docs.append((i, " ".join(own + (taken if i % 2 else taken[: len(taken) // 3]) + say(10))))
    for n in range(1, 13):  # all substitutions that a short item may have, wherever they are
        for gone in combinations(range(n), n - int(np.ceil(0.8 * n - 1e-9))):
            taken = [f"gone{i}" if i in gone else w for i, w in enumerate(dict(items)[100 + n])]
            docs.append((1000 * n + len(docs), " ".join(say(3) + taken + say(3))))
    items = [(i, ", ".join(t).title()) for i, t in items]
    return docs + [(None, docs[1][1]), (1, docs[1][1]), (90, None), (91, "")], items + [(None, items[0][1]), (53, None)]


def found(df):
    return {(r.doc_id, r.item_id): r.n_matched for r in df.collect()}


def test_masks_leave_no_window_out():
    for gone in combinations(range(D.WINDOW), 2):
        assert any(
            all(start + i not in gone for i, c in enumerate(m) if c == "1") for m in D.MASKS for start in range(D.WINDOW - len(m) + 1))


def test_equals_plain_search(spark):
    docs, items = sample()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("own")).withColumn("h", F.lit("own"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("own"))
    wanted = slow(docs, items)
    assert len(wanted) > 200
    assert found(D.overlaps(d, b)) == wanted
    assert found(D.overlaps(d, b, broadcast_seeds=0)) == wanted


def test_clean_rows_stay(spark):
    docs, items = sample()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row__", F.lit("own")).withColumn("FOUND__", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    leaks = {k for k, _ in slow(docs, items)}
    kept = D.keep_clean(d, b)
    assert kept.columns == d.columns and {r["row__"] for r in kept.collect()} == {"own"}
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((i or -1) for i, _ in docs if i not in leaks)


def test_empty(spark):
    docs, items = sample()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.overlaps(d.limit(0), b).count() == 0 and D.overlaps(d, b.limit(0)).count() == 0
