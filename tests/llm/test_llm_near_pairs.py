"""No pair of texts at similarity 0.8 stays apart, however many others look like it and whatever the edit."""

from __future__ import annotations

import numpy as np

from risklattice.llm import widehash as W


def links(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in W.keep_one(docs).collect()}


def similarity(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_lone_pair_in_a_crowded_key(spark):
    """300 texts of the same words in other orders have one fingerprint, so one crowd under each key; two pairs are near."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(80)])
    texts = [" ".join(rng.permutation(words)) for _ in range(300)]
    for at in (120, 210):
        base = texts[at].split()
        base[40], base[41] = base[41], base[40]
        texts.append(" ".join(base))
    assert len({W.wide_fingerprint(t.encode()) for t in texts}) == 1
    assert all(similarity(texts[i], texts[j]) >= 0.8 for i, j in ((120, 300), (210, 301)))
    assert links(spark, texts) == set(range(300))


def test_blocks_added_and_cut(spark):
    rng = np.random.default_rng(9)
    vocabulary = np.array([f"w{i}" for i in range(2000)])
    say = lambda n: list(rng.choice(vocabulary, n))
    texts, near = [], []
    for i in range(60):
        base = say(int(rng.integers(60, 600)))
        n, at = len(base) * 20 // 100, len(base) // 3
        edited = (base + say(n), say(n) + base, base[: len(base) - n + 4], base[n - 4 :], base[:at] + say(n - 4) + base[at:], base[:at] + base[at + n - 8 :])[i % 6]
        texts += [" ".join(base), " ".join(edited)]
        near.append(similarity(*texts[-2:]))
    assert min(near) >= 0.8 and np.mean(near) < 0.85
    assert links(spark, texts) == set(range(0, 120, 2))
