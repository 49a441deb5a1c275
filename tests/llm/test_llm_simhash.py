from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from risklattice.llm import simhash
from risklattice.llm.components import components


def slow_fingerprint(text):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ")
             .replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: dict[int, int], bits: int) -> dict[int, int]:
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints_match_plain_python(spark):
    texts = [None, "", " \n", "One", "a b", "A b\tC\x0bd", "é É ÀA x y z", "w " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(df).collect()}
    assert got == {i: slow_fingerprint(t) for i, t in enumerate(texts)}


def test_components_of_random_fingerprints(spark):
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 2**64, 40, dtype=np.uint64)]
    for _ in range(260):  # chains and clouds around the first ones
        base = fps[int(rng.integers(0, len(fps)))]
        fps.append(base ^ sum({1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))}))
    by_id = dict(enumerate(fps))
    signed = [(i, f - 2**64 if f >= 2**63 else f) for i, f in by_id.items()]
    distinct = spark.createDataFrame(signed, "doc_id long, fp long")
    for bits in (1, 2):
        for most in (64, 2):  # with 2, nearly all goes the way of crowded keys
            found = simhash.links(distinct.select("fp").distinct(), bits, most)
            label = {r.node: r.component for r in components(found).collect()}
            least = {}
            for i, f in signed:
                c = label.get(f, f)
                least[c] = min(least.get(c, i), i)
            assert {i: least[label.get(f, f)] for i, f in signed} == slow_components(by_id, bits)


def test_rows_that_need_care(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (2, None, "y"), (3, "", "y"), (4, "q " * 9000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("fp", F.lit("own"))
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
