"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from risklattice.llm import periods
from risklattice.llm.queries import QUERIES


def slow_runs(words: list, least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing each word with that q places on, for every q."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least_length, least_exponent * q))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_all_runs_of_short_texts(words):
    codes = np.array([*words, 9], np.int64)
    start, end, period = periods.runs_of(codes)
    assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == slow_runs(words, 2, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=5), st.integers(1, 9)), max_size=12))
def test_blocks_of_repeats(parts):
    words = [w for part, times in parts for w in part * times]
    runs, collapsed = periods._block([words, words[::-1], []], 6, 4)
    for text, found, left in zip((words, words[::-1], []), runs, collapsed):
        expected = slow_runs(text)
        assert [(r["start"], r["length"], r["period"]) for r in found] == expected
        gone = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert left == b" ".join(w for i, w in enumerate(text) if i not in gone)


def slow_digest(doc_id: int | None, text: str | None) -> tuple:
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(text))


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "é", "word", "."], rng.integers(0, 90)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "x " * 5000), (404, "x y z " * 3 + "x"), (405, "x x " * 8), (405, "x x " * 8), (None, "a b " * 9)]
    spark.createDataFrame([(i, t, "en", 7) for i, t in rows], "doc_id long, text string, lang string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *slow_digest(i, t)) for i, t in rows), key=key)


def test_given_table(spark):
    """Every text of the smallest table of up to 700 words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for row in docs:
        if len(row.text.split()) <= 700:
            assert got[row.doc_id] == slow_digest(row.doc_id, row.text)


def test_long_text_and_empty_table(spark):
    words = [f"w{i % 7919}" for i in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = periods.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(0, 200_000, 7919)] and row.n_words == 200_000
    assert row.collapsed == " ".join(words[:7919])
    assert periods.digests(periods.periodic_runs(docs.limit(0))).count() == 0


@pytest.mark.parametrize("least_exponent", [2, 3])
def test_other_bounds(spark, least_exponent):
    docs = spark.createDataFrame([(1, "a b c a b c a q q")], "doc_id long, text string")
    runs = [tuple(r) for r in periods.periodic_runs(docs, 2, least_exponent).first().runs]
    assert runs == ([(0, 7, 3), (7, 2, 1)] if least_exponent == 2 else [])
