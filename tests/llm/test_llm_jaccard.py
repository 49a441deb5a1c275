"""The Jaccard join against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from risklattice.llm import jaccard


def grams(text: str | None, width: int = 5) -> set:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow(rows: list[tuple], width: int = 5, percent: int = 80) -> list[tuple]:
    sets = [grams(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    members: dict[int, list] = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(root(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def joined(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, set_id int, a string")
    return jaccard.jaccard_join(docs, **how).select("doc_id", "n_shingles", "component_id").collect()


def copies(rng, base: list[str], times: int, edits: int) -> list[str]:
    out = []
    for _ in range(times):
        words = list(base)
        for _ in range(edits):
            words[int(rng.integers(len(words)))] = f"z{int(rng.integers(10**9))}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("order", [{"rounds": 1}, {"share": 1, "least": 2, "most": 50, "crowded": 2, "rounds": 0}])
def test_equals_all_pairs(spark, order):
    """Edits around the bound, chains of them, passages in many texts, short texts, copies, and missing values."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: list(rng.choice(vocabulary, n))
    texts = []
    for n in (30, 60, 150, 300):
        for edits in (1, 2, 4, 8):
            texts += copies(rng, say(n), 6, edits)
    drift = say(100)
    for i in range(20):  # each is near the next, but not the last to the first
        drift[4 * i] = f"y{i}"
        texts.append(" ".join(drift))
    passage = say(60)
    texts += [" ".join(passage + say(int(n))) for n in rng.integers(1, 60, 60)]
    texts += ["a b c", "a b c", "A B  c", "a b c d", "a b", "a", "a b c d e", "a b c d e f", "É b c", "é b c", "x " * 30, "x " * 40]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (None, None), (None, texts[0]), (7, texts[7]), (7, texts[7])]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    assert ordered(joined(spark, rows, **order)) == ordered(slow(rows))


def test_other_widths_and_bounds(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(40)]
    rows = list(enumerate(copies(rng, base, 15, 2) + copies(rng, base, 15, 6)))
    assert ordered(joined(spark, rows, width=2, percent=60, rounds=1)) == ordered(slow(rows, 2, 60))
    assert ordered(joined(spark, rows, width=1, percent=100, rounds=0)) == ordered(slow(rows, 1, 100))


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(1, 100))
def test_overlap_of_two_sets(x, y, percent):
    spread = lambda s: np.sort(np.array(sorted(s), np.uint64) * np.uint64(0x0412345678ABCDEF))
    if x and y:
        assert jaccard.overlap_reaches(spread(x), spread(y), percent) == (100 * len(x & y) >= percent * len(x | y))


def test_group_of_near_copies_makes_few_pairs(spark):
    """400 near copies of one text: pairs grow with the texts, not with their square."""
    rng = np.random.default_rng(7)
    texts = copies(rng, [f"w{i}" for i in range(300)], 400, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared = jaccard.shared_columns(jaccard.incidence(docs, 5, 80))
    assert jaccard.neighbour_pairs(jaccard.apart(shared, None), 80).count() <= 3 * len(texts)
    assert {r.component_id for r in jaccard.jaccard_join(docs).collect()} == {0}


def test_outsiders_of_a_group_meet_few_of_it(spark):
    """500 sets of one component and 20 others under one column: the round before the last makes 32 pairs for each of these."""
    met = spark.createDataFrame([(1, 0, i, 100, 0, 0 if i < 500 else i) for i in range(520)], "key long, part long, set_id long, n int, pos int, comp long")
    assert jaccard.remaining_pairs(met, 80).count() == 20 * 500 + 190
    assert jaccard.remaining_pairs(jaccard.delegates(met), 80).count() == 20 * 32 + 190


def test_group_with_outsiders_equals_all_pairs(spark):
    """A group of near copies, and sets near a tenth of them."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    rows = list(enumerate(copies(rng, base, 160, 3) + copies(rng, base, 60, 4)))
    assert ordered(joined(spark, rows)) == ordered(slow(rows))


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(150_000))), (2, " ".join(f"w{i}" for i in range(125_000)))], "doc_id long, text string")
    assert ordered(jaccard.jaccard_join(docs, rounds=0).select("doc_id", "n_shingles", "component_id").collect()) == [(1, 149_996, 1), (2, 124_996, 1)]
    assert jaccard.jaccard_join(docs.limit(0), rounds=0).count() == 0
