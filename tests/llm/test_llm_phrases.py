"""Collocations against brute force: all phrases counted, cut, dropped and ranked."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from risklattice.llm import phrases


def slow(rows: list[tuple], top: int, least: int, longest: int = 5) -> list[tuple]:
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = set()
        for q, a in candidates.items():
            inside |= {q[i:j] for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and f[q[i:j]] <= a}
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out = []
    for lang, size in (("en", 60), ("fr", 200), (None, 30), ("und", 30)):
        words = np.array([f"w{i}" for i in range(size)])
        share = 1 / np.arange(1, size + 1)
        idioms = [" ".join(rng.choice(words, int(n))) for n in rng.integers(2, 8, 12)] + ["é Ä z", "Aé b. C d", "rare1 rare2 rare3 rare4 rare5 rare6"]
        for _ in range(60):
            parts = [str(x) for x in rng.choice(words, 60, p=share / share.sum())]
            for at in rng.integers(0, 60, 14):
                parts[at] = idioms[int(rng.integers(len(idioms)))] + (", ", " ", "\n", "\t", "! ")[int(rng.integers(5))]
            out.append((lang, " ".join(parts)))
    return [*out, ("en", None), ("en", ""), ("xx", " . , "), out[0], out[0], ("tie", "a b. c d. e f. " * 9)]


@pytest.mark.parametrize("how", [{"top": 10, "least": 8, "first_wave": 1, "step": 2}, {"top": 2000, "least": 5}, {"top": 3, "least": 9, "longest": 3, "first_wave": 2}])
def test_equals_brute_force(spark, how):
    rows = corpus()
    docs = spark.createDataFrame([(i, lang, t, 1) for i, (lang, t) in enumerate(rows)], "n long, lang string, text string, words int")
    got = sorted(tuple(r) for r in phrases.collocations(docs, **how).collect())
    assert got == slow(rows, how["top"], how["least"], how.get("longest", 5)) and got


def test_waves_stop_early(spark, monkeypatch):
    """Words that can't reach the last score that counts are never extended."""
    asked = []
    plain = phrases.Filter.__init__
    monkeypatch.setattr(phrases.Filter, "__init__", lambda self, p: (asked.append({r.phrase for r in p.collect()}), plain(self, p))[1])
    rows = [("en", f"common x{i % 7} . left{i % 10} right{i % 10}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(r) for r in phrases.collocations(docs, top=5, least=100).collect()]
    assert got and sorted(got) == slow(rows, 5, 100)
    assert "common" in asked[0] and all("common" not in x for x in asked[1:])


def test_no_phrases_and_empty_table(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0
