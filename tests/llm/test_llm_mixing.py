from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from risklattice.llm import mixing


def slow_cycle(weights):
    """Earliest deadline first, slot by slot."""
    total, done, picks = sum(w for _, w in weights), Counter(), []
    for t in range(total):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, (_, w) in enumerate(weights) if done[i] * total // w <= t and done[i] < w]
        pick = min(ready)[1]
        done[pick] += 1
        picks.append(pick)
    return picks


def test_cycle_keeps_every_deadline(spark):
    weights = [(None, 3), ("a", 17), ("b", 1), ("c", 8), ("d", 8), ("e", 5)]
    got = mixing.cycle(spark.createDataFrame(weights, "source string, weight int")).collect()
    picks = slow_cycle(weights)
    total = len(picks)
    assert {r.source: r.slots for r in got} == {s: [t for t, p in enumerate(picks) if p == i] for i, (s, _) in enumerate(weights)}
    for i, (_, w) in enumerate(weights):
        for t in range(1, total + 1):
            assert abs(picks[:t].count(i) - w * t / total) < 1


def test_mix_is_whole_and_in_proportion(spark):
    rows = [(i, "big") for i in range(900)] + [(1000 + i, "mid") for i in range(300)] + [(2000 + i, None) for i in range(40)]
    rows += [(7, "big"), (7, "big"), (None, "mid"), (None, "mid"), (3000, "unnamed")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("slot", F.lit("own")).withColumn("weight", F.lit("own"))
    weights = spark.createDataFrame([("big", 2), ("mid", 2), (None, 1), ("absent", 1)], "source string, weight int")
    got = mixing.mix(docs, weights, block=10).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    by_source = defaultdict(list)
    for r in sorted(got, key=lambda r: r.position):
        by_source[r.source].append(r)
        assert r.slot is None or r.release <= r.slot < r.deadline
    assert by_source["unnamed"][0].position == len(rows) - 1
    for own in by_source.values():
        assert [r.place for r in own] == list(range(len(own)))
    early = Counter(r.source for r in got if r.position < 150)
    assert abs(early["big"] - 60) <= 10 and abs(early["mid"] - 60) <= 10 and abs(early[None] - 30) <= 10


def test_weights_and_order_of_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "ab"[i % 4 == 0]) for i in range(400)], "doc_id long, text string, source string")
    weights = mixing.weights_by_size(docs, power=1.0, resolution=100)
    assert {r.source: r.weight for r in weights.collect()} == {"a": 75, "b": 25}
    ordered = mixing.in_order(docs, weights, block=4)
    assert ordered.columns == docs.columns and {r.doc_id for r in ordered.collect()} == set(range(400))
    assert Counter(r.source for r in ordered.collect()[:80]) == {"a": 60, "b": 20}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs, mixing.weights_by_size(docs)).count() == 0
    assert mixing.in_order(docs, mixing.weights_by_size(docs)).count() == 0
