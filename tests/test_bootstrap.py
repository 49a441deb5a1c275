"""Bootstrap over score ranges of equal count: same numbers as plain resampling, and bounded ranges however scores are spread."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.operators import evaluate as E


def plain(day, score, y, reps, seed):
    """(ap, auroc) by replicate from weights of rows."""
    number = {d: i for i, d in enumerate(sorted(set(day)))}
    weights = E._multiplicities(len(number), reps, seed)
    out = {}
    for r in range(reps):
        w = weights[[number[d] for d in day], r]
        p, q = (w * y).sum(), (w * (1 - y)).sum()
        if not p or not q:
            continue
        ap = u = above_n = above_p = 0.0
        for s in sorted(set(score), reverse=True):
            at = score == s
            n, k = w[at].sum(), (w * y)[at].sum()
            u += k * (q - (above_n - above_p) - (n - k)) + k * (n - k) / 2
            above_n, above_p = above_n + n, above_p + k
            ap += k * above_p / above_n if above_n else 0
        out[r] = (ap / p, u / (p * q))
    return out


@pytest.mark.parametrize("rows", [1, 7, 16_384])
def test_equals_plain_resampling_with_all_scores_in_one_octave(spark, rows):
    rng = np.random.default_rng(4)
    n = 6000
    score = 0.5 + rng.integers(0, 5000, n) / 1e6  # one octave, within a hundredth
    score[: n // 3] = 0.502  # a third of all rows has one score
    day, y = rng.integers(0, 9, n), (rng.random(n) < 0.2).astype(int)
    df = spark.createDataFrame([("m", int(d), float(s), int(t)) for d, s, t in zip(day, score, y)], "model string, day int, s double, y int")
    df = df.union(df.limit(5).withColumn("s", F.lit(None).cast("double")))
    got = {r.rep: (r.ap, r.auroc) for r in E.bootstrap_days(df, "y", "s", "day", ["model"], n=12, seed=3, range_rows=rows).collect()}
    want = plain(day, score, y, 12, 3)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[r], want[r], atol=1e-9) for r in want)


def test_ranges_are_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [(int(d), float(0.5 + s / 1e9)) for s in rng.integers(0, 3000, 20_000) for d in (0, 1)]
    counts = spark.createDataFrame(rows, "d int, s double").distinct()
    ranges = E.score_ranges(counts, [], "s", 100)
    sizes = [r["count"] for r in counts.join(ranges, "s").groupBy("_range").count().collect()]
    assert max(sizes) < 100 + 2 and len(sizes) >= counts.count() / 102
    bounds = ranges.groupBy("_range").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("_range").collect()
    assert all(a.lo > b.hi for a, b in zip(bounds, bounds[1:]))
