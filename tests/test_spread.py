"""Detector readings are spread over posts only where they can be the largest there."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from risklattice.operators import joins
from risklattice.plans import assemble


def test_few_readings_are_spread(spark, monkeypatch):
    rows = [("N", day, 10.0 * k + 2.5, float((7 * i + 3 * day) % 101 - 5), float(i % 5)) for day in (1, 2) for k in (0, 1) for i in range(50)]
    rows += [("N", 1, 2.5, None, 1.0), ("S", 1, 12.5, 8.0, None)]
    det = spark.createDataFrame(rows, "dir string, d int, x double, flow double, heavy double").selectExpr("dir", "make_timestamp_ntz(2024, 1, d, 0, 0, 0) as t", "x", "flow", "heavy")
    speed = det.select("dir", "t", F.explode(F.expr("sequence(0L, 20L)")).alias("pos")).distinct().withColumn("speed", 60.0 + (F.col("pos") * 7) % 50)
    sections = spark.createDataFrame([(0, 0.0, 10.0), (1, 10.0, 20.0)], "k int, lo double, hi double")
    spread = []
    expand = joins.expand_section

    def counted(df, *rest):
        spread.append(df.count())
        return expand(df, *rest)

    monkeypatch.setattr(joins, "expand_section", counted)
    got = assemble.propagate_detectors(det, speed, sections, ["dir"], "t", "pos", "x", "k", "lo", "hi").collect()
    assert spread == [5]
    top = {}
    for d, day, x, q, _ in rows:
        k = int(x // 10)
        top.setdefault((d, day, k, x), []).append(q)
    cv = {}
    for d, k in (("N", 0), ("N", 1)):
        values = [q for (a, _, b, _), qs in top.items() if (a, b) == (d, k) for q in qs if q is not None]
        mean = sum(values) / len(values)
        cv[d, k] = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) / (mean + 1e-6)
    low, high = sorted(cv.values())
    q95 = low + (high - low) * 0.95
    alpha = {key: 0.015 + 0.025 * 0.6 * min(v / (q95 + 1e-6), 1.0) for key, v in cv.items()}
    want = {}
    for (d, day, k, x), qs in top.items():
        for pos in range(10 * k, 10 * k + 11):
            for q in (v for v in qs if v is not None):
                vs, vt = 60 + (int(x) * 7) % 50, 60 + (pos * 7) % 50
                flow = q / (vs + 1e-6) * math.exp(-alpha.get((d, k), 0.025) * abs(pos - x)) * vt
                flow = min(max(flow, q * 0.5), q * 1.5)
                at = (d, day, pos)
                want[at] = max(want.get(at, -math.inf), flow)
    found = {(r.dir, r.t.day, r.pos): r.flow for r in got}
    assert len(got) == len(found) and found.keys() == want.keys()
    assert all(math.isclose(found[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
