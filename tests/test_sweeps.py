"""Threshold sweeps on a handful of rows whose rates can be told by hand."""

from __future__ import annotations

import pytest

from risklattice.operators import evaluate

ROWS = [(1, 0.9, 0.9), (1, 0.6, 0.2), (0, 0.6, 0.9), (0, 0.1, 0.1)]


def test_sweep_of_one_threshold(spark):
    frame = spark.createDataFrame(ROWS, "y int, s double, t double")
    best = evaluate.sweep_threshold(frame, "y", "s", [0.1, 0.5, 0.8], "f2").first()
    assert (best.threshold, best.tp, best.fp, best.fn) == (0.5, 2, 1, 0)
    assert (best.f1, best.f2) == (pytest.approx(0.8), pytest.approx(10 / 11))


def test_sweep_of_two_stages(spark):
    frame = spark.createDataFrame(ROWS, "y int, s double, t double")
    best = evaluate.sweep_two_stage(frame, "y", "s", "t", [0.5, 0.8], [0.1, 0.5], "f1").first()
    assert (best.s1, best.s2, best.tp, best.fp) == (0.5, 0.1, 2, 1)
    assert (best.f1, best.f2) == (pytest.approx(0.8), pytest.approx(10 / 11))
