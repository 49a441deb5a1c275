"""Components end when the links are stars, and not a round later."""

from __future__ import annotations

import random

import pytest

from risklattice.llm import components as module


def reach(links):
    label = {x: x for link in links for x in link}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


random.seed(3)
RANDOM = [(random.randrange(90), random.randrange(90)) for _ in range(70)]


@pytest.mark.parametrize(("links", "most"), [
    ([(1, 7), (8, 1), (2, 5)], 0),  # stars
    ([(7, 8), (8, 1)], 1),  # the hub is not the smallest
    ([(i, i + 1) for i in range(20)], 6),
    (RANDOM, 5),
    ([], 0),
])
def test_rounds_end_at_stars(spark, monkeypatch, links, most):
    written, keep = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.append(name) or keep(df, name))
    found = {r.node: r.component for r in module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == reach([(a, b) for a, b in links if a != b])
    assert len(written) - 1 <= most  # the first is of the links themselves


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(RuntimeError):
        module.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), max_rounds=1)
