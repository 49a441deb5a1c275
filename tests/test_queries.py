"""Every registered query against its SQL at the smallest scale.

Queries without SQL must return rows. Set TEST_SF=sf0.01 for the larger run.
"""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

from risklattice.queries import ORACLES, QUERIES, load_all

load_all()
FOLDER = f"/root/testdata/{os.environ.get('TEST_SF', 'sf0.001')}"
SLOW = {"m04_fit_logit", "m06_fit_forest", "m10_oof_scores", "m19_choose", "m20_fit_severity"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert compare(rows, df.columns, cursor.fetchall(), names) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
