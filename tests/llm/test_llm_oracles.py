from __future__ import annotations

import pytest
from compare import compare, connect

from risklattice.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert not [c for c in cursor.description if "HUGEINT" in str(c[1])]
    assert compare(df.collect(), df.columns, cursor.fetchall(), columns) is None
