import os

import pytest

from lexloom.llm import queries
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    ours, theirs = same(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_with_a_stable_schema(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
