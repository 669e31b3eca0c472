import os

import pytest

from lexloom.plans import collections, core_problems, packs, reference
from tests.oracle import DATA, same

CASES = [(name, m.queries()[name], sql) for m in (reference, packs, collections, core_problems) for name, sql in m.oracle_sql().items()]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_oracle(spark, name, query, sql):
    ours, theirs = same(spark, query, sql)
    assert ours == theirs


def test_lookup_plan(spark):
    plan = reference.r_lookup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_snapshot_plan_is_all_jvm_and_combines_before_shuffling(spark):
    plan = core_problems.p1_found(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "partial_bit_or" in plan
