"""Every query against its SQL on the given tables."""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.exists(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare(df, duck, SQL[name]) == []
    else:
        assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.exists(SF_DIR), reason="no tables")
def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)
