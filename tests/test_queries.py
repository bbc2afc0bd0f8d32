"""Every registered query of the core against its SQL over whole tables; those without SQL must run."""

import pytest
from oracle import compare, connect

from quern.plans import registry

D = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, D, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, D)
    assert len(df.columns) == len(set(df.columns))
    df.collect()
