"""The registered queries for training data: against SQL where there is one, else that they run and rerun alike."""

import pytest
from oracle import compare, connect, plain

from quern.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, D, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_and_reruns_alike(spark, name):
    a, b = (sorted((repr(plain(tuple(r))) for r in QUERIES[name](spark, D).collect())) for _ in range(2))
    assert a == b and a
