"""Plans: what reaches the scan, and what a plan must not hold."""

import io
from contextlib import redirect_stdout

import pytest

from quern.plans import registry

D = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(QUERIES["sc02_filtered_scan"](spark, D))
    assert "EqualTo(l_returnflag,R)" in p and "GreaterThan(l_quantity,40.0)" in p
    assert "struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_returnflag:string>" in p
    p = plan(QUERIES["ag04_token_share"](spark, D))
    assert "rendered:struct<n_tokens:int>" in p and "problem" not in p


@pytest.mark.parametrize("name", ["wn01_rank_bins", "wn03_stratum_rank", "or01_balanced_schedule", "jn06_ngram_overlap", "jn12_range_pairs", "ag05_floor_percentiles", "jn04_order_items", "st05_jaccard"])
def test_no_cross_join_and_no_row_by_row_python(spark, name):
    p = plan(QUERIES[name](spark, D))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "BatchEvalPython" not in p


@pytest.mark.parametrize("name", ["wn01_rank_bins", "wn03_stratum_rank", "or03_hash_permutation", "wn08_average_ranks"])
def test_rows_are_never_ranked_in_one_window(spark, name):
    # The only windows over a constant or a group are those over the counts of partitions.
    for line in plan(QUERIES[name](spark, D)).split("\n"):
        if line.startswith("Arguments: [row_number("):
            assert "_part" in line
