"""The curated pool over tables in which every stage has something to drop."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

LONG = "Count the paths of length nine in a grid of lamps"
DOCS = [
    (1, "one free text about lamps", "a", "en"),
    (2, "One free text, about lamps!", "b", "en"),  # copy of 1
    (3, "a text in two languages", "a", "en"),
    (4, "A text in two languages.", "a", "de"),  # conflict with 3
    (5, "Find x.", "a", "en"),  # equal to an item of two words
    (6, "Prelude: " + LONG + ", then stop", "a", "en"),  # holds an item
    (7, "find x and more", "a", None),
    (8, "another text", "a", "fr"),
    (9, "text of no source", None, "fr"),
    (10, "!?", "a", "en"),
    (11, None, "a", "en"),
]
ITEMS = [(1, "find X"), (2, LONG), (3, None), (4, "...")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pool"))
    spark.createDataFrame(DOCS, "doc_id long, text string, source string, lang string").toPandas().to_parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, problem string").toPandas().to_parquet(f"{d}/heldout_item.parquet")
    return d


def test_conflicts_and_short_items_are_dropped_and_the_rest_ranked(spark, tables):
    rows = entry.queries()["flagship_ranked_pool"](spark, tables).collect()
    assert {(r.doc_id, r.source, r.copies, r.kept) for r in rows} == {(1, "a", 2, 3), (7, "a", 1, 3), (8, "a", 1, 3), (9, None, 1, 1)}
    assert sorted(r["rank"] for r in rows if r.source == "a") == [1, 2, 3]


def test_equals_its_sql(spark, tables):
    assert compare(spark, connect(tables), tables, entry.queries()["flagship_ranked_pool"], entry.oracle_sql()["flagship_ranked_pool"]) == ""


def test_the_entry_is_the_whole_pipeline(spark):
    assert {"rank", "copies", "kept"} <= set(entry.entry(spark).columns)
