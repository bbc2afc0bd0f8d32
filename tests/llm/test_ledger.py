import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from quern.llm import ledger


def canon(t):
    return regex.sub(r"[^\p{L}\p{M}\p{N}+\-<>=]", "", t.lower())


TEXTS = ["", None, "  ", "!!", "a b", "A  B", "a-b", "ab", "ａ b", "é x", "é x", "x<y=+", "x < y = +", "a\tb.", "long " * 5000, "LONG" * 5000, "İx", "i̇x"]


def run(spark, rows, schema="id long, text string, when int", parts=3):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return ledger.collapse(ledger.records(df, "t", "id", ledger.text_key(F.col("text")), F.col("when")))


def expected(rows):
    groups = {}
    for i, t, _ in rows:
        if t and canon(t):
            groups.setdefault(canon(t), []).append(i)
    return groups


@pytest.mark.parametrize("deliveries", [1, 4])
def test_against_brute_force(spark, deliveries):
    r = random.Random(deliveries)
    rows = [(i, r.choice(TEXTS), r.choice([None, *range(deliveries)])) for i in range(200)]
    recs, book = run(spark, rows)
    want = expected(rows)
    assert sorted((x.first_id, x.n) for x in book.read().collect()) == sorted((min(v), len(v)) for v in want.values())
    got = {(x.kept_id, x.copy_id) for x in ledger.copies(recs, book).collect()}
    assert got == {(min(v), i) for v in want.values() for i in v if i != min(v)}


def keyed(spark, rows):
    return spark.createDataFrame(rows, "id long, tbl string, text string").withColumn("key", ledger.text_key(F.col("text")))


def test_ledger_takes_batch_after_batch(spark):
    book = ledger.Ledger(spark)
    for k in range(4):
        df = keyed(spark, [(100 - 10 * k + i, "t", "x" if i % 2 else f"y{k}") for i in range(6)])
        assert book.add(df)
        before = sorted(map(tuple, book.read().collect()))
        assert not book.add(df.limit(0))
        assert sorted(map(tuple, book.read().collect())) == before
    got = {x.n: x.first_id for x in book.read().filter("n > 3").collect()}
    assert got == {12: 71}


def test_a_named_batch_is_taken_once(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    for _ in range(2):
        book = ledger.Ledger(spark, root)
        for k in range(3):
            book.add(keyed(spark, [(k, "t", "a"), (9, "t", f"b{k}")]), f"day_{k}")
    assert {(r.n, r.first_id) for r in book.read().collect()} == {(3, 0), (1, 9)}
    with pytest.raises(ValueError):
        book.add(keyed(spark, [(1, "t", "a")]), "a/b")


def files(folder):
    return {p: p.stat().st_size for p in folder.rglob("*.parquet")}


def test_a_small_batch_writes_little_and_old_versions_go(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}")
    book.add(spark.range(200_000).select("id", F.lit("t").alias("tbl"), F.md5(F.col("id").cast("string")).cast("binary").alias("key")))
    before = files(tmp_path)
    small = spark.range(1_000, 3_000).select((F.col("id") - 1_000).alias("id"), F.lit("t").alias("tbl"), F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    book.add(small)
    after = files(tmp_path)
    assert before.keys() <= after.keys() and sum(after.values()) - sum(before.values()) < 0.05 * sum(before.values())
    assert book.read().agg(F.sum("n"), F.count("*")).first()[:] == (202_000, 200_000)
    plan = book.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # of the deltas alone
    for _ in range(30):
        book.add(small)
    assert len([x for x in tmp_path.iterdir() if x.name.startswith("base")]) == 1 and sum(files(tmp_path).values()) < 1.6 * sum(before.values())
    assert book.read().filter("n > 1").agg(F.min("n"), F.max("n"), F.count("*")).first()[:] == (32, 32, 2_000)


def test_buckets_grow_with_the_ledger():
    assert [ledger.buckets_for(k) for k in (0, 8_000_000, 8_000_001, 10**9)] == [8, 8, 16, 1_024]


def test_payloads(spark):
    a = {"problem": "A b", "points": 900, "style": "x", "none": None}
    rows = [
        (1, json.dumps(a)),
        (2, json.dumps({k.upper(): v for k, v in reversed(a.items())}, indent=2)),
        (3, json.dumps(a | {"points": "900"})),
        (4, json.dumps(a | {"points": 901})),
        (5, json.dumps({k: v for k, v in a.items() if k != "style"})),
        (6, json.dumps(a)[:-5]),
        (7, None),
        (8, "{}"),
        (9, "[1]"),
        (10, ""),
        (11, json.dumps(a | {"problem": "a, B."})),
    ]
    df = spark.createDataFrame(rows, "id long, payload string")
    keys = {r.id: bytes(r.k) if r.k is not None else None for r in df.select("id", ledger.payload_key(F.col("payload")).alias("k")).collect()}
    assert keys[1] == keys[2] == keys[3] == keys[11]
    assert len({keys[1], keys[4], keys[5]}) == 3
    assert [keys[i] for i in (6, 7, 8, 10)] == [None] * 4


def test_a_hot_key_and_other_columns(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit("Hot  text!")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit(1).alias("n"), F.lit(2).alias("key"), F.lit(3).alias("tbl"))
    recs, book = ledger.collapse(ledger.records(df, "t", "id", ledger.text_key(F.col("text")), F.lit(None)))
    got = ledger.copies(recs, book)
    assert got.count() == 9_999 and got.select("kept_id").distinct().collect()[0][0] == 0


def test_empty(spark):
    recs, book = run(spark, [])
    assert book.read().count() == 0 and ledger.copies(recs, book).count() == 0


def test_a_ledger_is_gone_on_with(spark, tmp_path):
    root = f"file://{tmp_path}/ledger"
    make = lambda rows: spark.createDataFrame(rows, "id long, tbl string, text string").withColumn("key", ledger.text_key(F.col("text")))
    ledger.Ledger(spark, root).add(make([(5, "t", "a"), (6, "t", "b"), (None, "t", "a")]))
    ledger.Ledger(spark, root).add(make([(2, "t", "A."), (9, "u", "a")]))
    for broken in ("delta-7", "base-9-8"):  # broke off
        (tmp_path / "ledger" / broken).mkdir(parents=True)
    assert {(r.tbl, r.n, r.first_id) for r in ledger.Ledger(spark, root).read().collect()} == {("t", 3, 2), ("t", 1, 6), ("u", 1, 9)}
