import hashlib
import random

from pyspark.sql import functions as F

from quern.llm import sample

SCHEMA = "item_sha256 string, rank long, batch_no int"


def number(item):
    return int(hashlib.sha256(f"{sample.SEED}:{item}".encode()).hexdigest()[:13], 16) / 2**52


def rows_of(n, batches, seed=1):
    r = random.Random(seed)
    items = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    spelled = lambda x: r.choice([x, x.upper(), f" {x}", f"{x[:9]} {x[9:]}"])
    return [(r.choice([None, "", "  ", *[spelled(r.choice(items))] * 20]), r.choice([None, r.randrange(99)]), r.choice([None, *range(1, batches + 1)])) for _ in range(6 * n)]


def picked(df):
    return {r.item_sha256: (r.prn, r.first_batch, r.selected_batch, r.best_rank) for r in df.collect()}


def test_against_brute_force_and_partitioning(spark):
    rows = rows_of(300, 6)
    got = [picked(sample.stable_sample(spark.createDataFrame(rows, SCHEMA).withColumn("prn", F.lit(1)).repartition(k))) for k in (1, 5)]
    seen = {}
    for item, rank, b in rows:
        i = "".join((item or "").split()).lower()
        if i:
            e = seen.setdefault(i, [99, None])
            e[0] = min(e[0], b or 0)
            e[1] = rank if e[1] is None else e[1] if rank is None else min(rank, e[1])
    present = sorted({b or 0 for i, _, b in rows if i and i.strip()})
    want = {}
    for i, (first, best) in seen.items():
        for b in present:
            if b >= first and number(i) < max(sample.threshold(x) for x in present if x <= b):
                want[i] = (number(i), first, b, best)
                break
    assert got[0] == got[1] == want


def test_what_was_selected_stays(spark):
    rows = rows_of(300, 8)
    before = set()
    for upto in (1, 3, 5, 8):
        now = set(picked(sample.stable_sample(spark.createDataFrame([x for x in rows if (x[2] or 0) <= upto], SCHEMA))))
        assert before <= now
        before = now


def test_thresholds_that_fall_are_held(spark):
    rows = [(hashlib.sha256(str(k).encode()).hexdigest(), 1, 1 + k % 2) for k in range(400)]
    got = picked(sample.stable_sample(spark.createDataFrame(rows, SCHEMA), lambda b: {1: 0.3, 2: 0.1}[b]))
    assert set(got) == {i for i, _, _ in rows if number(i) < 0.3}


def test_register_keeps_numbers(spark):
    reg = sample.Register(spark)
    reg.insert(spark.createDataFrame([("a",), ("b",)], "item string"), 1)
    reg.insert(spark.createDataFrame([("b",), ("c",)], "item string"), 2)
    assert {(r.item, r.first_batch) for r in reg.read().collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_empty(spark):
    assert sample.stable_sample(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_register_is_gone_on_with(spark, tmp_path):
    root = f"file://{tmp_path}/register"
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "item string")
    sample.Register(spark, root).insert(df("a", "b"), 1)
    sample.Register(spark, root).insert(df("b", "c"), 2)
    sample.Register(spark, root).insert(df("b", "c", "d"), 2)  # the batch comes again
    assert {(r.item, r.first_batch) for r in sample.Register(spark, root).read().collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2)}


def test_a_later_run_with_a_lower_threshold_keeps_what_was_selected(spark, tmp_path):
    root = f"file://{tmp_path}/register"
    rows = [(hashlib.sha256(str(k).encode()).hexdigest(), 1, 1 + k % 2) for k in range(400)]
    first = picked(sample.stable_sample(spark.createDataFrame(rows, SCHEMA), lambda b: 0.3, root))
    later = [(hashlib.sha256(str(k).encode()).hexdigest(), 1, 3) for k in range(300, 500)]
    then = picked(sample.stable_sample(spark.createDataFrame(later, SCHEMA), lambda b: 0.1, root))
    assert first.keys() <= then.keys() == {i for i, _, _ in rows + later if number(i) < 0.3}
    assert {i: v[:3] for i, v in first.items()} == {i: v[:3] for i, v in then.items() if i in first}
    again = picked(sample.stable_sample(spark.createDataFrame(rows, SCHEMA), lambda b: 0.9, root))
    assert {i: v[:3] for i, v in again.items()} == {i: v[:3] for i, v in then.items()}  # batches 1 and 2 come again
