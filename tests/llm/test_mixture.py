import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixture


def corpus(seed=1, n=600):
    r = random.Random(seed)
    source = lambda: r.choice(["big", "big", "big", "mid", "small", None, "unlisted"])
    rows = []
    for i in range(n):
        s = source()
        if s == "small" and r.random() < 0.8:
            s = "mid"
        rows.append((i, s, r.choice([None, "", *[" ".join(r.choice(["alpha", "beta", "1234", "é"]) for _ in range(r.randrange(1, 120)))] * 8])))
    return rows + [(0, "mid", "again and again"), (n, "mid", "a very long text " * 3000)]


TARGETS = [("big", 0.3, 2), ("mid", 0.4, 2), ("small", 0.2, 3), ("gone", 0.1, 9)]


def run(spark, rows, parts=3, **k):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("block", F.lit(1)).repartition(parts)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return mixture.mixture(docs, targets, block=64, slots=16, **k)


def test_the_mixture(spark):
    rows = corpus()
    got = run(spark, rows, 2, total=60_000).collect()
    enc = mixture.encoder(mixture.TOKENIZER)
    total = collections.Counter()
    for r in got:
        total[r.source] += r.n_tokens
        assert len(r.tokens) == r.n_tokens <= 64
    size = collections.Counter()
    for _, s, t in rows:
        if t:
            size[s] += len(enc.encode_ordinary(t))
    assert set(total) == {"big", "mid", "small"}
    repeats = {s: m for s, _, m in TARGETS}
    uses = collections.Counter((r.source, r.block) for r in got)
    assert all(n <= repeats[s] for (s, _), n in uses.items())
    assert max(r.turn for r in got if r.source == "small") <= 3
    # small is too small for its share and is used in full; the others keep their ratio.
    assert total["small"] == 3 * size["small"]
    assert total["big"] / total["mid"] == pytest.approx(0.75, rel=0.02)
    assert len({(r.shard, r.slot) for r in got}) == len(got)
    by_shard = collections.Counter(r.shard for r in got)
    assert sorted(by_shard.values())[1:] == [16] * (len(by_shard) - 1)
    # The first turn of a source holds each of its tokens once, in blocks that join to its documents.
    blocks = {r.block: r.tokens for r in got if r.source == "small" and r.turn == 1}
    text = enc.decode([t for b in sorted(blocks) for t in blocks[b]])
    assert sorted(text) == sorted("".join(t for _, s, t in rows if s == "small" and t))


def test_rerun_and_partitioning_change_nothing(spark):
    rows = corpus(2, 200)
    a, b = (sorted(map(str, run(spark, rows, k).collect())) for k in (1, 5))
    assert a == b and a != sorted(map(str, run(spark, rows, 1, seed=9).collect()))


def test_plan():
    t = np.array([1000, 100, 0, 50])
    got = mixture.plan(np.array([0.5, 0.25, 0.1, 0.15]), np.array([1, 2, 5, 1]), t, 800, 10)
    assert got[2] == 0 and got[1] == 20 and got[3] == 5 and got.sum() == 80
    assert mixture.plan(np.array([0.0, -1.0]), np.array([1, 1]), np.array([10, 10]), None, 10).tolist() == [0, 0]
    assert mixture.plan(np.array([1.0]), np.array([2]), np.array([25]), 10**9, 10).tolist() == [6]


def test_permutations():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        p = mixture.permute(np.arange(n), np.full(n, n), np.full(n, 7, np.uint64))
        assert sorted(p) == list(range(n))
    assert mixture.permute(np.array([0]), np.array([10**12]), np.array([1], np.uint64))[0] < 10**12


def test_a_source_listed_twice(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    with pytest.raises(ValueError):
        mixture.mixture(docs, spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1)], "source string, target_share double, max_repeats int"))


def test_empty_tables_and_null_targets(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", None, None), (None, 0.5, 1), ("b", 1.0, None)], "source string, target_share double, max_repeats int")
    assert mixture.mixture(docs, targets).count() == 0
    one = spark.createDataFrame([(1, "b", "x y z"), (2, "a", "q")], "doc_id long, source string, text string")
    assert [r.source for r in mixture.mixture(one, targets).collect()] == ["b"]
    assert mixture.mixture(one, targets.limit(0)).count() == 0
