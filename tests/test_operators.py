"""Operators without SQL against plain Python, and the edge cases of those that are shared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import curate, geometry, joins, ranks, replay, schedule, score
from quern.operators.quantiles import quantiles
from quern.session import lookup_skewed


def test_ranked_with_nulls_and_a_hot_group(spark):
    rows = [("a" if i % 3 else None, i) for i in range(300)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v int"), [F.desc("v")], "r", ("g",), "n").collect()
    for g in ("a", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [r.r for r in own] == list(range(1, len(own) + 1))
        assert [r.v for r in own] == sorted((r.v for r in own), reverse=True)
        assert {r.n for r in own} == {len(own)}


def test_ranked_of_nothing(spark):
    assert ranks.ranked(spark.createDataFrame([], "g string, v int"), ["v"], "r", ("g",)).count() == 0


def test_running_sum(spark):
    df = spark.createDataFrame([(i, i * i, "x" if i < 7 else None) for i in range(20)], "i int, v long, g string")
    got = {r.i: r.s for r in ranks.running_sum(df, "v", ["i"], "s", ("g",)).collect()}
    for i in range(20):
        assert got[i] == sum(k * k for k in range(0 if i < 7 else 7, i + 1))


@pytest.mark.parametrize("n", [1, 2, 7])
def test_quantiles(spark, n):
    v = [random.Random(n).random() for _ in range(n)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(99, None)], "i int, v double")
    assert quantiles(df, "v", ["i"], {"q": 0.3}).first().q == pytest.approx(np.quantile(v, 0.3))
    assert quantiles(df, "v", ["i"], {"q": 0.3}, how="floor").first().q == sorted(v)[int(0.3 * (n - 1))]


def test_lookup_skewed(spark):
    rows = spark.range(30_000).select((F.when(F.col("id") < 20_000, 1).otherwise(F.col("id"))).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("k") + 1)
    got = lookup_skewed(rows, table, ["k"], "n")
    assert got.count() == 30_000 and got.filter("x <> k + 1").count() == 0


def test_range_join(spark):
    r = random.Random(1)
    a, b = [(i, r.uniform(-50, 50)) for i in range(80)], [(i, r.uniform(-50, 50)) for i in range(80)]
    got = joins.range_join(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), "x", "y", 3.0)
    assert {(p.i, p.j) for p in got.collect()} == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 3}


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "2024-01-03 10:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-05 00:00:00")], "k int, t string").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([(1, "2024-01-03 09:00:00", "a"), (1, "2024-01-03 11:00:00", "b"), (2, "2024-01-02 00:00:00", "c")], "k int, u string, v string").withColumn("u", F.to_timestamp("u"))
    got = {(r.k, r.t.day): r.v for r in joins.as_of_join(left, right, "t", "u", ["k"]).collect()}
    assert got == {(1, 3): "a", (1, 1): None, (2, 5): "c"}


def test_greedy_near_dedup_equals_the_pass(spark):
    import hashlib

    def simhash(ts):
        t = np.zeros(64, int)
        for x in ts:
            h = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")
            t += np.array([1 if h >> i & 1 else -1 for i in range(64)])
        return sum(1 << i for i in range(64) if t[i] >= 0) if ts else 0

    r = random.Random(3)
    base = [[f"w{r.randrange(500)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for i in range(150):
        ts = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            ts[r.randrange(60)] = f"w{r.randrange(500)}"
        rows.append((i, r.choice("ab"), r.choice([None, "f1", "f2", f"u{i}"]), ts if i % 40 else []))
    got = {x.id: x.kept for x in curate.greedy_near_dedup(spark.createDataFrame(rows, "id long, source string, family string, tokens array<string>"), "id", "source", "family", "tokens").collect()}
    seen, kept, families = set(), [], set()
    for i, s, f, ts in rows:
        h = simhash(ts)
        ok = h not in seen and not (f and (s, f) in families) and all(bin(h ^ k).count("1") > 3 for k in kept)
        seen.add(h)
        if ok:
            kept.append(h)
            if f:
                families.add((s, f))
        assert got[i] == ok, i


def test_greedy_near_dedup_broadcasts_nothing(spark, monkeypatch):
    plans, written = [], curate.materialize

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(curate, "materialize", watched)
    rows = [(i, "a", "f" if i % 2 else None, [f"w{i % 5}", "x"]) for i in range(20)]
    out = curate.greedy_near_dedup(spark.createDataFrame(rows, "id long, source string, family string, tokens array<string>"), "id", "source", "family", "tokens")
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    pairs = curate.hamming_pairs(spark.range(9).select("id", F.xxhash64("id").alias("h")), "id", "h", 3, 5)
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)


def test_interleave_keeps_shares(spark):
    df = spark.createDataFrame([(i, "abc"[min(2, i % 7 // 3)]) for i in range(210)], "i long, s string")
    got = schedule.stratified_interleave(df, "i", "s", F.sha2(F.col("i").cast("string"), 256), 60).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 61))
    for k in (7, 21, 60):
        for s in "abc":
            share = sum(1 for i in range(210) if "abc"[min(2, i % 7 // 3)] == s) / 210
            assert abs(sum(r.s == s for r in got[:k]) - share * k) <= 1


@pytest.mark.parametrize("m,t", [(1, 5), (4, 4), (4, 2), (4, 11)])
def test_balanced_schedule(spark, m, t):
    support = spark.range(m).withColumnRenamed("id", "i")
    targets = schedule.exposure_targets(support, "i", t, F.sha2(F.col("i").cast("string"), 256))
    rows = schedule.balanced_schedule(targets, "i", 1, "x", 3).collect()
    assert sorted(r.schedule_index for r in rows) == list(range(t))
    counts = [sum(r.i == k for r in rows) for k in range(m)]
    assert max(counts) - min(counts) <= 1 and all(r.step == r.schedule_index // 3 for r in rows)


def test_apportion_adds_up(spark):
    s = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3)], "s string, n long")
    got = {r.s: r.quota for r in schedule.apportion(s, "s", "n", 10, F.sha2("s", 256)).collect()}
    assert sum(got.values()) == 10 and got["a"] in (4, 5) and all(v >= 2 for v in got.values())


def test_farthest_first_and_d_optimal(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(40, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, e array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    mean = u.mean(0)
    chosen = [int(np.argmax(u @ mean))]
    while len(chosen) < 5:
        near = (u @ u[chosen].T).max(1)
        near[chosen] = 9
        chosen.append(int(np.argmin(near)))
    assert [x.i for x in schedule.farthest_first(df, "i", "e", 5, "s").orderBy("rank").collect()] == chosen
    inv, done = np.eye(6), []
    for _ in range(4):
        g = np.log1p(np.einsum("ij,jk,ik->i", v, inv, v))
        g[done] = -1
        done.append(int(np.argmax(np.round(g, 9))))
        z = inv @ v[done[-1]]
        inv = inv - np.outer(z, z) / (1 + v[done[-1]] @ z)
    assert [x.i for x in schedule.greedy_d_optimal(df, "i", "e", 4).orderBy("rank").collect()] == done


def test_inclusion_probabilities(spark):
    df = spark.createDataFrame([(float(i + 1), float(i % 7)) for i in range(100)], "c double, s double")
    for budget in (1e9, 0.001, 1500.0):
        got = replay.inclusion_probabilities(df, "c", "s", budget).collect()
        spent = sum(r.q * r.c for r in got)
        assert all(0.01 <= r.q <= 1 for r in got)
        if budget == 1500.0:
            assert spent == pytest.approx(budget, rel=1e-6)
    with pytest.raises(ValueError):
        replay.inclusion_probabilities(df.withColumn("s", F.lit(0.0)), "c", "s", 10.0)


def test_draw_keeps_one(spark):
    df = spark.createDataFrame([(1, 1e-9), (2, 2e-9)], "i long, q double")
    assert [r.i for r in replay.bernoulli_draw(df, "i", "q", 1, 1).collect()] == [2]


def test_count_sketch_is_linear(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)] + [("a", 3, 4.0)], "k string, i long, v double")
    whole = {r.bucket: r.value for r in replay.count_sketch(df, "k", "i", "v", 3, 8).collect()}
    parts = [replay.count_sketch(df.filter(f"i % 2 = {k}"), "k", "i", "v", 3, 8).collect() for k in (0, 1)]
    for b, x in whole.items():
        assert x == pytest.approx(sum(r.value for p in parts for r in p if r.bucket == b))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,boxed,inner",
    [("a \\boxed{1} b \\boxed{x{y}z}", "\\boxed{x{y}z}", "x{y}z"), ("none", None, None), ("\\boxed{1", None, None), ("\\fbox{3}", "\\fbox{3}", None), (None, None, None), ("", None, None)],
)
def test_boxed(spark, text, boxed, inner):
    assert one(spark, text, X.last_boxed) == boxed
    assert one(spark, text, lambda c: X.unboxed(X.last_boxed(c))) == inner


@pytest.mark.parametrize("a,b,same", [("\\frac{1}{2}", "0.5", True), ("-\\frac{1}{2}", "-0.5", True), ("1,000", "1000", True), ("50\\%", "0.5", False), ("3/6", "1/2", True), ("x", "x", True), ("x", "y", False), (None, "1", False), ("+7", "7", True)])
def test_answers(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(score.answers_equal(X.plain_answer(F.col("a")), X.plain_answer(F.col("b"))).alias("x")).first().x == same


@pytest.mark.parametrize("a,b,same", [("007", "7", True), ("-0", "0", True), ("1e-7", "0", True), ("nan", "0", False), ("1 2", "1", False), ("1 2", "2 1", False), ("a  b\n", "a b", True), ("1000000.1", "1000000.9", True), ("1.0", "1.1", False)])
def test_outputs(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(score.outputs_equivalent(F.col("a"), F.col("b")).alias("x")).first().x == same


@pytest.mark.parametrize("text,want", [("no fence", None), ("```\nx\n```", "x\n"), ("```python\na\n```\n```\nb\n```", "a\n"), ("```python\na\n```\n```python\nb\n```", "b\n"), ("```python\na", None)])
def test_fences(spark, text, want):
    assert one(spark, text, X.last_fence) == want


@pytest.mark.parametrize("text,want", [("a</think> b", "b"), ("a", ""), ("a</think>b</think>\n c", "c")])
def test_after_think(spark, text, want):
    assert one(spark, text, X.after_think) == want


def test_normalisation(spark):
    assert one(spark, " Ａ  b c\n", X.normalized) == "A b c"
    assert one(spark, "Ab-C 9!", X.loose_key) == "abc9"


def test_ngrams(spark):
    words = lambda t: X.words_of(F.lit(t))
    get = lambda t, **k: spark.range(1).select(X.ngrams(words(t), 3, **k).alias("x")).first().x
    assert get("a b c d a b c") == ["a b c", "b c d", "c d a", "d a b"]
    assert get("a b") == [] and get("a b", short_whole=True) == ["a b"] and get("", short_whole=True) == []


def test_stable_hash_is_the_json_array(spark):
    import hashlib
    import json

    want = hashlib.sha256(json.dumps([42, "rank", "a\"é", 7], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    got = spark.createDataFrame([('a"é', 7)], "s string, i long").select(X.stable_hash(42, "rank", X.json_escape(F.col("s")), F.col("i").cast("string")).alias("x")).first().x
    assert got == want


def test_permutation_test():
    assert geometry.permutation_p([1, 2, 3, 4], [1, 2, 3, 4]) == pytest.approx(2 / 24)
    assert np.isnan(geometry.permutation_p([1, 1, 1], [1, 2, 3]))


def test_cosine_of_a_zero_vector_is_null(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 2.0])], "l string, v array<double>")
    got = geometry.cosines(geometry.gram(geometry.mean_vectors(df, "l", "v"), "l")).filter("a < b").first()
    assert got.cosine is None


def test_variance_components_add_up(spark):
    r = np.random.default_rng(1)
    rows = [(int(g), float(x)) for g in range(6) for x in r.normal(g, 1, 5 + g)]
    got = geometry.variance_components(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
    assert got.common + got.between + got.within == pytest.approx(sum(v * v for _, v in rows))


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_hamming_pairs(spark, blocks):
    r = random.Random(blocks)
    base = [r.getrandbits(64) for _ in range(20)]
    hashes = []
    for i in range(120):
        h = r.choice(base)
        for _ in range(r.randrange(6)):
            h ^= 1 << r.randrange(64)
        hashes.append(h)
    hashes = list(dict.fromkeys([*hashes, 0, 2**64 - 1]))
    df = spark.createDataFrame([(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in enumerate(hashes)], "i long, h long")
    got = {tuple(x) for x in curate.hamming_pairs(df, "i", "h", 3, blocks).collect()}
    assert got == {(i, j) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if i < j and (x ^ y).bit_count() <= 3}
