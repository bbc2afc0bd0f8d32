import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.words import lowered
from quern.llm import neardup

WORD = re.compile(r"[^\W_]+")


def shingles(t, n, least):
    w = WORD.findall(lowered(t)) if t else []
    return frozenset(zip(*(w[i:] for i in range(n)))) if len(w) >= max(n, least) else None


def brute(rows, j, n, least):
    sets = {i: s for i, t in rows if (s := shingles(t, n, least))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k >= j * (len(sets[a]) + len(sets[b]) - k) - 1e-9:
            parent[find(a)] = find(b)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(i)
    return {(min(v), i) for v in groups.values() for i in v if i != min(v)}


def corpus(seed, n=160, vocab=4000, size=60):
    r = random.Random(seed)
    base = [[f"w{r.randrange(vocab)}" for _ in range(r.randrange(20, size))] for _ in range(n // 5)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            k = r.randrange(len(w))
            w[k : k + r.randrange(3)] = [f"w{r.randrange(vocab)}" for _ in range(r.randrange(3))]
        t = r.choice([" ", ", "]).join(w)
        rows.append((i, r.choice([t, t, t.upper(), t + "!"])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "too short"), (n + 3, "x " * 40_000), (n + 4, "x " * 40_001)]


@pytest.mark.parametrize("seed,j,n,least,vocab", [(1, 0.6, 3, 10, 4000), (2, 0.8, 5, 5, 4000), (3, 0.6, 3, 10, 12)])
def test_groups_against_brute_force(spark, seed, j, n, least, vocab):
    rows = corpus(seed, vocab=vocab)
    df = spark.createDataFrame(rows, "id long, t string").withColumn("node", F.lit(1)).repartition(4)
    got = [(x.group_id, x.id) for x in neardup.near_groups(df, "id", ["t"], j, n, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, j, n, least)


def test_a_shard_of_more_than_a_block(spark):
    # Three kinds of texts around one common passage: all their rare shingles are shared by over a thousand nodes.
    r = random.Random(5)
    common = [f"c{k}" for k in range(24)]
    kinds = [[f"k{a}x{k}" for k in range(24)] for a in range(3)]
    rows = []
    for i in range(1_350):
        own = kinds[i % 3]
        words = common + own + [f"v{i}x{q}" for q in range(r.randrange(1, 5))]
        rows.append((i, " ".join(words)))
    rows += [(2_000, " ".join(common + kinds[0][:12] + kinds[1][:12])), (2_001, " ".join(common))]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    assert {(x.group_id, x.id) for x in neardup.near_groups(df, "id", ["t"], 0.6, 3, 10).collect()} == brute(rows, 0.6, 3, 10)


def batch_of(*cols):
    return neardup.pa.RecordBatch.from_arrays([neardup.pa.array(c, neardup.pa.int64()) for c in cols], ["key", "node", "token"])


def test_shards_need_two_nodes_and_an_index_place():
    keys, nodes = [1, 2, 2, 3, 3, 4, 4], [3, 2, 5, 2, 4, 3, 5]
    out = [x for b in neardup._shards(iter([batch_of(keys, nodes, [None] * 7)])) for x in zip(*(c.to_pylist() for c in b.columns))]
    shards = {}
    for s, n, size in out:
        assert size == 2
        shards.setdefault(s, set()).add(n)
    assert sorted(map(sorted, shards.values())) == [[3, 5]]  # small shards count every place, and equal ones are one
    big = np.arange(0, 2 * (neardup.SMALL + 1), 2)
    assert not list(neardup._shards(iter([batch_of([9] * len(big), big, [None] * len(big))])))
    big[3] |= 1
    (only,) = neardup._shards(iter([batch_of([9] * len(big), big, [None] * len(big))]))
    assert only.column(1).to_pylist() == big.tolist()


def test_hot_tokens_are_passed_on():
    out = [tuple(x) for b in neardup._shards(iter([batch_of([5, 5, 6], [2, 4, 6], [77, 77, 77])])) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(out) == [(77, 2, 0), (77, 4, 0), (77, 6, 0)]
    assert neardup.cells_of(np.array([0, 80, 88, 96, 255], np.uint8))[[0, 1]].tolist() == [1, 1] and neardup.cells_of(np.array([120], np.uint8))[0] == 32


def shard_of(bits, sizes=None, index=None, labels=None, guests=None):
    s, n = neardup.Shard(), len(bits)
    s.members = list(zip(range(n), sizes or [50] * n, bits, index or [True] * n, labels or [0] * n, guests or [False] * n))
    return s


def test_links_of_a_shard():
    x = sum(1 << q for q in (3, 70, 400))
    bits = [x ^ ((1 << k) - 1) for k in range(6)]
    every = set(shard_of(bits).links(0.6, None, False))
    assert every == set(itertools.combinations(range(6), 2))
    assert set(shard_of(bits).links(0.6, 1, False)) == {(k, k + 1) for k in range(5)}
    across = set(shard_of(bits, labels=[0, 0, 0, 1, 1, 1]).links(0.6, None, True))
    assert across == {(a, b) for a, b in every if (a < 3) != (b < 3)}
    assert not set(shard_of(bits[:2], [10, 50]).links(0.6, None, False))
    # Of a pair the smaller one must stand at an index place, and two guests have met in a cell of their own.
    assert set(shard_of(bits[:3], [50, 52, 54], [False, True, False]).links(0.6, None, False)) == {(1, 2)}
    assert set(shard_of(bits[:3], labels=[0, 1, 2], guests=[True, True, False]).links(0.6, None, True)) == {(0, 2), (1, 2)}


def test_the_first_shared_shingle_is_at_an_index_place_of_the_smaller():
    r = random.Random(9)
    for _ in range(3_000):
        common, a, b = r.randrange(1, 60), r.randrange(0, 40), r.randrange(0, 40)
        j = r.choice([0.6, 0.8])
        if common < j * (common + a + b):
            continue
        order = r.sample(range(1_000), common + a + b)
        x, y = sorted(order[: common + a]), sorted(order[:common] + order[common + a :])
        first = min(set(x) & set(y))
        small, large = sorted((x, y), key=len)
        size = lambda s, q: int(neardup.prefix_size(np.array([len(s)]), q)[0])
        assert small.index(first) < size(small, 2 * j / (1 + j)) and large.index(first) < size(large, j)


def template(n, own, seed):
    """n texts of one template of 72 words and some words of their own; no two of them are alike at 0.6."""
    r = random.Random(seed)
    frame = [f"t{k}" for k in range(72)]
    return [(i, " ".join(frame + [f"o{r.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


def test_a_template_isnt_paired(spark):
    rows = template(3_000, 52, 4)
    rows += [(10_000 + i, t + " tail") for i, t in rows[:50]]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    got = {(x.group_id, x.id) for x in neardup.near_groups(df, "id", ["t"], 0.6, 3, 30).collect()}
    assert got == {(i, 10_000 + i) for i in range(50)}


def test_two_fields_are_grouped_apart(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(3, t, None), (5, t + " end", t), (8, None, t)], "id long, a string, b string")
    got = {tuple(x) for x in neardup.near_groups(df, "id", ["a", "b"], 0.6, 3, 30).select("field", "group_id", "id").collect()}
    assert got == {("a", 3, 5), ("b", 5, 8)}


def test_a_third_of_the_rows_are_copies(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(t)).alias("t"))
    got = neardup.near_groups(df, "id", ["t"], 0.6, 3, 30)
    assert got.count() == 9_999 and got.select("group_id").distinct().collect()[0][0] == 0


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(6)
    xs = [r.getrandbits(64) for _ in range(50)]
    xs += [x ^ (1 << r.randrange(64)) for x in xs] + xs[:5]
    tree = neardup.BKTree()
    for x in xs:
        tree.add(x)
    for q in xs[:20]:
        for radius in (0, 3, 30):
            assert sorted(tree.within(q, radius)) == [(i, (x ^ q).bit_count()) for i, x in enumerate(xs) if (x ^ q).bit_count() <= radius]


def test_the_hamming_bound_holds():
    r = np.random.default_rng(7)
    for _ in range(200):
        a = set(r.integers(0, 2**63, r.integers(1, 400)).tolist())
        b = set(list(a)[: r.integers(0, len(a) + 1)]) | set(r.integers(0, 2**63, r.integers(0, 90)).tolist())
        if b:
            s = [neardup.Sets.__new__(neardup.Sets) for _ in range(2)]
            for x, v in zip(s, (a, b)):
                x.hashes, x.sizes = np.sort(np.array(list(v), np.uint64)), np.array([len(v)])
            h = [int.from_bytes(x.sketches()[0].tobytes()) for x in s]
            assert (h[0] ^ h[1]).bit_count() <= len(a ^ b)


def test_empty(spark):
    assert neardup.near_groups(spark.createDataFrame([], "id long, t string"), "id", ["t"]).count() == 0
