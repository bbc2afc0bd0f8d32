import random
import re

from pyspark.sql import functions as F

from quern.llm import leaks
from quern.llm.words import lowered

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, least):
    runs = {}
    for i, t in items:
        w = WORD.findall(lowered(t)) if t else []
        for k in range(len(w) - least + 1):
            runs.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall(lowered(t)) if t else []
        for k in range(len(w) - least + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + least]), ())}
    return out


def cases(seed, vocab):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocab)}"
    items = [(i, " ".join(word() for _ in range(r.choice([3, 12, 13, 14, 40])))) for i in range(30)] + [(90, None), (91, ""), (5, "again " * 20), (6, "again " * 20)]
    docs = [(500, None), (501, ""), (502, "x " * 60_000)]
    for d in range(120):
        w = [word() for _ in range(r.randrange(80))]
        if r.random() < 0.6:
            s = r.choice(items[:30])[1].split()
            a = r.randrange(len(s))
            n = r.choice([11, 12, 13, 14, 40])
            w[len(w) // 2 : len(w) // 2] = s[a : a + n]
        t = r.choice([" ", ", ", "\n", " — "]).join(w)
        docs.append((d, r.choice([t, t.upper(), t.replace("w", "ｗ"), t.replace("w", "w​")])))
    return docs + docs[:3], items


def test_against_brute_force(spark):
    for seed, vocab in ((1, 1000), (2, 3)):
        docs, items = cases(seed, vocab)
        d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).repartition(3)
        i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
        want = brute(docs, items, 13)
        assert {tuple(x) for x in leaks.leaked_items(d, i).collect()} == want
        if seed == 1:
            assert {tuple(x) for x in leaks.leaked_items(d, i, max_words=40).collect()} == want


def test_shifts_never_jump_over_a_pattern():
    r = random.Random(3)
    for _ in range(30):
        items = [" ".join(r.choice("abc") for _ in range(r.randrange(5, 20))) for _ in range(4)]
        docs = [" ".join(r.choice("abc") for _ in range(60)) for _ in range(10)]
        got = {(k, i) for k, found in leaks.WuManber(items, [0, 1, 2, 3], 6).search(docs) for i in found}
        assert got == brute(list(enumerate(docs)), list(enumerate(items)), 6)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaked_items(d, i).count() == 0
    assert leaks.leaked_items(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"), i).count() == 0


def test_rows_dont_depend_on_blocks(spark):
    long = " ".join(f"w{k}" for k in range(200))
    items = [(1, " ".join(f"w{k}" for k in range(20))), (1, " ".join(f"w{k}" for k in range(40, 60))), (2, long), (2, "x y z"), (3, " ".join(f"v{k}" for k in range(30)))]
    docs = [(7, long), (7, long), (None, long), (8, " ".join(f"w{k}" for k in range(190, 200)) + " " + " ".join(f"v{k}" for k in range(13))), (9, " ".join(f"w{k}" for k in range(97, 110)))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(7, 1), (7, 2), (None, 1), (None, 2), (8, 3), (9, 2)], key=str)
    for words in (2_000_000, 400, 100, 30, 10):
        assert sorted(map(tuple, leaks.leaked_items(docs, items, max_words=words).collect()), key=str) == want, words


def test_pieces_hold_every_run():
    text = " ".join(f"w{k}" for k in range(57))
    runs = {tuple(p.split()[i : i + 5]) for p in leaks.pieces(text, 9, 5) for i in range(len(p.split()) - 4)}
    assert runs == {tuple(text.split()[i : i + 5]) for i in range(53)} and max(len(p.split()) for p in leaks.pieces(text, 9, 5)) <= 9
