import random
import unicodedata

from pyspark.sql import functions as F

from quern.llm import visual
from quern.llm.words import consistent

BASE = "Éa fine text, über-long; naïve Ñ 12 x² “q” a—b 한글 ộ"
SPELLINGS = [
    lambda t: t,
    lambda t: unicodedata.normalize("NFD", t),
    lambda t: t.replace("fi", "ﬁ"),
    lambda t: t.replace("a", "а").replace("o", "ο"),
    lambda t: t.replace(" ", " ").replace("-", "‑"),
    lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in t),
    lambda t: t[:4] + "​­⁠" + t[4:],
    lambda t: unicodedata.normalize("NFD", t).replace("e", "е"),
    lambda t: "﻿" + t,
]
DIFFERENT = [BASE.lower(), BASE.replace("²", "2"), BASE.replace("“", '"'), BASE.replace(" ", "  ", 1), BASE.replace(", ", ",\n"), BASE + "."]


def test_forms_equal_the_plain_function(spark):
    r = random.Random(2)
    chars = "aeoſß éüñ日本ﬁﬀ１ａ－​­ ̧̣́̈аеοΑ²…“”—한ᄀ각ậ̂𝐀😀\n\t؛"
    texts = [None, "", BASE, *("".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(300)), "é" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("piece", F.lit(1))
    got = {x.i: x.f for x in visual.consistent_form(df.repartition(3), "i", "t", "f").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == consistent(t), (i, t)


def test_spellings_become_one(spark):
    forms = {consistent(f(BASE)) for f in SPELLINGS}
    assert forms == {consistent(BASE)}
    assert all(consistent(x) != consistent(BASE) for x in DIFFERENT)


def test_pairs_against_brute_force(spark):
    r = random.Random(4)
    rows = [("a", i, r.choice([None, "", BASE.lower(), *(f(BASE) for f in SPELLINGS), *DIFFERENT])) for i in range(150)] + [("b", i, r.choice(SPELLINGS)(BASE)) for i in range(40)]
    got = [tuple(x) for x in visual.look_alikes(spark.createDataFrame(rows, "tbl string, id long, text string").withColumn("cell", F.lit(0))).collect()]
    want = {(t, i, j) for t, i, x in rows for u, j, y in rows if t == u and i < j and x is not None and y is not None and x != y and consistent(x) == consistent(y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_class_with_very_many_copies(spark):
    df = spark.range(3_000).select(F.lit("t").alias("tbl"), "id", F.when(F.col("id") < 2, F.lit("ａbc")).otherwise(F.lit("abc")).alias("text"))
    assert visual.look_alikes(df).count() == 2 * 2_998


def test_empty(spark):
    assert visual.look_alikes(spark.createDataFrame([], "tbl string, id long, text string")).count() == 0


def test_a_long_text_of_marks(spark):
    t = "ẹ́ạ́ ü" * 30_000
    df = spark.createDataFrame([(1, t), (2, "́ alone"), (3, "")], "id long, t string")
    got = {r.id: r.f for r in visual.consistent_form(df, "id", "t", "f").collect()}
    assert got == {1: consistent(t), 2: consistent("́ alone"), 3: ""}
