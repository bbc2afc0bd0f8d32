"""One consistent form for texts that look the same (problem 2).

The text is exploded to positioned pieces: every code point that could change, and the one before it, is a
piece of its own; runs of ASCII between them, which no step changes, stay whole. The pieces are
broadcast-joined with a mapping made by rule from the Unicode data (decompositions, wide and narrow forms,
ligatures, invisible characters, spaces, hyphens) and the look-alike letters; its size is bounded by Unicode.
Combining marks are ordered by their class behind their base, the string is rebuilt, and composed. A window numbers the
bases and one sort orders the parts, so a long text costs no more a character than a short one.

Defined cases: NULL stays NULL, an empty text stays empty; ASCII texts are their own form and skip the
explosion; a key must stand for one text; rows with a NULL id make no pairs; extra columns aren't touched.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.words import form_table
from quern.session import materialize

#: A run of ASCII up to the last one before another character, or any single character.
PIECE = r"[\x00-\x7F]+(?=[\x00-\x7F]|$)|[\s\S]"
MARKED = r"[\p{M}ᄀ-ᇿ]"


@functools.cache
def _mapping_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    table = {chr(i): f for i, f in form_table().items()}
    for i in range(0x300, 0x1FFFF):  # marks keep their character but need their class
        if chr(i) not in table and unicodedata.combining(chr(i)):
            table[chr(i)] = chr(i)
    return [(ch, [(x, unicodedata.combining(x)) for x in f]) for ch, f in table.items()]


def mapping(spark: SparkSession) -> DataFrame:
    """piece, parts: what a character becomes, each part with its combining class. At most one row for each
    code point, whatever the data, so it may be broadcast."""
    return spark.createDataFrame(_mapping_rows(), "piece string, parts array<struct<ch:string,cls:int>>")


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def consistent_form(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """(key, out) for each row of df, one row for each distinct key with the same text. key must determine
    the text; rows with NULL text get NULL."""
    base = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    plain = F.col("_t").isNull() | ~F.col("_t").rlike(r"[^\x00-\x7F]")
    done = base.filter(plain).select(F.col("_k").alias(key), F.col("_t").alias(out))
    pieces = base.filter(~plain).select("_k", F.posexplode(F.regexp_extract_all("_t", F.lit(PIECE), F.lit(0))).alias("pos", "piece"))
    one = F.array(F.struct(F.col("piece").alias("ch"), F.lit(0).alias("cls")))
    mapped = pieces.join(F.broadcast(mapping(df.sparkSession)), "piece", "left").select("_k", "pos", F.coalesce("parts", one).alias("parts"))
    # Each part gets the number of the base it stands behind: bases of earlier pieces, and those so far in its own, which has a few parts at most.
    bases = F.size(F.filter("parts", lambda x: x["cls"] == 0))
    earlier = F.sum(bases).over(W.partitionBy("_k").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    mapped = mapped.withColumn("base", F.coalesce(earlier, F.lit(0)))
    own = lambda i: F.size(F.filter(F.slice("parts", 1, i + 1), lambda y: y["cls"] == 0))
    keyed = F.transform("parts", lambda x, i: F.struct((F.col("base") + own(i)).alias("base"), x["cls"].alias("cls"), F.col("pos").alias("pos"), i.alias("i"), x["ch"].alias("ch")))
    rebuilt = mapped.select("_k", keyed.alias("p")).groupBy("_k").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("parts"))
    text_out = rebuilt.select(F.col("_k").alias(key), F.array_join(F.transform("parts", lambda x: x["ch"]), "").alias(out))
    to_compose = F.col(out).rlike(MARKED)
    text_out = materialize(text_out, "forms")
    return done.unionByName(text_out.filter(~to_compose)).unionByName(text_out.filter(to_compose).select(key, _compose(F.col(out)).alias(out)))


def look_alikes(rows: DataFrame) -> DataFrame:
    """rows: tbl, id, text. (tbl, id_a, id_b), id_a < id_b: all pairs of rows whose texts differ but have
    one consistent form. Only classes with two or more different stored texts are paired. Within a class the
    left rows are dealt to as many cells as it has thousands of rows, so no cell is unbounded."""
    rows = rows.filter("text IS NOT NULL").select("tbl", "id", F.unhex(F.md5("text")).alias("sk"), "text")
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    odd = rows.filter(~ascii_only)
    forms = consistent_form(odd.select(F.struct("tbl", "id").alias("k"), "text"), "k", "text", "form")
    forms = forms.select("k.tbl", "k.id", F.unhex(F.md5("form")).alias("ck"))
    keyed = rows.filter(ascii_only).select("tbl", "id", "sk", F.col("sk").alias("ck")).unionByName(odd.select("tbl", "id", "sk").join(forms, ["tbl", "id"]))
    keyed = materialize(keyed, "visual-keys")
    classes = keyed.groupBy("tbl", "ck").agg(F.count(F.lit(1)).alias("n"), F.min("sk").alias("lo"), F.max("sk").alias("hi")).filter("lo <> hi")
    members = materialize(keyed.join(classes.select("tbl", "ck", "n"), ["tbl", "ck"]), "visual-members")
    cells = (F.col("n") / 1000).cast("int") + 1
    a = members.select("tbl", "ck", F.col("sk").alias("sa"), F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), cells).cast("int").alias("cell"))
    b = members.select("tbl", "ck", F.col("sk").alias("sb"), F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    return a.join(b, ["tbl", "ck", "cell"]).filter("id_a < id_b AND sa <> sb").select("tbl", "id_a", "id_b")


def domain_rows(spark: SparkSession, d: str) -> DataFrame:
    cand = spark.read.parquet(f"{d}/sft_candidate.parquet").select(F.lit("sft_candidate").alias("tbl"), F.col("cand_id").alias("id"), F.col("problem").alias("text"))
    aime = spark.read.parquet(f"{d}/aime25.parquet").select(F.lit("aime25").alias("tbl"), F.expr("try_cast(id AS bigint)").alias("id"), F.col("problem").alias("text"))
    return cand.unionByName(aime)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes(domain_rows(spark, d))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    rows = domain_rows(spark, d)
    forms = consistent_form(rows.select(F.struct("tbl", "id").alias("k"), "text"), "k", "text", "form")
    return forms.select("k.tbl", "k.id", "form")


def form_sql(text: str) -> str:
    """The consistent form of a column in SQL: replacements of single characters by rule, invisible ones dropped, and the
    canonical composition of the engine."""
    from quern.llm.words import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS, HYPHENS

    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    plain = "".join(map(chr, range(0x21, 0x7F)))
    spaces = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rest = HYPHENS.replace("\uff0d", "")  # the wide form is in the range above
    form = f"translate({text}, {quoted(wide + spaces + rest + CYRILLIC + GREEK)}, {quoted(plain + ' ' * len(spaces) + '-' * len(rest) + CYRILLIC_AS + GREEK_AS)})"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        form = f"replace({form}, '{a}', '{b}')"
    return f"nfc_normalize(regexp_replace({form}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g'))"


def words_sql(text: str) -> str:
    """The words of a column in SQL: runs of letters and digits of the lowered text in the consistent form."""
    return f"regexp_extract_all(lower({form_sql(text)}), '[\\p{{L}}\\p{{N}}]+')"


def _sql() -> str:
    rows = "SELECT 'sft_candidate' AS tbl, cand_id AS id, problem AS text FROM sft_candidate UNION ALL SELECT 'aime25', id::BIGINT, problem FROM aime25"
    return f"WITH f AS (SELECT tbl, id, text, {form_sql('text')} AS form FROM ({rows}))"


P2_FOUND_SQL = _sql() + " SELECT a.tbl, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.tbl = b.tbl AND a.form = b.form AND a.id < b.id AND a.text <> b.text"
P2_FORMS_SQL = _sql() + " SELECT tbl, id, form FROM f"
