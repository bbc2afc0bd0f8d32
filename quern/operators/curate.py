"""Operators of pool curation."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.session import materialize

TESTS = "inputs array<string>, outputs array<string>"
#: Most grams (8 bytes each) that are broadcast.
ITEM_GRAMS = 2_000_000


def collapse_by_key(df: DataFrame, key: Column, row_id: str, first: list[str], value: str, ids: int = 0) -> DataFrame:
    """One row for each non-empty key: copies, number of distinct non-NULL values, the columns of `first` from the
    row with the smallest id, that id, and the smallest `ids` ids. Rows are combined by (key, value) first, so
    a key with very many rows is small before it meets in one task."""
    rows = df.select(key.alias("key"), row_id, value, *first).filter("key IS NOT NULL AND key <> ''")
    lead = F.min(F.struct(row_id, *first)).alias("_lead") if first else F.min(F.struct(row_id)).alias("_lead")
    part = rows.groupBy("key", value).agg(F.count(F.lit(1)).alias("copies"), lead)
    out = part.groupBy("key").agg(F.sum("copies").alias("copies"), F.count(value).alias("values"), F.min("_lead").alias("_lead"))
    out = out.select("key", "copies", "values", F.col(f"_lead.{row_id}").alias(row_id), *(F.col(f"_lead.{c}").alias(c) for c in first))
    if ids:
        from quern.operators.ranks import ranked

        least = ranked(rows.select("key", row_id), [row_id], "_r", ("key",)).filter(F.col("_r") <= ids)
        out = out.join(least.groupBy("key").agg(F.array_sort(F.collect_list(row_id)).alias("ids")), "key")
    return out


def ngram_overlap(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, n: int) -> DataFrame:
    """Set overlap of the distinct n-grams of documents and items: doc_id, item_id, overlap, and the number of
    grams of the item (size); a text of under n words is one gram, its whole. If the items have at most ITEM_GRAMS grams (they
    are counted), those are broadcast, so that only grams some item has are shuffled."""
    def grams(df: DataFrame, i: str, t: str) -> DataFrame:
        words = df.filter(F.col(t).isNotNull()).select(i, X.words_of(F.col(t)).alias("_w"))
        return words.select(i, F.explode(X.ngram_hashes(F.col("_w"), n, short_whole=True)).alias("gram"))

    right = materialize(grams(items, item_id, item_text), "item-grams")
    sizes = right.groupBy(item_id).agg(F.count(F.lit(1)).alias("size"))
    left = grams(docs, doc_id, doc_text)
    if right.count() <= ITEM_GRAMS:
        left = left.join(F.broadcast(right.select("gram").distinct()), "gram", "left_semi")  # at most ITEM_GRAMS numbers
    return left.join(right, "gram").groupBy(doc_id, item_id).agg(F.count(F.lit(1)).alias("overlap")).join(sizes, item_id)


def containment(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, n: int, share: float) -> DataFrame:
    """(doc_id, item_id, containment): pairs whose shared runs of n code tokens are at least `share` of the smaller one's distinct
    runs. Texts under n tokens have none. The items' runs are broadcast while they are at most ITEM_GRAMS, as in ngram_overlap;
    a run that very many documents hold is counted map-side before it meets an item. A plain explode would have Spark infer a filter
    on the runs, push it to the scan and so cut the text into tokens once for each run; an outer one has no such filter."""
    def grams(df: DataFrame, i: str, t: str) -> DataFrame:
        tokens = df.filter(F.col(t).isNotNull()).select(i, X.code_tokens(F.col(t)).alias("_t")).select(i, X.ngram_hashes(F.col("_t"), n).alias("_g"))
        sized = tokens.select(i, F.size("_g").alias(f"_n_{i}"), "_g")  # before the explosion, which else copies the array into each row
        return sized.select(i, f"_n_{i}", F.explode_outer("_g").alias("gram")).filter("gram IS NOT NULL")

    right = materialize(grams(items, item_id, item_text), "item-runs")
    left = grams(docs, doc_id, doc_text)
    if right.count() <= ITEM_GRAMS:
        left = left.join(F.broadcast(right.select("gram").distinct()), "gram", "left_semi")  # at most ITEM_GRAMS numbers
    both = left.join(right, "gram").groupBy(doc_id, item_id, f"_n_{doc_id}", f"_n_{item_id}").agg(F.count(F.lit(1)).alias("_k"))
    part = F.col("_k") / F.least(f"_n_{doc_id}", f"_n_{item_id}")
    return both.select(doc_id, item_id, part.alias("containment")).filter(F.col("containment") >= share)


def blocks_for(rows: int) -> int:
    """Blocks for keys that are rare among so many fingerprints at radius 3: 16, 26, 32 or 36 bits a key."""
    return 4 if rows < 1 << 12 else 5 if rows < 1 << 22 else 6 if rows < 1 << 28 else 7


def map_delta(first: Column, current: Column) -> Column:
    """What turns one map<string,string> into another, as a map: its changed and new entries, and under `__removed__` the JSON
    list of keys that are gone. A NULL side gives the other whole under `__replace__`; equal maps give an empty one."""
    changed = F.map_filter(current, lambda k, v: ~F.map_contains_key(first, k) | ~v.eqNullSafe(F.try_element_at(first, k)))
    gone = F.array_sort(F.array_except(F.map_keys(first), F.map_keys(current)))
    removed = F.when(F.size(gone) > 0, F.create_map(F.lit("__removed__"), F.to_json(gone))).otherwise(F.expr("cast(map() as map<string,string>)"))
    whole = F.create_map(F.lit("__replace__"), F.to_json(current))
    same = F.expr("cast(map() as map<string,string>)")
    return F.when(first.isNull() & current.isNull(), same).when(first.isNull() | current.isNull(), whole).otherwise(F.map_concat(changed, removed))


def apply_delta(first: Column, delta: Column) -> Column:
    gone = F.coalesce(F.from_json(F.try_element_at(delta, F.lit("__removed__")), "array<string>"), F.expr("cast(array() as array<string>)"))
    kept = F.map_filter(first, lambda k, v: ~F.array_contains(gone, k) & ~F.map_contains_key(delta, k))
    merged = F.map_concat(kept, F.map_filter(delta, lambda k, v: k != "__removed__"))
    return F.when(F.map_contains_key(delta, F.lit("__replace__")), F.from_json(F.try_element_at(delta, F.lit("__replace__")), "map<string,string>")).otherwise(merged)


def first_broken(rules: list[tuple[str, Column]], fine: str = "ok") -> Column:
    """The name of the first rule whose condition holds; NULL conditions don't."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules), F.lit(fine))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, n: int, share: float) -> DataFrame:
    """Documents that hold less than `share` of the n-grams of every item."""
    bad = ngram_overlap(docs, items, doc_id, doc_text, item_id, item_text, n).filter(F.col("overlap") >= share * F.col("size")).select(doc_id).distinct()
    return docs.join(bad, doc_id, "left_anti")


def unwrap(df: DataFrame, text: str, prefix: str, suffix: str) -> DataFrame:
    """Takes a fixed prefix off where it is there, then a fixed suffix, and trims what is left; `wrap` tells both, partial or
    neither."""
    p = F.startswith(F.col(text), F.lit(prefix))
    out = df.withColumn("_p", p).withColumn("inner", F.when(p, F.substring(F.col(text), F.lit(len(prefix) + 1), F.length(text))).otherwise(F.col(text)))
    s = F.endswith(F.col("inner"), F.lit(suffix))
    out = out.withColumn("_s", s).withColumn("inner", F.when(s, F.substring(F.col("inner"), F.lit(1), F.length("inner") - len(suffix))).otherwise(F.col("inner")))
    wrap = F.when(F.col("_p") & F.col("_s"), "both").when(F.col("_p") | F.col("_s"), "partial").otherwise("neither")
    return out.withColumn("wrap", wrap).withColumn("inner", F.regexp_replace("inner", r"(?U)^\s+|\s+$", "")).drop("_p", "_s")


def test_reason(tests: Column) -> Column:
    """The first reason that holds against a tests JSON, or ok."""
    v = F.try_parse_json(tests)
    inputs, outputs = F.get_json_object(tests, "$.inputs"), F.get_json_object(tests, "$.outputs")
    is_list = lambda c: F.coalesce(F.startswith(c, F.lit("[")), F.lit(False))
    return (
        F.when(tests.isNull() | (tests == ""), "absent")
        .when(v.isNull(), "invalid_json")
        .when(~F.startswith(F.ltrim(tests), F.lit("{")), "not_object")
        .when(F.get_json_object(tests, "$.fn_name").isNotNull(), "call_based")
        .when(~is_list(inputs) | ~is_list(outputs), "missing_arrays")
        .when(F.json_array_length(inputs) != F.json_array_length(outputs), "length_mismatch")
        .when(F.json_array_length(inputs) == 0, "empty")
        .otherwise("ok")
    )


def trimmed_tests(tests: Column, most: int) -> Column:
    t = F.from_json(tests, TESTS)
    return F.struct(F.slice(t["inputs"], 1, most).alias("inputs"), F.slice(t["outputs"], 1, most).alias("outputs"))


def with_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), c).otherwise(F.concat(c, F.lit(suffix)))


def first_present(*cols: str) -> Column:
    """The first value that is neither NULL nor empty; blanks count as a value."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols))


def _fields(payload: str) -> Column:
    return F.transform(F.map_entries(F.from_json(payload, "map<string,string>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))


def adapt_payload(df: DataFrame, payload: str, names: list[str]) -> DataFrame:
    """Columns from a flat JSON object whose field names vary in case; unparseable rows are left out."""
    m = df.withColumn("_f", _fields(payload)).filter("_f IS NOT NULL")
    pick = lambda n: F.try_element_at(F.filter("_f", lambda e: e["key"] == n), F.lit(1))["value"]
    return m.select(*df.columns, *(pick(n).alias(n) for n in names))


def payload_strings(df: DataFrame, payload: str) -> DataFrame:
    """A row for each value of the JSON objects."""
    return df.withColumn("_f", _fields(payload)).select(*df.columns, F.explode("_f").alias("_e")).select(*df.columns, F.col("_e.value").alias("value"))


def line_counts(df: DataFrame, row_id: str, text: str, least: int) -> DataFrame:
    """Number of non-blank lines, and of the most frequent line of at least `least` characters, blanks
    squeezed. Works inside the row: no shuffle."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    long = F.array_sort(F.filter("_l", lambda x: F.length(x) >= least))
    runs = F.aggregate(
        long,
        F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("most")),
        lambda a, x: F.struct(x.alias("last"), F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"), F.greatest(a["most"], F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("most")),
        lambda a: a["most"],
    )
    return df.select(row_id, lines.alias("_l")).select(row_id, F.size("_l").cast("long").alias("lines"), runs.alias("most"))


#: What makes a difficulty hard or easy; all else is medium.
HARD, EASY = ("hard", "advanced", "expert"), ("easy", "intro", "basic")


def difficulty_level(c: Column) -> Column:
    d = F.lower(F.coalesce(c, F.lit("")))
    return F.when(d.rlike("|".join(HARD)), "hard").when(d.rlike("|".join(EASY)), "easy").otherwise("medium")


@F.pandas_udf(T.StringType())
def code_style(code: pd.Series, tests: pd.Series, problem: pd.Series) -> pd.Series:
    """function, competitive or unknown: asserts in the tests make a function; code that doesn't parse is unknown; reading or
    writing standard streams, or a problem that tells its input or output format, is competitive; then a function or class
    at the top makes a function, and anything else is competitive."""
    import ast
    import re

    def one(c, t, p):
        if "assert " in (t or "").lower():
            return "function"
        tree = X.parsed(c or "")
        if tree is None:
            return "unknown"
        reads = any(isinstance(n, ast.Call) and getattr(n.func, "id", None) == "input" for n in ast.walk(tree))
        if reads or "stdin" in (c or "") or "stdout" in (c or "") or re.search(r"\b(?:input|output) format\b", p or "", re.I):
            return "competitive"
        return "function" if any(isinstance(n, (ast.FunctionDef, ast.ClassDef)) for n in tree.body) else "competitive"

    return pd.Series([one(*x) for x in zip(code, tests, problem)])


def prefix_or_suffix(tokens: str, prefix: int, suffix: int) -> Column:
    """The first `prefix` and last `suffix` elements of an array."""
    n = F.size(tokens)
    return F.filter(tokens, lambda t, i: (i < prefix) | (i >= n - suffix))


def block_keys(h: Column, radius: int, blocks: int) -> Column:
    """Keys of which two 64-bit hashes within `radius` bits share at least one: the hash is cut to `blocks` blocks,
    and a key names blocks - radius of them with their bits. More blocks make more, but rarer keys: with radius 3,
    4 blocks give 4 keys of 16 bits, 5 give 10 of 26, 6 give 20 of 32."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [F.shiftrightunsigned(h, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    keys = [F.xxhash64(F.lit(k), *(bits[i] for i in c)) for k, c in enumerate(itertools.combinations(range(blocks), blocks - radius))]
    return F.array(*keys)


def hamming_pairs(nodes: DataFrame, row_id: str, h: str, radius: int, blocks: int) -> DataFrame:
    """(a, b), a < b: all pairs of rows whose hashes differ in at most `radius` bits. Hashes should be distinct. The join is
    merged whatever size Spark sees: its estimate leaves out that each row becomes one for each key, so it would broadcast them."""
    keyed = nodes.select(F.col(row_id).alias("a"), F.col(h).alias("ha"), F.explode(block_keys(F.col(h), radius, blocks)).alias("k"))
    other = keyed.toDF("b", "hb", "k")
    return keyed.join(other.hint("merge"), "k").filter((F.col("a") < F.col("b")) & (X.hamming(F.col("ha"), F.col("hb")) <= radius)).select("a", "b").distinct()


def greedy_near_dedup(df: DataFrame, row_id: str, source: str, family: str, tokens: str, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(row_id, kept): what a pass in ascending id keeps if it rejects a row with the fingerprint of an earlier
    row, one of an earlier kept (source, family), and one within `radius` bits of a kept fingerprint.

    That is the lexicographically first maximal independent set of the conflict graph: in each round a row all
    of whose earlier neighbours are rejected is kept, and its neighbours are rejected. Rows are collapsed by
    fingerprint, and families linked to all members only through a first undecided one, so neither copies nor
    a family with a tenth of the rows make pairs; fingerprint links come from keys of untouched blocks. All tables grow with
    the rows but are small as files, by which Spark would choose to broadcast them, so every join is merged."""
    rows = df.select(row_id, source, family, X.simhash64(F.col(tokens)).alias("h"))
    rows = materialize(rows, "dedup-rows")
    first = rows.groupBy("h").agg(F.min(F.struct(row_id, source, family)).alias("r"))
    nodes = materialize(first.select(F.col(f"r.{row_id}").alias("id"), F.col(f"r.{source}").alias("source"), F.col(f"r.{family}").alias("family"), "h"), "dedup-nodes")
    near = hamming_pairs(nodes, "id", "h", radius, blocks or blocks_for(nodes.count())).toDF("id", "id2")
    near = materialize(near, "dedup-near")
    state = nodes.select("id", "source", "family", F.lit(None).cast("boolean").alias("kept"))
    while True:
        open_ = state.filter("kept IS NULL")
        # A row waits for an earlier open neighbour and for the first open row of its family.
        heads = open_.filter("family IS NOT NULL").groupBy("source", "family").agg(F.min("id").alias("head"))
        waits = near.join(open_.select("id").hint("merge"), "id", "left_semi").select(F.col("id2").alias("id")).distinct().withColumn("w", F.lit(True))
        ready = open_.join(waits.hint("merge"), "id", "left").join(heads.hint("merge"), ["source", "family"], "left")
        new = materialize(ready.filter("w IS NULL AND (head IS NULL OR head = id)").select("id", "source", "family"), "dedup-new")
        if not new.take(1):
            break
        hit = near.join(new.select("id").hint("merge"), "id", "left_semi").select(F.col("id2").alias("id")).distinct().withColumn("hit", F.lit(True))
        taken = new.filter("family IS NOT NULL").select("source", "family").distinct().withColumn("taken", F.lit(True))
        mark = new.select("id", F.lit(True).alias("new"))
        out = state.join(mark.hint("merge"), "id", "left").join(hit.hint("merge"), "id", "left").join(taken.hint("merge"), ["source", "family"], "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("new"), True).when(F.col("hit") | F.col("taken"), False)
        state = materialize(out.select("id", "source", "family", kept.alias("kept")), "dedup-state")
    decided = state.select(F.col("id").alias(row_id), "kept")
    return rows.select(row_id).join(decided.hint("merge"), row_id, "left").select(row_id, F.coalesce("kept", F.lit(False)).alias("kept"))
