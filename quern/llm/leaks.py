"""Test items leaking into documents, found by Wu-Manber multi-pattern search over words (problem 6).

The patterns are all runs of `least` consecutive words of the items' texts; a word is a run of letters and
digits of the lowered text in the consistent form, so anything between words doesn't matter. Symbols of the
search are 64-bit word hashes. A block is `BLOCK` words: the shift table gives for the block at the end of the
window how far the window may move at least, which skips all positions no pattern can end at; a block with
shift 0 names a bucket of patterns, told apart by their first block; the words themselves are then compared
one by one, which confirms an occurrence.

The items are the bounded side: they are taken in blocks of at most MAX_WORDS words, longer texts in pieces that
overlap by least - 1 words, each block with its own tables in a broadcast variable and its own pass over the
documents, so neither the driver nor a task holds more than a block. Documents are never shuffled, only pairs found are.

Defined cases: a pair of ids is one row, whatever the number of blocks, of texts an item has and of rows that repeat a
document; NULL and empty texts leak nothing; items under `least` words have no pattern; an item repeated
under another id is reported for each id; documents with a NULL id are reported under it; items with a NULL id aren't searched; empty tables
give no rows; other columns aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.mixing import mix
from quern.llm.visual import words_sql
from quern.llm.words import lowered, word_hashes

LEAST = 13
BLOCK = 3
MAX_WORDS = 2_000_000


def _blocks(h: np.ndarray) -> np.ndarray:
    """blocks[i] is the hash of the BLOCK words that end at word i (the first ones are of no use)."""
    out = np.zeros(len(h), np.uint64)
    for i in range(BLOCK):
        shifted = np.zeros(len(h), np.uint64)
        shifted[i:] = h[: len(h) - i]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + shifted)
    return out


class WuManber:
    """Tables for the runs of `least` words of some texts: shift by block, and patterns by last and first
    block. A pattern is (text number, first word)."""

    def __init__(self, texts: list[str], owners: list, least: int = LEAST):
        self.least, self.owners = least, owners
        low = [lowered(t) for t in texts]
        h, counts, starts, ends = word_hashes(low)
        blocks, bounds = _blocks(h).tolist(), np.concatenate(([0], np.cumsum(counts))).tolist()
        self.words: list[list[str]] = []
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, text in enumerate(low):
            lo, hi = bounds[t], bounds[t + 1]
            self.words.append([text[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())])
            if hi - lo < least:
                continue
            for at in range(BLOCK - 1, hi - lo):
                b, far = blocks[lo + at], max(0, least - 1 - at)
                if far < self.shift.get(b, least):
                    self.shift[b] = far
                if not far:
                    first = at - least + 1
                    self.buckets.setdefault(b, {}).setdefault(blocks[lo + first + BLOCK - 1], []).append((t, first))

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, set]]:
        """(place, owners of the patterns in it) of each text that holds any."""
        low = [lowered(t) for t in texts]
        h, counts, starts, ends = word_hashes(low)
        blocks = _blocks(h).tolist()
        shift, most, least, lo = self.shift.get, self.least - BLOCK + 1, self.least, 0
        for k, n in enumerate(counts.tolist()):
            found, words = set(), None
            at, end = lo + least - 1, lo + n
            while at < end:
                b = blocks[at]
                s = shift(b, most)
                if s:
                    at += s
                    continue
                for t, first in self.buckets[b].get(blocks[at - least + BLOCK], ()):
                    if self.owners[t] not in found:
                        if words is None:
                            words = [low[k][x:y] for x, y in zip(starts[lo:end].tolist(), ends[lo:end].tolist())]
                        if words[at - least + 1 - lo : at + 1 - lo] == self.words[t][first : first + least]:
                            found.add(self.owners[t])
                at += 1
            if found:
                yield k, found
            lo = end


def _search(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs, items = b.column(0).to_pylist(), [], []
            for k, owners in tables.value.search(b.column(1).to_pylist()):
                docs += [ids[k]] * len(owners)
                items += sorted(owners)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], ["doc_id", "item_id"])

    return run


def leaked_items(docs: DataFrame, items: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> DataFrame:
    """docs: doc_id long, text string. items: item_id long, text string (several rows an item are fine).
    (doc_id, item_id) for each document that shares at least `least` consecutive words with the item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, texts, owners, held = [], [], [], 0

    def search() -> None:
        tables = spark.sparkContext.broadcast(WuManber(texts, owners, least))
        out.append(docs.mapInArrow(_search(tables), "doc_id long, item_id long"))
        texts.clear()
        owners.clear()

    for r in items.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").toLocalIterator():  # one partition of items at a time
        for piece in pieces(r.text, max_words, least):
            texts.append(piece)
            owners.append(r.item_id)
            held += len(piece) // 2 + 1  # more words than that it can't have
            if held >= max_words:
                search()
                held = 0
    if texts or not out:
        search()
    return functools.reduce(DataFrame.unionByName, out).distinct()


def pieces(text: str, max_words: int, least: int) -> Iterator[str]:
    """The text, or if it may have over max_words words its pieces of so many, each with the last least - 1 words of the
    one before, so that every run of least words is in one."""
    if len(text) // 2 + 1 <= max_words:
        yield text
        return
    low = lowered(text)
    _, _, starts, ends = word_hashes([low])
    step = max(1, max_words - least + 1)
    for k in range(0, max(1, len(starts) - least + 1), step):
        yield low[starts[k] : ends[min(k + max(max_words, least), len(ends)) - 1]] if len(starts) else ""


def domain_items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/heldout_item.parquet").select("item_id", F.explode(F.array("problem", "solution")).alias("text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), domain_items(spark, d))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, and into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _grams(words: str, at: str) -> str:
    """Runs of LEAST words, one row each."""
    return f"SELECT DISTINCT {at}, array_to_string(list_slice(w, i, i + {LEAST - 1}), ' ') AS g FROM (SELECT {at}, w, unnest(range(1, len(w) - {LEAST - 2})) AS i FROM ({words}))"


P6_FOUND_SQL = f"""
WITH i AS ({_grams(f"SELECT item_id, {words_sql('t')} AS w FROM (SELECT item_id, unnest([problem, solution]) AS t FROM heldout_item)", "item_id")}),
d AS ({_grams(f"SELECT doc_id, {words_sql('text')} AS w FROM documents", "doc_id")})
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)
"""
P6_ITEMS_SQL = f"SELECT item_id, count(*) AS documents FROM ({P6_FOUND_SQL}) GROUP BY item_id"
