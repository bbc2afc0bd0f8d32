"""A mixture of sources to target shares of tokens (problem 7).

Each source's documents are put in a pseudorandom order and their tokens packed end to end into blocks of
BLOCK tokens (the last one may be shorter). The wanted numbers of blocks are the target shares of the whole,
where a source gives at most max_repeats times its own blocks and what it falls short is spread over the others
in proportion. Every output shard draws its counts by source from a multinomial; the draws' sums differ from
the wanted numbers by their noise, and just so many slots of the sources drawn too often are handed to those
drawn too seldom. The j-th slot of a source is its pass j div N over the source's N blocks and the block that a
keyed permutation of 0..N-1 of that pass gives for j mod N; blocks are joined to slots by that number.

So no block, and no part of a document, occurs more often than max_repeats, the result depends on the seed
alone, and nothing but the table of sources (checked to be small) is on the driver. Positions within a source
are prefix sums over buckets, and so are the numbers of slots over shards: no window holds a whole source.

Defined cases: NULL and empty texts have no tokens and don't occur; documents with a NULL source or one
without a target aren't used; sources without documents get a share of 0; NULL or negative shares count as
0, a NULL max_repeats as 1; a source listed twice is an error; repeated rows are documents of their own; empty
tables give an empty mixture.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.mixing import mix
from quern.session import materialize

BLOCK, SLOTS, SEED = 1_024, 64, 20_310
MAX_SOURCES = 10_000
DOCS_A_BUCKET = 20_000
SHARDS_A_GROUP = 1_024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY = 64 << 20


def vocabulary_of(path: str) -> bytes:
    with open(path, "rb") as f:
        out = f.read(MAX_VOCABULARY + 1)
    if len(out) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary file is over {MAX_VOCABULARY} bytes")
    return out


def encoder(path: str):
    return _encoder(vocabulary_of(path))


@functools.cache
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _width(vocabulary: bytes) -> type:
    return np.uint16 if _encoder(vocabulary).max_token_value < 1 << 16 else np.uint32


def _encode(vocabulary):
    """From (doc_id, s, text): the number of tokens, and the tokens end to end in two bytes each (four for large vocabularies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = _encoder(vocabulary.value), _width(vocabulary.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                tokens = [np.array(enc.encode_ordinary(t), width) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in tokens], pa.int32()), pa.array([x.tobytes() for x in tokens], pa.binary())], ["doc_id", "s", "n", "data"])

    return run


def _cut(width: int, block: int):
    """From (s, doc_id, at, n, data): the piece of each block the document touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for s, doc, at, n, data in zip(*(c.to_pylist() for c in b.columns)):
                for k in range(at // block, (at + n - 1) // block + 1):
                    lo, hi = max(0, k * block - at), min(n, (k + 1) * block - at)
                    held.append((s, k, at + lo, doc, data[lo * width : hi * width]))
            if held:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], ["s", "block", "at", "doc_id", "data"])

    return run


def _open(width: type):
    """The tokens of each row's block as numbers again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(b"".join(x["data"] for x in p), width).astype(np.int32) for p in b.column("p").to_pylist()]
            docs = [[x["doc_id"] for x in p] for p in b.column("p").to_pylist()]
            cols = [b.column(c) for c in ("shard", "slot", "source", "turn", "block")]
            cols += [pa.array([len(x) for x in tokens], pa.int32()), pa.array(docs, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "slot", "source", "turn", "block", "n_tokens", "doc_ids", "tokens"])

    return run


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..n-1 at i, for each element: a four-round Feistel network over the least even
    number of bits that hold n, walked until it is below n."""
    i, n, key = (np.asarray(x, np.uint64).copy() for x in (i, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    half = np.where((np.uint64(1) << (np.uint64(2) * half)) < n, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.copy(), np.arange(len(i))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mix(right + mix(k + np.uint64(r + 1))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def plan(shares: np.ndarray, repeats: np.ndarray, tokens: np.ndarray, total: int | None, block: int) -> np.ndarray:
    """Slots of each source. total: tokens of the mixture, as many as the sources have if None."""
    blocks = -(-tokens // block)
    cap = (blocks * np.maximum(repeats, 0)).astype(float)
    left = (tokens.sum() if total is None else total) / block
    shares = np.where(cap > 0, np.maximum(shares, 0), 0.0)
    want, full = np.zeros(len(shares)), shares == 0
    while left > 1e-9 and not full.all():
        add = left * shares / shares[~full].sum() * ~full
        over = ~full & (want + add >= cap)
        if not over.any():
            want, left = want + add, 0
        else:  # fill those up, then spread what is left
            left -= (cap - want)[over].sum()
            want[over] = cap[over]
            full |= over
    out = np.floor(want).astype(np.int64)
    rest = int(np.ceil(want.sum() - 1e-9)) - out.sum()
    for s in np.argsort(-(want - out), kind="stable")[: max(0, rest)]:
        out[s] += out[s] < cap[s]
    return out


def _draw(p: np.ndarray, slots: int, total: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                rng = np.random.Generator(np.random.Philox(key=[seed, k]))
                c = rng.multinomial(min(slots, total - k * slots), p)
                s = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s.astype(np.int32)), pa.array(c[s].astype(np.int64))], ["shard", "s", "c"])

    return run


def _deal(wanted: np.ndarray, drawn: np.ndarray, blocks: np.ndarray, seed: int):
    """From a row for each shard and source with its count and its first number: the shard's slots."""
    over, under = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    over_at, under_end = np.cumsum(over) - over, np.cumsum(under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.repeat([x["s"] for x in cells], [x["c"] for x in cells])
                j = np.concatenate([np.arange(x["first"], x["first"] + x["c"]) for x in cells])
                far = j >= wanted[s]
                rank = over_at[s[far]] + j[far] - wanted[s[far]]
                to = np.searchsorted(under_end, rank, side="right")
                s[far] = to
                j[far] = drawn[to] + rank - (under_end[to] - under[to])
                n = blocks[s]
                turn = j // n
                key = mix(mix(np.full(len(s), seed, np.uint64)) + s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + turn.astype(np.uint64))
                block = permute(j % n, n, key)
                order = np.argsort(mix(key + j.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), kind="stable")
                slot = np.empty(len(s), np.int64)
                slot[order] = np.arange(len(s))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard)), pa.array(slot.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array((turn + 1).astype(np.int32)), pa.array(block)], ["shard", "slot", "s", "turn", "block"])

    return run


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs: doc_id, source, text. targets: source, target_share, max_repeats. One row for each slot of each
    output shard: the source, the turn (1 to max_repeats) and number of its block, the tokens, and the documents
    they come from in order."""
    spark = docs.sparkSession
    goal = targets.filter("source IS NOT NULL").select("source", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(goal) > MAX_SOURCES or len({r.source for r in goal}) < len(goal):
        raise ValueError(f"targets must list each source once, and no more than {MAX_SOURCES}")
    names = spark.createDataFrame([(r.source, k) for k, r in enumerate(goal)], "source string, s int")
    listed = docs.filter("length(text) > 0").join(F.broadcast(names), "source").select(F.col("doc_id").cast("long"), F.col("s"), F.col("text").cast("string"))
    vocabulary = vocabulary_of(tokenizer)
    width, shared = _width(vocabulary), spark.sparkContext.broadcast(vocabulary)
    packed = listed.mapInArrow(_encode(shared), "doc_id long, s int, n int, data binary").filter("n > 0")
    # The numbers of rows are written with them, so they stay as they are.
    packed = materialize(packed.withColumn("row", F.monotonically_increasing_id()), "mix-tokens")
    sizes = {r.s: (r.docs, r.n) for r in packed.groupBy("s").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).collect()}  # one row a source
    tokens = np.array([sizes.get(k, (0, 0))[1] for k in range(len(goal))], np.int64)
    wanted = plan(np.array([r.share for r in goal], float), np.array([r.repeats for r in goal], np.int64), tokens, total, block)
    n_slots = int(wanted.sum())
    out = "shard long, slot int, source string, turn int, block long, n_tokens int, doc_ids array<long>, tokens array<int>"
    if not n_slots:
        return spark.createDataFrame([], out)
    # Where each document begins in its source. Only numbers are placed; the tokens join their places, are cut where they
    # lie, and are shuffled once more to their blocks, which then stay where they are.
    buckets = max(1, max(d for d, _ in sizes.values()) // DOCS_A_BUCKET)
    u = F.xxhash64(F.lit(seed), "doc_id")
    placed = packed.select("row", "s", "n", "doc_id", F.xxhash64("data").alias("same"), u.alias("u")).withColumn("bucket", F.pmod(F.xxhash64("u"), F.lit(buckets)).cast("int"))
    before = lambda cols: W.partitionBy(*cols)
    sums = placed.groupBy("s", "bucket").agg(F.sum("n").alias("t"))
    sums = sums.select("s", "bucket", (F.sum("t").over(before(["s"]).orderBy("bucket")) - F.col("t")).alias("base"))
    run = before(["s", "bucket"]).orderBy("u", "doc_id", "same", "row").rowsBetween(W.unboundedPreceding, 0)
    light = placed.withColumn("at", F.sum("n").over(run) - F.col("n")).join(sums, ["s", "bucket"]).select("row", (F.col("at") + F.col("base")).alias("at"))
    pieces = packed.join(light, "row").select("s", "doc_id", "at", "n", "data").mapInArrow(_cut(np.dtype(width).itemsize, block), "s int, block long, at long, doc_id long, data binary")
    blocks = pieces.groupBy("s", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "data"))).alias("p"))
    # Counts of each shard, and the number of the first slot of each source in it.
    shards = -(-n_slots // slots)
    draws = materialize(spark.range(shards).mapInArrow(_draw(wanted / n_slots, slots, n_slots, seed), "shard long, s int, c long"), "mix-draws")
    drawn = np.zeros(len(goal), np.int64)
    for r in draws.groupBy("s").agg(F.sum("c").alias("c")).collect():  # one row a source
        drawn[r.s] = r.c
    draws = draws.withColumn("g", F.floor(F.col("shard") / SHARDS_A_GROUP))
    groups = draws.groupBy("s", "g").agg(F.sum("c").alias("t")).select("s", "g", (F.sum("t").over(before(["s"]).orderBy("g")) - F.col("t")).alias("base"))
    cells = draws.withColumn("first", F.sum("c").over(before(["s", "g"]).orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).join(groups, ["s", "g"])
    cells = cells.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("s", "c", (F.col("first") + F.col("base")).alias("first")))).alias("cells"))
    dealt = cells.mapInArrow(_deal(wanted, drawn, -(-tokens // block), seed), "shard long, slot int, s int, turn int, block long")
    mixed = dealt.join(blocks, ["s", "block"]).join(F.broadcast(names), "s")
    return mixed.select("shard", "slot", "source", "turn", "block", "p").mapInArrow(_open(width), out)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text"), spark.read.parquet(f"{d}/mix_target.parquet")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(*_tables(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each listed source: the share of all tokens wanted and reached, and how often its blocks occur."""
    docs, targets = _tables(spark, d)
    got = mixture(docs, targets).groupBy("source").agg(F.sum("n_tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("blocks"), F.max("turn").alias("turns"))
    all_of = got.agg(F.sum("tokens").alias("total"))
    out = targets.filter("source IS NOT NULL").join(got, "source", "left").crossJoin(F.broadcast(all_of))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("source", "target_share", "max_repeats", zero("tokens").alias("tokens"), zero("blocks").alias("blocks"), zero("turns").alias("turns"), (zero("tokens") / F.col("total")).alias("share"))
