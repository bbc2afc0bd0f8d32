"""Near-duplicate groups under small edits, by BK-trees over Hamming distances (problem 5).

A text is its set of distinct runs of `shingle` consecutive words, each a 64-bit hash; a 64-bit hash of the
set is its node, so exact copies and formatted copies are one node and are never paired with each other.

The Hamming distance. Each node has a parity sketch: bit i tells whether an odd number of the set's hashes
fall on i. The Hamming distance of two sketches is never more than the size of the sets' symmetric
difference, and two sets of a and b shingles that are alike at J differ in at most (1-J)/(1+J) * (a+b).
So a search with that radius loses nothing, whatever the data.

The shards. One tree over everything follows nearly every edge, since unrelated sets are all about equally far
from each other and the radius at these likenesses is wide (figures in the README), so nodes are first dealt to shards
where alike nodes meet. In a fixed order of all shingles two alike sets share one of their first n - ceil(J n) + 1
shingles, and at the first one they share, what is left of the smaller set must still hold the whole overlap: there the
shingle is among its first n - ceil(2J/(1+J) n) + 1 (it is an "index" place). So each early shingle names a shard, a
shard without an index place is none, and of a pair the smaller one must stand at an index place. Texts that share a
long template but differ in as many words of their own meet in no shard, since the order puts rare shingles first, by
a count sketch of fixed size (`SLOTS` bytes are broadcast, whatever the data). A shard's tree is built in the task that holds the shard (trees grow with the data,
so they aren't broadcast): each node asks the tree of the index places, following only edges within the radius.

Hot shingles. One that over `BLOCK` nodes may hold (as the count sketch tells) names as many cells as it has blocks of
nodes, and nodes are dealt to them by hash, so no task holds a whole shingle.

Groups need not be paired in full. A first round links each node to its `NEAREST` nearest ones in each shard or cell (all,
in small shards). A second round takes from larger shards only pairs the first didn't bring to one component, so a large
group of alike texts costs no more than its nodes, and still no link between different groups is lost. There, nodes of
a hot shingle that aren't in its commonest component visit all its cells; those of that component stay in their own.

An exact comparison of the shingle sets (all 64 bits of each hash) confirms each link the trees give, and groups are the
connected components.

Defined cases: NULLs and texts under `least_words` words are left out; texts that agree word for word, case
and form aside, are in one group; repeated ids count as copies; rows with a NULL id aren't listed; empty tables give no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.mixing import mix
from quern.llm.visual import words_sql
from quern.llm.words import lowered, window_hashes, word_hashes
from quern.llm.components import connected_components
from quern.session import discard, lookup_skewed, materialize

SLOTS = 1 << 22
FLAGS = 1 << 23
BLOCK = 1_024
NEAREST = 8
BITS = 512
PART = 1_000
GATHER = 200_000
OUT_ROWS = 50_000
#: In shards of up to so many nodes every place counts as an index place, which makes more of them equal.
SMALL = 64
#: Nodes a task remembers to pass over copies; those it forgot are dropped after the shuffle.
SEEN = 1_000_000
_CHUNK = 1 << 16


def _salt(field: int) -> np.uint64:
    return mix(np.array([field + 1], np.uint64))[0]


class Sets:
    """The shingle sets of some texts, end to end: `places` of the texts that are long enough, their `sizes`,
    the distinct hashes of each in ascending order (`hashes`), and their `nodes`."""

    def __init__(self, texts: list[str | None], field: int, shingle: int, least_words: int):
        h, counts, _, _ = word_hashes([lowered(t) for t in texts])
        ends = np.cumsum(counts)
        runs = window_hashes(h, shingle) ^ _salt(field)
        self.places = np.flatnonzero(counts >= max(least_words, shingle))
        sizes = counts[self.places] - shingle + 1
        begin = (ends - counts)[self.places]
        # Runs over the seam of two texts are left out.
        self.hashes = runs[_ranges(begin, sizes)]
        self.sizes = sizes
        self._settle()
        ones = np.add.reduceat(mix(self.hashes + np.uint64(1)), self.starts) if len(self.places) else np.empty(0, np.uint64)
        self.nodes = mix(ones + self.sizes.astype(np.uint64)) & ~np.uint64(1)  # the last bit is free for a mark

    def _settle(self) -> None:
        """Sort each set and drop what it has twice."""
        at = 0
        for n in self.sizes.tolist():
            self.hashes[at : at + n].sort()
            at += n
        starts = np.cumsum(self.sizes) - self.sizes
        fresh = np.ones(len(self.hashes), bool)
        fresh[1:] = self.hashes[1:] != self.hashes[:-1]
        fresh[starts] = True
        if len(starts):
            self.sizes = np.add.reduceat(fresh.astype(np.int64), starts)
        self.hashes = self.hashes[fresh]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def keep(self, which: np.ndarray) -> None:
        self.hashes = self.hashes[_ranges(self.starts[which], self.sizes[which])]
        self.places, self.sizes, self.nodes = self.places[which], self.sizes[which], self.nodes[which]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def unseen(self, seen: set[int]) -> None:
        """Keep one text of each node that isn't in seen, and put the nodes there."""
        which = []
        if len(seen) > SEEN:
            seen.clear()
        for k, node in enumerate(self.nodes.tolist()):
            if node not in seen:
                seen.add(node)
                which.append(k)
        self.keep(np.array(which, np.int64))

    def sketches(self) -> np.ndarray:
        """A row of BITS / 8 bytes for each set."""
        row = np.repeat(np.arange(len(self.sizes)), self.sizes) * BITS
        slot = ((self.hashes >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64)
        odd = np.bincount(row + slot, minlength=len(self.sizes) * BITS).reshape(-1, BITS) & 1
        return np.packbits(odd.astype(np.uint8), axis=1)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin[0], begin[0] + 1, ..., of sizes[0] many, then those of begin[1], ..."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) if total else np.empty(0, np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def prefix_size(n: np.ndarray, j: float) -> np.ndarray:
    return n - np.ceil(j * n - 1e-9).astype(np.int64) + 1


def cells_of(ranks: np.ndarray) -> np.ndarray:
    """Cells of shingles whose slots have these ranks."""
    return np.maximum(1, np.ceil((2.0 ** (ranks.astype(float) / 8) - 1) / BLOCK)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], first: int, fields: int, shingle: int, least_words: int) -> Iterator[tuple[pa.RecordBatch, int, Sets]]:
    """The sets of every field, PART texts at a time, so that memory doesn't grow with a batch."""
    for b in batches:
        for lo in range(0, b.num_rows, PART):
            part = b.slice(lo, PART)
            for f in range(fields):
                s = Sets(part.column(first + f).to_pylist(), f, shingle, least_words)
                if len(s.places):
                    yield part, f, s


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self):
        self.bits: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, x: int, radius: int, visits: list[int] | None = None) -> list[tuple[int, int]]:
        """(place, distance) of all members within the radius; follows only edges within it. visits adds up the
        members looked at, the members there were and those found."""
        found, todo, looked = [], [0] if self.bits else [], 0
        while todo:
            at = todo.pop()
            looked += 1
            d = (self.bits[at] ^ x).bit_count()
            if d <= radius:
                found.append((at, d))
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        if visits is not None:
            visits[:] = visits[0] + looked, visits[1] + len(self.bits), visits[2] + len(found)
        return found

    def add(self, x: int) -> None:
        self.bits.append(x)
        self.children.append({})
        new, at = len(self.bits) - 1, 0
        while new:
            d = (self.bits[at] ^ x).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]


class Shard:
    """The members of a shard: node, size, sketch, whether it stands at an index place, label of its component, and
    whether it is a guest from another cell."""

    def __init__(self):
        self.members: list[tuple[int, int, int, bool, int, bool]] = []

    def links(self, j: float, most: int | None, across: bool, visits: list[int] | None = None) -> Iterator[tuple[int, int]]:
        """Links that the Hamming bound, the sizes and the index places allow: of each member to its `most` nearest
        ones, or, with across, to all of another label. visits adds up what was looked at, and what there was."""
        tree, inside, share = BKTree(), [], (1 - j) / (1 + j)
        for me in sorted(self.members, key=lambda x: not x[3]):
            node, n, x, index, label, guest = me
            near = []
            found = tree.within(x, int(share * (n + n / j) + 1e-9), visits)
            for at, d in found:
                to, m, _, _, other, far = inside[at]
                if d > share * (n + m) + 1e-9 or j * max(n, m) > min(n, m) + 1e-9 or across and (label == other or guest and far):
                    continue
                if index or m <= n:  # those in the tree stand at index places
                    near.append((d, to))
            for _, to in sorted(near)[:most]:
                yield (to, node) if to < node else (node, to)
            if index:
                tree.add(x)
                inside.append(me)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _scan(fields: int, shingle: int, least_words: int):
    """Members with size and sketch, and the partition's shingle counts in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist, seen = np.zeros(SLOTS, np.uint16), set()
        for part, f, s in _parts(batches, 1, fields, shingle, least_words):
            m, width = len(s.places), BITS // 8
            data = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * width, width, dtype=np.int32)), pa.py_buffer(s.sketches().tobytes())])
            ids = part.column(0).take(pa.array(s.places))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, f, np.int32)), ids, pa.array(_signed(s.nodes)), pa.array(s.sizes.astype(np.int32)), data], schema=_SCAN)
            s.unseen(seen)
            slots, n = np.unique(_slot(s.hashes), return_counts=True)
            hist[slots] = np.minimum(hist[slots].astype(np.int64) + n, 65535)
        for c in range(SLOTS // _CHUNK):
            counts = hist[c * _CHUNK : (c + 1) * _CHUNK]
            if counts.any():
                yield pa.RecordBatch.from_pydict({"field": [-1], "id": [c], "node": [0], "n": [0], "data": [counts.tobytes()]}, _SCAN)

    return run


_SCAN = pa.schema([("field", pa.int32()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chunk counts of any number of partitions in constant memory."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kind = np.uint16 if len(data) == 2 * _CHUNK else np.uint64
            sums.setdefault(c, np.zeros(_CHUNK, np.uint64))[:] += np.frombuffer(data, kind)
    for c, x in sums.items():
        yield pa.RecordBatch.from_pydict({"id": [c], "data": [x.tobytes()]}, pa.schema([("id", pa.int64()), ("data", pa.binary())]))


def _rank_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of all, as a rank for each slot (one byte, growing with the count)."""
    for b in _sum_chunks(batches):
        rank = np.minimum(255, 8 * np.log2(1.0 + np.frombuffer(b.column(1)[0].as_py(), np.uint64))).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"chunk": b.column(0).to_pylist(), "ranks": [rank.tobytes()]}, pa.schema([("chunk", pa.int64()), ("ranks", pa.binary())]))


def _prefixes(fields: int, shingle: int, least_words: int, j: float, ranks):
    """(key, node, token): the rarest shingles of each node, once for each node and partition. A token is the rank
    of the shingle's slot and 56 bits of its hash, so ascending tokens are the order of all shingles. The last bit of
    a node tells whether the token is at an index place. The key is the token, or for a hot one that of the
    node's cell, and only then is the token named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen, both = np.frombuffer(ranks.value, np.uint8), set(), 2 * j / (1 + j)
        for _, _, s in _parts(batches, 0, fields, shingle, least_words):
            s.unseen(seen)
            s.hashes = (rank[_slot(s.hashes)].astype(np.uint64) << np.uint64(56)) | (s.hashes >> np.uint64(8))
            s._settle()
            sizes = np.minimum(prefix_size(s.sizes, j), s.sizes)
            tokens = s.hashes[_ranges(s.starts, sizes)]
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            nodes = np.repeat(s.nodes, sizes) | (place < np.repeat(prefix_size(s.sizes, both), sizes)).astype(np.uint64)
            cells = cells_of(tokens >> np.uint64(56))
            hot = cells > 1
            keys = np.where(hot, mix(tokens + own_cell(nodes, cells).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), tokens)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(_signed(nodes)), pa.array(_signed(tokens), mask=~hot)], ["key", "node", "token"])

    return run


def own_cell(nodes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (mix((nodes >> np.uint64(1)) + np.uint64(11)) % cells.astype(np.uint64)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of several batches in one, of at least `rows` rows but for the last; NULLs are 0."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield _columns(held)
            held = []
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([x.column(i).fill_null(0).to_numpy(zero_copy_only=False) for x in held]) for i in range(held[0].num_columns))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, node, token) sorted by key and node: a shard for each set of two or more nodes that share a key and
    have an index place, once for each partition; size is its number of nodes. Tokens that are named are
    passed on with their nodes, size being 0."""
    known: set[int] = set()
    named = ["shard", "node", "size"]

    def deal(t: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(t):
            return
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
        t, n, tokens = t[fresh], n[fresh], tokens[fresh]
        hot = tokens != 0
        if hot.any():
            yield pa.RecordBatch.from_arrays([pa.array(tokens[hot]), pa.array(n[hot]), pa.array(np.zeros(int(hot.sum()), np.int32))], named)
        starts = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(t)))
        good = (sizes > 1) & (np.maximum.reduceat(n & 1, starts) > 0)
        starts, sizes = starts[good], sizes[good]
        if not len(starts):
            return
        nodes = n[_ranges(starts, sizes)] | np.repeat(sizes <= SMALL, sizes)
        starts = np.cumsum(sizes) - sizes
        names = mix(np.add.reduceat(mix(nodes.view(np.uint64) + np.uint64(7)), starts) + sizes.astype(np.uint64))
        which = []
        if len(known) > SEEN:
            known.clear()
        for k, x in enumerate(names.tolist()):
            if x not in known:
                known.add(x)
                which.append(k)
        if which:
            w = np.array(which)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.repeat(names[w], sizes[w]))), pa.array(nodes[_ranges(starts[w], sizes[w])]), pa.array(np.repeat(sizes[w], sizes[w]).astype(np.int32))], named)

    held = tuple(np.empty(0, np.int64) for _ in range(3))
    for new in _gathered(batches, GATHER):
        cols = tuple(np.concatenate(x) for x in zip(held, new))
        t = cols[0]
        last = len(t) - int(np.argmax(t[::-1] != t[-1])) if t[0] != t[-1] else 0  # where the last key begins
        yield from deal(*(c[:last] for c in cols))
        held = tuple(c[last:] for c in cols)
    yield from deal(*held)


def _links(j: float, across: bool):
    """From (shard, node, n, data, label, guest) sorted by shard: the links the shard's tree gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[int, int]] = set()
        group, at = Shard(), None

        def close() -> None:
            if len(group.members) > 1:
                pairs.update(group.links(j, None if across else NEAREST, across))
            group.members.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                pairs.clear()

        for b in batches:
            for shard, node, n, data, label, guest in zip(*(c.to_pylist() for c in b.columns)):
                if shard != at:
                    close()
                    at = shard
                group.members.append((node & ~1, n, int.from_bytes(data), bool(node & 1), label, guest))
                if len(pairs) > OUT_ROWS:
                    yield from flush()
        close()
        yield from flush()

    return run


def _flag_of(ids: pa.Array) -> np.ndarray:
    return (mix(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FLAGS)).astype(np.int64)


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of the ids' slots, in chunks, of a fixed size in each partition."""
    flags = np.zeros(FLAGS, bool)
    for b in batches:
        flags[_flag_of(b.column(0))] = True
    for c in range(FLAGS // _CHUNK):
        part = flags[c * _CHUNK : (c + 1) * _CHUNK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["chunk", "bits"])


def _or_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for c, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(c, np.zeros(_CHUNK // 8, np.uint8))[:] |= np.frombuffer(bits, np.uint8)
    for c, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["chunk", "bits"])


def _sets(fields: int, shingle: int, least_words: int, flags):
    """(node, data): the shingle hashes, once for each node and partition, for the rows whose id's slot
    is flagged; which of those are needed is settled by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, wanted = set(), np.unpackbits(np.frombuffer(flags.value, np.uint8)).astype(bool)
        flagged = (b.filter(pa.array(wanted[_flag_of(b.column(0))])) for b in batches)
        for _, _, s in _parts(flagged, 1, fields, shingle, least_words):
            s.unseen(seen)
            if len(s.places):
                ends = np.append(s.starts, s.starts[-1] + s.sizes[-1]).astype(np.int64) * 8
                data = pa.Array.from_buffers(pa.large_binary(), len(s.places), [None, pa.py_buffer(ends), pa.py_buffer(s.hashes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_signed(s.nodes)), data], ["node", "data"])

    return run


def _confirm(j: float):
    """Pairs whose sets share at least j of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.concatenate((p, q))
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                keep.append(common >= j * (len(p) + len(q) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return run


def near_groups(df: DataFrame, id_col: str, fields: list[str], j: float = 0.8, shingle: int = 5, least_words: int = 5) -> DataFrame:
    """(field, id, group_id): every text in a group with another, the smallest id being group_id (it isn't
    listed itself)."""
    spark, k = df.sparkSession, len(fields)
    base = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    texts = base.select(*(f"f{i}" for i in range(k)))
    scan = materialize(base.mapInArrow(_scan(k, shingle, least_words), "field int, id long, node long, n int, data binary"), "near-scan")
    members = scan.filter("field >= 0")
    chunks = scan.filter("field < 0").select("id", "data", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt"))
    partial = chunks.repartition("id", "salt").select("id", "data").mapInArrow(_sum_chunks, "id long, data binary")
    rank = bytearray(SLOTS)
    for r in partial.repartition(16, "id").mapInArrow(_rank_chunks, "chunk long, ranks binary").collect():  # SLOTS bytes, whatever the data
        rank[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = r.ranks
    ranks = spark.sparkContext.broadcast(bytes(rank))
    tokens = texts.mapInArrow(_prefixes(k, shingle, least_words, j, ranks), "key long, node long, token long")
    by_key = tokens.repartition(F.col("key")).sortWithinPartitions("key", "node")
    shards = materialize(by_key.mapInArrow(_shards, "shard long, node long, size int").distinct(), "near-shards")
    nodes = members.groupBy("node").agg(F.first("field").alias("field"), F.first("n").alias("n"), F.first("data").alias("data"), F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    plain = F.col("node").bitwiseAND(F.lit(-2))
    shards_of = shards.withColumn("at", plain)

    def links(dealt: DataFrame, across: bool) -> DataFrame:
        rows = dealt.join(nodes.select(F.col("node").alias("at"), "n", "data"), "at").select("shard", "node", "n", "data", "label", "guest")
        rows = rows.repartition(F.col("shard")).sortWithinPartitions("shard")
        return materialize(rows.mapInArrow(_links(j, across), "a long, b long").distinct(), "near-links")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = materialize(ends.join(nodes.select("node", "rep"), "node"), "near-needed")
        flagged = needed.select("rep").mapInArrow(_flags, "chunk long, bits binary").repartition(FLAGS // _CHUNK // 8, "chunk").mapInArrow(_or_chunks, "chunk long, bits binary")
        bitmap = bytearray(FLAGS // 8)
        for r in flagged.collect():  # FLAGS bits, whatever the data
            bitmap[r.chunk * _CHUNK // 8 : (r.chunk + 1) * _CHUNK // 8] = r.bits
        flags = spark.sparkContext.broadcast(bytes(bitmap))
        sets = base.mapInArrow(_sets(k, shingle, least_words, flags), "node long, data binary").join(needed, "node", "left_semi")
        sets = materialize(sets.dropDuplicates(["node"]), "near-sets")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        out = materialize(both.mapInArrow(_confirm(j), "a long, b long"), "near-confirmed")
        discard(pairs, needed, sets)
        return out

    # First each node's nearest ones in its shards: in shards of up to NEAREST + 1 nodes those are all.
    alone = F.lit(False).alias("guest")
    edges = confirmed(links(shards_of.filter("size > 0").select("shard", "node", "at", F.lit(0).cast("long").alias("label"), alone), False))
    roots = connected_components(edges, "a", "b")
    large = shards_of.filter(f"size > {NEAREST + 1} OR size = 0")
    if large.take(1):
        # Then, in larger shards, all pairs that aren't in one component yet; a shard in one component is done.
        labelled = large.join(roots.toDF("at", "root"), "at", "left").withColumn("label", F.coalesce("root", "at")).drop("root")
        labelled = materialize(labelled, "near-large")
        counts = labelled.groupBy("shard", "label").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("node").bitwiseAND(F.lit(1))).alias("index"))
        open_ = counts.groupBy("shard").agg(F.count(F.lit(1)).alias("labels"), F.max("index").alias("index"), F.max_by("label", "c").alias("common")).filter("labels > 1 AND index = 1")
        dealt = lookup_skewed(labelled, open_.join(labelled.groupBy("shard").count(), "shard"), ["shard"], "count")
        cold = dealt.filter("size > 0").select("shard", "node", "at", "label", alone)
        # A hot shingle's cells: all nodes are at home in their own, those of rarer components visit the others.
        rank_of = F.shiftrightunsigned("shard", 56)
        cells = F.ceil((F.pow(F.lit(2.0), rank_of / 8) - 1) / BLOCK).cast("int")
        hot = dealt.filter("size = 0").withColumn("own", F.pmod(F.xxhash64("at"), cells).cast("int"))
        goes = F.when(F.col("label") == F.col("common"), F.array("own")).otherwise(F.sequence(F.lit(0), cells - 1))
        hot = hot.withColumn("cell", F.explode(goes))
        hot = hot.select(F.xxhash64("shard", "cell").alias("shard"), "node", "at", "label", (F.col("cell") != F.col("own")).alias("guest"))
        more = links(cold.unionByName(hot), True)
        discard(labelled)
        if more.take(1):
            roots = connected_components(edges.unionByName(confirmed(more)), "a", "b")
    discard(shards)
    # A node without a link stands for itself; a component is named by its smallest id.
    whole = nodes.select("field", "node", "rep", "copies").join(roots.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = materialize(whole, "near-nodes")
    heads = whole.groupBy("root").agg(F.min("rep").alias("group_id"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("k")).filter("all > 1")
    named = lookup_skewed(whole, heads.select("root", "group_id", "k"), ["root"], "k")
    named = materialize(named.select("node", F.col("copies").alias("n"), "group_id"), "near-named")
    discard(whole)
    found = lookup_skewed(members.select("field", "id", "node"), named, ["node"], "n").filter("id <> group_id")
    return found.select(F.array(*map(F.lit, fields))[F.col("field")].alias("field"), "group_id", F.col("id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cand = spark.read.parquet(f"{d}/sft_candidate.parquet")
    return near_groups(cand, "cand_id", ["problem", "code"], 0.6, 3, 30).select("field", "group_id", F.col("id").alias("cand_id"))


#: Shingles of distinct word lists, pairs that share enough of them, and the least id each text reaches.
P5_FOUND_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT field, cand_id, w FROM (
    SELECT 'problem' AS field, cand_id, {words_sql('problem')} AS w FROM sft_candidate
    UNION ALL SELECT 'code', cand_id, {words_sql('code')} FROM sft_candidate)
  WHERE len(w) >= 30),
sets AS MATERIALIZED (
  SELECT field, cand_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: hash(array_to_string(list_slice(w, i, i + 2), ' '))))) AS s FROM w),
node AS MATERIALIZED (SELECT field, s, min(cand_id) AS node, len(s) AS n FROM sets GROUP BY field, s),
posting AS MATERIALIZED (SELECT field, node, n, unnest(s) AS h FROM node),
pair AS (
  SELECT a.field, a.node AS x, b.node AS y FROM posting a JOIN posting b ON a.field = b.field AND a.h = b.h AND a.node < b.node AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n)
  GROUP BY a.field, a.node, b.node, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9),
edge AS MATERIALIZED (SELECT field, x, y FROM pair UNION ALL SELECT field, y, x FROM pair),
reach AS (SELECT field, node, node AS root FROM node UNION SELECT e.field, e.y, r.root FROM reach r JOIN edge e ON e.field = r.field AND e.x = r.node WHERE r.root < e.y),
root AS (SELECT field, node, min(root) AS root FROM reach GROUP BY field, node)
SELECT s.field, g.group_id, s.cand_id FROM sets s JOIN node n USING (field, s) JOIN root r ON r.field = n.field AND r.node = n.node
JOIN (SELECT r.field, r.root, min(r.node) AS group_id FROM root r GROUP BY r.field, r.root) g ON g.field = r.field AND g.root = r.root
WHERE s.cand_id <> g.group_id
"""
