"""Copies hidden by formatting, counted by an incremental ledger (problem 1).

A record's content key is the MD5 of its canonical text: lower case, and only letters, marks, numbers and
`+ - < > =` kept. The ledger has one row for each key: the number of records and the earliest (smallest)
id. It is a table bucketed by the key, with a bucket for every KEYS_A_BUCKET keys, and small deltas beside it. A new batch
is aggregated first (map-side combine, so a key with a third of all rows costs one row a task) and written as a
delta, so a batch costs no more than its own keys. The ledger is the full outer join of the buckets with the deltas' sums:
counts are added, the earliest representative is kept. Buckets and deltas meet by bucket, so the old side is never shuffled.
Once deltas hold a COMPACT share of the bucketed rows, the join is written as the new buckets, and the old ones and the
deltas are removed; when the ledger has outgrown its buckets, it gets more of them.

A ledger of an earlier session is gone on with by naming its root. A batch that names itself is taken once.

Defined cases: NULL ids count but are never the representative; NULL, unparseable and empty contents have no key and never enter the ledger; repeated ids in
one batch count once for each row; ties of the representative go to the smallest id; empty batches, and those whose name
was seen, change nothing; versions that broke off don't count; extra columns of any name are ignored, since only id and key columns are taken.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import children, drop_path, lasting, lookup_skewed, materialize, scratch, touch

KEYS_A_BUCKET = 1_000_000
LEAST_BUCKETS = 8
COMPACT = 0.25
KEPT = r"[^\p{L}\p{M}\p{N}+\-<>=]+"
LEDGER = "tbl string, key binary, n bigint, first_id bigint"


def canonical_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), KEPT, "")


def text_key(text: Column) -> Column:
    """Content key of a text; NULL for NULL and for texts with nothing left."""
    c = canonical_text(text)
    return F.when(F.length(c) > 0, F.unhex(F.md5(c)))


def payload_key(payload: Column) -> Column:
    """Content key of a flat JSON object: the sorted pairs of lower-cased field name and canonical value.
    JSON null is a value of its own. NULL for unparseable and field-less payloads."""
    fields = F.map_entries(F.from_json(payload, "map<string,string>"))
    pairs = F.array_sort(
        F.transform(fields, lambda e: F.concat(F.lower(e["key"]), F.lit("\x1f"), F.coalesce(canonical_text(e["value"]), F.lit("\x1d"))))
    )
    return F.when(F.size(pairs) > 0, F.unhex(F.md5(F.array_join(pairs, "\x1e"))))


def buckets_for(keys: int) -> int:
    """A power of two, so that growth keeps the number for long."""
    return max(LEAST_BUCKETS, 1 << max(0, -(-keys // KEYS_A_BUCKET) - 1).bit_length())


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tbl", "key").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))


class Ledger:
    """Counts and earliest representatives by content key, kept in the shared folder: `base-VERSION-BUCKETS` holds what came
    up to that version, `delta-VERSION` a later batch, `taken` the names of batches. Frames that were read end with the next add."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        """root: where a ledger is, to go on with it; a new one in the shared folder if not given."""
        self.spark, self.root = spark, root or lasting(spark, "ledger")
        names = children(spark, self.root)
        whole = [x for x in names if x.startswith(("base-", "delta-")) and "_SUCCESS" in children(spark, f"{self.root}/{x}")]
        self.base = max((x for x in whole if x.startswith("base-")), key=self._version, default=None)
        since = self._version(self.base) if self.base else -1
        self.deltas = sorted((x for x in whole if x.startswith("delta-") and self._version(x) > since), key=self._version)
        self.next = max((self._version(x) for x in names if x.startswith(("base-", "delta-"))), default=-1) + 1
        self.taken = {x[4:] for x in children(spark, f"{self.root}/taken")} | {x.split("-", 2)[2] for x in whole if x.startswith("delta-") and x.count("-") > 1}
        self.rows = {x: self._count(x) for x in [*self.deltas, *[self.base] * bool(self.base)]}

    @staticmethod
    def _version(name: str) -> int:
        return int(name.split("-")[1])

    def _count(self, name: str) -> int:
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/{name}").count()

    def _table(self, name: str) -> str:
        """The name under which this session knows the buckets."""
        return "quern_" + hashlib.md5(f"{self.root}/{name}".encode()).hexdigest()

    def _bucketed(self) -> DataFrame:
        table, n = self._table(self.base), self.base.split("-")[2]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({LEDGER}) USING parquet CLUSTERED BY (tbl, key) SORTED BY (tbl, key) INTO {n} BUCKETS LOCATION '{self.root}/{self.base}'")
        return self.spark.table(table)

    def read(self) -> DataFrame:
        """tbl, key, n, first_id."""
        if not self.deltas:
            return self._bucketed() if self.base else self.spark.createDataFrame([], LEDGER)
        new = _sums(self.spark.read.schema(LEDGER).parquet(*(f"{self.root}/{x}" for x in self.deltas)))
        if not self.base:
            return new
        o, b = self._bucketed().alias("o"), new.alias("b")
        count = F.coalesce("o.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return o.join(b, ["tbl", "key"], "full_outer").select("tbl", "key", count.alias("n"), F.least("o.first_id", "b.first_id").alias("first_id"))

    def add(self, batch: DataFrame, name: str | None = None) -> bool:
        """batch: tbl string, id long, key binary. Rows without a key are passed over. name: letters, digits and underscores;
        a batch of a name that was taken is passed over. Whether anything was added."""
        if name is not None and (name in self.taken or not re.fullmatch(r"\w+", name)):
            if name in self.taken:
                return False
            raise ValueError(f"no name of a batch: {name!r}")
        at = f"delta-{self.next}" + (f"-{name}" if name else "")
        new = batch.filter("key IS NOT NULL").groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
        new.write.mode("overwrite").parquet(f"{self.root}/{at}")
        self.next += 1
        if name:
            self.taken.add(name)
        self.rows[at] = self._count(at)
        self.deltas.append(at)
        if sum(self.rows[x] for x in self.deltas) > COMPACT * self.rows.get(self.base, 0):
            self.compact()
        return self.rows.get(at) != 0

    def compact(self) -> None:
        """Write the buckets anew. They count once they are whole; what they replace is removed after that."""
        keys = sum(self.rows.values())
        n = buckets_for(keys)
        at, merged = f"base-{self._version(self.deltas[-1])}-{n}", self.read()
        if not (self.base and self.base.split("-")[2] == str(n)):
            merged = merged.repartition(n, "tbl", "key")
        merged.write.mode("overwrite").bucketBy(n, "tbl", "key").sortBy("tbl", "key").option("path", f"{self.root}/{at}").saveAsTable(self._table(at))
        for name in self.taken:
            touch(self.spark, f"{self.root}/taken/was-{name}")
        old, self.base, self.deltas = [*self.deltas, *[self.base] * bool(self.base)], at, []
        for x in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(x)}")
            drop_path(self.spark, f"{self.root}/{x}")
        self.rows = {at: self._count(at)}


def records(df: DataFrame, tbl: str, id_col: str, key: Column, delivered: Column) -> DataFrame:
    """Ledger input of one table; delivered tells the delivery a row came with (NULL counts as the first)."""
    return df.select(F.lit(tbl).alias("tbl"), F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(delivered.cast("int"), F.lit(0)).alias("delivery"))


def collapse(recs: DataFrame) -> tuple[DataFrame, Ledger]:
    """Run the deliveries of recs through a new ledger, in order. Returns the keyed records, cut off from
    their source, and the ledger."""
    recs = materialize(recs.filter("key IS NOT NULL"), "ledger-records", ("delivery",))
    ledger = Ledger(recs.sparkSession, scratch(recs.sparkSession, "ledger"))
    for (d,) in sorted(tuple(r) for r in recs.select("delivery").distinct().collect()):  # a handful of deliveries
        ledger.add(recs.filter(F.col("delivery") == d), f"delivery_{d}".replace("-", "minus"))
    return recs, ledger


def copies(recs: DataFrame, ledger: Ledger) -> DataFrame:
    """(tbl, kept_id, copy_id): one row for each record that isn't the representative of its content."""
    groups = materialize(ledger.read().filter("n > 1"), "ledger-groups")
    found = lookup_skewed(recs.select("tbl", "id", "key"), groups, ["tbl", "key"], "n")
    return found.filter("id <> first_id").select("tbl", F.col("first_id").alias("kept_id"), F.col("id").alias("copy_id"))


def domain_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of the three tables of problem 1. A delivery is a half-year of arrival."""
    half = lambda c: F.year(c) * 2 + F.when(F.month(c) > 6, 1).otherwise(0)
    cand = spark.read.parquet(f"{d}/sft_candidate.parquet")
    hmmt = spark.read.parquet(f"{d}/hmmt25_feb.parquet")
    raw = spark.read.parquet(f"{d}/raw_record.parquet")
    return (
        records(cand, "sft_candidate", "cand_id", text_key(F.col("problem")), half(F.col("ingested_at")))
        .unionByName(records(hmmt, "hmmt25_feb", "id", text_key(F.col("problem")), F.lit(0)))
        .unionByName(records(raw, "raw_record", "raw_id", payload_key(F.col("payload")), half(F.col("fetched_at"))))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(*collapse(domain_records(spark, d)))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One row for each content with its number of copies and its representative."""
    _, ledger = collapse(domain_records(spark, d))
    return ledger.read().select("tbl", F.col("first_id").alias("kept_id"), "n")


_KEPT = r"[^\p{L}\p{M}\p{N}+\-<>=]+"
_canon = lambda c: f"regexp_replace(lower({c}), '{_KEPT}', '', 'g')"
_PAIRS = f"""SELECT raw_id, list_sort(list(lower(k) || chr(31) || coalesce({_canon("v")}, chr(29)))) AS pairs FROM (
  SELECT raw_id, k, json_extract_string(payload, '$."' || k || '"') AS v FROM (SELECT raw_id, payload, unnest(json_keys(payload)) AS k FROM raw_record WHERE json_valid(payload) AND json_type(payload) = 'OBJECT')) GROUP BY raw_id"""
_GROUPS = f"""WITH r AS (SELECT 'sft_candidate' AS tbl, cand_id AS id, {_canon("problem")} AS k FROM sft_candidate
  UNION ALL SELECT 'hmmt25_feb', id, {_canon("problem")} FROM hmmt25_feb
  UNION ALL SELECT 'raw_record', raw_id, array_to_string(pairs, chr(30)) FROM ({_PAIRS})),
g AS (SELECT tbl, k, min(id) AS kept_id, count(*)::BIGINT AS n FROM r WHERE k <> '' GROUP BY tbl, k)"""
P1_FOUND_SQL = f"{_GROUPS} SELECT r.tbl, kept_id, id AS copy_id FROM r JOIN g ON r.tbl = g.tbl AND r.k = g.k WHERE id <> kept_id"
P1_RECORDS_SQL = f"{_GROUPS} SELECT tbl, kept_id, n FROM g"
