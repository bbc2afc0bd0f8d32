"""A sample that stays as data grows: permanent random numbers (problem 3).

Every identifier gets one uniform number in [0, 1) when it is first seen. The number is a hash of seed and
identifier, so any rerun and partitioning gives the same, and it is persisted by an anti-join insert: a batch
adds only identifiers the register lacks. An identifier is selected once its number is under the threshold
of a batch. Thresholds never fall, also from one run to the next, since each is stored with the register and
a batch takes at least the highest of those before it; so whatever was selected stays selected. A run goes on with an earlier one's
register by naming its root.

Identifiers are compared without case and blanks. Defined cases: NULL and blank identifiers are no items;
rows without a batch come with batch 0; NULL ranks are passed over for best_rank (NULL if all are); repeated
rows count once; an empty table gives an empty sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import children, lasting, materialize, touch

SEED = "quern-sample-1"
REGISTER = "item string, prn double, first_batch int"


def item_of(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(F.length(t) > 0, t)


def permanent_number(item: Column, seed: str = SEED) -> Column:
    """52 bits of SHA-256 of seed and identifier, as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), item), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def threshold(batch: int) -> float:
    """Share of the items selected as of a batch: 10 % at first, one point more a batch, 20 % at most."""
    return min(0.20, 0.10 + 0.01 * max(0, batch - 1))


class Register:
    """The persisted numbers. Each insert appends a new part; nothing is rewritten."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        """root: where a register is, to go on with it; a new one in the shared folder if not given."""
        self.spark, self.root = spark, root or lasting(spark, "register")
        whole = [x for x in children(spark, self.root) if "_SUCCESS" in children(spark, f"{self.root}/{x}")]
        self.parts = [f"{self.root}/{x}" for x in whole if x.startswith("batch-")]
        #: The threshold of each batch, one number a delivery, kept as marks named batch=threshold.
        self.levels = {int(b): float(x) for b, x in (name.split("=") for name in children(spark, f"{self.root}/levels"))}

    def read(self) -> DataFrame:
        return self.spark.read.schema(REGISTER).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], REGISTER)

    def insert(self, items: DataFrame, batch: int) -> None:
        """items: one row for each item. Those already there keep their number and batch."""
        at = f"{self.root}/batch-{batch}"
        self.parts = [p for p in self.parts if p != at]  # a batch that comes again replaces its part
        new = items.join(self.read(), "item", "left_anti") if self.parts else items
        new.select("item", permanent_number(F.col("item")).alias("prn"), F.lit(batch).alias("first_batch")).write.mode("overwrite").parquet(at)
        self.parts.append(at)

    def raise_level(self, batch: int, wanted: float) -> float:
        """The threshold as of a batch: the wanted one, or the highest so far. It is stored, and a batch that comes again keeps its own."""
        if batch not in self.levels:
            self.levels[batch] = max([wanted, *self.levels.values()])
            touch(self.spark, f"{self.root}/levels/{batch}={float(self.levels[batch])!r}")
        return self.levels[batch]


def stable_sample(rows: DataFrame, threshold_of: Callable[[int], float] = threshold, root: str | None = None) -> DataFrame:
    """root: where an earlier run's register is, to go on with it. rows: item_sha256, rank, batch_no. One row for each selected item: its number, the batch it was first
    seen and the batch it was selected with, and its best rank."""
    spark = rows.sparkSession
    seen = rows.select(item_of(F.col("item_sha256")).alias("item"), F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch"), F.col("rank").cast("long").alias("rank"))
    seen = seen.filter("item IS NOT NULL").groupBy("item", "batch").agg(F.min("rank").alias("rank"))
    seen = materialize(seen, "sample-items", ("batch",))
    batches = sorted(r[0] for r in seen.select("batch").distinct().collect())  # one number a delivery
    register = Register(spark, root)
    for b in batches:
        register.insert(seen.filter(F.col("batch") == b).select("item"), b)
        register.raise_level(b, threshold_of(b))
    picked = register.read().filter(F.col("prn") < max(register.levels.values(), default=0.0))
    # An item is selected with the first batch that is no earlier than its own and whose threshold is above its number.
    when = F.lit(None).cast("int")
    for b, x in sorted(register.levels.items(), reverse=True):
        when = F.when((F.col("prn") < x) & (F.col("first_batch") <= b), b).otherwise(when)
    ranks = seen.groupBy("item").agg(F.min("rank").alias("best_rank"))
    return picked.withColumn("selected_batch", when).join(ranks, "item", "left").select(F.col("item").alias("item_sha256"), "prn", "first_batch", "selected_batch", "best_rank")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample(spark.read.parquet(f"{d}/support_rows.parquet").select("item_sha256", "rank", "batch_no"))


P3_SQL = """
WITH seen AS (
  SELECT lower(regexp_replace(item_sha256, '\\s+', '', 'g')) AS item, coalesce(batch_no, 0) AS batch, rank FROM support_rows WHERE item_sha256 IS NOT NULL),
items AS (
  SELECT item, min(batch) AS first_batch, min(rank) AS best_rank, ('0x' || substr(sha256('quern-sample-1:' || item), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS prn
  FROM seen WHERE item <> '' GROUP BY item),
levels AS (SELECT DISTINCT batch AS b, least(0.20, 0.10 + 0.01 * greatest(0, batch - 1))::DOUBLE AS x FROM seen WHERE item <> '')
SELECT item AS item_sha256, prn, first_batch::INTEGER AS first_batch, min(b)::INTEGER AS selected_batch, best_rank::BIGINT AS best_rank
FROM items JOIN levels ON prn < x AND first_batch <= b GROUP BY item, prn, first_batch, best_rank
"""
