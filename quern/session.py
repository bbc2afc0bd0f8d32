"""Session helpers: the shared work folder, cut lineage, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a broadcast side may have in the helpers of this module.
BROADCAST_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the checkpoint folder set on its
    context. Only where neither is set and the master is local (tests on one machine) a temporary folder is made
    and remembered in the session; on a cluster that is an error, since executors can't share such a folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            at = "file://" + tempfile.mkdtemp(prefix="quern-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the part of this application, which clean() removes."""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def lasting(spark: SparkSession, name: str) -> str:
    """A fresh path for what outlives the application: clean() leaves it."""
    return f"{shared_dir(spark)}/quern/lasting/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts the lineage: a lost executor costs
    no recomputation, and the plan above starts from a scan with known size. discard() removes the table."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables nothing reads any more: every frame built on them has been written itself."""
    for t in tables:
        drop_path(t.sparkSession, t._written_at)


def clean(spark: SparkSession) -> None:
    """Remove everything this application wrote as intermediate tables. Frames that read them end with it."""
    drop_path(spark, f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, for marks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lookup_skewed(rows: DataFrame, table: DataFrame, on: list[str], count_col: str) -> DataFrame:
    """Inner join rows to table, which has one row for each key with the number of its rows in count_col.

    Keys with over a thousandth of all rows (so fewer than BROADCAST_ROWS keys, whatever the data) are
    joined by broadcast and never shuffled to one task; all others are joined by shuffle. Both parts
    together are the whole join: no key is dropped. NULL keys match nothing, as in any equi-join."""
    total = table.agg(F.sum(count_col)).first()[0] or 0
    least = max(10_000, total // BROADCAST_ROWS + 1)
    hot = table.filter(F.col(count_col) >= least)
    if total < least or not hot.take(1):
        return rows.join(table, on)
    mark = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    rest = rows.join(mark.drop("_hot"), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(table.filter(F.col(count_col) < least), on))
