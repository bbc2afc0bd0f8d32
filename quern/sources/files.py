"""Readers and writers: JSON shapes, shards, step folders, gzip tables, frozen outputs, cached sources."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import scratch, shared_dir


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema. Blank lines are passed over; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents that are one JSON list, or an object with the list under data, rows or problems."""
    item = f"array<struct<{schema}>>"
    texts = spark.read.text(path, wholetext=True)
    t = F.col("value")
    wrapped = F.from_json(t, f"struct<data:{item},rows:{item},problems:{item}>")
    rows = F.when(F.startswith(F.ltrim(t), F.lit("[")), F.from_json(t, item)).otherwise(F.coalesce(wrapped["data"], wrapped["rows"], wrapped["problems"]))
    return texts.select(F.explode(rows).alias("r")).select("r.*")


def read_steps(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """A folder of {step}.jsonl files or folders (also as name={step}.jsonl), the step as a column."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(root)
    step = F.regexp_extract(F.col("_metadata.file_path"), r"[/=]([0-9]+)\.jsonl", 1).cast("int")
    return rows.select("*", step.alias("step"))


def write_frozen(df: DataFrame, path: str, name: str) -> DataFrame:
    """Write once: an existing path is refused. The manifest (rows, columns, a digest that doesn't depend on order)
    is written after the data and the marker last; returns the manifest."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    spark = df.sparkSession
    back = spark.read.parquet(f"{path}/data")
    digest = F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)")).cast("string")
    m = back.agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest")).select(F.lit(name).alias("name"), "rows", F.lit(",".join(back.columns)).alias("columns"), "digest")
    m.write.mode("errorifexists").json(f"{path}/manifest")
    spark.range(1).select(F.lit(True).alias("validated")).write.mode("errorifexists").json(f"{path}/VALIDATED")
    return spark.read.schema("name string, rows long, columns string, digest string").json(f"{path}/manifest")


def cached(spark: SparkSession, config: dict, build) -> tuple[DataFrame, bool]:
    """The table of a configuration, built once for each content of the configuration and reused after."""
    key = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:24]
    path = f"{shared_dir(spark)}/quern-cache/{key}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    hit = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if not hit:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), hit


def round_trip(df: DataFrame, kind: str, **options) -> DataFrame:
    """Write to a fresh folder in a format and read back with the same schema."""
    spark, at = df.sparkSession, scratch(df.sparkSession, kind)
    df.write.options(**options).format(kind).save(at)
    return spark.read.schema(df.schema).options(**options).format(kind).load(at)
