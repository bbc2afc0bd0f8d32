"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.ranks import ranked
from quern.plans.base import Book, table
from quern.session import scratch
from quern.sources import files

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("sc01_projected_scan", "SELECT doc_id, source, n_chars FROM documents")
def projected_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "n_chars")


@book.query("sc02_filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def filtered_scan(spark, d):
    return table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity")


@book.query("sc03_whole_scan", "SELECT * FROM mix_target")
def whole_scan(spark, d):
    return table(spark, d, "mix_target")


@book.query("sc05_jsonl", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def jsonl(spark, d):
    at = scratch(spark, "jsonl")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(at)
    return files.read_jsonl(spark, at, "c_custkey long, c_name string, c_acctbal double")


@book.query("sc06_polymorphic_json", "SELECT n_nationkey, n_name FROM nation")
def polymorphic_json(spark, d):
    rows = table(spark, d, "nation").withColumn("part", F.col("n_nationkey") % 3)
    lists = rows.groupBy("part").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("l"))  # 25 rows
    text = F.when(F.col("part") == 0, F.to_json("l")).when(F.col("part") == 1, F.to_json(F.struct(F.col("l").alias("data")))).otherwise(F.to_json(F.struct(F.col("l").alias("problems"))))
    at = scratch(spark, "records")
    lists.select(text.alias("value"), "part").write.partitionBy("part").text(at)
    return files.read_records(spark, f"{at}/part=*", "n_nationkey:int,n_name:string")


@book.query("sc07_shard_union", "SELECT o_orderkey % 4 AS shard, count(*)::BIGINT AS rows_in, count(DISTINCT o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def shard_union(spark, d):
    at = scratch(spark, "shards")
    table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("shard")).write.partitionBy("shard").json(at)
    back = spark.read.schema("o_orderkey long, shard long").json(at)
    keys = back.groupBy("shard", "o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("shard").agg(F.sum("n").alias("rows_in"), F.count(F.lit(1)).alias("keys"))


@book.query("sc08_step_folders", "SELECT baseline_step AS step, count(*)::BIGINT AS rows_in, count(DISTINCT index)::BIGINT AS prompts FROM rollout_metadata WHERE baseline_step IS NOT NULL GROUP BY 1")
def step_folders(spark, d):
    at = scratch(spark, "steps")
    r = table(spark, d, "rollout_metadata").filter("baseline_step IS NOT NULL").select("index", "baseline_step")
    r.withColumn("f", F.concat(F.col("baseline_step").cast("string"), F.lit(".jsonl"))).drop("baseline_step").write.partitionBy("f").json(at)
    k = files.read_steps(spark, at, "index long").groupBy("step", "index").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("step").agg(F.sum("n").alias("rows_in"), F.count("index").alias("prompts"))


@book.query("sc09_samples", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS sample, l_quantity FROM lineitem")
def samples(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("samples"))
    return nested.select("l_orderkey", F.posexplode("samples").alias("sample", "s")).select("l_orderkey", F.col("sample").cast("long").alias("sample"), "s.l_quantity")


@book.query("sc13_content_cache", "SELECT p_brand, count(*)::BIGINT AS n FROM part GROUP BY 1")
def content_cache(spark, d):
    build = lambda: table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    config = {"source": d, "table": "part", "by": "p_brand", "at": spark.sparkContext.applicationId}
    files.cached(spark, config, build)
    return files.cached(spark, config, build)[0]


@book.query("sc14_gzip_csv", "SELECT schedule_id, position, step, item_sha256 FROM order_rows")
def gzip_csv(spark, d):
    o = table(spark, d, "order_rows").select("schedule_id", "position", "step", "item_sha256")
    return files.round_trip(o, "csv", header="true", compression="gzip", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


@book.query("sc15_offsets", "SELECT l_orderkey, count(*)::BIGINT AS n, bool_and(l_partkey >= p) AS monotone, bool_and(isfinite(l_quantity)) AS finite FROM (SELECT *, lag(l_partkey, 1, l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem) GROUP BY 1")
def offsets(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("o"), F.bool_and(~F.isnan("l_quantity") & (F.abs("l_quantity") != float("inf"))).alias("finite"))
    steps = F.zip_with(F.slice("o", 1, F.size("o") - 1), F.slice("o", 2, F.size("o") - 1), lambda x, y: x <= y)
    return a.select("l_orderkey", F.size("o").cast("long").alias("n"), F.forall(steps, lambda x: x).alias("monotone"), "finite")


@book.query("sc16_sketch_layout", "SELECT label, count(*)::BIGINT AS vectors, min(len(embedding))::BIGINT AS least, max(len(embedding))::BIGINT AS most FROM embeddings GROUP BY 1")
def sketch_layout(spark, d):
    n = F.size("embedding").cast("long")
    return table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.min(n).alias("least"), F.max(n).alias("most"))


@book.query("sc17_tensor_chunks", "SELECT vec_id, c AS chunk, round(list_sum(list_transform(list_slice(embedding, c * 16 + 1, c * 16 + 16), lambda x: x::DOUBLE)), 5) AS total FROM embeddings, (SELECT unnest(range(4)) AS c)")
def tensor_chunks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("chunk"))
    part = F.slice("embedding", (F.col("chunk") * 16 + 1).cast("int"), 16)
    return e.select("vec_id", "chunk", F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@book.query("sc18_task_loader", "SELECT 'aime25' AS t, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS ids FROM aime25 UNION ALL SELECT 'hmmt25_feb', count(*), count(DISTINCT id) FROM hmmt25_feb UNION ALL SELECT 'heldout_item', count(*), count(DISTINCT item_id) FROM heldout_item")
def task_loader(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.lit(t).alias("t"), F.col(c).cast("string").alias("id"))
    rows = one("aime25", "id").unionByName(one("hmmt25_feb", "id")).unionByName(one("heldout_item", "item_id"))
    k = rows.groupBy("t", "id").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("t").agg(F.sum("n").alias("n"), F.count("id").alias("ids"))


@book.query("sc19_round_robin", "SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 8 AS shard FROM heldout_item")
def round_robin(spark, d):
    return ranked(table(spark, d, "heldout_item").select("item_id"), ["item_id"], "r").select("item_id", ((F.col("r") - 1) % 8).alias("shard"))


@book.query("sk01_parquet", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def parquet(spark, d):
    return files.round_trip(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "parquet", compression="snappy")


@book.query("sk02_partitioned", "SELECT split, count(*)::BIGINT AS n FROM (SELECT CASE WHEN cand_id % 20 = 0 THEN 'val' ELSE 'train' END AS split FROM sft_candidate) GROUP BY 1")
def partitioned(spark, d):
    at = scratch(spark, "splits")
    c = table(spark, d, "sft_candidate").select("cand_id", "source", F.when(F.col("cand_id") % 20 == 0, "val").otherwise("train").alias("split"))
    c.write.partitionBy("split").option("compression", "zstd").parquet(at)
    return spark.read.parquet(at).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@book.query("sk03_json", "SELECT r_regionkey, r_name FROM region")
def json_sink(spark, d):
    return files.round_trip(table(spark, d, "region").select("r_regionkey", "r_name"), "json")


@book.query("sk04_freeze", "SELECT 'part' AS name, count(*)::BIGINT AS rows, 'p_partkey,p_brand,p_size' AS columns FROM part")
def freeze(spark, d):
    m = files.write_frozen(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), scratch(spark, "frozen"), "part")
    return m.select("name", "rows", "columns")


@book.query("sk06_orc", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def orc(spark, d):
    return files.round_trip(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "orc")
