"""Prompt selection, nested supports and schedules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import curate, ranks, schedule
from quern.plans.base import Book, table

book = Book()
QUERIES, SQL = book.queries, book.sql


def population(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "kind", "n_chars")


@book.query("wn01_rank_bins", "SELECT doc_id, floor((row_number() OVER (ORDER BY n_chars, sha256('[42,\"rank-bin\",\"length\",' || doc_id || ']'), doc_id) - 1) * 4 / count(*) OVER ())::INTEGER AS bin FROM documents")
def rank_bins(spark, d):
    tie = X.stable_hash(42, "rank-bin", "length", F.col("doc_id").cast("string"))
    return ranks.rank_bins(population(spark, d), "n_chars", [tie, F.col("doc_id")], 4).select("doc_id", "bin")


@book.query("wn01_rank_bins_by_source", "SELECT doc_id, floor((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) * 3 / count(*) OVER (PARTITION BY source))::INTEGER AS bin FROM documents")
def rank_bins_by_source(spark, d):
    return ranks.rank_bins(population(spark, d), "n_chars", ["doc_id"], 3, by=("source",)).select("doc_id", "bin")


@book.query("wn02_step_bins", "SELECT bin, count(*)::BIGINT AS n FROM (SELECT least(4, (baseline_step - 1) * 5 // (SELECT max(baseline_step) FROM rollout_metadata))::INTEGER AS bin FROM rollout_metadata WHERE baseline_step IS NOT NULL) GROUP BY bin")
def step_bins(spark, d):
    r = table(spark, d, "rollout_metadata").filter("baseline_step IS NOT NULL").select("baseline_step")
    top = r.agg(F.max("baseline_step").alias("top"))
    b = r.crossJoin(F.broadcast(top)).select(F.least(F.lit(4), F.expr("(baseline_step - 1) * 5 div top")).cast("int").alias("bin"))  # one row
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@book.query("wn03_stratum_rank", "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('[42,\"stratum\",' || doc_id || ']'), doc_id) AS r FROM documents")
def stratum_rank(spark, d):
    h = population(spark, d).withColumn("h", X.stable_hash(42, "stratum", F.col("doc_id").cast("string")))
    return ranks.ranked(h, ["h", "doc_id"], "r", ("source", "lang")).select("doc_id", "r")


NESTED = "SELECT doc_id, row_number() OVER (ORDER BY sha256('[42,\"support-order\",' || doc_id || ']'), doc_id) AS r FROM documents"


def nested(spark, d):
    return ranks.ranked(population(spark, d).withColumn("h", X.stable_hash(42, "support-order", F.col("doc_id").cast("string"))), ["h", "doc_id"], "r").select("doc_id", "source", "n_chars", "r")


@book.query("wn04_support_prefix", f"SELECT m AS size, doc_id, r FROM ({NESTED}) JOIN (SELECT unnest([1, 8, 48, 384]) AS m) ON r <= m")
def support_prefix(spark, d):
    sizes = F.explode(F.filter(F.array(*map(F.lit, (1, 8, 48, 384))), lambda m: F.col("r") <= m))
    return nested(spark, d).select(sizes.alias("size"), "doc_id", "r")


@book.query("wn05_membership", f"SELECT doc_id, CASE WHEN r <= 1 THEN 1 WHEN r <= 8 THEN 8 WHEN r <= 48 THEN 48 ELSE 384 END AS least_size FROM ({NESTED}) WHERE r <= 384")
def membership(spark, d):
    least = F.array_min(F.filter(F.array(*map(F.lit, (1, 8, 48, 384))), lambda m: F.col("r") <= m))
    return nested(spark, d).filter("r <= 384").select("doc_id", least.alias("least_size"))


@book.query(
    "wn06_first_appearance",
    """SELECT schedule_id, item_sha256, first_position, n, row_number() OVER (PARTITION BY schedule_id ORDER BY first_position, item_sha256) AS rank
    FROM (SELECT schedule_id, item_sha256, min(position) AS first_position, count(*)::BIGINT AS n FROM order_rows WHERE item_sha256 IS NOT NULL AND position IS NOT NULL GROUP BY ALL)""",
)
def first_appearance(spark, d):
    g = table(spark, d, "order_rows").filter("item_sha256 IS NOT NULL AND position IS NOT NULL").groupBy("schedule_id", "item_sha256").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("n"))
    return ranks.ranked(g, ["first_position", "item_sha256"], "rank", ("schedule_id",))


@book.query("wn07_step_position", "SELECT schedule_id, count(*) FILTER (WHERE position // 64 = step)::BIGINT AS agree, count(*)::BIGINT AS n, sum(position % 64)::BIGINT AS within FROM order_rows WHERE position IS NOT NULL GROUP BY schedule_id")
def step_position(spark, d):
    o = table(spark, d, "order_rows").filter("position IS NOT NULL")
    agree = F.count(F.when(F.expr("position div 64") == F.col("step"), 1))
    return o.groupBy("schedule_id").agg(agree.alias("agree"), F.count(F.lit(1)).alias("n"), F.sum(F.col("position") % 64).alias("within"))


@book.query("wn08_average_ranks", "SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) - 1 + (count(*) OVER (PARTITION BY s_nationkey) - 1) / 2.0 AS r FROM supplier")
def average_ranks(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    groups = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    at = ranks.running_sum(groups, "n", ["s_nationkey"], "upto")
    return s.join(at, "s_nationkey").select("s_suppkey", (F.col("upto") - F.col("n") + (F.col("n") - 1) / 2.0).alias("r"))


@book.query(
    "wn09_blocks",
    "SELECT l_orderkey, l_linenumber, round(c - coalesce(lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0), 4) AS block FROM (SELECT l_orderkey, l_linenumber, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS c FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))",
)
def blocks(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber")  # an order has few lines
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    c = li.withColumn("c", F.sum("q").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return c.select("l_orderkey", "l_linenumber", F.round(F.col("c") - F.coalesce(F.lag("c").over(w), F.lit(0.0)), 4).alias("block"))


@book.query(
    "wn10_energy_thresholds",
    """WITH e AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY p_brand), c AS (SELECT v, sum(v) OVER (ORDER BY v DESC, p_brand) / (SELECT sum(v) FROM e) AS share FROM e)
    SELECT (count(*) FILTER (WHERE share < 0.5) + 1)::BIGINT AS k50, (count(*) FILTER (WHERE share < 0.9) + 1)::BIGINT AS k90 FROM c""",
)
def energy_thresholds(spark, d):
    e = table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    c = ranks.running_sum(e, "v", [F.desc("v"), F.col("p_brand")], "c")
    total = e.agg(F.sum("v").alias("t"))
    share = F.col("c") / F.col("t")
    return c.crossJoin(F.broadcast(total)).agg((F.count(F.when(share < 0.5, 1)) + 1).alias("k50"), (F.count(F.when(share < 0.9, 1)) + 1).alias("k90"))  # one row


@book.query("wn14_ordered_distinct", "SELECT schedule_id, item_sha256, row_number() OVER (PARTITION BY schedule_id ORDER BY p, item_sha256) - 1 AS at FROM (SELECT schedule_id, item_sha256, min(position) AS p FROM order_rows WHERE item_sha256 IS NOT NULL AND position IS NOT NULL GROUP BY ALL)")
def ordered_distinct(spark, d):
    o = table(spark, d, "order_rows").filter("item_sha256 IS NOT NULL AND position IS NOT NULL").groupBy("schedule_id", "item_sha256").agg(F.min("position").alias("p"))
    return ranks.ranked(o, ["p", "item_sha256"], "r", ("schedule_id",)).select("schedule_id", "item_sha256", (F.col("r") - 1).alias("at"))


SCHEDULE = f"""WITH s AS (SELECT doc_id FROM ({NESTED}) WHERE r <= {{m}}),
t AS (SELECT doc_id, {{t}} // {{m}} + CASE WHEN row_number() OVER (ORDER BY sha256('[42,"extra",' || doc_id || ']'), doc_id) <= {{t}} % {{m}} THEN 1 ELSE 0 END AS target FROM s),
p AS (SELECT doc_id, unnest(range(target)) AS round FROM t),
i AS (SELECT doc_id, round, (round * {{m}} + row_number() OVER (PARTITION BY round ORDER BY sha256('[42,"schedule",' || round || ',' || doc_id || ']'), doc_id) - 1)::BIGINT AS schedule_index FROM p)"""


def scheduled(spark, d, m, t, batch=64):
    support = nested(spark, d).filter(F.col("r") <= m).select("doc_id")
    targets = schedule.exposure_targets(support, "doc_id", t, X.stable_hash(42, "extra", F.col("doc_id").cast("string")))
    return schedule.balanced_schedule(targets, "doc_id", 42, "schedule", batch)


@book.query("or01_balanced_schedule", SCHEDULE.format(m=48, t=1000) + " SELECT doc_id, round, schedule_index, schedule_index // 64 AS step, schedule_index % 64 AS position FROM i")
def balanced_schedule(spark, d):
    return scheduled(spark, d, 48, 1000)


@book.query("or01a_schedule_one_round", SCHEDULE.format(m=64, t=64) + " SELECT doc_id, round, schedule_index FROM i")
def schedule_one_round(spark, d):
    return scheduled(spark, d, 64, 64).select("doc_id", "round", "schedule_index")


@book.query("or17_schedule_extension", SCHEDULE.format(m=48, t=480) + " SELECT schedule_index, doc_id, schedule_index < 240 AS was_there FROM i")
def schedule_extension(spark, d):
    """A longer schedule; was_there tells the places the shorter one filled with the same item."""
    short = scheduled(spark, d, 48, 240).select("schedule_index", F.col("doc_id").alias("before"))
    long = scheduled(spark, d, 48, 480).select("schedule_index", "doc_id")
    return long.join(short, "schedule_index", "left").select("schedule_index", "doc_id", F.coalesce(F.col("before") == F.col("doc_id"), F.lit(False)).alias("was_there"))


@book.query("or02_interleave")
def interleave(spark, d):
    h = X.stable_hash(42, "within", F.col("doc_id").cast("string"))
    return schedule.stratified_interleave(population(spark, d), "doc_id", "source", h, 384)


@book.query("or03_hash_permutation", NESTED.replace("doc_id, row_number()", "doc_id, row_number()"))
def hash_permutation(spark, d):
    return nested(spark, d).select("doc_id", "r")


@book.query(
    "or05_hard_ranking",
    "SELECT index, score, row_number() OVER (ORDER BY score, sha256('42:hard:' || index), index) AS rank FROM (SELECT index, round(avg(score), 6) AS score FROM rollout_metadata WHERE index IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY index)",
)
def hard_ranking(spark, d):
    r = table(spark, d, "rollout_metadata").filter("index IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").groupBy("index").agg(F.round(F.avg("score"), 6).alias("score"))
    h = F.sha2(F.concat(F.lit("42:hard:"), F.col("index").cast("string")), 256)
    return ranks.ranked(r.withColumn("h", h), ["score", "h", "index"], "rank").select("index", "score", "rank")


@book.query(
    "or05_shortest_ranking",
    "SELECT index, tokens, row_number() OVER (ORDER BY tokens, sha256('42:shortest:' || index), index) AS rank FROM (SELECT index, round(avg(response_token_count), 6) AS tokens FROM rollout_metadata WHERE index IS NOT NULL AND response_token_count IS NOT NULL GROUP BY index)",
)
def shortest_ranking(spark, d):
    r = table(spark, d, "rollout_metadata").filter("index IS NOT NULL AND response_token_count IS NOT NULL").groupBy("index").agg(F.round(F.avg("response_token_count"), 6).alias("tokens"))
    h = F.sha2(F.concat(F.lit("42:shortest:"), F.col("index").cast("string")), 256)
    return ranks.ranked(r.withColumn("h", h), ["tokens", "h", "index"], "rank").select("index", "tokens", "rank")


@book.query("or06_key_order", "SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) AS at FROM (SELECT doc_id, regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g') AS k FROM documents WHERE text IS NOT NULL)")
def key_order(spark, d):
    k = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.loose_key(F.col("text")).alias("k"))
    return ranks.ranked(k, ["k", "doc_id"], "at").select("doc_id", "at")


@book.query("or07_top_k", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars IS NOT NULL) WHERE r <= 4")
def top_k(spark, d):
    # The four largest of each task, then of each source: at most four rows a source and task are shuffled.
    p = population(spark, d).filter("n_chars IS NOT NULL").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = [F.desc("n_chars"), F.asc("doc_id")]
    part = p.withColumn("r", F.row_number().over(W.partitionBy("source", "cell").orderBy(*order))).filter("r <= 4")
    return part.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(*order))).filter("r <= 4").select("source", "doc_id", "n_chars")


@book.query("or08_numeric_keys", "SELECT source_index, row_number() OVER (ORDER BY CASE WHEN regexp_matches(source_index, '^[0-9]+$') THEN 0 ELSE 1 END, CASE WHEN regexp_matches(source_index, '^[0-9]+$') THEN source_index::BIGINT END, source_index) AS at FROM (SELECT DISTINCT source_index FROM order_rows WHERE source_index IS NOT NULL)")
def numeric_keys(spark, d):
    k = table(spark, d, "order_rows").filter("source_index IS NOT NULL").select("source_index").distinct()
    digits = F.when(F.col("source_index").rlike("^[0-9]+$"), 0).otherwise(1)
    return ranks.ranked(k, [digits, F.when(digits == 0, F.expr("try_cast(source_index AS bigint)")), F.col("source_index")], "at")


@book.query("or09_cost_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS at FROM part")
def cost_order(spark, d):
    return ranks.ranked(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], "at").select("p_partkey", "at")


@book.query("or11_hash_split", "SELECT cand_id, CASE WHEN substr(sha256('[3,\"dev\",' || cand_id || ']'), 1, 2) < '10' THEN 'dev' ELSE 'train' END AS split FROM sft_candidate")
def hash_split(spark, d):
    h = X.stable_hash(3, "dev", F.col("cand_id").cast("string"))
    return table(spark, d, "sft_candidate").select("cand_id", F.when(F.substring(h, 1, 2) < "10", "dev").otherwise("train").alias("split"))


@book.query("or12_hash_sample", "SELECT doc_id FROM documents ORDER BY sha256('[5,\"sample\",' || doc_id || ']'), doc_id LIMIT 100")
def hash_sample(spark, d):
    return population(spark, d).select("doc_id").orderBy(X.stable_hash(5, "sample", F.col("doc_id").cast("string")), "doc_id").limit(100)


@book.query(
    "or13_probe_selection",
    """WITH k AS (SELECT l_orderkey, l_linenumber, min(h) AS h FROM (SELECT l_orderkey, l_linenumber, sha256('[42,' || l_orderkey || ',' || l_linenumber || ']') AS h FROM lineitem) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY h, l_linenumber) AS rn FROM k) SELECT l_orderkey, l_linenumber FROM r ORDER BY (rn > 1)::INT, h LIMIT 128""",
)
def probe_selection(spark, d):
    h = X.stable_hash(42, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    k = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("h", h)
    r = k.withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey").orderBy("h", "l_linenumber")))  # an order has few lines
    return r.orderBy((F.col("rn") > 1).cast("int"), "h").limit(128).select("l_orderkey", "l_linenumber")


@book.query("or14_label_order", "SELECT p_brand, row_number() OVER (ORDER BY coalesce(list_position(['Brand#5', 'Brand#1', 'Brand#3'], p_brand), 99), p_brand) AS at FROM (SELECT DISTINCT p_brand FROM part)")
def label_order(spark, d):
    fixed = F.array(*map(F.lit, ("Brand#5", "Brand#1", "Brand#3")))
    at = F.nullif(F.array_position(fixed, F.col("p_brand")), F.lit(0))
    return ranks.ranked(table(spark, d, "part").select("p_brand").distinct(), [F.coalesce(at, F.lit(99)), F.col("p_brand")], "at")


@book.query(
    "or15_inner_folds",
    "SELECT l_orderkey, l_linenumber, CASE WHEN r <= n / 2 THEN 0 ELSE 1 END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY sha256('[9,' || l_orderkey || ',' || l_linenumber || ']')) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE n >= 4 AND n % 2 = 0",
)
def inner_folds(spark, d):
    h = X.stable_hash(9, F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    k = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("h", h)
    r = k.withColumn("r", F.row_number().over(W.partitionBy("l_orderkey").orderBy("h"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("l_orderkey")))
    return r.filter("n >= 4 AND n % 2 = 0").select("l_orderkey", "l_linenumber", F.when(F.col("r") <= F.col("n") / 2, 0).otherwise(1).alias("fold"))


@book.query(
    "or16_seed_grid",
    f"SELECT seed, doc_id FROM (SELECT seed, doc_id, row_number() OVER (PARTITION BY seed ORDER BY sha256('[' || seed || ',\"grid\",' || doc_id || ']'), doc_id) AS r FROM documents, (SELECT unnest([42, 43, 44]) AS seed)) WHERE r <= 16",
)
def seed_grid(spark, d):
    p = population(spark, d).select("doc_id", F.explode(F.array(*map(F.lit, (42, 43, 44)))).alias("seed"))
    h = F.sha2(F.concat(F.lit("["), F.col("seed").cast("string"), F.lit(',"grid",'), F.col("doc_id").cast("string"), F.lit("]")), 256)
    return ranks.ranked(p.withColumn("h", h), ["h", "doc_id"], "r", ("seed",)).filter("r <= 16").select("seed", "doc_id")


@book.query("kn03_apportion", "WITH s AS (SELECT coalesce(source, '?') AS source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, n * 384 / (SELECT sum(n) FROM s)::DOUBLE AS x FROM s), r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, sha256('[42,' || source || ']')) AS r FROM e) SELECT source, n, (floor(x) + CASE WHEN r <= 384 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END)::BIGINT AS quota FROM r")
def apportion(spark, d):
    s = population(spark, d).groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return schedule.apportion(s, "source", "n", 384, F.sha2(F.concat(F.lit("[42,"), F.col("source"), F.lit("]")), 256))


@book.query("kn04_farthest_first")
def farthest_first(spark, d):
    return schedule.farthest_first(table(spark, d, "embeddings"), "vec_id", "embedding", 16, "42:semantic")


@book.query("kn05_greedy_d_optimal")
def greedy_d_optimal(spark, d):
    return schedule.greedy_d_optimal(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@book.query("kn06_quartets", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c, e.n_nationkey AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_nationkey < c.n_nationkey JOIN nation e ON c.n_nationkey < e.n_nationkey WHERE a.n_regionkey <> b.n_regionkey AND c.n_regionkey <> e.n_regionkey")
def quartets(spark, d):
    n = table(spark, d, "nation")  # the sets of four of a small pool are the result itself
    if n.count() > 128:
        raise ValueError("sets of four are listed for pools of at most 128")
    k = {x: n.select(F.col("n_nationkey").alias(x), F.col("n_regionkey").alias("r" + x)) for x in "abcd"}
    out = k["a"].join(k["b"], (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))).join(k["c"], F.col("b") < F.col("c")).join(k["d"], (F.col("c") < F.col("d")) & (F.col("rc") != F.col("rd")))
    return out.select("a", "b", "c", "d")


@book.query(
    "kn07_support_gate",
    "SELECT source, CASE WHEN n >= 100 AND langs >= 3 THEN 'm48' WHEN n >= 20 THEN 'm8' ELSE 'none' END AS support FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source)",
)
def support_gate(spark, d):
    g = population(spark, d).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("n").alias("n"), F.count("lang").alias("langs"))
    return g.select("source", F.when((F.col("n") >= 100) & (F.col("langs") >= 3), "m48").when(F.col("n") >= 20, "m8").otherwise("none").alias("support"))


@book.query("kn09_anchor_split", "SELECT doc_id, CASE WHEN r <= n // 4 // 8 * 8 THEN 'anchor' ELSE 'rest' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('[1,\"anchor\",' || doc_id || ']'), doc_id) AS r, count(*) OVER () AS n FROM documents)")
def anchor_split(spark, d):
    h = population(spark, d).select("doc_id", X.stable_hash(1, "anchor", F.col("doc_id").cast("string")).alias("h"))
    return ranks.ranked(h, ["h", "doc_id"], "r", (), "n").select("doc_id", F.when(F.col("r") <= F.expr("n div 4 div 8 * 8"), "anchor").otherwise("rest").alias("part"))


@book.query(
    "ag19_numeric_balance",
    f"WITH s AS (SELECT doc_id, r FROM ({NESTED})) SELECT m AS size, round((avg(n_chars) - (SELECT avg(n_chars) FROM documents)) / (SELECT stddev_pop(n_chars) FROM documents), 6) AS smd FROM s JOIN documents USING (doc_id) JOIN (SELECT unnest([8, 48, 384]) AS m) ON r <= m GROUP BY m",
)
def numeric_balance(spark, d):
    n = nested(spark, d)
    pool = n.agg(F.avg("n_chars").alias("mu"), F.stddev_pop("n_chars").alias("sd"))
    rows = n.select("n_chars", F.explode(F.filter(F.array(*map(F.lit, (8, 48, 384))), lambda m: F.col("r") <= m)).alias("size"))
    out = rows.groupBy("size").agg(F.avg("n_chars").alias("x")).crossJoin(F.broadcast(pool))  # one row
    return out.select("size", F.round(F.when(F.col("sd") == 0, 0.0).otherwise((F.col("x") - F.col("mu")) / F.col("sd")), 6).alias("smd"))


@book.query(
    "ag20_categorical_balance",
    f"""WITH s AS (SELECT coalesce(source, '?') AS source, count(*) / least(384, (SELECT count(*) FROM documents))::DOUBLE AS p FROM ({NESTED}) JOIN documents USING (doc_id) WHERE r <= 384 GROUP BY 1), q AS (SELECT coalesce(source, '?') AS source, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS p FROM documents GROUP BY 1)
    SELECT source, round(coalesce(s.p, 0) - coalesce(q.p, 0), 6) AS diff FROM s FULL JOIN q USING (source)""",
)
def categorical_balance(spark, d):
    n = nested(spark, d).withColumn("source", F.coalesce("source", F.lit("?")))
    part = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("t")))).select("source", (F.col("n") / F.col("t")).alias(name))
    s, q = part(n.filter("r <= 384"), "p"), part(n, "q")
    return s.join(q, "source", "full_outer").select("source", F.round(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)), 6).alias("diff"))


@book.query("ag31_exposure_range", SCHEDULE.format(m=48, t=1000) + " SELECT min(n)::BIGINT AS least, max(n)::BIGINT AS most, sum(n)::BIGINT AS total FROM (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id)")
def exposure_range(spark, d):
    n = scheduled(spark, d, 48, 1000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))


# Set operations and contracts of supports.


@book.query("st01_nestedness", f"SELECT 'm8' AS small, 'm48' AS large, (SELECT count(*) FROM (SELECT doc_id FROM ({NESTED}) WHERE r <= 8 EXCEPT SELECT doc_id FROM ({NESTED}) WHERE r <= 48))::BIGINT AS outside")
def nestedness(spark, d):
    n = nested(spark, d)
    out = n.filter("r <= 8").select("doc_id").exceptAll(n.filter("r <= 48").select("doc_id"))
    return out.agg(F.count(F.lit(1)).alias("outside")).select(F.lit("m8").alias("small"), F.lit("m48").alias("large"), "outside")


@book.query("st02_set_equality", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders))::BIGINT AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem))::BIGINT AS only_right")
def set_equality(spark, d):
    a, b = table(spark, d, "lineitem").select("l_orderkey"), table(spark, d, "orders").select("o_orderkey")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a.subtract(b), "only_left").crossJoin(n(b.subtract(a), "only_right"))  # one row each


@book.query("st03_missing_ids", "SELECT DISTINCT item_sha256 FROM order_rows WHERE item_sha256 IS NOT NULL EXCEPT SELECT item_sha256 FROM support_rows")
def missing_ids(spark, d):
    return table(spark, d, "order_rows").filter("item_sha256 IS NOT NULL").select("item_sha256").subtract(table(spark, d, "support_rows").select("item_sha256"))


@book.query("st04_disjoint_splits", "SELECT count(*)::BIGINT AS shared FROM (SELECT problem FROM aime25 INTERSECT SELECT problem FROM hmmt25_feb)")
def disjoint_splits(spark, d):
    return table(spark, d, "aime25").select("problem").intersect(table(spark, d, "hmmt25_feb").select("problem")).agg(F.count(F.lit(1)).alias("shared"))


@book.query(
    "st05_jaccard",
    "WITH w AS (SELECT DISTINCT o_orderpriority AS p, o_custkey AS c FROM orders) SELECT a.p AS a, b.p AS b, round(count(*) FILTER (WHERE b.c = a.c) / ((SELECT count(*) FROM w WHERE p = a.p) + (SELECT count(*) FROM w WHERE p = b.p) - count(*) FILTER (WHERE b.c = a.c)), 6) AS j FROM w a JOIN w b ON a.c = b.c AND a.p < b.p GROUP BY a.p, b.p",
)
def jaccard_sets(spark, d):
    w = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_custkey").alias("c")).distinct()
    n = w.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    # A customer has few priorities, so its pairs are few.
    both = w.toDF("a", "c").join(w.toDF("b", "c"), "c").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    out = both.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return out.select("a", "b", F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("j"))


@book.query("st06_union", "SELECT t, count(*)::BIGINT AS n FROM (SELECT 'aime25' AS t, problem FROM aime25 UNION ALL SELECT 'hmmt25_feb', problem FROM hmmt25_feb UNION ALL SELECT 'heldout', problem FROM heldout_item) GROUP BY t")
def union(spark, d):
    one = lambda n, t: table(spark, d, n).select(F.lit(t).alias("t"), "problem")
    return one("aime25", "aime25").unionByName(one("hmmt25_feb", "hmmt25_feb")).unionByName(one("heldout_item", "heldout")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


@book.query("st07_category_union", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS left_n, coalesce(b.n, 0)::BIGINT AS right_n FROM (SELECT data_source AS k, count(*) AS n FROM order_rows WHERE data_source IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT source AS k, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) b ON a.k = b.k")
def category_union(spark, d):
    n = lambda t, c, name: table(spark, d, t).filter(f"{c} IS NOT NULL").groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias(name))
    return n("order_rows", "data_source", "left_n").join(n("documents", "source", "right_n"), "k", "full_outer").fillna(0)


@book.query("ck01_duplicate_keys", "SELECT schedule_id, position, count(*)::BIGINT AS n FROM order_rows GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "order_rows").groupBy("schedule_id", "position").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@book.query("ck02_cardinality", "SELECT 'aime25' AS t, count(*)::BIGINT AS n, count(*) = 360 AS ok FROM aime25 UNION ALL SELECT 'heldout_item', count(*), count(*) = 400 FROM heldout_item")
def cardinality(spark, d):
    one = lambda t, n: table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n", (F.col("n") == n).alias("ok"))
    return one("aime25", 360).unionByName(one("heldout_item", 400))


@book.query("ck04_balance", "SELECT schedule_id, max(n) - min(n) AS spread FROM (SELECT schedule_id, item_sha256, count(*)::BIGINT AS n FROM order_rows GROUP BY ALL) GROUP BY schedule_id")
def balance(spark, d):
    n = table(spark, d, "order_rows").groupBy("schedule_id", "item_sha256").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("schedule_id").agg((F.max("n") - F.min("n")).alias("spread"))


@book.query("ck05_step_balance", "SELECT schedule_id, step, max(n) AS most, count(*)::BIGINT AS items FROM (SELECT schedule_id, step, item_sha256, count(*)::BIGINT AS n FROM order_rows GROUP BY ALL) GROUP BY ALL")
def step_balance(spark, d):
    n = table(spark, d, "order_rows").groupBy("schedule_id", "step", "item_sha256").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("schedule_id", "step").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("items"))


@book.query(
    "ck06_prefix",
    f"SELECT count(*) FILTER (WHERE a.doc_id = b.doc_id)::BIGINT AS kept, count(*) FILTER (WHERE a.doc_id IS DISTINCT FROM b.doc_id)::BIGINT AS changed FROM ({SCHEDULE.format(m=48, t=240)} SELECT schedule_index, doc_id FROM i) a LEFT JOIN ({SCHEDULE.format(m=48, t=960)} SELECT schedule_index, doc_id FROM i) b USING (schedule_index)",
)
def prefix(spark, d):
    short, long = scheduled(spark, d, 48, 240).select("schedule_index", "doc_id"), scheduled(spark, d, 48, 960).select("schedule_index", F.col("doc_id").alias("other"))
    j = short.join(long, "schedule_index", "left")
    return j.agg(F.count(F.when(F.col("doc_id") == F.col("other"), 1)).alias("kept"), F.count(F.when(~F.col("doc_id").eqNullSafe(F.col("other")), 1)).alias("changed"))


@book.query(
    "ck08_rebuild",
    """WITH f AS (SELECT source, arg_min(lineage, cand_id) AS first FROM sft_candidate WHERE lineage IS NOT NULL AND source IS NOT NULL GROUP BY 1),
    r AS (SELECT c.source, sha256(array_to_string(list_sort(list_transform(map_entries(lineage), lambda e: e.key || '=' || coalesce(e.value, '?'))), '&')) AS h, lineage = first AS plain FROM sft_candidate c JOIN f USING (source) WHERE lineage IS NOT NULL)
    SELECT source, count(*)::BIGINT AS rows_in, count(h)::BIGINT AS verified, count(*) FILTER (WHERE plain)::BIGINT AS without_delta, min(h) AS least_hash FROM r GROUP BY 1""",
)
def rebuild(spark, d):
    """Rows kept as a delta against the first row of their source, rebuilt from both and compared with what they were by hash."""
    rows = table(spark, d, "sft_candidate").filter("lineage IS NOT NULL AND source IS NOT NULL").select("cand_id", "source", "lineage")
    first = rows.groupBy("source").agg(F.min_by("lineage", "cand_id").alias("first"))
    text = lambda m: F.sha2(F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("?"))))), "&"), 256)
    stored = rows.join(first, "source").select("source", text(F.col("lineage")).alias("h"), curate.map_delta(F.col("first"), F.col("lineage")).alias("delta"))
    back = stored.join(first, "source").withColumn("again", text(curate.apply_delta(F.col("first"), F.col("delta"))))
    n = lambda c: F.count(F.when(c, 1))
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("rows_in"), n(F.col("again") == F.col("h")).alias("verified"), n(F.size("delta") == 0).alias("without_delta"), F.min("again").alias("least_hash"))


@book.query("ck13_key_sets", "SELECT k FROM (SELECT DISTINCT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION ALL SELECT k FROM (SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def key_sets(spark, d):
    a, b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.subtract(b).unionByName(b.subtract(a))
