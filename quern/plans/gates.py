"""Replay gates, cycles, hit rates, label tables and other operators that stand on their own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import geometry, replay, schedule, score
from quern.operators.ranks import ranked
from quern.plans.base import Book, table
from quern.session import scratch
from quern.sources.files import read_steps

book = Book()
QUERIES, SQL = book.queries, book.sql

#: One row for each step: RMS gap, share of clipped rows, effective sample size of exp(k1), kept within +-10.
STEPS = """s AS (SELECT baseline_step AS step, sqrt(avg(k1_mean * k1_mean)) AS gap, avg((abs(k1_mean) > 0.05)::INT) AS clipped, sum(w) * sum(w) / (sum(w * w) * count(*)) AS ess,
  avg(k1_mean) AS m, stddev_samp(k1_mean) / sqrt(count(*)) AS e, avg(k1_mean - 0.1 * score) AS dm, stddev_samp(k1_mean - 0.1 * score) / sqrt(count(*)) AS de,
  avg(greatest(-0.02, least(0.02, k1_mean)) - 0.1 * score) AS cm, stddev_samp(greatest(-0.02, least(0.02, k1_mean)) - 0.1 * score) / sqrt(count(*)) AS ce
  FROM (SELECT *, exp(greatest(-10, least(10, 20 * k1_mean))) AS w FROM rollout_metadata WHERE baseline_step IS NOT NULL AND NOT isnan(k1_mean) AND NOT isnan(score)) GROUP BY 1)"""


def steps(spark, d):
    r = table(spark, d, "rollout_metadata").filter("baseline_step IS NOT NULL AND NOT isnan(k1_mean) AND NOT isnan(score) AND k1_mean IS NOT NULL AND score IS NOT NULL")
    k, w = F.col("k1_mean"), F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), 20 * F.col("k1_mean"))))
    capped = F.greatest(F.lit(-0.02), F.least(F.lit(0.02), k)) - 0.1 * F.col("score")
    error = lambda c: F.stddev_samp(c) / F.sqrt(F.count(F.lit(1)))
    diff = k - 0.1 * F.col("score")
    return r.groupBy(F.col("baseline_step").alias("step")).agg(
        F.sqrt(F.avg(k * k)).alias("gap"), F.avg((F.abs(k) > 0.05).cast("int")).alias("clipped"), replay.ess(w).alias("ess"),
        F.avg(k).alias("m"), error(k).alias("e"), F.avg(diff).alias("dm"), error(diff).alias("de"), F.avg(capped).alias("cm"), error(capped).alias("ce"),
    )


@book.query(
    "sx03_continuation_gate",
    f"""WITH {STEPS}, f AS (SELECT arg_min(gap, step) AS first FROM s), r AS (SELECT step, CASE WHEN first > 0 THEN gap / first ELSE 1 END AS ratio, clipped, ess FROM s, f)
    SELECT step, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.98 THEN 'learn_gap_exhausted' WHEN clipped > 0.5 THEN 'off_policy_clipping' WHEN ess < 0.5 THEN 'off_policy_ess' ELSE 'continue' END AS reason FROM r""",
)
def continuation_gate(spark, d):
    s = steps(spark, d)
    first = s.agg(F.min_by("gap", "step").alias("first"))
    gate = replay.continuation_gate(F.col("gap"), F.col("first"), F.col("clipped"), F.col("ess"), 0.98, 0.5, 0.5)
    return s.crossJoin(F.broadcast(first)).select("step", gate.alias("g")).select("step", F.round("g.ratio", 6).alias("ratio"), "g.reason")  # one row


@book.query(
    "sx04_progress_gate",
    f"""WITH {STEPS}, b AS (SELECT step, m - 1.0 * e AS p, dm - 1.0 * de AS c, cm - 1.0 * ce AS k, ess, clipped FROM s)
    SELECT step, round(p, 9) AS progress, round(c, 9) AS contrast, round(k, 9) AS capped, (coalesce(p > 0, false)::INT + coalesce(c > 0, false)::INT + coalesce(k > 0, false)::INT + (ess >= 0.5)::INT + (clipped <= 0.5)::INT + (ess >= 0.6)::INT)::INTEGER AS passed,
    CASE WHEN NOT coalesce(p > 0, false) THEN 'no_absolute_progress' WHEN NOT coalesce(c > 0, false) THEN 'fresh_is_cheaper' WHEN NOT coalesce(k > 0, false) THEN 'importance_weight_tails' WHEN ess < 0.5 THEN 'anchor_ess_collapsed' WHEN clipped > 0.5 THEN 'off_policy_clipping' WHEN ess < 0.6 THEN 'off_policy_ess' ELSE 'continue' END AS reason FROM b""",
)
def progress_gate(spark, d):
    c = F.col
    # The actor's floor is the anchor's; its share is given less a tenth, so that the two conditions differ.
    gate = replay.progress_gate((c("m"), c("e")), (c("dm"), c("de")), (c("cm"), c("ce")), 1.0, c("ess"), c("clipped"), c("ess") - 0.1, 0.5, 0.5)
    g = steps(spark, d).select("step", gate.alias("g"))
    return g.select("step", F.round("g.progress_bound", 9).alias("progress"), F.round("g.contrast_bound", 9).alias("contrast"), F.round("g.capped_bound", 9).alias("capped"), "g.passed", "g.reason")


@book.query(
    "sx06_cycle_driver",
    """WITH l AS (SELECT l_orderkey AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS draw, l_quantity AS cost, l_discount >= 0.09 AS stop FROM lineitem),
    s AS (SELECT *, max(cost) FILTER (WHERE draw = 0) OVER (PARTITION BY batch) AS fresh, sum(CASE WHEN draw > 0 THEN cost ELSE 0 END) OVER (PARTITION BY batch ORDER BY draw ROWS UNBOUNDED PRECEDING) AS spent,
      coalesce(max(stop::INT) OVER (PARTITION BY batch ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS halted FROM l)
    SELECT batch, draw::BIGINT AS draw, spent, (draw = 0 OR spent <= 1.5 * fresh AND draw <= 3 AND halted = 0) AS runs FROM s""",
)
def cycle_driver(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # an order has few lines
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), (F.row_number().over(order) - 1).cast("long").alias("draw"), F.col("l_quantity").alias("cost"), (F.col("l_discount") >= 0.09).alias("stop"))
    return replay.cycle_draws(l, "batch", "draw", "cost", 1.5, 3, "stop").select("batch", "draw", "spent", "runs")


@book.query(
    "ag08_pass_at_k",
    "SELECT step, round(avg(h), 9) AS hit_at_k, count(*)::BIGINT AS problems, min(k)::BIGINT AS least_k, max(k)::BIGINT AS most_k FROM (SELECT baseline_step AS step, index, max((score > 0.5 AND NOT isnan(score))::INT) AS h, count(*) AS k FROM (SELECT * REPLACE (coalesce(score, 0) AS score) FROM rollout_metadata) WHERE index IS NOT NULL GROUP BY ALL) GROUP BY step",
)
def pass_at_k(spark, d):
    r = table(spark, d, "rollout_metadata").filter("index IS NOT NULL").withColumn("step", F.col("baseline_step"))
    out = score.pass_at_k(r, "index", (F.col("score") > 0.5) & ~F.isnan("score"), ["step"])
    return out.select("step", F.round("hit_at_k", 9).alias("hit_at_k"), "problems", "least_k", "most_k")


@book.query(
    "wn12_top_quartile",
    "SELECT g, count(*) FILTER (WHERE r <= greatest(1, n // 4))::BIGINT AS rows, round(sum(x) FILTER (WHERE r <= greatest(1, n // 4)) / sum(x), 6) AS share FROM (SELECT c_mktsegment AS g, c_acctbal AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WHERE c_acctbal > 0) GROUP BY g",
)
def top_quartile(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), "c_acctbal", "c_custkey")
    return score.top_share(c, "c_acctbal", "c_custkey", 0.25, ("g",)).select("g", "rows", F.round("share", 6).alias("share"))


@book.query(
    "jn13_nearest_selected",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, row_number() OVER (ORDER BY sha256('[42,"semantic",' || vec_id || ']'), vec_id) AS o FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS other, b.o, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS d FROM v a JOIN v b ON b.o <= 24 AND a.vec_id <> b.vec_id AND (a.o > 24 OR b.o < a.o))
    SELECT v.vec_id, round(min(d), 6) AS distance FROM v LEFT JOIN p USING (vec_id) GROUP BY v.vec_id""",
)
def nearest_selected(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    h = e.withColumn("h", X.stable_hash(42, "semantic", F.col("vec_id").cast("string")))
    first = h.orderBy("h", "vec_id").limit(24).select("vec_id", "embedding", "h")  # the selection, in its order
    return schedule.nearest_selected(e, first, "vec_id", "embedding", "h").select("vec_id", F.round("distance", 6).alias("distance"))


@book.query(
    "jn16_label_table",
    """WITH w AS (SELECT coalesce(source, '?') AS label, max(x) FILTER (WHERE style = 'function') AS function, max(x) FILTER (WHERE style = 'competitive') AS competitive, max(x) FILTER (WHERE style = 'unknown') AS unknown
      FROM (SELECT source, style, round(avg(rendered.n_tokens), 4) AS x FROM sft_candidate GROUP BY ALL) GROUP BY 1),
    f AS (SELECT label FROM w ORDER BY label DESC LIMIT 1)
    SELECT label, function, competitive, unknown, row_number() OVER (ORDER BY (label <> '?')::INT, label) AS place FROM w""",
)
def label_table(spark, d):
    s = table(spark, d, "sft_candidate").groupBy(F.coalesce("source", F.lit("?")).alias("label"), "style").agg(F.round(F.avg("rendered.n_tokens"), 4).alias("x"))
    return score.label_table(s, "label", "style", "x", ["function", "competitive", "unknown"], ["?"]).select("label", "function", "competitive", "unknown", "place")


@book.query("or02a_interleave_largest_hash")
def interleave_largest(spark, d):
    h = X.stable_hash(42, "within", F.col("doc_id").cast("string"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    small = schedule.stratified_interleave(docs, "doc_id", "source", h, 96, 42).withColumnRenamed("rank", "smallest")
    large = schedule.stratified_interleave(docs, "doc_id", "source", h, 96, 42, True).withColumnRenamed("rank", "largest")
    return small.select("doc_id", "smallest").join(large.select("doc_id", "largest"), "doc_id", "full_outer")


@book.query(
    "sk07_step_records",
    """SELECT baseline_step AS step, count(*)::BIGINT AS responses, sum(response_token_count)::BIGINT AS tokens, count(*) FILTER (WHERE response_truncated)::BIGINT AS truncated, round(avg(k) , 9) AS k1_mean, round(sqrt(avg(k * k)), 9) AS k1_rms, round(avg((abs(k) > 0.05)::INT), 9) AS clipped
    FROM (SELECT *, CASE WHEN isnan(k1_mean) THEN NULL ELSE k1_mean END AS k FROM rollout_metadata) WHERE baseline_step IS NOT NULL GROUP BY 1""",
)
def step_records(spark, d):
    """A record for each step, emitted as one JSON file a step and read back as a folder of steps."""
    r = table(spark, d, "rollout_metadata").filter("baseline_step IS NOT NULL").withColumn("k", F.when(~F.isnan("k1_mean"), F.col("k1_mean")))
    records = r.groupBy(F.col("baseline_step").alias("step")).agg(
        F.count(F.lit(1)).alias("responses"), F.sum("response_token_count").alias("tokens"), F.count(F.when(F.col("response_truncated"), 1)).alias("truncated"),
        F.avg("k").alias("m"), F.sqrt(F.avg(F.col("k") * F.col("k"))).alias("rms"), F.avg((F.abs("k") > 0.05).cast("int")).alias("clip"),
    )
    at = scratch(spark, "step-records")
    records.withColumn("file", F.concat(F.col("step").cast("string"), F.lit(".jsonl"))).write.partitionBy("file").json(at)
    back = read_steps(spark, at, "responses long, tokens long, truncated long, m double, rms double, clip double")
    return back.select("step", "responses", "tokens", "truncated", F.round("m", 9).alias("k1_mean"), F.round("rms", 9).alias("k1_rms"), F.round("clip", 9).alias("clipped"))


@book.query(
    "af06_prefix_of_any_rank",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS bare, round(2 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS seeds, round(list_sum(list_transform(list_slice(embedding, 1, 8), lambda x: x::DOUBLE)), 5) AS prefixes FROM embeddings",
)
def prefix_of_any_rank(spark, d):
    """Sketches of three layouts brought to one (seeds of vectors), and summed."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda c: F.round(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x), 5)
    bare = geometry.select_prefix(e, "v").select("vec_id", total("v").alias("bare"))
    seeds = geometry.select_prefix(e.withColumn("v", F.array("v", "v")), "v").select("vec_id", total("v").alias("seeds"))
    by_prefix = e.withColumn("v", F.array(F.array("v"), F.array(F.slice("v", 1, 8))))
    prefixes = geometry.select_prefix(by_prefix, "v", "head", ("full", "head")).select("vec_id", total("v").alias("prefixes"))
    return bare.join(seeds, "vec_id").join(prefixes, "vec_id")


@book.query(
    "sc16_rectangular_cohort",
    """WITH g AS (SELECT label, vec_id % 4 AS member, count(*) AS n, min(len(embedding)) AS lo, max(len(embedding)) AS hi FROM embeddings GROUP BY ALL),
    s AS (SELECT label, count(*) AS members, min(lo) AS lo, max(hi) AS dimension, max(n) AS n FROM g GROUP BY 1)
    SELECT label, members::BIGINT AS members, dimension::INTEGER AS dimension, (members = max(members) OVER () AND lo = max(dimension) OVER () AND n = 1) AS rectangular FROM s""",
)
def rectangular_cohort(spark, d):
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 4).alias("member"), "embedding")
    return geometry.rectangular(e, "label", "member", "embedding")


@book.query(
    "sk06_scatter",
    """WITH m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
    p AS (SELECT a.label AS a, b.label AS b, a.pos % 2 AS part, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS c FROM m a JOIN m b USING (pos) WHERE a.label < b.label GROUP BY ALL)
    SELECT a || '-' || b AS point_id, round(max(c) FILTER (WHERE part = 0), 6) AS x, round(max(c) FILTER (WHERE part = 1), 6) AS y, round(max(c) FILTER (WHERE part = 1) - max(c) FILTER (WHERE part = 0), 6) AS gap FROM p GROUP BY a, b""",
)
def scatter(spark, d):
    """The table behind a scatter plot: for each pair of labels two cosines and their gap, through a CSV file with a header."""
    from quern.sources.files import round_trip

    m = geometry.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").withColumn("part", F.col("pos") % 2)
    g = geometry.gram(m, "label", domain="part").filter("part IS NOT NULL")
    c = geometry.cosines(g, ["part"]).filter("a < b").groupBy("a", "b").pivot("part", [0, 1]).agg(F.max("cosine"))
    x, y = F.col("0"), F.col("1")
    rows = c.select(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("point_id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(y - x, 6).alias("gap"))
    return round_trip(rows, "csv", header="true")


def _labels(spark, d, half):
    """Label means of half the vectors, a matrix that is checked to be small."""
    m = geometry.mean_vectors(table(spark, d, "embeddings").filter(f"vec_id % 2 = {half}"), "label", "embedding")
    return geometry.small_matrix(m, "label")[1]


@book.query("an10_separation_bounds")
def separation_bounds(spark, d):
    """Bounds of how much more alike labels 4 to 7 are than 0 to 3, when their first eight vectors, two halves of four, are drawn anew."""
    e = table(spark, d, "embeddings").filter("label < 8").select("label", "vec_id", "embedding")
    rows = ranked(e, ["vec_id"], "r", ("label",)).filter("r <= 8").orderBy("label", "r").select("embedding").collect()  # 64 vectors
    if len(rows) < 64:
        return spark.createDataFrame([], "low double, mean double, high double")
    v = np.array([r.embedding for r in rows], float)
    return spark.createDataFrame([geometry.quartet_gap(v @ v.T, [0, 1, 2, 3], [4, 5, 6, 7], 4, 2_000, 42)], "low double, mean double, high double")


@book.query("an20_rank_geometry")
def rank_geometry(spark, d):
    a, b = _labels(spark, d, 0), _labels(spark, d, 1)
    n = min(len(a), len(b))
    a, b = (x[:n] - x[:n].mean(0) for x in (a, b))
    return spark.createDataFrame(geometry.subspace_overlaps(a, b, [1, 2, 4, 8]), "rank int, overlap double, least_cosine double")


@book.query("an22_frozen_audit")
def frozen_audit(spark, d):
    """Four labels chosen by greedy D-optimality on one half of the vectors, looked at on the other."""
    a, b = _labels(spark, d, 0), _labels(spark, d, 1)
    n = min(len(a), len(b))
    inv, chosen = np.eye(a.shape[1]), []
    for _ in range(min(4, n)):
        gain = np.round(np.einsum("ij,jk,ik->i", a[:n], inv, a[:n]), 9)
        gain[chosen] = -1
        chosen.append(int(np.argmax(gain)))
        z = inv @ a[chosen[-1]]
        inv -= np.outer(z, z) / (1 + a[chosen[-1]] @ z)
    r = geometry.frozen_audit(a[:n], b[:n], chosen, 500, 42)
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} double" for k in r))
