"""Analysis of models as vectors and distributions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import geometry as G
from quern.operators import ranks
from quern.plans.base import Book, table

book = Book()
QUERIES, SQL = book.queries, book.sql

MEANS = "SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL"
GRAM = f"WITH m AS ({MEANS}), g AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM m a JOIN m b ON a.pos = b.pos AND a.label <= b.label GROUP BY ALL)"


def means(spark, d):
    return G.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")


@book.query("ag21_prompt_aggregates", "SELECT label, pos, round(sum(w * x) / sum(w), 6) AS m, sum(w)::DOUBLE AS mass FROM (SELECT label, 1 + vec_id % 7 AS w, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def prompt_aggregates(spark, d):
    m = G.mean_vectors(table(spark, d, "embeddings"), "label", "embedding", 1 + F.col("vec_id") % 7)
    return m.select("label", "pos", F.round("m", 6).alias("m"), "mass")


@book.query("ag22_support_error", f"WITH p AS (SELECT pos, avg(x) AS c FROM (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos), m AS ({MEANS}) SELECT label, round(sqrt(sum((m - c) * (m - c)) / sum(c * c)), 6) AS error, round(sum(m * c) / sqrt(sum(m * m) * sum(c * c)), 6) AS cosine FROM m JOIN p USING (pos) GROUP BY label")
def support_error(spark, d):
    pool = G.long_form(table(spark, d, "embeddings"), [], "embedding").groupBy("pos").agg(F.avg("x").alias("c"))
    j = means(spark, d).join(pool, "pos")
    m, c = F.col("m"), F.col("c")
    return j.groupBy("label").agg(F.round(F.sqrt(F.sum((m - c) * (m - c)) / F.sum(c * c)), 6).alias("error"), F.round(F.sum(m * c) / F.sqrt(F.sum(m * m) * F.sum(c * c)), 6).alias("cosine"))


@book.query("ag23_tensor_dots", "SELECT l_shipmode, round(sum(a * b), 4) AS ab, round(sum(a * a), 4) AS aa, round(sum(b * b), 4) AS bb FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_discount AS a, l_tax AS b FROM lineitem) GROUP BY ROLLUP (l_shipmode)")
def tensor_dots(spark, d):
    li = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    s = lambda x, y: F.round(F.sum(F.col(x) * F.col(y)), 4).alias(x + y)
    return li.rollup("l_shipmode").agg(s("a", "b"), s("a", "a"), s("b", "b"))


@book.query("ag25_pair_geometry", GRAM + ", n AS (SELECT a AS l, sqrt(dot) AS norm FROM g WHERE a = b) SELECT g.a, g.b, round(dot, 6) AS dot, round(dot / (x.norm * y.norm), 6) AS cosine, round(dot / (x.norm * x.norm), 6) AS scale FROM g JOIN n x ON x.l = g.a JOIN n y ON y.l = g.b WHERE g.a < g.b")
def pair_geometry(spark, d):
    c = G.cosines(G.gram(means(spark, d), "label")).filter("a < b")
    return c.select("a", "b", *(F.round(x, 6).alias(x) for x in ("dot", "cosine", "scale")))


DOMAINS = "SELECT label, vec_id % 3 AS dom, pos, avg(x) AS m FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL"


@book.query("ag26_domain_gram", f"WITH m AS ({DOMAINS}) SELECT dom, a.label AS a, b.label AS b, round(sum(a.m * b.m), 6) AS dot FROM m a JOIN m b USING (pos, dom) WHERE a.label <= b.label GROUP BY GROUPING SETS ((dom, a.label, b.label), (a.label, b.label))")
def domain_gram(spark, d):
    e = table(spark, d, "embeddings").withColumn("dom", F.col("vec_id") % 3)
    m = G.long_form(e, ["label", "dom"], "embedding").groupBy("label", "dom", "pos").agg(F.avg("x").alias("m"))
    return G.gram(m, "label", domain="dom").select("dom", "a", "b", F.round("dot", 6).alias("dot"))


@book.query("ag27_influence_summary", "SELECT o_orderpriority AS p, round(avg(x), 6) AS mean, count(*) FILTER (WHERE x > 0)::BIGINT AS improved, count(*) FILTER (WHERE x < 0)::BIGINT AS worsened, round(avg((x >= 0.1)::INT), 6) AS breadth10, round(min(x), 6) AS worst, round(max(x), 6) AS best FROM (SELECT o_orderpriority, (o_totalprice - 150000) / 150000 AS x FROM orders) GROUP BY 1")
def influence_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), ((F.col("o_totalprice") - 150000) / 150000).alias("x"))
    x = F.col("x")
    return o.groupBy("p").agg(F.round(F.avg(x), 6).alias("mean"), F.count(F.when(x > 0, 1)).alias("improved"), F.count(F.when(x < 0, 1)).alias("worsened"), F.round(F.avg((x >= 0.1).cast("int")), 6).alias("breadth10"), F.round(F.min(x), 6).alias("worst"), F.round(F.max(x), 6).alias("best"))


@book.query(
    "ag29_variance_components",
    """WITH p AS (SELECT l_suppkey, count(*) AS n, sum(l_discount) AS s, sum(l_discount * l_discount) AS q FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, sum(n * n) AS nn FROM p)
    SELECT round(s * s / n, 6) AS common, round(b - s * s / n, 6) AS between, round(q - b, 6) AS within, round(((b - s * s / n) / (k - 1) - (q - b) / (n - k)) / ((n - nn / n) / (k - 1)), 9) AS component FROM t""",
)
def variance_components(spark, d):
    v = G.variance_components(table(spark, d, "lineitem"), "l_suppkey", "l_discount")
    return v.select(*(F.round(c, 9 if c == "component" else 6).alias(c) for c in v.columns))


@book.query("ag34_energy_share", "SELECT g, round(e / sum(e) OVER (), 6) AS share FROM (SELECT l_returnflag || l_linestatus AS g, sum(l_discount * l_discount) AS e FROM lineitem GROUP BY 1)")
def energy_share(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("g")).agg(F.sum(F.col("l_discount") * F.col("l_discount")).alias("e"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("e").alias("t")))).select("g", F.round(F.col("e") / F.col("t"), 6).alias("share"))  # one row


@book.query("ag35_carrier_scores", "WITH p AS (SELECT pos, avg(x) AS c FROM (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos), v AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sum(x * c) / sqrt(sum(x * x) * sum(c * c)), 6) AS score FROM v JOIN p USING (pos) GROUP BY vec_id")
def carrier_scores(spark, d):
    e = table(spark, d, "embeddings")
    pool = G.long_form(e, [], "embedding").groupBy("pos").agg(F.avg("x").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]).alias("c"))
    j = e.crossJoin(F.broadcast(pool))  # one row: a vector of the dimension
    x, c = F.col("embedding"), F.col("c")
    return j.select("vec_id", F.round(G.dot(x, c) / F.sqrt(G.dot(x, x) * G.dot(c, c)), 6).alias("score"))


@book.query("ag36_token_weighted", "SELECT vec_id, round(sum(x * w / mw), 6) AS total FROM (SELECT vec_id, 1 + vec_id % 5 AS w, unnest(embedding)::DOUBLE AS x FROM embeddings), (SELECT avg(1 + vec_id % 5) AS mw FROM embeddings) GROUP BY vec_id")
def token_weighted(spark, d):
    e = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    mw = e.agg(F.avg("w").alias("mw"))
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * F.col("w") / F.col("mw")), F.lit(0.0), lambda a, x: a + x)
    return e.crossJoin(F.broadcast(mw)).select("vec_id", F.round(total, 6).alias("total"))  # one row


@book.query("ag37_residual_rows", f"WITH m AS ({MEANS}), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), p AS (SELECT pos, sum(m * n) / sum(n) AS c FROM m JOIN n USING (label) GROUP BY pos) SELECT label, round(sqrt(sum(n * (m - c) * (m - c))), 6) AS norm FROM m JOIN n USING (label) JOIN p USING (pos) GROUP BY label")
def residual_rows(spark, d):
    m = means(spark, d)
    pool = m.groupBy("pos").agg((F.sum(F.col("m") * F.col("mass")) / F.sum("mass")).alias("c"))
    r = F.col("m") - F.col("c")
    return m.join(pool, "pos").groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("mass") * r * r)), 6).alias("norm"))


@book.query("jn10_gather", "SELECT a.l_orderkey, round(sum(a.l_discount - b.l_tax), 6) AS delta FROM (SELECT l_orderkey, l_linenumber, sum(l_discount) AS l_discount FROM lineitem GROUP BY ALL) a JOIN (SELECT l_orderkey, l_linenumber, sum(l_tax) AS l_tax FROM lineitem GROUP BY ALL) b USING (l_orderkey, l_linenumber) GROUP BY 1")
def gather(spark, d):
    li = table(spark, d, "lineitem")
    a = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_discount").alias("x"))
    b = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_tax").alias("y"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.round(F.sum(F.col("x") - F.col("y")), 6).alias("delta"))


@book.query("jn14_gram_matrix", GRAM + " SELECT a, b, round(dot, 6) AS dot FROM g")
def gram_matrix(spark, d):
    return G.gram(means(spark, d), "label").select("a", "b", F.round("dot", 6).alias("dot"))


@book.query("mf02_restricted_kl", "WITH s AS (SELECT l_orderkey, l_quantity, l_extendedprice, sum(l_quantity) OVER w AS a, sum(l_extendedprice) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, round(sum(l_quantity / a * ln((l_quantity / a) / (l_extendedprice / b))), 9) AS kl FROM s GROUP BY 1")
def restricted_kl(spark, d):
    w = W.partitionBy("l_orderkey")  # the ids kept at one position are few
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / F.sum("l_quantity").over(w)).alias("p"), (F.col("l_extendedprice") / F.sum("l_extendedprice").over(w)).alias("q"))
    return li.groupBy("l_orderkey").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 9).alias("kl"))


@book.query("mf03_fisher_norm", "WITH s AS (SELECT l_orderkey, l_discount AS v, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem), m AS (SELECT *, sum(p * v) OVER (PARTITION BY l_orderkey) AS c FROM s) SELECT l_orderkey, round(sum(p * (v - c) * (v - c)), 15) AS fisher FROM m GROUP BY 1")
def fisher_norm(spark, d):
    w = W.partitionBy("l_orderkey")  # the ids kept at one position are few
    s = table(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").alias("v"), (F.col("l_quantity") / F.sum("l_quantity").over(w)).alias("p"))
    x = F.sqrt("p") * (F.col("v") - F.sum(F.col("p") * F.col("v")).over(w))
    return s.withColumn("x", x).groupBy("l_orderkey").agg(F.round(F.sum(F.col("x") * F.col("x")), 15).alias("fisher"))


@book.query("mf04_fit", "SELECT l_returnflag AS g, round(sum(x * y) / sum(x * x), 9) AS alpha, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 9) AS cosine, round(sqrt(sum(y * y) / sum(x * x)), 9) AS ratio FROM (SELECT l_returnflag, l_discount AS x, l_tax AS y FROM lineitem) GROUP BY 1")
def fit(spark, d):
    x, y = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.round(F.sum(x * y) / F.sum(x * x), 9).alias("alpha"), F.round(F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y)), 9).alias("cosine"), F.round(F.sqrt(F.sum(y * y) / F.sum(x * x)), 9).alias("ratio"))


@book.query("mf05_distance", GRAM + ", n AS (SELECT a AS l, dot AS nn FROM g WHERE a = b) SELECT g.a, g.b, round(sqrt(greatest(0, x.nn + y.nn - 2 * dot)), 6) AS distance FROM g JOIN n x ON x.l = g.a JOIN n y ON y.l = g.b WHERE g.a < g.b")
def distance(spark, d):
    c = G.cosines(G.gram(means(spark, d), "label")).filter("a < b")
    a, b = F.col("norm_a"), F.col("norm_b")
    return c.select("a", "b", F.round(F.sqrt(F.greatest(F.lit(0.0), a * a + b * b - 2 * a * b * F.col("cosine"))), 6).alias("distance"))


@book.query("mf08_correlations", "WITH r AS (SELECT c_acctbal AS x, c_custkey AS y, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rx FROM customer) SELECT round(corr(x, y), 9) AS pearson, round(corr(rx, y), 9) AS spearman FROM r")
def correlations(spark, d):
    c = table(spark, d, "customer").select("c_acctbal", F.col("c_custkey").alias("y"))
    groups = c.groupBy("c_acctbal").agg(F.count(F.lit(1)).alias("n"))
    at = ranks.running_sum(groups, "n", ["c_acctbal"], "upto")
    r = c.join(at, "c_acctbal").withColumn("rx", F.col("upto") - F.col("n") + 1 + (F.col("n") - 1) / 2.0)
    return r.agg(F.round(F.corr("c_acctbal", "y"), 9).alias("pearson"), F.round(F.corr("rx", "y"), 9).alias("spearman"))


@book.query("mf09_permutation_test")
def permutation_test(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    g = table(spark, d, "supplier").join(nations, "s_nationkey").groupBy("n_regionkey").agg(F.avg("s_acctbal").alias("y"))
    rows = g.orderBy("n_regionkey").collect()  # five regions: the test takes nine pairs at most
    return spark.createDataFrame([(G.permutation_p([float(r.n_regionkey) for r in rows], [r.y for r in rows]),)], "p double")


@book.query(
    "an01_influence_matrix",
    """WITH a AS (SELECT o_orderpriority AS i, o_orderstatus AS j, avg(o_totalprice) AS l FROM orders GROUP BY ALL), b AS (SELECT o_orderstatus AS j, avg(o_totalprice) AS base FROM orders GROUP BY 1), t AS (SELECT j, min(l) AS teacher FROM a GROUP BY 1)
    SELECT i, j, round(base - l, 4) AS gain, round((base - l) / (base - teacher), 7) AS fraction FROM a JOIN b USING (j) JOIN t USING (j)""",
)
def influence_matrix(spark, d):
    o = table(spark, d, "orders")
    a = o.groupBy(F.col("o_orderpriority").alias("i"), F.col("o_orderstatus").alias("j")).agg(F.avg("o_totalprice").alias("l"))
    b = o.groupBy(F.col("o_orderstatus").alias("j")).agg(F.avg("o_totalprice").alias("base"))
    rows = a.join(b, "j").join(a.groupBy("j").agg(F.min("l").alias("teacher")), "j")
    return G.influence(rows, "l", "base", "teacher").select("i", "j", F.round("gain", 4).alias("gain"), F.round("fraction", 7).alias("fraction"))


@book.query("an02_spectrum")
def spectrum(spark, d):
    return G.spectrum(G.gram(means(spark, d), "label"))


@book.query("an03_teacher_residual", GRAM + ", t AS (SELECT CASE WHEN a = 0 THEN b ELSE a END AS l, dot AS w FROM g WHERE a = 0 OR b = 0), o AS (SELECT dot AS own FROM g WHERE a = 0 AND b = 0) SELECT g.a, g.b, round(dot - x.w * y.w / own, 6) AS dot FROM g JOIN t x ON x.l = g.a JOIN t y ON y.l = g.b, o WHERE g.a <> 0 AND g.b <> 0")
def teacher_residual(spark, d):
    return G.residual_gram(G.gram(means(spark, d), "label"), 0).select("a", "b", F.round("dot", 6).alias("dot"))


@book.query("an04_bootstrap")
def bootstrap(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("probe")).agg(F.sum(F.col("l_discount") * F.col("l_tax")).alias("ab"), F.sum(F.col("l_discount") * F.col("l_discount")).alias("aa"), F.sum(F.col("l_tax") * F.col("l_tax")).alias("bb"))
    return G.bootstrap_cosines(s, 100, 42)


@book.query("an09_debiased_similarity", "WITH v AS (SELECT label, vec_id % 2 AS half, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, half, pos, avg(x) AS m FROM v GROUP BY ALL) SELECT a.label AS label, round(sum(a.m * b.m), 6) AS cross FROM m a JOIN m b ON a.label = b.label AND a.pos = b.pos AND a.half = 0 AND b.half = 1 GROUP BY 1")
def debiased_similarity(spark, d):
    e = table(spark, d, "embeddings").withColumn("half", F.col("vec_id") % 2)
    m = G.long_form(e, ["label", "half"], "embedding").groupBy("label", "pos").agg(F.avg(F.when(F.col("half") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("x"))).alias("b"))
    return m.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("label").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("cross"))


@book.query("an11_decomposition", "SELECT g, round(sum(x * y) / sum(x * x), 9) AS alpha, round(1 - sum(x * y) * sum(x * y) / (sum(x * x) * sum(y * y)), 9) AS residual FROM (SELECT l_returnflag AS g, l_discount AS x, l_tax AS y FROM lineitem) GROUP BY ROLLUP (g)")
def decomposition(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    x, y = F.col("x"), F.col("y")
    return li.rollup("g").agg(F.round(F.sum(x * y) / F.sum(x * x), 9).alias("alpha"), F.round(1 - F.sum(x * y) * F.sum(x * y) / (F.sum(x * x) * F.sum(y * y)), 9).alias("residual"))


@book.query("an13_association", "SELECT round(corr(a, b), 9) AS pearson, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier GROUP BY 1) USING (k)")
def association(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("b"))
    return a.join(b, "k").agg(F.round(F.corr("a", "b"), 9).alias("pearson"), F.count(F.lit(1)).alias("n"))


@book.query("an14_clipping", f"WITH m AS ({MEANS}) SELECT label, round(least(1, 0.5 / sqrt(sum(m * m))), 6) AS factor FROM m GROUP BY label")
def clipping(spark, d):
    return means(spark, d).groupBy("label").agg(F.round(F.least(F.lit(1.0), 0.5 / F.sqrt(F.sum(F.col("m") * F.col("m")))), 6).alias("factor"))


@book.query(
    "an17_policy_delta",
    """WITH base AS (SELECT l_orderkey AS probe, l_linenumber AS pos, min(l_returnflag) AS d, min(l_discount) AS lp FROM lineitem GROUP BY ALL),
    model AS (SELECT l_orderkey AS probe, l_linenumber AS pos, min(l_tax) AS lp FROM lineitem WHERE l_quantity >= 5 GROUP BY ALL),
    j AS (SELECT d, m.lp - b.lp AS x FROM base b LEFT JOIN model m USING (probe, pos))
    SELECT d, round(sum(x), 6) AS total, round(sum(x * x), 6) AS energy, count(x)::BIGINT AS n, count(*) FILTER (WHERE x IS NULL)::BIGINT AS missing FROM j GROUP BY GROUPING SETS ((d), ())""",
)
def policy_delta(spark, d):
    """Log-probability differences of two models on the chosen tokens, met by probe and position; positions only one has are counted."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("probe"), F.col("l_linenumber").alias("pos"), "l_returnflag", "l_discount", "l_tax", "l_quantity")
    base = li.groupBy("probe", "pos").agg(F.min("l_returnflag").alias("d"), F.min("l_discount").alias("lp"))
    model = li.filter("l_quantity >= 5").groupBy("probe", "pos").agg(F.min("l_tax").alias("lp2"))
    j = base.join(model, ["probe", "pos"], "left").select("d", (F.col("lp2") - F.col("lp")).alias("x"))
    return j.rollup("d").agg(F.round(F.sum("x"), 6).alias("total"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("energy"), F.count("x").alias("n"), F.count(F.when(F.col("x").isNull(), 1)).alias("missing"))


@book.query("an19_reproducibility", "WITH v AS (SELECT label, vec_id % 2 AS half, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) FILTER (WHERE half = 0) AS a, avg(x) FILTER (WHERE half = 1) AS b FROM v GROUP BY ALL) SELECT label, round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def reproducibility(spark, d):
    e = table(spark, d, "embeddings").withColumn("half", F.col("vec_id") % 2)
    m = G.long_form(e, ["label", "half"], "embedding").groupBy("label", "pos").agg(F.avg(F.when(F.col("half") == 0, F.col("x"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("x"))).alias("b"))
    a, b = F.col("a"), F.col("b")
    return m.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("label").agg(F.round(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 6).alias("cosine"))
