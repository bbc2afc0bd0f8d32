"""Further text, array, matrix and contract operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import curate, geometry, ranks, schedule
from quern.plans.base import Book, table
from quern.plans.scoring import ANSWER, BOXED
from quern.session import scratch

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("sc10_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY sha256('[99,\"shuffle\",' || doc_id || ']'), doc_id) - 1 AS place FROM documents")
def seeded_shuffle(spark, d):
    h = table(spark, d, "documents").select("doc_id", X.stable_hash(99, "shuffle", F.col("doc_id").cast("string")).alias("h"))
    return ranks.ranked(h, ["h", "doc_id"], "r").select("doc_id", (F.col("r") - 1).alias("place"))


@book.query("pf13_scaffolding", "SELECT cand_id, regexp_matches(code, '(?m)^assert ') AS asserts, regexp_matches(code, '__main__') AS main, regexp_matches(code, '(?m)^print\\(') AS prints FROM sft_candidate WHERE code IS NOT NULL")
def scaffolding(spark, d):
    c = F.col("code")
    return table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", c.rlike("(?m)^assert ").alias("asserts"), c.rlike("__main__").alias("main"), c.rlike(r"(?m)^print\(").alias("prints"))


@book.query("jn07_simhash_pairs")
def simhash_pairs(spark, d):
    c = table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", X.simhash64(X.code_tokens(F.col("code"))).alias("h"))
    first = c.groupBy("h").agg(F.min("cand_id").alias("id"), F.count(F.lit(1)).alias("copies"))  # copies aren't paired
    pairs = curate.hamming_pairs(first, "id", "h", 3, 5)
    h = first.select("id", "h")
    out = pairs.join(h.toDF("a", "ha"), "a").join(h.toDF("b", "hb"), "b")
    return out.select("a", "b", X.hamming(F.col("ha"), F.col("hb")).alias("distance"))


@book.query("jn15_arm_positions", "SELECT o_orderpriority AS arm, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def arm_positions(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select(F.col("o_orderpriority").alias("arm"), "o_orderkey", "o_orderdate")
    return ranks.ranked(o, ["o_orderdate", "o_orderkey"], "position", ("arm",)).select("arm", "o_orderkey", "position")


@book.query("or04_seeded_permutation", "SELECT n_nationkey, place::BIGINT AS place FROM (SELECT unnest([15, 16, 19, 20, 9, 7, 17, 24, 6, 10, 3, 0, 21, 18, 12, 5, 11, 14, 23, 2, 4, 22, 1, 13, 8]) AS k, unnest(range(25)) AS place) JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) USING (k)")
def seeded_permutation(spark, d):
    return schedule.seeded_permutation(table(spark, d, "nation"), "n_nationkey", 42)


@book.query(
    "or10_step_shuffle",
    "SELECT step, r_regionkey, row_number() OVER (PARTITION BY step ORDER BY sha256('[1,' || step || ',' || r_regionkey || ',' || copy || ']'), r_regionkey) - 1 AS place FROM region, (SELECT unnest(range(4)) AS step), (SELECT unnest(range(3)) AS copy)",
)
def step_shuffle(spark, d):
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    r = table(spark, d, "region").select("r_regionkey", seq(4).alias("step")).select("r_regionkey", "step", seq(3).alias("copy"))
    h = X.stable_hash(1, *(F.col(c).cast("string") for c in ("step", "r_regionkey", "copy")))
    return ranks.ranked(r.withColumn("h", h), ["h", "r_regionkey"], "p", ("step",)).select("step", "r_regionkey", (F.col("p") - 1).alias("place"))


@book.query("st08_disjoint_seeds", "WITH s AS (SELECT seed, doc_id, row_number() OVER (PARTITION BY seed ORDER BY sha256('[' || seed || ',\"support\",' || doc_id || ']'), doc_id) AS r FROM documents, (SELECT unnest([43, 44]) AS seed)) SELECT count(*)::BIGINT AS shared FROM (SELECT doc_id FROM s WHERE seed = 43 AND r <= 8 INTERSECT SELECT doc_id FROM s WHERE seed = 44 AND r <= 8)")
def disjoint_seeds(spark, d):
    def support(seed):
        h = table(spark, d, "documents").select("doc_id", X.stable_hash(seed, "support", F.col("doc_id").cast("string")).alias("h"))
        return h.orderBy("h", "doc_id").limit(8).select("doc_id")

    return support(43).intersect(support(44)).agg(F.count(F.lit(1)).alias("shared"))


@book.query("sf03_answer", "SELECT id, CASE WHEN length(a) > 1 AND starts_with(a, '$') AND ends_with(a, '$') THEN substr(a, 2, length(a) - 2) ELSE a END AS a FROM (SELECT id, trim(regexp_replace(answer, '\\s+', ' ', 'g')) AS a FROM hmmt25_feb)")
def answer(spark, d):
    a = X.squeezed(F.col("answer"))
    for _ in range(3):
        a = F.regexp_replace(a, r"^\$(.*)\$$", "$1")
    return table(spark, d, "hmmt25_feb").select("id", a.alias("a"))


@book.query("sf06_token_ngrams", "SELECT cand_id, CASE WHEN len(t) >= 13 THEN len(list_distinct(list_transform(range(1, len(t) - 11), lambda i: array_to_string(list_slice(t, i, i + 12), chr(31))))) ELSE 0 END::BIGINT AS grams FROM (SELECT cand_id, list_transform(regexp_extract_all(code, '([A-Za-z_][A-Za-z_0-9]*|[0-9]+)'), lambda x: lower(x)) AS t FROM sft_candidate WHERE code IS NOT NULL)")
def token_ngrams(spark, d):
    t = table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", X.code_tokens(F.col("code")).alias("t"))
    return t.select("cand_id", F.size(X.ngram_hashes(F.col("t"), 13)).cast("long").alias("grams"))


@book.query(
    "sf07_bottom_k",
    """WITH g AS (SELECT item_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: sha256(array_to_string(list_slice(w, i, i + 4), ' '))))) AS h
      FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(NFKC(problem)), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM heldout_item) WHERE len(w) >= 5),
    s AS (SELECT item_id, list_transform(range(1, 9), lambda i: h[least(i, len(h))]) AS signature FROM g)
    SELECT item_id, signature, list_transform(range(4), lambda b: sha256(b || ':' || signature[2 * b + 1] || signature[2 * b + 2])) AS bands FROM s""",
)
def bottom_k(spark, d):
    """The 8 smallest hashes of the 5-word shingles, a shorter list filled up with its last, and a key for each of 4 bands."""
    w = table(spark, d, "heldout_item").select("item_id", X.words_of(F.col("problem")).alias("w")).filter("size(w) >= 5")
    h = w.select("item_id", F.array_sort(F.transform(X.ngrams(F.col("w"), 5), lambda x: F.sha2(x, 256))).alias("h"))
    signature = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.element_at("h", F.least(i, F.size("h"))))
    bands = F.array(*(F.sha2(F.concat(F.lit(f"{b}:"), F.col("signature")[2 * b], F.col("signature")[2 * b + 1]), 256) for b in range(4)))
    return h.select("item_id", signature.alias("signature")).select("item_id", "signature", bands.alias("bands"))


@book.query("sf09_hamming", "SELECT l_orderkey, l_linenumber, min(bit_count(xor(l_partkey, l_suppkey)))::INTEGER AS distance FROM lineitem GROUP BY ALL")
def hamming(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(X.hamming(F.col("l_partkey"), F.col("l_suppkey"))).alias("distance"))


@book.query("sf17_clean_code", "SELECT cand_id, length(trim(regexp_replace(code, '^\\s*(?:python|py)\\n', ''), ' ' || chr(10)))::BIGINT AS n FROM sft_candidate WHERE code IS NOT NULL")
def clean_code(spark, d):
    c = table(spark, d, "sft_candidate").filter("code IS NOT NULL")
    return c.select("cand_id", F.length(F.expr("trim(BOTH ' \n' FROM regexp_replace(code, '^\\\\s*(?:python|py)\\\\n', ''))")).cast("long").alias("n"))


@book.query("sf22_templates", "SELECT item_id, sha256('Solve.' || chr(10) || problem || chr(10) || 'Answer with a number of at most ' || length(answer) || ' signs.') AS h FROM heldout_item")
def templates(spark, d):
    t = F.format_string("Solve.\n%s\nAnswer with a number of at most %d signs.", "problem", F.length("answer"))
    return table(spark, d, "heldout_item").select("item_id", F.sha2(t, 256).alias("h"))


@book.query(
    "af02_map_delta",
    """WITH a AS (SELECT cand_id, lineage AS m, map_from_entries(list_filter(map_entries(lineage), lambda e: e.key <> 'seed') || [{'key': 'added_key', 'value': style}]) AS n FROM sft_candidate WHERE lineage IS NOT NULL AND style IS NOT NULL)
    SELECT cand_id, len(list_filter(map_keys(m), lambda k: NOT list_contains(map_keys(n), k)))::BIGINT AS removed, len(list_filter(map_entries(n), lambda e: NOT list_contains(map_keys(m), e.key) OR m[e.key] IS DISTINCT FROM e.value))::BIGINT AS changed, list_sort(map_keys(n)) AS keys FROM a""",
)
def map_delta(spark, d):
    base = table(spark, d, "sft_candidate").filter("lineage IS NOT NULL AND style IS NOT NULL").select("cand_id", F.col("lineage").alias("m"), F.map_concat(F.map_filter("lineage", lambda k, v: k != "seed"), F.create_map(F.lit("added_key"), F.col("style"))).alias("n"))
    delta = base.withColumn("d", curate.map_delta(F.col("m"), F.col("n")))
    back = delta.withColumn("again", curate.apply_delta(F.col("m"), F.col("d")))
    gone = F.coalesce(F.json_array_length(F.try_element_at("d", F.lit("__removed__"))), F.lit(0))
    # The keys are those of the map that the delta gives back, so a delta that doesn't rebuild shows.
    return back.select("cand_id", gone.cast("long").alias("removed"), F.size(F.map_filter("d", lambda k, v: k != "__removed__")).cast("long").alias("changed"), F.array_sort(F.map_keys("again")).alias("keys"))


@book.query("af03_tolerant_parse", "SELECT raw_id, json_valid(payload) AS ok FROM raw_record WHERE payload IS NOT NULL")
def tolerant_parse(spark, d):
    return table(spark, d, "raw_record").filter("payload IS NOT NULL").select("raw_id", F.try_parse_json("payload").isNotNull().alias("ok"))


@book.query("af05_ragged_expand", "SELECT n_nationkey, unnest(range(n_regionkey + 1)) AS position FROM nation")
def ragged_expand(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_regionkey").cast("long"))).alias("position"))


@book.query("af07_ordered_distinct", "SELECT l_orderkey, list(k ORDER BY p, k) AS keys FROM (SELECT l_orderkey, l_returnflag AS k, min(l_linenumber) AS p FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def ordered_distinct(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("a"))  # an order has few lines
    return a.select("l_orderkey", F.array_distinct(F.transform("a", lambda x: x["l_returnflag"])).alias("keys"))


@book.query("af08_centering", "WITH c AS (SELECT vec_id, pos, x - avg(x) OVER (PARTITION BY pos) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)) SELECT vec_id, round(sum(x * x), 5) AS energy FROM c GROUP BY vec_id")
def centering(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    mean = e.groupBy("pos").agg(F.avg("x").alias("m"))  # combined map-side: no window over a whole coordinate
    c = F.col("x") - F.col("m")
    return e.join(mean, "pos").groupBy("vec_id").agg(F.round(F.sum(c * c), 5).alias("energy"))


def _halves(spark, d):
    e = table(spark, d, "embeddings").withColumn("half", F.col("vec_id") % 2)
    return [geometry.mean_vectors(e.filter(f"half = {k}"), "label", "embedding") for k in (0, 1)]


def _matrix(m):
    """Labels by dimension, both small: one row a label and coordinate."""
    rows = m.orderBy("label", "pos").collect()
    labels, dims = sorted({r.label for r in rows}), max(r.pos for r in rows) + 1
    if len(labels) > geometry.MAX_SIDE or dims > 4096:
        raise ValueError("matrix too large for the driver")
    out = np.zeros((len(labels), dims))
    for r in rows:
        out[labels.index(r.label), r.pos] = r.m
    return out


@book.query("an05_random_reference")
def random_reference(spark, d):
    m = _matrix(geometry.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"))
    rng, g = np.random.default_rng(42), m @ m.T
    value = lambda s: float(np.linalg.slogdet(np.eye(len(s)) + g[np.ix_(s, s)])[1])
    ref = [value(rng.choice(len(m), 3, replace=False)) for _ in range(500)]
    mu, sd = float(np.mean(ref)), float(np.std(ref, ddof=1))
    return spark.createDataFrame([(mu, sd, float(np.quantile(ref, 0.05)), float(np.quantile(ref, 0.95)), (value([0, 1, 2]) - mu) / (sd or 1.0))], "mean double, sd double, p05 double, p95 double, z double")


@book.query("an06_crossfit_spectrum")
def crossfit_spectrum(spark, d):
    a, b = map(_matrix, _halves(spark, d))
    c = a @ b.T
    ev = np.linalg.eigvalsh((c + c.T) / 2)[::-1]
    return spark.createDataFrame([(k + 1, float(max(x, 0)), float(-min(ev.min(), 0)), float(ev[ev > 0].sum())) for k, x in enumerate(ev)], "k int, value double, worst_negative double, positive_mass double")


@book.query("an07_subspace_overlap")
def subspace_overlap(spark, d):
    a, b = map(_matrix, _halves(spark, d))
    u, v = (np.linalg.svd(x, full_matrices=False)[2][:3] for x in (a, b))
    s = np.linalg.svd(u @ v.T, compute_uv=False)
    return spark.createDataFrame([(k + 1, float(x), float((s**2).mean())) for k, x in enumerate(s)], "k int, cosine double, overlap double")


@book.query(
    "an08_position_profile",
    "WITH b AS (SELECT label, pos // 16 AS block, vec_id, sum(x) AS x FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) SELECT block, round(var_pop(x), 6) AS variance, round(avg(x) * avg(x) / nullif(var_pop(x), 0), 6) AS reliability FROM b GROUP BY block",
)
def position_profile(spark, d):
    e = geometry.long_form(table(spark, d, "embeddings"), ["label", "vec_id"], "embedding")
    b = e.groupBy("label", F.floor(F.col("pos") / 16).alias("block"), "vec_id").agg(F.sum("x").alias("x"))
    m, v = F.avg("x"), F.var_pop("x")
    return b.groupBy("block").agg(F.round(v, 6).alias("variance"), F.round(m * m / F.nullif(v, F.lit(0.0)), 6).alias("reliability"))


@book.query("an10_multinomial_patterns", "SELECT a::INTEGER AS a, b::INTEGER AS b, c::INTEGER AS c, d::INTEGER AS d, 24.0 / (factorial(a::INTEGER) * factorial(b::INTEGER) * factorial(c::INTEGER) * factorial(d::INTEGER))::DOUBLE / 256 AS p FROM range(5) x(a), range(5) y(b), range(5) z(c), range(5) w(d) WHERE a + b + c + d = 4")
def multinomial_patterns(spark, d):
    import itertools
    from math import factorial

    rows = [(c, 24 / np.prod([factorial(x) for x in c]) / 256) for c in itertools.product(range(5), repeat=4) if sum(c) == 4]
    return spark.createDataFrame([(*map(int, c), float(p)) for c, p in rows], "a int, b int, c int, d int, p double")


@book.query("an12_log_determinant")
def log_determinant(spark, d):
    _, g = geometry.local_matrix(geometry.gram(geometry.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label"))
    return spark.createDataFrame([(k, float(np.linalg.slogdet(np.eye(k) + g[:k, :k])[1])) for k in range(1, len(g) + 1)], "k int, logdet double")


@book.query(
    "an16_attestation",
    """WITH a AS (SELECT 'region' AS t, string_agg(r_regionkey || ':' || r_name, ',' ORDER BY r_regionkey) AS s, string_agg(r_regionkey || ':' || r_name, ',' ORDER BY r_regionkey) AS u FROM region
    UNION ALL SELECT 'nation', string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey), string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) FROM nation
    UNION ALL SELECT 'supplier', string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey), string_agg(CASE WHEN s_nationkey = 3 THEN s_suppkey || ':?' ELSE s_suppkey || ':' || s_name END, ',' ORDER BY s_suppkey) FROM supplier)
    SELECT t, sha256(s) AS recorded, s = u AS may_reuse FROM a""",
)
def attestation(spark, d):
    """A spectrum may be used again if each of its three inputs still has the recorded hash; one of them was changed meanwhile."""
    def digest(df, key, name, text):
        rows = df.select(F.struct(F.col(key).alias("k"), F.concat_ws(":", F.col(key).cast("string"), text).alias("x")).alias("r"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["x"]), ",")  # the tables of a spectrum are small
        return rows.agg(F.sha2(joined, 256).alias("h")).select(F.lit(name).alias("t"), "h")

    inputs = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name")]
    recorded = [digest(table(spark, d, t), k, t, F.col(c)) for t, k, c in inputs]
    edited = F.when(F.col("s_nationkey") == 3, "?").otherwise(F.col("s_name"))
    now = recorded[:2] + [digest(table(spark, d, "supplier"), "s_suppkey", "supplier", edited)]
    union = lambda x: x[0].unionByName(x[1]).unionByName(x[2])
    return union(recorded).withColumnRenamed("h", "recorded").join(union(now), "t").select("t", "recorded", (F.col("recorded") == F.col("h")).alias("may_reuse"))


@book.query(
    "an18_fisher_report",
    "WITH s AS (SELECT l_returnflag AS dom, l_orderkey, l_discount AS u, l_tax AS v, l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS p FROM lineitem), c AS (SELECT *, u - sum(p * u) OVER (PARTITION BY l_orderkey) AS x, v - sum(p * v) OVER (PARTITION BY l_orderkey) AS y FROM s) SELECT dom, round(sum(p * x * y) / sqrt(sum(p * x * x) * sum(p * y * y)), 6) AS cosine, round(sqrt(sum(p * x * x)), 5) AS norm FROM c GROUP BY ROLLUP (dom)",
)
def fisher_report(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey")  # the ids kept at one position are few
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dom"), "l_orderkey", F.col("l_discount").alias("u"), F.col("l_tax").alias("v"), (F.col("l_quantity") / F.sum("l_quantity").over(w)).alias("p"))
    c = li.select("dom", "p", (F.col("u") - F.sum(F.col("p") * F.col("u")).over(w)).alias("x"), (F.col("v") - F.sum(F.col("p") * F.col("v")).over(w)).alias("y"))
    s = lambda a, b: F.sum(F.col("p") * F.col(a) * F.col(b))
    return c.rollup("dom").agg(F.round(s("x", "y") / F.sqrt(s("x", "x") * s("y", "y")), 6).alias("cosine"), F.round(F.sqrt(s("x", "x")), 5).alias("norm"))


@book.query(
    "an21_regimes",
    """WITH e AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x, 1 + vec_id % 7 AS tokens, 1 + vec_id % 3 AS places FROM embeddings),
    m AS (SELECT 'equal' AS regime, label, pos, avg(x) AS g FROM e GROUP BY ALL UNION ALL SELECT 'token', label, pos, sum(x * tokens) / sum(tokens) FROM e GROUP BY label, pos UNION ALL SELECT 'position', label, pos, sum(x * places) / sum(places) FROM e GROUP BY label, pos),
    c AS (SELECT regime, least(1, 0.25 / sqrt(sum(p * p))) AS clip FROM (SELECT regime, pos, avg(g) AS p FROM m GROUP BY ALL) GROUP BY regime),
    q AS (SELECT regime, pos, avg(g * clip) AS common FROM m JOIN c USING (regime) GROUP BY ALL)
    SELECT regime, any_value(round(clip, 6)) AS clip, round(sum(g * clip * g * clip), 6) AS energy, round(sum(g * clip * common), 6) AS along, round(sum((g * clip - common) * (g * clip - common)), 6) AS between FROM m JOIN c USING (regime) JOIN q USING (regime, pos) GROUP BY regime""",
)
def regimes(spark, d):
    """Label means under three weightings of the same rows, each clipped once by the norm of its pooled mean, and the energy, the
    part along the common mean and the part between labels that remain."""
    e = table(spark, d, "embeddings").select("label", (1 + F.col("vec_id") % 7).cast("double").alias("tokens"), (1 + F.col("vec_id") % 3).cast("double").alias("places"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    kinds = F.array(*(F.struct(F.lit(n).alias("regime"), w.alias("w")) for n, w in (("equal", F.lit(1.0)), ("token", F.col("tokens")), ("position", F.col("places")))))
    m = e.withColumn("k", F.explode(kinds)).groupBy(F.col("k.regime").alias("regime"), "label", "pos").agg((F.sum(F.col("x") * F.col("k.w")) / F.sum("k.w")).alias("g"))
    pooled = m.groupBy("regime", "pos").agg(F.avg("g").alias("p"))
    clip = pooled.groupBy("regime").agg(geometry.clip_factor(F.sqrt(F.sum(F.col("p") * F.col("p"))), 0.25).alias("clip"))
    c = m.join(F.broadcast(clip), "regime").join(pooled, ["regime", "pos"]).select("regime", "clip", (F.col("g") * F.col("clip")).alias("g"), (F.col("p") * F.col("clip")).alias("p"))  # three rows
    total = lambda x, n: F.round(F.sum(x), 6).alias(n)
    g, p = F.col("g"), F.col("p")
    return c.groupBy("regime").agg(F.round(F.first("clip"), 6).alias("clip"), total(g * g, "energy"), total(g * p, "along"), total((g - p) * (g - p), "between"))


@book.query("an22_confirmation", "WITH s AS (SELECT label, vec_id % 2 AS half, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, half, pos, avg(x) AS m FROM s GROUP BY ALL) SELECT label, half, round(sqrt(sum(m * m)), 6) AS norm FROM m GROUP BY ALL")
def confirmation(spark, d):
    e = table(spark, d, "embeddings").withColumn("half", F.col("vec_id") % 2)
    m = geometry.long_form(e, ["label", "half"], "embedding").groupBy("label", "half", "pos").agg(F.avg("x").alias("m"))
    return m.groupBy("label", "half").agg(F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))


_REGION_JSON = "string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' || chr(10), '' ORDER BY r_regionkey)"


@book.query("ck03_hash_verification", f"SELECT 'first' AS copy, sha256({_REGION_JSON}) AS h, true AS verified FROM region UNION ALL SELECT 'second', sha256({_REGION_JSON.replace('|| r_name ||', '|| lower(r_name) ||')}), bool_and(r_name = lower(r_name)) FROM region")
def hash_verification(spark, d):
    """Two copies of a file against the manifest of the first: the second one was changed."""
    region = table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).sortWithinPartitions("r_regionkey")

    def files(df, name):
        at = scratch(spark, "verified")
        df.write.json(at)
        read = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(at)
        return read.select(F.lit(name).alias("copy"), F.sha2("content", 256).alias("h"))

    first = files(region, "first")
    manifest = first.select(F.col("h").alias("listed"))  # one row: one file
    both = first.unionByName(files(region.withColumn("r_name", F.lower("r_name")), "second"))
    return both.crossJoin(F.broadcast(manifest)).select("copy", "h", (F.col("h") == F.col("listed")).alias("verified"))


@book.query("ck07_finite", "SELECT count(*) FILTER (WHERE isnan(score))::BIGINT AS nan_scores, count(*) FILTER (WHERE score IS NULL)::BIGINT AS null_scores, count(*) FILTER (WHERE isnan(k1_mean))::BIGINT AS nan_k1 FROM rollout_metadata")
def finite(spark, d):
    r = table(spark, d, "rollout_metadata")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return r.agg(n(F.isnan("score"), "nan_scores"), n(F.col("score").isNull(), "null_scores"), n(F.isnan("k1_mean"), "nan_k1"))


@book.query("ck09_refuse_overwrite", "SELECT true AS refused, count(*)::BIGINT AS rows_in, sum(r_regionkey)::BIGINT AS keys FROM region")
def refuse_overwrite(spark, d):
    """A second write with other rows is refused, and what is there is still the first."""
    from pyspark.errors import AnalysisException

    from quern.sources.files import write_frozen

    at, region = scratch(spark, "once"), table(spark, d, "region")
    write_frozen(region, at, "region")
    try:
        write_frozen(region.withColumn("r_regionkey", F.col("r_regionkey") + 100), at, "region")
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(f"{at}/data").agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("rows_in"), F.sum("r_regionkey").cast("long").alias("keys"))


@book.query(
    "ck14_folder_fingerprint",
    """WITH f AS (SELECT n_regionkey, string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || chr(10), '' ORDER BY n_nationkey) AS content FROM nation GROUP BY 1)
    SELECT count(*)::BIGINT AS files, sha256(string_agg(n_regionkey || chr(9) || length(content) || chr(9) || sha256(content), chr(10) ORDER BY n_regionkey)) AS fingerprint FROM f""",
)
def folder_fingerprint(spark, d):
    """The hash of a folder's sorted lines of name, size and content hash: it doesn't depend on the order files are listed in."""
    at = scratch(spark, "folder")
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    nation.coalesce(1).sortWithinPartitions("n_regionkey", "n_nationkey").write.partitionBy("n_regionkey").json(at)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(at)
    line = F.concat_ws("\t", F.regexp_extract("path", r"n_regionkey=([0-9]+)", 1), F.length("content").cast("string"), F.sha2("content", 256))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))  # one row a file of one folder


@book.query("kn02_deficit_prefix")
def deficit_prefix(spark, d):
    h = X.stable_hash(7, "within", F.col("cand_id").cast("string"))
    return schedule.stratified_interleave(table(spark, d, "sft_candidate").select("cand_id", "style"), "cand_id", "style", h, 96)


def _runs(rows: str, at: str) -> str:
    tokens = "list_transform(regexp_extract_all(t, '([A-Za-z_][A-Za-z_0-9]*|[0-9]+)'), lambda x: lower(x))"
    return f"SELECT {at}, len(g) AS n, unnest(g) AS gram FROM (SELECT {at}, list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(list_slice(w, i, i + 12), chr(31)))) AS g FROM (SELECT {at}, {tokens} AS w FROM ({rows}) WHERE t IS NOT NULL) WHERE len(w) >= 13)"


@book.query(
    "jn05_sft_containment",
    f"""WITH a AS ({_runs("SELECT doc_id, text AS t FROM documents", "doc_id")}), b AS ({_runs("SELECT item_id, problem AS t FROM heldout_item", "item_id")})
    SELECT doc_id, item_id, round(count(*) / least(a.n, b.n), 6) AS containment FROM a JOIN b USING (gram) GROUP BY doc_id, item_id, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.2""",
)
def sft_containment(spark, d):
    hits = curate.containment(table(spark, d, "documents"), table(spark, d, "heldout_item"), "doc_id", "text", "item_id", "problem", 13, 0.2)
    return hits.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


@book.query("pl01_curation_funnel", "WITH a AS (SELECT *, regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g') AS k FROM documents) SELECT 'read' AS stage, count(*)::BIGINT AS n FROM a UNION ALL SELECT 'text', count(*) FROM a WHERE k <> '' UNION ALL SELECT 'distinct', count(DISTINCT k) FROM a WHERE k <> '' UNION ALL SELECT 'no_conflict', count(*) FROM (SELECT k FROM a WHERE k <> '' GROUP BY k HAVING count(DISTINCT lang) <= 1)")
def curation_funnel(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    g = curate.collapse_by_key(docs, X.loose_key(F.col("text")), "doc_id", [], "lang")
    one = lambda df, c, name: df.agg(c.cast("long").alias("n")).select(F.lit(name).alias("stage"), "n")
    n = F.count(F.lit(1))
    return one(docs, n, "read").unionByName(one(g, F.sum("copies"), "text")).unionByName(one(g, n, "distinct")).unionByName(one(g.filter("`values` <= 1"), n, "no_conflict"))


@book.query("sc04_streamed_rows", "SELECT count(*)::BIGINT AS n, sum(value)::DECIMAL(18,2)::DOUBLE AS total FROM events")
def streamed_rows(spark, d):
    from quern.streaming import telemetry as S

    rows = S.run_to_table(S.event_stream(spark, f"{d}/events.parquet").select("event_id", "value"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@book.query("sf11_unboxed", f"SELECT doc_id, {ANSWER} AS answer FROM ({BOXED}) JOIN documents USING (doc_id) WHERE contains(text, 'boxed')")
def unboxed(spark, d):
    docs = table(spark, d, "documents").filter(F.contains("text", F.lit("boxed"))).select("doc_id", X.last_boxed(F.col("text")).alias("b"))
    return docs.select("doc_id", X.unboxed(F.col("b")).alias("answer"))


@book.query("sf12_boxed_or_none", "SELECT doc_id, CASE WHEN contains(text, '\\boxed{') THEN 'some' ELSE 'None' END AS found FROM documents WHERE text IS NOT NULL")
def boxed_or_none(spark, d):
    b = F.coalesce(F.trim(X.unboxed(X.last_boxed(F.col("text")))), F.lit("None"))
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.when(b == "None", "None").otherwise("some").alias("found"))


@book.query("sf16_python_code")
def python_code(spark, d):
    c = table(spark, d, "sft_candidate").select("cand_id", X.best_code(F.col("code")).alias("body"))
    return c.select("cand_id", F.length("body").alias("n"), F.sha2("body", 256).alias("h"))


@book.query("sf25_fence_split", "SELECT cand_id, length(split_part(split_part(code, '```python', -1), '```', 1))::BIGINT AS n FROM sft_candidate WHERE contains(code, '```python')")
def fence_split(spark, d):
    part = F.split_part(F.split_part("code", F.lit("```python"), F.lit(-1)), F.lit("```"), F.lit(1))
    return table(spark, d, "sft_candidate").filter(F.contains("code", F.lit("```python"))).select("cand_id", F.length(part).cast("long").alias("n"))


@book.query("mf06_eigenvalues")
def eigenvalues(spark, d):
    return geometry.spectrum(geometry.gram(geometry.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")).select("k", "value")


@book.query(
    "mf07_participation",
    """WITH m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
    g AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM m a JOIN m b USING (pos) GROUP BY ALL)
    SELECT round(sum(dot) FILTER (WHERE a = b) * sum(dot) FILTER (WHERE a = b) / sum(dot * dot), 6) AS participation, round(sum(dot) FILTER (WHERE a = b), 6) AS trace FROM g""",
)
def participation(spark, d):
    """Of the spectrum of a Gram matrix, from its traces: (sum of eigenvalues)^2 over the sum of their squares, which needs no eigenvalue."""
    g = geometry.gram(geometry.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label")
    return geometry.participation(g).select(F.round("participation", 6).alias("participation"), F.round("trace", 6).alias("trace"))


@book.query("mf12_splitmix")
def splitmix(spark, d):
    from quern.operators.replay import sketch_cell

    c = sketch_cell(F.col("c_custkey"), F.lit(7), F.lit(1024))
    return table(spark, d, "customer").select("c_custkey", c["bucket"].alias("bucket"), c["sign"].alias("sign"))


@book.query("mf13_floor_arithmetic", "SELECT o_orderkey, o_orderkey // 256 AS step, o_orderkey % 256 AS position FROM orders")
def floor_arithmetic(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 256").alias("step"), (F.col("o_orderkey") % 256).alias("position"))


@book.query("af01_canonical_json", "SELECT r_regionkey, '{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}' AS j FROM region")
def canonical_json(spark, d):
    return table(spark, d, "region").select("r_regionkey", X.canonical_json("r_regionkey", "r_name").alias("j"))


@book.query("af04_first_elements", "SELECT vec_id, list_transform(list_slice(embedding, 1, 3), lambda x: round(x::DOUBLE, 5)) AS head FROM embeddings")
def first_elements(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double"), 5)).alias("head"))


@book.query(
    "an15_widened_control",
    """WITH p AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS gap FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 500),
    b AS (SELECT c_custkey, arg_min(s_suppkey, (round(gap, 6), s_suppkey)) AS control, min(gap) AS gap FROM p GROUP BY 1)
    SELECT c_custkey, CASE WHEN gap <= 5 THEN 5 WHEN gap <= 50 THEN 50 ELSE 500 END AS tolerance, control, round(gap, 6) AS gap FROM b""",
)
def widened_control(spark, d):
    """For each unit the narrowest tolerance that leaves it a control, and the nearest control at it."""
    from quern.operators.joins import matched_control

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("control"), "s_acctbal")
    return matched_control(c, s, "c_custkey", "control", "c_acctbal", "s_acctbal", [5, 50, 500], ("nation",)).select("c_custkey", "tolerance", "control", F.round("gap", 6).alias("gap"))


@book.query("an20_crossfit_between")
def crossfit_between(spark, d):
    a, b = map(_matrix, _halves(spark, d))
    c = (a - a.mean(0)).T @ (b - b.mean(0)) / max(1, len(a) - 1)
    ev = np.linalg.eigvalsh((c + c.T) / 2)
    return spark.createDataFrame([(float(ev.sum()), float(ev[ev > 0].sum()), float(-ev[ev < 0].sum()))], "signed double, positive double, negative double")


@book.query("ck11_identity", "SELECT source, count(DISTINCT source_revision)::BIGINT AS revisions, count(*) FILTER (WHERE source_revision IS NULL)::BIGINT AS unknown, (count(DISTINCT source_revision) = 1 AND count(*) FILTER (WHERE source_revision IS NULL) = 0) AS identical FROM sft_candidate GROUP BY source")
def identity(spark, d):
    g = table(spark, d, "sft_candidate").groupBy("source", "source_revision").agg(F.count(F.lit(1)).alias("n"))
    out = g.groupBy("source").agg(F.count("source_revision").alias("revisions"), F.coalesce(F.sum(F.when(F.col("source_revision").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return out.withColumn("identical", (F.col("revisions") == 1) & (F.col("unknown") == 0))


@book.query(
    "ck12_contract",
    """SELECT CASE WHEN rendered IS NULL OR rendered.n_tokens IS NULL THEN 'not_rendered' WHEN rendered.truncated THEN 'truncated' WHEN rendered.assistant_tokens > rendered.n_tokens THEN 'assistant_exceeds_total' WHEN rendered.n_tokens > 400 THEN 'too_long'
    WHEN license IS NULL THEN 'no_license' WHEN coalesce(family_id, '') = '' THEN 'no_family' ELSE 'ok' END AS verdict, count(*)::BIGINT AS n, sum(coalesce(rendered.n_tokens, 0))::BIGINT AS tokens FROM sft_candidate GROUP BY 1""",
)
def contract(spark, d):
    """The first rule of a training row's contract that it breaks."""
    r = F.col("rendered")
    rules = [
        ("not_rendered", r["n_tokens"].isNull()),
        ("truncated", r["truncated"]),
        ("assistant_exceeds_total", r["assistant_tokens"] > r["n_tokens"]),
        ("too_long", r["n_tokens"] > 400),
        ("no_license", F.col("license").isNull()),
        ("no_family", F.coalesce("family_id", F.lit("")) == ""),
    ]
    rows = table(spark, d, "sft_candidate").select(curate.first_broken(rules).alias("verdict"), F.coalesce(r["n_tokens"], F.lit(0)).alias("t"))
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"))
