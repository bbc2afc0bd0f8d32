"""Scoring of outputs, log-probability statistics and replay."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import ranks, replay, score
from quern.operators.quantiles import quantiles
from quern.plans.base import Book, table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("sf01_normalize")
def normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(X.normalized(F.col("text"))).cast("long").alias("n"))


@book.query("sf02_loose_key", "SELECT doc_id, sha256(regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g')) AS k FROM documents WHERE text IS NOT NULL")
def loose_key(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2(X.loose_key(F.col("text")), 256).alias("k"))


@book.query("sf04_ngram_count", "SELECT item_id, len(list_distinct(list_transform(range(1, greatest(2, len(w) - 6)), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))))::BIGINT AS grams FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(NFKC(problem)), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM heldout_item) WHERE len(w) > 0")
def ngram_count(spark, d):
    t = table(spark, d, "heldout_item").select("item_id", X.words_of(F.col("problem")).alias("w")).filter("size(w) > 0")
    return t.select("item_id", F.size(X.ngrams(F.col("w"), 8, short_whole=True)).cast("long").alias("grams"))


@book.query("sf05_code_tokens", "SELECT cand_id, len(regexp_extract_all(code, '([A-Za-z_][A-Za-z_0-9]*|[0-9]+)'))::BIGINT AS n FROM sft_candidate WHERE code IS NOT NULL")
def code_tokens(spark, d):
    return table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", F.size(X.code_tokens(F.col("code"))).cast("long").alias("n"))


@book.query("sf08_simhash")
def simhash(spark, d):
    t = table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", X.simhash64(X.code_tokens(F.col("code"))).alias("h"))
    return t.select("cand_id", "h", *(X.band(F.col("h"), i).alias(f"band{i}") for i in range(4)))


#: The last boxed expression in SQL, braces nested four deep at most.
_TAIL = "CASE WHEN contains(text, '\\boxed') THEN '\\boxed' || split_part(text, '\\boxed', -1) WHEN contains(text, '\\fbox') THEN '\\fbox' || split_part(text, '\\fbox', -1) END"
_DEEP = r"\{[^{}]*\}"
for _ in range(3):
    _DEEP = r"\{(?:[^{}]|" + _DEEP + r")*\}"
BOXED = f"SELECT doc_id, nullif(regexp_extract({_TAIL}, '^[^{{}}]*{_DEEP}'), '') AS boxed FROM documents"
ANSWER = "CASE WHEN starts_with(boxed, '\\boxed{') THEN substr(boxed, 8, length(boxed) - 8) END"


@book.query("sf10_boxed", f"SELECT doc_id, boxed, {ANSWER} AS answer FROM ({BOXED}) WHERE boxed IS NOT NULL")
def boxed(spark, d):
    return table(spark, d, "documents").select("doc_id", X.last_boxed(F.col("text")).alias("boxed")).filter("boxed IS NOT NULL").select("doc_id", "boxed", X.unboxed(F.col("boxed")).alias("answer"))


#: The commands an answer loses, in SQL.
PLAIN = "answer"
for _x in (*X.SIZING, *X.SPACING, "$"):
    PLAIN = f"replace({PLAIN}, '{_x}', '')"
PLAIN = f"regexp_replace(regexp_replace(regexp_replace({PLAIN}, '\\s+', '', 'g'), '\\.+$', ''), '^\\+', '')"


@book.query("sf13_plain_answer", f"SELECT id, {PLAIN} AS a FROM hmmt25_feb")
def plain_answer(spark, d):
    return table(spark, d, "hmmt25_feb").select("id", X.plain_answer(F.col("answer")).alias("a"))


@book.query(
    "sf14_ratio",
    rf"""WITH t AS (SELECT id, replace({PLAIN}, ',', '') AS a FROM hmmt25_feb),
    p AS (SELECT id, CASE WHEN regexp_full_match(a, '[-+]?[0-9]+') THEN a::HUGEINT WHEN regexp_full_match(a, '[-+]?[0-9]+[.][0-9]+') THEN replace(a, '.', '')::HUGEINT
        WHEN regexp_full_match(a, '[-+]?[0-9]+/[-+]?[0-9]+') THEN split_part(a, '/', 1)::HUGEINT
        WHEN regexp_full_match(a, '[-+]?\\[dt]?frac\{{-?[0-9]+\}}\{{-?[0-9]+\}}') THEN regexp_extract(a, 'frac\{{(-?[0-9]+)\}}', 1)::HUGEINT * (CASE WHEN starts_with(a, '-') THEN -1 ELSE 1 END) END AS n,
      CASE WHEN regexp_full_match(a, '[-+]?[0-9]+') THEN 1::HUGEINT WHEN regexp_full_match(a, '[-+]?[0-9]+[.][0-9]+') THEN pow(10, length(split_part(a, '.', 2)))::HUGEINT
        WHEN regexp_full_match(a, '[-+]?[0-9]+/[-+]?[0-9]+') THEN split_part(a, '/', 2)::HUGEINT
        WHEN regexp_full_match(a, '[-+]?\\[dt]?frac\{{-?[0-9]+\}}\{{-?[0-9]+\}}') THEN regexp_extract(a, '\}}\{{(-?[0-9]+)\}}', 1)::HUGEINT END AS m FROM t)
    SELECT id, CASE WHEN m <> 0 THEN (sign(m)::HUGEINT * n // gcd(n, m))::VARCHAR END AS num, CASE WHEN m <> 0 THEN (abs(m) // gcd(n, m))::VARCHAR END AS den FROM p""",
)
def ratio(spark, d):
    r = X.as_ratio(X.plain_answer(F.col("answer")))
    return table(spark, d, "hmmt25_feb").select("id", r.alias("r")).select("id", "r.num", "r.den")


@book.query("sf15_last_fence", "SELECT cand_id, length(coalesce(list_last(regexp_extract_all(code, '```(?:python|py)[ \\t]*\\n((?s:.*?))```', 1)), list_last(regexp_extract_all(code, '```[^\\n`]*\\n((?s:.*?))```', 1))))::BIGINT AS n FROM sft_candidate WHERE code IS NOT NULL")
def last_fence(spark, d):
    return table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", F.length(X.last_fence(F.col("code"))).cast("long").alias("n"))


@book.query(
    "sf18_outputs_equivalent",
    """WITH t AS (SELECT cand_id, unnest(range(len(i))) AS place, unnest(i) AS a, unnest(o) AS b FROM (SELECT cand_id, json_extract_string(tests_json, '$.inputs[*]') AS i, json_extract_string(tests_json, '$.outputs[*]') AS o FROM sft_candidate WHERE json_valid(tests_json)) WHERE len(i) = len(o) AND len(i) > 0),
    w AS (SELECT cand_id, place, list_filter(string_split(regexp_replace(a, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS x, list_filter(string_split(regexp_replace(b, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS y FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
    z AS (SELECT cand_id, place, len(x) = len(y) AS even, unnest(list_zip(x, y)) AS p FROM w UNION ALL SELECT cand_id, place, len(x) = len(y), NULL FROM w),
    q AS (SELECT *, try_cast(p[1] AS DOUBLE) AS m, try_cast(p[2] AS DOUBLE) AS n FROM z)
    SELECT cand_id, place, bool_and(even AND (p IS NULL OR p[1] = p[2] OR coalesce(CASE WHEN regexp_full_match(p[1], '[+-]?[0-9]{1,18}') AND regexp_full_match(p[2], '[+-]?[0-9]{1,18}') THEN p[1]::BIGINT = p[2]::BIGINT ELSE abs(m - n) <= greatest(1e-6, 1e-6 * greatest(abs(m), abs(n))) AND NOT isnan(m) AND NOT isnan(n) END, false))) AS same FROM q GROUP BY ALL""",
)
def outputs_equivalent(spark, d):
    """Whether each test's output is its input but for the writing of numbers and blanks."""
    t = F.from_json("tests_json", "inputs array<string>, outputs array<string>").alias("t")
    rows = table(spark, d, "sft_candidate").select("cand_id", t).filter("size(t.inputs) = size(t.outputs)")
    rows = rows.select("cand_id", F.posexplode(F.arrays_zip("t.inputs", "t.outputs")).alias("place", "p")).filter("p.inputs IS NOT NULL AND p.outputs IS NOT NULL")
    return rows.select("cand_id", F.col("place").cast("long").alias("place"), score.outputs_equivalent(F.col("p.inputs"), F.col("p.outputs")).alias("same"))


@book.query("sf19_after_think", "SELECT doc_id, CASE WHEN contains(text, '</think>') THEN length(ltrim(split_part(text, '</think>', -1), ' ' || chr(10))) ELSE 0 END::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def after_think(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length(X.after_think(F.col("text"))).cast("long").alias("n"))


@book.query("sf20_candidate_window")
def candidate_window(spark, d):
    t = table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", "code", F.regexp_extract("code", r"def (\w+)", 1).alias("entry"))
    return t.select("cand_id", F.length(score.candidate_window(F.col("code"), F.col("entry"))).alias("n"))


@book.query("sf21_prompt_text", "SELECT doc_id, length('user: ' || text || chr(10) || 'lang: ' || coalesce(lang, '?'))::BIGINT AS chars, sha256('user: ' || text || chr(10) || 'lang: ' || coalesce(lang, '?')) AS h FROM documents WHERE text IS NOT NULL")
def prompt_text(spark, d):
    m = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("lang").alias("role"), F.coalesce("lang", F.lit("?")).alias("content")))
    t = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length(t).cast("long").alias("chars"), F.sha2(t, 256).alias("h"))


@book.query("sf23_text_hash", "SELECT cand_id, sha256(code) AS h FROM sft_candidate WHERE code IS NOT NULL")
def text_hash(spark, d):
    return table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", F.sha2("code", 256).alias("h"))


_NAME = "'_fsdp_wrapped_module.' || CASE WHEN p_size < 10 THEN 'model.embed_tokens.weight' WHEN p_size < 15 THEN 'model.norm._flat_param' WHEN p_size < 20 THEN 'lm_head.weight' ELSE 'model.layers.' || p_size || '._checkpoint_wrapped_module.mlp.weight' END"


@book.query(
    "sf24_group_names",
    f"""WITH n AS (SELECT replace(replace({_NAME}, '_fsdp_wrapped_module.', ''), '_checkpoint_wrapped_module.', '') AS name FROM part)
    SELECT name, CASE WHEN contains(name, 'embed_tokens') THEN 'embedding' WHEN contains(name, 'lm_head') THEN 'lm_head' WHEN regexp_matches(name, 'layers[.][0-9]+[.]') THEN 'layer_' || regexp_extract(name, 'layers[.]([0-9]+)[.]', 1) WHEN contains(name, 'norm') THEN 'final_norm' ELSE 'other' END AS g, count(*)::BIGINT AS n FROM n GROUP BY ALL""",
)
def group_names(spark, d):
    raw = F.expr(_NAME.replace("p_size ||", "cast(p_size as string) ||"))
    name = X.parameter_name(raw)
    return table(spark, d, "part").groupBy(name.alias("name"), X.parameter_group(name).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@book.query("hx01_item_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS h FROM nation")
def item_hash(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.item_hash("n_nationkey", "n_name", "n_regionkey").alias("h"))


@book.query("hx02_stable_hash", "SELECT c_custkey, sha256('[42,\"rank\",\"' || c_name || '\",' || c_custkey || ']') AS h FROM customer")
def stable_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.stable_hash(42, "rank", X.json_escape(F.col("c_name")), F.col("c_custkey").cast("string")).alias("h"))


@book.query("hx03_blake_hex")
def blake_hex(spark, d):
    return table(spark, d, "sft_candidate").select("cand_id", X.blake_hex(F.col("code")).alias("h"))


@book.query("hx04_token_list_hash", "SELECT l_orderkey, sha256(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey)) AS h FROM lineitem GROUP BY l_orderkey")
def token_list_hash(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("t"))
    return t.select("l_orderkey", F.sha2(F.array_join(F.transform("t", lambda x: x["l_partkey"].cast("string")), ","), 256).alias("h"))


CLEAN = "index IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)"


@book.query(
    "ag07_mean_at_k",
    f"SELECT round(avg(m), 6) AS mean_at_k, round(avg(h), 6) AS hit_at_k, count(*)::BIGINT AS problems, sum(k)::BIGINT AS samples FROM (SELECT index, avg((score > 0.5)::INT) AS m, max((score > 0.5)::INT) AS h, count(*) AS k FROM rollout_metadata WHERE {CLEAN} GROUP BY index)",
)
def mean_at_k(spark, d):
    out = score.mean_at_k(table(spark, d, "rollout_metadata").filter(CLEAN), "index", F.col("score") > 0.5, [])
    return out.select(F.round("mean_at_k", 6).alias("mean_at_k"), F.round("hit_at_k", 6).alias("hit_at_k"), "problems", "samples")


@book.query("ag09_rates", "SELECT lang, round(avg((NOT contains(text, '\\boxed'))::INT), 6) AS missing_boxed, round(avg(contains(text, '</think>')::INT), 6) AS think_closed FROM documents WHERE text IS NOT NULL GROUP BY lang")
def rates(spark, d):
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return table(spark, d, "documents").filter("text IS NOT NULL").groupBy("lang").agg(share(~F.contains("text", F.lit("\\boxed")), "missing_boxed"), share(F.contains("text", F.lit("</think>")), "think_closed"))


@book.query("ag10_generation_stats", "SELECT baseline_step, round(avg(response_token_count), 6) AS tokens, round(avg(response_truncated::INT), 6) AS truncated FROM rollout_metadata GROUP BY baseline_step")
def generation_stats(spark, d):
    return table(spark, d, "rollout_metadata").groupBy("baseline_step").agg(F.round(F.avg("response_token_count"), 6).alias("tokens"), F.round(F.avg(F.col("response_truncated").cast("int")), 6).alias("truncated"))


@book.query(
    "ag11_choice_scores",
    "SELECT o_orderpriority AS p, round(avg((list_contains(['A','B'], f))::INT), 6) AS first_ok, round(avg((f <> l)::INT), 6) AS changed FROM (SELECT o_orderpriority, chr(65 + (o_orderkey % 4)::INT) AS f, chr(65 + (o_custkey % 4)::INT) AS l FROM orders) GROUP BY 1",
)
def choice_scores(spark, d):
    letter = lambda c: F.char(65 + F.col(c) % 4)
    said = F.concat(F.lit("Think. answer: $"), letter("o_orderkey"), F.lit("$ no, Answer: \\boxed{"), letter("o_custkey"), F.lit("}"))
    a = score.choice_answers(F.col("said"))
    o = table(spark, d, "orders").withColumn("said", said).select("o_orderpriority", F.try_element_at(a, F.lit(1)).alias("f"), F.try_element_at(a, F.lit(-1)).alias("l"))
    return o.groupBy(F.col("o_orderpriority").alias("p")).agg(F.round(F.avg(F.col("f").isin("A", "B").cast("int")), 6).alias("first_ok"), F.round(F.avg((F.col("f") != F.col("l")).cast("int")), 6).alias("changed"))


@book.query(
    "ag12_first_k_samples",
    "SELECT l_orderkey, count(*)::BIGINT AS k, round(avg(l_discount), 6) AS rate, min(l_quantity) AS least, max(l_quantity) AS most, sum((l_discount > 0.05)::INT)::BIGINT AS correct FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount) AS r FROM lineitem) WHERE r <= 3 GROUP BY l_orderkey",
)
def first_k_samples(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount"))), 1, 3).alias("s"))
    q, x = F.transform("s", lambda v: v["l_quantity"]), F.transform("s", lambda v: v["l_discount"])
    return s.select("l_orderkey", F.size("s").cast("long").alias("k"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size("s"), 6).alias("rate"), F.array_min(q).alias("least"), F.array_max(q).alias("most"), F.size(F.filter(x, lambda v: v > 0.05)).cast("long").alias("correct"))


@book.query("ag13_average_of_four", "SELECT o_orderstatus AS arm, round((avg(v1) + avg(v2) + avg(v3) + avg(v4)) / 4, 6) AS avg4 FROM (SELECT o_orderstatus, o_totalprice AS v1, o_orderkey AS v2, o_custkey AS v3, length(o_orderpriority) AS v4 FROM orders) GROUP BY 1")
def average_of_four(spark, d):
    o = table(spark, d, "orders")
    four = [F.avg("o_totalprice"), F.avg("o_orderkey"), F.avg("o_custkey"), F.avg(F.length("o_orderpriority"))]
    return o.groupBy(F.col("o_orderstatus").alias("arm")).agg(F.round(sum(four[1:], four[0]) / 4, 6).alias("avg4"))


@book.query(
    "ag14_masked_logprobs",
    "SELECT l_orderkey, round(sum(lp), 6) AS total, round(avg(lp), 6) AS mean, round(avg((l_discount - l_tax > 0.02)::INT), 6) AS clipped FROM (SELECT l_orderkey, -l_discount * l_quantity AS lp, l_discount, l_tax FROM lineitem WHERE l_returnflag <> 'R') GROUP BY l_orderkey",
)
def masked_logprobs(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag <> 'R'")
    lp = -F.col("l_discount") * F.col("l_quantity")
    return li.groupBy("l_orderkey").agg(F.round(F.sum(lp), 6).alias("total"), F.round(F.avg(lp), 6).alias("mean"), F.round(F.avg((F.col("l_discount") - F.col("l_tax") > 0.02).cast("int")), 6).alias("clipped"))


K1 = "k1_mean IS NOT NULL AND NOT isnan(k1_mean)"


@book.query(
    "ag15_k1_statistics",
    f"SELECT round(avg(k1_mean), 9) AS mean, round(stddev_pop(k1_mean), 9) AS sd, round(avg(k1_mean * k1_mean), 9) AS ms, round(avg((k1_mean > 0)::INT), 6) AS positive, round(quantile_cont(k1_mean, 0.1), 9) AS q10, round(quantile_cont(k1_mean, 0.5), 9) AS q50, round(quantile_cont(k1_mean, 0.9), 9) AS q90 FROM rollout_metadata WHERE {K1}",
)
def k1_statistics(spark, d):
    r = table(spark, d, "rollout_metadata").filter(K1).select("index", "baseline_step", "k1_mean")
    k = F.col("k1_mean")
    a = r.agg(F.round(F.avg(k), 9).alias("mean"), F.round(F.stddev_pop(k), 9).alias("sd"), F.round(F.avg(k * k), 9).alias("ms"), F.round(F.avg((k > 0).cast("int")), 6).alias("positive"))
    q = quantiles(r, "k1_mean", ["index", "baseline_step"], {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return a.crossJoin(q.select(*(F.round(c, 9).alias(c) for c in ("q10", "q50", "q90"))))  # one row each


@book.query(
    "ag16_staleness",
    "SELECT l_returnflag AS g, round(avg(x * x), 9) AS mean_square, round(sum(w) * sum(w) / (sum(w * w) * count(*)), 6) AS ess FROM (SELECT l_returnflag, x, exp(greatest(-20, least(20, x))) AS w FROM (SELECT l_returnflag, l_discount - l_tax AS x FROM lineitem)) GROUP BY 1",
)
def staleness(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") - F.col("l_tax")).alias("x"))
    w = F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("x"))))
    return li.withColumn("w", w).groupBy("g").agg(F.round(F.avg(F.col("x") * F.col("x")), 9).alias("mean_square"), F.round(replay.ess(F.col("w")), 6).alias("ess"))


@book.query("ag17_rms_k1", "SELECT l_orderkey, round(sqrt(avg(x * x)), 9) AS rms FROM (SELECT l_orderkey, greatest(-10, least(10, l_tax - l_discount)) AS x FROM lineitem) GROUP BY l_orderkey")
def rms_k1(spark, d):
    x = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("l_tax") - F.col("l_discount")))
    return table(spark, d, "lineitem").withColumn("x", x).groupBy("l_orderkey").agg(F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 9).alias("rms"))


@book.query("ag18_token_counts", "SELECT baseline_step, sum(response_token_count)::BIGINT AS tokens, round(sum(score * response_token_count), 4) AS weighted FROM rollout_metadata WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY baseline_step")
def token_counts(spark, d):
    r = table(spark, d, "rollout_metadata").filter("score IS NOT NULL AND NOT isnan(score)")
    return r.groupBy("baseline_step").agg(F.sum("response_token_count").alias("tokens"), F.round(F.sum(F.col("score") * F.col("response_token_count")), 4).alias("weighted"))


@book.query(
    "ag24_mass_stats",
    "SELECT round(avg(c_acctbal), 4) AS mean, min(c_acctbal) AS least, round(quantile_cont(c_acctbal, 0.05), 4) AS p05, round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.95), 4) AS p95, max(c_acctbal) AS most, round(sum(c_acctbal), 2) AS total FROM customer",
)
def mass_stats(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    q = quantiles(c, "c_acctbal", ["c_custkey"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}).select(*(F.round(x, 4).alias(x) for x in ("p05", "p50", "p95")))
    return c.agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("most"), F.round(F.sum("c_acctbal"), 2).alias("total")).crossJoin(q)  # one row each


@book.query(
    "ag30_cost_metrics",
    "SELECT c_mktsegment AS g, round(avg(c_acctbal), 4) AS mean, round(quantile_cont(c_acctbal, 0.5), 4) AS p50, round(quantile_cont(c_acctbal, 0.9), 4) AS p90, round(quantile_cont(c_acctbal, 0.95), 4) AS p95, max(c_acctbal) AS most, round(avg((c_acctbal >= 9000)::INT), 6) AS capped FROM customer GROUP BY 1",
)
def cost_metrics(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), "c_custkey", "c_acctbal")
    q = quantiles(c, "c_acctbal", ["c_custkey"], {"p50": 0.5, "p90": 0.9, "p95": 0.95}, ("g",)).select("g", *(F.round(x, 4).alias(x) for x in ("p50", "p90", "p95")))
    a = c.groupBy("g").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.max("c_acctbal").alias("most"), F.round(F.avg((F.col("c_acctbal") >= 9000).cast("int")), 6).alias("capped"))
    return a.join(q, "g")


@book.query(
    "ag28_concentration",
    "WITH v AS (SELECT l_suppkey, sum(l_discount) AS x FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY x DESC, l_suppkey) AS r, count(*) OVER () AS n FROM v WHERE x > 0) SELECT round(max(x) / sum(x), 6) AS top1, round(sum(x) FILTER (WHERE r <= greatest(1, n // 4)) / sum(x), 6) AS quartile FROM r",
)
def concentration(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("x")).filter("x > 0")
    r = ranks.ranked(v, [F.desc("x"), F.col("l_suppkey")], "r", (), "n")
    top = F.sum(F.when(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.col("x")))
    return r.agg(F.round(F.max("x") / F.sum("x"), 6).alias("top1"), F.round(top / F.sum("x"), 6).alias("quartile"))


@book.query("ag32_domain_counters", "SELECT baseline_step, count(*)::BIGINT AS records, sum(response_token_count)::BIGINT AS tokens, count(DISTINCT index)::BIGINT AS prompts FROM rollout_metadata GROUP BY 1")
def domain_counters(spark, d):
    # Distinct prompts in two steps: a step with very many rows is spread over its prompts first.
    g = table(spark, d, "rollout_metadata").groupBy("baseline_step", "index").agg(F.count(F.lit(1)).alias("records"), F.sum("response_token_count").alias("tokens"))
    return g.groupBy("baseline_step").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"), F.count("index").alias("prompts"))


@book.query(
    "ag33_clustered_error",
    "SELECT l_returnflag AS g, round(sum(v) / sum(t), 9) AS mean, round(CASE WHEN count(*) < 2 THEN 0 ELSE sqrt(count(*)) * stddev_samp(v) / sum(t) END, 9) AS se FROM (SELECT l_returnflag, l_orderkey, sum(l_discount * l_quantity) AS v, sum(l_quantity) AS t FROM lineitem GROUP BY ALL) GROUP BY 1",
)
def clustered_error(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_orderkey").agg(F.sum(F.col("l_discount") * F.col("l_quantity")).alias("v"), F.sum("l_quantity").alias("t"))
    n = F.count(F.lit(1))
    return r.groupBy("g").agg(F.round(F.sum("v") / F.sum("t"), 9).alias("mean"), F.round(F.when(n < 2, 0.0).otherwise(F.sqrt(n) * F.stddev_samp("v") / F.sum("t")), 9).alias("se"))


# Replay.


def responses(spark, d):
    r = table(spark, d, "rollout_metadata").filter(f"{CLEAN} AND {K1} AND response_token_count IS NOT NULL")
    return r.groupBy("index").agg(F.max("response_token_count").cast("double").alias("cost"), F.max(F.abs("k1_mean")).alias("score"))


@book.query(
    "kn08_inclusion",
    f"""WITH r0 AS (SELECT index, max(response_token_count)::DOUBLE AS c, max(abs(k1_mean)) AS s FROM rollout_metadata WHERE {CLEAN} AND {K1} AND response_token_count IS NOT NULL GROUP BY index),
    r AS (SELECT index, c, greatest(s, (SELECT min(s) FROM r0 WHERE s > 0)) AS s FROM r0), b AS (SELECT 0.3 * sum(c) AS budget, 0.01 * sum(c) AS least FROM r),
    e AS (SELECT x, sum(slope) AS slope, sum(more) AS more FROM (SELECT 0.01 / s AS x, c * s AS slope, -0.01 * c AS more FROM r UNION ALL SELECT 1 / s, -c * s, c FROM r) GROUP BY x),
    w AS (SELECT x, slope, sum(slope) OVER o AS k, least + sum(more) OVER o + x * sum(slope) OVER o AS f, budget FROM e, b WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT arg_min(x - (f - budget) / (k - slope), x) AS rate FROM w WHERE f >= budget - 1e-9 * budget),
    q AS (SELECT c, least(1, greatest(0.01, rate * s)) AS q FROM r, l)
    SELECT count(*)::BIGINT AS n, round(sum(q * c), 2) AS spent, round(0.3 * sum(c), 2) AS budget, count(*) FILTER (WHERE q >= 1)::BIGINT AS certain, count(*) FILTER (WHERE q <= 0.01)::BIGINT AS least FROM q""",
)
def inclusion(spark, d):
    r = responses(spark, d)
    budget = 0.3 * r.agg(F.sum("cost")).first()[0]
    q = replay.inclusion_probabilities(r, "cost", "score", budget)
    n = lambda c: F.count(F.when(c, 1))
    return q.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("q") * F.col("cost")), 2).alias("spent"), F.round(F.lit(budget), 2).alias("budget"), n(F.col("q") >= 1).alias("certain"), n(F.col("q") <= 0.01).alias("least"))


@book.query(
    "kn10_bernoulli_draw",
    "WITH u AS (SELECT index, least(1, 0.05 + ((index % 10 + 10) % 10) / 20.0)::DOUBLE AS q, ('0x' || substr(sha256('[7,\"draw\",1,' || index || ']'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM (SELECT DISTINCT index FROM rollout_metadata WHERE index IS NOT NULL)) SELECT index, round(1 / q, 6) AS weight FROM u WHERE u < q",
)
def draw(spark, d):
    r = table(spark, d, "rollout_metadata").filter("index IS NOT NULL").select("index").distinct().withColumn("q", F.least(F.lit(1.0), 0.05 + F.pmod("index", F.lit(10)) / 20.0))
    return replay.bernoulli_draw(r, "index", "q", 7, 1).select("index", F.round("weight", 6).alias("weight"))


@book.query(
    "sx01_fifo_buffer",
    "SELECT schedule_id AS run, step AS batch, count(*)::BIGINT AS rows_in, dense_rank() OVER (PARTITION BY schedule_id ORDER BY step DESC) - 1 AS age FROM order_rows WHERE step IS NOT NULL GROUP BY schedule_id, step QUALIFY age < 4",
)
def fifo_buffer(spark, d):
    o = table(spark, d, "order_rows").select(F.col("schedule_id").alias("run"), F.col("step").alias("batch"))
    return replay.fifo_buffer(o, "run", "batch", 4)


@book.query(
    "sx02_cycle_schedule",
    "SELECT step, CASE WHEN k >= 6 THEN 2 ELSE 0 END AS replays, (k >= 6 AND (k - 6) % 3 = 0) AS refresh FROM (SELECT step, row_number() OVER (ORDER BY step) AS k FROM (SELECT DISTINCT baseline_step AS step FROM rollout_metadata WHERE baseline_step IS NOT NULL))",
)
def cycle_schedule(spark, d):
    s = table(spark, d, "rollout_metadata").filter("baseline_step IS NOT NULL").select(F.col("baseline_step").alias("step")).distinct()
    return replay.cycle_schedule(s, "step", capacity=6, draws=2, every=3)


@book.query(
    "sx05_paired_contrast",
    "SELECT count(*)::BIGINT AS n, round(avg(a - b), 9) AS diff, round(stddev_samp(a - b) / sqrt(count(*)), 9) AS se FROM (SELECT l_orderkey, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1)",
)
def paired_contrast(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.avg("l_discount") - F.avg("l_tax")).alias("x"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 9).alias("diff"), F.round(F.stddev_samp("x") / F.sqrt(F.count(F.lit(1))), 9).alias("se"))


@book.query("sx07_padding", "SELECT source, n, (8 - n % 8) % 8 AS padding, n + (8 - n % 8) % 8 AS padded FROM (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source)")
def padding(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    pad = (8 - F.col("n") % 8) % 8
    return g.select("source", "n", pad.alias("padding"), (F.col("n") + pad).alias("padded"))


@book.query("sx08_count_sketch")
def count_sketch(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return replay.count_sketch(rows.withColumn("v", F.col("v").cast("double")), "label", "i", "v", 7, 32)


@book.query("sx09_manifest", "SELECT count(*)::BIGINT AS rows_in, count(DISTINCT source)::BIGINT AS sources, sum(rendered.n_tokens)::BIGINT AS tokens, count(*) FILTER (WHERE tests_json <> '')::BIGINT AS with_tests, min(created_at) AS first_at, max(created_at) AS last_at FROM sft_candidate")
def manifest(spark, d):
    # One row a source first, so that the distinct count needs no expansion of the rows.
    g = table(spark, d, "sft_candidate").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("rendered.n_tokens").alias("t"), F.count(F.when(F.col("tests_json") != "", 1)).alias("w"), F.min("created_at").alias("a"), F.max("created_at").alias("z"))
    return g.agg(F.sum("n").alias("rows_in"), F.count("source").alias("sources"), F.sum("t").alias("tokens"), F.sum("w").alias("with_tests"), F.min("a").alias("first_at"), F.max("z").alias("last_at"))


@book.query(
    "mf10_stop_events",
    "SELECT l_returnflag AS g, round(avg(ln(p)), 9) AS log_stop, round(avg(ln(1 - p)), 9) AS log_go, round(avg(p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q))), 9) AS kl FROM (SELECT l_returnflag, greatest(1e-6, least(1 - 1e-6, l_discount)) AS p, greatest(1e-6, least(1 - 1e-6, l_tax)) AS q FROM lineitem) GROUP BY 1",
)
def stop_events(spark, d):
    clip = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), clip("l_discount").alias("p"), clip("l_tax").alias("q"))
    p, q = F.col("p"), F.col("q")
    return li.groupBy("g").agg(F.round(F.avg(F.log(p)), 9).alias("log_stop"), F.round(F.avg(F.log(1 - p)), 9).alias("log_go"), F.round(F.avg(p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))), 9).alias("kl"))


@book.query(
    "mf11_importance_terms",
    "SELECT l_linestatus AS g, round(sum(w * v) / count(*), 9) AS raw, round(sum(least(w, 1.02) * v) / count(*), 9) AS capped, round(sum(w) * sum(w) / (sum(w * w) * count(*)), 6) AS ess, round(sum(w - least(w, 1.02)) / sum(w), 9) AS removed FROM (SELECT l_linestatus, exp(greatest(-50, least(50, l_discount - l_tax))) AS w, l_tax AS v FROM lineitem) GROUP BY 1",
)
def importance_terms(spark, d):
    w = F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("l_discount") - F.col("l_tax"))))
    li = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("g"), w.alias("w"), F.col("l_tax").alias("v"))
    cut, n = F.least("w", F.lit(1.02)), F.count(F.lit(1))
    return li.groupBy("g").agg(F.round(F.sum(F.col("w") * F.col("v")) / n, 9).alias("raw"), F.round(F.sum(cut * F.col("v")) / n, 9).alias("capped"), F.round(replay.ess(F.col("w")), 6).alias("ess"), F.round(F.sum(F.col("w") - cut) / F.sum("w"), 9).alias("removed"))


@book.query(
    "mf01_log_softmax",
    "SELECT l_orderkey, l_linenumber, round(max(x - m - ln(z)), 9) AS lp FROM (SELECT *, sum(exp(x - m)) OVER (PARTITION BY l_orderkey) AS z FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS x, max(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem)) GROUP BY ALL",
)
def log_softmax(spark, d):
    w = W.partitionBy("l_orderkey")  # the ids of one position are few
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("x")).withColumn("m", F.max("x").over(w))
    lp = F.col("x") - F.col("m") - F.log(F.sum(F.exp(F.col("x") - F.col("m"))).over(w))
    return x.withColumn("lp", lp).groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max("lp"), 9).alias("lp"))


@book.query("sk05_pivot", "SELECT l_shipyear, coalesce(sum(q) FILTER (WHERE f = 'A'), 0)::BIGINT AS A, coalesce(sum(q) FILTER (WHERE f = 'N'), 0)::BIGINT AS N, coalesce(sum(q) FILTER (WHERE f = 'R'), 0)::BIGINT AS R FROM (SELECT year(l_shipdate)::INTEGER AS l_shipyear, l_returnflag AS f, 1 AS q FROM lineitem) GROUP BY 1")
def pivot(spark, d):
    li = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("l_shipyear"), "l_returnflag")
    return li.groupBy("l_shipyear").pivot("l_returnflag", ["A", "N", "R"]).count().fillna(0)
