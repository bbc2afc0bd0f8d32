"""Pool curation: unwrapping, validation, deduplication, conflicts, decontamination, funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import curate
from quern.operators.joins import range_join
from quern.operators.quantiles import quantiles
from quern.operators.ranks import ranked
from quern.plans.base import Book, table

book = Book()
QUERIES, SQL = book.queries, book.sql

FLAGSHIP = """
WITH keyed AS (SELECT doc_id, source, lang, text, regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g') AS k FROM documents WHERE text IS NOT NULL),
grouped AS (SELECT k, count(*) AS copies, count(DISTINCT lang) AS langs, first(text ORDER BY doc_id) AS text, first(source ORDER BY doc_id) AS source, min(doc_id) AS doc_id FROM keyed WHERE k <> '' GROUP BY k),
words AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(NFKC(text)), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM grouped),
grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 6)), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS g FROM words WHERE len(w) > 0),
bw AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(NFKC(problem)), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM heldout_item),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(2, len(w) - 6)), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))) AS g FROM bw WHERE len(w) > 0),
bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS c FROM grams JOIN bg USING (g) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM hit JOIN bn USING (item_id) WHERE c >= 0.5 * n)
SELECT source, count(*)::BIGINT AS kept, sum(copies)::BIGINT AS rows_in, sum(CASE WHEN langs > 1 THEN 1 ELSE 0 END)::BIGINT AS conflicts
FROM grouped WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY source
"""


@book.query("flagship_curated_pool", FLAGSHIP)
def flagship(spark, d):
    pool = curate.collapse_by_key(table(spark, d, "documents"), X.loose_key(F.col("text")), "doc_id", ["text", "source"], "lang")
    items = table(spark, d, "heldout_item").select("item_id", "problem")
    clean = curate.decontaminate(pool, items, "doc_id", "text", "item_id", "problem", 8, 0.5)
    return clean.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), F.sum("copies").alias("rows_in"), F.sum((F.col("values") > 1).cast("long")).alias("conflicts"))


RANKED_POOL = FLAGSHIP.split("\nSELECT")[0] + """
SELECT doc_id, source, copies::BIGINT AS copies, row_number() OVER (PARTITION BY source ORDER BY sha256('[42,"stratum",' || doc_id || ']'), doc_id) AS rank, count(*) OVER (PARTITION BY source) AS kept
FROM grouped WHERE langs <= 1 AND doc_id NOT IN (SELECT doc_id FROM bad)
AND k NOT IN (SELECT regexp_replace(lower(NFKC(problem)), '[^0-9a-z]', '', 'g') FROM heldout_item WHERE problem IS NOT NULL)
"""


@book.query("flagship_ranked_pool", RANKED_POOL)
def ranked_pool(spark, d):
    pool = curate.collapse_by_key(table(spark, d, "documents"), X.loose_key(F.col("text")), "doc_id", ["text", "source"], "lang").filter("values <= 1")
    items = table(spark, d, "heldout_item").select("item_id", "problem")
    # An item of under 8 words has no 8-gram, so a copy of it is only found by its key.
    pool = pool.join(items.select(X.loose_key(F.col("problem")).alias("key")).distinct(), "key", "left_anti")
    clean = curate.decontaminate(pool, items, "doc_id", "text", "item_id", "problem", 8, 0.5)
    h = clean.select("doc_id", "source", "copies", X.stable_hash(42, "stratum", F.col("doc_id").cast("string")).alias("h"))
    return ranked(h, ["h", "doc_id"], "rank", ("source",), "kept").select("doc_id", "source", "copies", "rank", "kept")


@book.query(
    "pf01_unwrap",
    """WITH p AS (SELECT cand_id, starts_with(code, '```python' || chr(10)) AS p, CASE WHEN starts_with(code, '```python' || chr(10)) THEN substr(code, 11) ELSE code END AS t FROM sft_candidate WHERE code IS NOT NULL),
    s AS (SELECT *, ends_with(t, chr(10) || '```') AS s, CASE WHEN ends_with(t, chr(10) || '```') THEN left(t, length(t) - 4) ELSE t END AS u FROM p)
    SELECT cand_id, CASE WHEN p AND s THEN 'both' WHEN p OR s THEN 'partial' ELSE 'neither' END AS wrap, sha256(regexp_replace(u, '^WS+|WS+$', '', 'g')) AS inner_hash FROM s""".replace("WS", r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"),
)
def unwrap(spark, d):
    out = curate.unwrap(table(spark, d, "sft_candidate").filter("code IS NOT NULL"), "code", "```python\n", "\n```")
    return out.select("cand_id", "wrap", F.sha2("inner", 256).alias("inner_hash"))


PROMPTS = "CASE coalesce(kind, '') WHEN 'statement' THEN 1 WHEN 'editorial' THEN 2 ELSE 3 END"


def prompts(spark, d):
    m = lambda role, c: F.struct(c.alias("content"), F.lit(role).alias("role"))
    docs = table(spark, d, "documents")
    user, system, other = m("user", F.col("text")), m("system", F.lit("Solve it.")), m("assistant", F.lit("Yes."))
    prompt = F.when(F.col("kind") == "statement", F.array(user)).when(F.col("kind") == "editorial", F.array(system, user)).otherwise(F.array(user, other, user))
    return docs.withColumn("prompt", prompt)


@book.query("pf02_single_turn", f"SELECT coalesce(kind, '?') AS kind, count(*)::BIGINT AS rows_in, sum(CASE WHEN {PROMPTS} = 1 THEN 1 ELSE 0 END)::BIGINT AS kept FROM documents GROUP BY 1")
def single_turn(spark, d):
    one = (F.size("prompt") == 1) & (F.col("prompt")[0]["role"] == "user")
    return prompts(spark, d).groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count(F.lit(1)).alias("rows_in"), F.sum(one.cast("long")).alias("kept"))


@book.query("pf03_one_user", f"SELECT doc_id, length(text)::BIGINT AS content_length FROM documents WHERE {PROMPTS} <= 2")
def one_user(spark, d):
    users = F.filter("prompt", lambda x: x["role"] == "user")
    return prompts(spark, d).filter(F.size(users) == 1).select("doc_id", F.length(users[0]["content"]).cast("long").alias("content_length"))


CHECKED = """SELECT cand_id, CASE WHEN tests_json IS NULL OR tests_json = '' THEN 'absent' WHEN NOT json_valid(tests_json) THEN 'invalid_json'
WHEN json_type(tests_json) <> 'OBJECT' THEN 'not_object' WHEN json_exists(tests_json, '$.fn_name') THEN 'call_based'
WHEN coalesce(json_type(tests_json, '$.inputs'), '') <> 'ARRAY' OR coalesce(json_type(tests_json, '$.outputs'), '') <> 'ARRAY' THEN 'missing_arrays'
WHEN json_array_length(tests_json, '$.inputs') <> json_array_length(tests_json, '$.outputs') THEN 'length_mismatch'
WHEN json_array_length(tests_json, '$.inputs') = 0 THEN 'empty' ELSE 'ok' END AS reason FROM sft_candidate"""


@book.query("pf04_test_schema", f"SELECT cand_id, reason, CASE WHEN reason = 'ok' THEN least(2, json_array_length(tests_json, '$.inputs'))::BIGINT END AS kept_tests FROM ({CHECKED}) JOIN sft_candidate USING (cand_id)")
def test_schema(spark, d):
    c = table(spark, d, "sft_candidate").select("cand_id", "tests_json").withColumn("reason", curate.test_reason(F.col("tests_json")))
    tests = curate.trimmed_tests(F.col("tests_json"), 2)
    return c.select("cand_id", "reason", F.when(F.col("reason") == "ok", F.size(tests["inputs"])).cast("long").alias("kept_tests"))


@book.query("pf05_suffix", "SELECT doc_id, length(CASE WHEN ends_with(text, ' Answer:') THEN text ELSE text || ' Answer:' END)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def suffix(spark, d):
    once = curate.with_suffix(F.col("text"), " Answer:")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.length(curate.with_suffix(once, " Answer:")).cast("long").alias("n"))


@book.query("pf06_token_budget", "SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(string_split(regexp_replace(lower(NFKC(text)), '[^0-9a-z]+', ' ', 'g'), ' '), lambda w: w <> ''))::BIGINT AS n FROM documents WHERE text IS NOT NULL) WHERE n <= 120")
def token_budget(spark, d):
    n = F.size(X.words_of(F.col("text"))).cast("long")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", n.alias("n")).filter("n <= 120")


FIELDS = "SELECT raw_id, lower(k) AS k, json_extract_string(payload, '$.\"' || k || '\"') AS v FROM (SELECT raw_id, payload, unnest(json_keys(payload)) AS k FROM raw_record WHERE json_valid(payload))"


@book.query(
    "pf07_adapters",
    f"""SELECT raw_id, hub, max(v) FILTER (WHERE k = 'style') AS style, max(v) FILTER (WHERE k = 'license') AS license,
    length(max(v) FILTER (WHERE k = 'problem'))::BIGINT AS problem_length FROM ({FIELDS}) JOIN raw_record USING (raw_id) GROUP BY raw_id, hub""",
)
def adapters(spark, d):
    got = curate.adapt_payload(table(spark, d, "raw_record"), "payload", ["style", "license", "problem"])
    return got.select("raw_id", "hub", "style", "license", F.length("problem").cast("long").alias("problem_length"))


@book.query("pf08_reject_reasons", f"SELECT reason, count(*)::BIGINT AS n FROM ({CHECKED}) GROUP BY reason")
def reject_reasons(spark, d):
    c = table(spark, d, "sft_candidate").select(curate.test_reason(F.col("tests_json")).alias("reason"))
    return c.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@book.query("pf09_first_present", "SELECT cand_id, coalesce(nullif(family_id, ''), nullif(native_id, ''), nullif(source_row_id, '')) AS key FROM sft_candidate")
def first_present(spark, d):
    return table(spark, d, "sft_candidate").select("cand_id", curate.first_present("family_id", "native_id", "source_row_id").alias("key"))


@book.query("pf10_flat_strings", f"SELECT raw_id, count(*)::BIGINT AS strings, sum(length(trim(v)))::BIGINT AS chars FROM ({FIELDS}) WHERE length(trim(v)) >= 24 GROUP BY raw_id")
def flat_strings(spark, d):
    values = curate.payload_strings(table(spark, d, "raw_record"), "payload").filter("length(trim(value)) >= 24")
    return values.groupBy("raw_id").agg(F.count(F.lit(1)).alias("strings"), F.sum(F.length(F.trim("value"))).alias("chars"))


@book.query("pf11_valid_code")
def valid_code(spark, d):
    c = table(spark, d, "sft_candidate").select("cand_id", "code", X.last_fence(F.col("code")).alias("inner"))
    body = F.coalesce("inner", "code")
    return c.withColumn("ok", X.python_ok(body) & (F.length(body) >= 20) & ~F.coalesce(F.contains("code", F.lit("<think>")), F.lit(False))).select("cand_id", "ok")


@book.query(
    "pf12_repeated_lines",
    """WITH l AS (SELECT cand_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS line FROM (SELECT cand_id, unnest(string_split(code, chr(10))) AS x FROM sft_candidate WHERE code IS NOT NULL)),
    k AS (SELECT cand_id, count(*) AS lines FROM l WHERE line <> '' GROUP BY cand_id), r AS (SELECT cand_id, max(n) AS most FROM (SELECT cand_id, line, count(*) AS n FROM l WHERE length(line) >= 8 GROUP BY ALL) GROUP BY cand_id)
    SELECT cand_id, lines::BIGINT AS lines, most::BIGINT AS most FROM k JOIN r USING (cand_id) WHERE lines >= 12 AND most >= 2""",
)
def repeated_lines(spark, d):
    out = curate.line_counts(table(spark, d, "sft_candidate").filter("code IS NOT NULL"), "cand_id", "code", 8)
    return out.filter("lines >= 12 AND most >= 2").select("cand_id", "lines", "most")


@book.query("pf14_style")
def style(spark, d):
    c = table(spark, d, "sft_candidate").filter("code IS NOT NULL")
    return c.select("cand_id", curate.code_style(F.col("code"), F.col("tests_json"), F.col("problem")).alias("style"))


@book.query(
    "pf15_difficulty",
    "SELECT CASE WHEN regexp_matches(d, 'hard|advanced|expert') THEN 'hard' WHEN regexp_matches(d, 'easy|intro|basic') THEN 'easy' ELSE 'medium' END AS level, count(*)::BIGINT AS n FROM (SELECT lower(coalesce(difficulty, '')) AS d FROM sft_candidate) GROUP BY 1",
)
def difficulty(spark, d):
    return table(spark, d, "sft_candidate").groupBy(curate.difficulty_level(F.col("difficulty")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@book.query(
    "pf16_difficulty_bin",
    "SELECT CASE WHEN score IS NULL OR isnan(score) THEN 'none' WHEN score = 0 THEN 'zero' WHEN score < 0.5 THEN 'low' WHEN score < 1 THEN 'high' ELSE 'perfect' END AS bin, count(*)::BIGINT AS n FROM rollout_metadata GROUP BY 1",
)
def difficulty_bin(spark, d):
    s = F.col("score")
    level = F.when(s.isNull() | F.isnan(s), "none").when(s == 0, "zero").when(s < 0.5, "low").when(s < 1, "high").otherwise("perfect")
    return table(spark, d, "rollout_metadata").groupBy(level.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@book.query("pf17_required_suffix", "SELECT doc_id FROM documents WHERE ends_with(text, '.') AND NOT ends_with(text, '..')")
def required_suffix(spark, d):
    return table(spark, d, "documents").filter("endswith(text, '.') AND NOT endswith(text, '..')").select("doc_id")


@book.query(
    "pf18_probe_budget",
    """SELECT index, keep::BIGINT AS keep, response_token_count > keep AS truncated, count(*)::BIGINT AS n FROM (SELECT index, response_token_count, least(response_token_count, 2048, 2300 - prompt_token_count) AS keep
    FROM rollout_metadata WHERE prompt_token_count IS NOT NULL AND response_token_count IS NOT NULL) WHERE keep > 0 GROUP BY ALL""",
)
def probe_budget(spark, d):
    r = table(spark, d, "rollout_metadata").filter("prompt_token_count IS NOT NULL AND response_token_count IS NOT NULL")
    r = r.withColumn("keep", F.least("response_token_count", F.lit(2048), 2300 - F.col("prompt_token_count")).cast("long")).filter("keep > 0")
    return r.groupBy("index", "keep", (F.col("response_token_count") > F.col("keep")).alias("truncated")).agg(F.count(F.lit(1)).alias("n"))


@book.query(
    "pf19_mask",
    """SELECT l_orderkey, count(*)::BIGINT AS kept, round(sum(l_quantity), 6) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    WHERE i <= 2 OR i > n - 1 GROUP BY l_orderkey""",
)
def mask(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("t"))
    kept = curate.prefix_or_suffix("t", 2, 1)
    return rows.select("l_orderkey", F.size(kept).cast("long").alias("kept"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["l_quantity"]), 6).alias("qty"))


@book.query(
    "pf20_typical_band",
    """WITH q AS (SELECT quantile_cont(c_acctbal, 0.1) AS lo, quantile_cont(c_acctbal, 0.9) AS hi FROM customer)
    SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer, q WHERE c_acctbal BETWEEN lo AND hi GROUP BY c_mktsegment""",
)
def typical_band(spark, d):
    c = table(spark, d, "customer")
    q = quantiles(c.select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], {"lo": 0.1, "hi": 0.9}).first()  # one row
    return c.filter(F.col("c_acctbal").between(q.lo, q.hi)).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@book.query("pf21_short_carriers", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= (SELECT quantile_cont(n_chars, 0.25) FROM documents)")
def short_carriers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    q = quantiles(docs, "n_chars", ["doc_id"], {"q": 0.25}).first().q  # one row
    return docs.filter(F.col("n_chars") <= q)


# Joins.


@book.query(
    "jn01_metadata_join",
    """WITH m AS (SELECT index, min(baseline_step) AS step FROM rollout_metadata WHERE index IS NOT NULL GROUP BY index)
    SELECT data_source, count(*)::BIGINT AS rows_in, count(index)::BIGINT AS matched, sum(step)::BIGINT AS steps FROM (SELECT data_source, TRY_CAST(TRY_CAST(source_index AS DOUBLE) AS BIGINT) AS i FROM order_rows) LEFT JOIN m ON i = index GROUP BY data_source""",
)
def metadata_join(spark, d):
    m = table(spark, d, "rollout_metadata").filter("index IS NOT NULL").groupBy("index").agg(F.min("baseline_step").alias("step"))
    o = table(spark, d, "order_rows").select("data_source", F.expr("try_cast(try_cast(source_index AS double) AS bigint)").alias("index"))
    return o.join(m.withColumn("hit", F.lit(1)), "index", "left").groupBy("data_source").agg(F.count(F.lit(1)).alias("rows_in"), F.count("hit").alias("matched"), F.sum("step").alias("steps"))


@book.query(
    "jn02_set_equality",
    """WITH a AS (SELECT DISTINCT schedule_id AS s, item_sha256 AS i FROM order_rows WHERE item_sha256 IS NOT NULL), b AS (SELECT DISTINCT support_id AS s, item_sha256 AS i FROM support_rows WHERE item_sha256 IS NOT NULL)
    SELECT s, count(*) FILTER (WHERE x AND y)::BIGINT AS shared, count(*) FILTER (WHERE x AND y IS NULL)::BIGINT AS only_order, count(*) FILTER (WHERE x IS NULL AND y)::BIGINT AS only_support
    FROM (SELECT s, i, true AS x FROM a) FULL JOIN (SELECT s, i, true AS y FROM b) USING (s, i) GROUP BY s""",
)
def set_equality(spark, d):
    a = table(spark, d, "order_rows").filter("item_sha256 IS NOT NULL").select(F.col("schedule_id").alias("s"), F.col("item_sha256").alias("i")).distinct()
    b = table(spark, d, "support_rows").filter("item_sha256 IS NOT NULL").select(F.col("support_id").alias("s"), F.col("item_sha256").alias("i")).distinct()
    both = a.withColumn("x", F.lit(1)).join(b.withColumn("y", F.lit(1)), ["s", "i"], "full_outer")
    return both.groupBy("s").agg(F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("shared"), F.count(F.when(F.col("y").isNull(), 1)).alias("only_order"), F.count(F.when(F.col("x").isNull(), 1)).alias("only_support"))


@book.query("jn03_subset", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def subset(spark, d):
    keys = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(keys, "c_custkey", "left_semi")


@book.query(
    "jn04_order_items",
    """WITH s AS (SELECT support_id, item_sha256, min(rank) AS rank FROM support_rows WHERE item_sha256 IS NOT NULL GROUP BY ALL)
    SELECT o.schedule_id, o.item_sha256, count(*)::BIGINT AS presentations, min(o.position) AS first_position, s.rank FROM order_rows o JOIN s ON o.schedule_id = s.support_id AND o.item_sha256 = s.item_sha256 GROUP BY ALL""",
)
def order_items(spark, d):
    s = table(spark, d, "support_rows").filter("item_sha256 IS NOT NULL").groupBy(F.col("support_id").alias("schedule_id"), "item_sha256").agg(F.min("rank").alias("rank"))
    # Aggregated before the join: a hot item is one row a schedule.
    o = table(spark, d, "order_rows").groupBy("schedule_id", "item_sha256").agg(F.count(F.lit(1)).alias("presentations"), F.min("position").alias("first_position"))
    return o.join(s, ["schedule_id", "item_sha256"]).select("schedule_id", "item_sha256", "presentations", "first_position", "rank")


@book.query("jn05_exact_decontamination", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g') NOT IN (SELECT regexp_replace(lower(NFKC(problem)), '[^0-9a-z]', '', 'g') FROM heldout_item WHERE problem IS NOT NULL)")
def exact_decontamination(spark, d):
    items = table(spark, d, "heldout_item").select(X.loose_key(F.col("problem")).alias("k")).distinct()
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.loose_key(F.col("text")).alias("k")).join(items, "k", "left_anti").select("doc_id")


GRAMS = FLAGSHIP.replace("FROM grouped)", "FROM documents WHERE text IS NOT NULL)").split("bad AS")[0].rstrip().rstrip(",").replace("grouped AS (SELECT k, count(*) AS copies, count(DISTINCT lang) AS langs, first(text ORDER BY doc_id) AS text, first(source ORDER BY doc_id) AS source, min(doc_id) AS doc_id FROM keyed WHERE k <> '' GROUP BY k),\n", "")


@book.query("jn06_ngram_overlap", GRAMS + " SELECT doc_id, item_id, c::BIGINT AS overlap, round(c / n, 6) AS containment FROM hit JOIN bn USING (item_id) WHERE c >= 4")
def ngram_overlap(spark, d):
    hits = curate.ngram_overlap(table(spark, d, "documents"), table(spark, d, "heldout_item"), "doc_id", "text", "item_id", "problem", 8)
    return hits.filter("overlap >= 4").select("doc_id", "item_id", "overlap", F.round(F.col("overlap") / F.col("size"), 6).alias("containment"))


@book.query("jn08_family_duplicates", "SELECT source, family_id, count(*)::BIGINT AS n, min(cand_id) AS first_id, count(DISTINCT sha256(coalesce(code, '')))::BIGINT AS codes FROM sft_candidate WHERE family_id <> '' GROUP BY ALL HAVING count(*) > 1")
def family_duplicates(spark, d):
    c = table(spark, d, "sft_candidate").filter("family_id <> ''").select("source", "family_id", "cand_id", F.sha2(F.coalesce("code", F.lit("")), 256).alias("h"))
    # Two steps, so that a family with very many rows is combined before it meets in one task.
    c = c.groupBy("source", "family_id", "h").agg(F.count(F.lit(1)).alias("n"), F.min("cand_id").alias("first_id"))
    return c.groupBy("source", "family_id").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("codes")).filter("n > 1")


@book.query("jn09_task_outputs", "SELECT o_orderkey, o_orderpriority, count(l_orderkey)::BIGINT AS outputs FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def task_outputs(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("outputs"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(n, "o_orderkey", "left").fillna(0, ["outputs"])


@book.query("jn11_matched_control", "SELECT count(*)::BIGINT AS pairs, round(sum(abs(c_acctbal - s_acctbal)), 4) AS gap FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 25")
def matched_control(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return range_join(c, s, "c_acctbal", "s_acctbal", 25.0, ("nation",)).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.abs(F.col("c_acctbal") - F.col("s_acctbal"))), 4).alias("gap"))


@book.query("jn12_range_pairs", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 2")
def range_pairs(spark, d):
    c, s = table(spark, d, "customer").select("c_custkey", "c_acctbal"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return range_join(c, s, "c_acctbal", "s_acctbal", 2.0).select("c_custkey", "s_suppkey")


@book.query(
    "jn17_aligned_tables",
    """SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE a.l_orderkey IS NULL)::BIGINT AS left_missing, count(*) FILTER (WHERE o_orderkey IS NULL)::BIGINT AS right_missing
    FROM (SELECT DISTINCT l_orderkey FROM lineitem) a FULL JOIN orders ON l_orderkey = o_orderkey""",
)
def aligned_tables(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey").distinct()
    b = table(spark, d, "orders").select("o_orderkey")
    j = a.join(b, a.l_orderkey == b.o_orderkey, "full_outer")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_orderkey").isNull(), 1)).alias("left_missing"), F.count(F.when(F.col("o_orderkey").isNull(), 1)).alias("right_missing"))


@book.query("jn18_unordered_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def unordered_pairs(spark, d):
    return table(spark, d, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count(F.lit(1)).alias("n"))


# Aggregates of curation.


@book.query(
    "ag01_key_groups",
    """SELECT sha256(k) AS key, count(*)::BIGINT AS rows_in, count(DISTINCT lang)::BIGINT AS values, first(source ORDER BY doc_id) AS first_source, list_slice(list_sort(list(doc_id)), 1, 8) AS ids
    FROM (SELECT *, regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g') AS k FROM documents WHERE text IS NOT NULL) WHERE k <> '' GROUP BY k""",
)
def key_groups(spark, d):
    g = curate.collapse_by_key(table(spark, d, "documents"), X.loose_key(F.col("text")), "doc_id", ["source"], "lang", ids=8)
    return g.select(F.sha2("key", 256).alias("key"), F.col("copies").alias("rows_in"), "values", F.col("source").alias("first_source"), "ids")


@book.query(
    "ag02_conflicts",
    """SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS rows_in, count(DISTINCT lang)::BIGINT AS langs FROM (SELECT *, regexp_replace(lower(NFKC(text)), '[^0-9a-z]', '', 'g') AS k FROM documents WHERE text IS NOT NULL) WHERE k <> '' GROUP BY k HAVING count(DISTINCT lang) > 1""",
)
def conflicts(spark, d):
    g = curate.collapse_by_key(table(spark, d, "documents"), X.loose_key(F.col("text")), "doc_id", [], "lang")
    return g.filter("values > 1").select("doc_id", F.col("copies").alias("rows_in"), F.col("values").alias("langs"))


@book.query("ag03_distribution", "SELECT coalesce(source_platform, '?') AS key, count(*)::BIGINT AS n FROM sft_candidate GROUP BY 1")
def distribution(spark, d):
    return table(spark, d, "sft_candidate").groupBy(F.coalesce("source_platform", F.lit("?")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@book.query("ag04_token_share", "SELECT source, sum(rendered.n_tokens)::BIGINT AS tokens, round(sum(rendered.n_tokens) / (SELECT sum(rendered.n_tokens) FROM sft_candidate), 6) AS share FROM sft_candidate GROUP BY source")
def token_share(spark, d):
    g = table(spark, d, "sft_candidate").groupBy("source").agg(F.sum("rendered.n_tokens").alias("tokens"))
    total = g.agg(F.sum("tokens").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("source", "tokens", F.round(F.col("tokens") / F.col("total"), 6).alias("share"))  # one row


@book.query(
    "ag05_floor_percentiles",
    """SELECT source, v[1 + floor(0.5 * (len(v) - 1))::INT]::DOUBLE AS p50, v[1 + floor(0.9 * (len(v) - 1))::INT]::DOUBLE AS p90, v[1 + floor(0.99 * (len(v) - 1))::INT]::DOUBLE AS p99
    FROM (SELECT source, list_sort(list(rendered.n_tokens)) AS v FROM sft_candidate WHERE rendered.n_tokens IS NOT NULL GROUP BY source)""",
)
def floor_percentiles(spark, d):
    c = table(spark, d, "sft_candidate").select("source", "cand_id", F.col("rendered.n_tokens").alias("n"))
    return quantiles(c, "n", ["cand_id"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ("source",), "floor")


@book.query(
    "ag06_quality_assertions",
    """SELECT bool_and(coalesce(rendered.n_tokens, 1) > 0) AS tokens_positive, bool_and(coalesce(rendered.assistant_tokens <= rendered.n_tokens, true)) AS assistant_within, bool_and(cand_id IS NOT NULL) AS ids_present, count(*)::BIGINT = count(DISTINCT cand_id)::BIGINT AS ids_unique FROM sft_candidate""",
)
def quality_assertions(spark, d):
    c = table(spark, d, "sft_candidate")
    ids = c.groupBy("cand_id").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") == 1).alias("ids_unique"))
    return c.agg(
        F.bool_and(F.coalesce("rendered.n_tokens", F.lit(1)) > 0).alias("tokens_positive"),
        F.bool_and(F.coalesce(F.col("rendered.assistant_tokens") <= F.col("rendered.n_tokens"), F.lit(True))).alias("assistant_within"),
        F.bool_and(F.col("cand_id").isNotNull()).alias("ids_present"),
    ).crossJoin(ids)  # one row each


@book.query("kn01_greedy_near_dedup")
def greedy_near_dedup(spark, d):
    c = table(spark, d, "sft_candidate").filter("code IS NOT NULL").select("cand_id", "source", F.nullif("family_id", F.lit("")).alias("family"), X.code_tokens(F.col("code")).alias("tokens"))
    return curate.greedy_near_dedup(c, "cand_id", "source", "family", "tokens")


@book.query(
    "wn11_validation_split",
    """WITH h AS (SELECT cand_id, sha256('[7,"val",' || cand_id || ']') AS h FROM sft_candidate) SELECT cand_id, CASE WHEN row_number() OVER (ORDER BY h, cand_id) <= least(512, (SELECT count(*) // 20 FROM h)) THEN 'val' ELSE 'train' END AS split FROM h""",
)
def validation_split(spark, d):
    h = table(spark, d, "sft_candidate").select("cand_id", X.stable_hash(7, "val", F.col("cand_id").cast("string")).alias("h"))
    r = ranked(h, ["h", "cand_id"], "r", (), "n")
    return r.select("cand_id", F.when(F.col("r") <= F.least(F.lit(512), F.floor(F.col("n") / 20)), "val").otherwise("train").alias("split"))


@book.query(
    "wn13_source_quota",
    "SELECT source, cand_id FROM (SELECT source, cand_id, row_number() OVER (PARTITION BY source ORDER BY sha256('[11,' || cand_id || ']'), cand_id) AS r FROM sft_candidate) WHERE r <= 50",
)
def source_quota(spark, d):
    h = table(spark, d, "sft_candidate").select("source", "cand_id", X.stable_hash(11, F.col("cand_id").cast("string")).alias("h"))
    return ranked(h, ["h", "cand_id"], "r", ("source",)).filter("r <= 50").select("source", "cand_id")
