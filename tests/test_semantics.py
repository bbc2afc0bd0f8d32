"""Literal cases of text, selection, replay and streaming operators."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import curate, geometry, joins, replay, schedule, score
from quern.streaming import telemetry


def over(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_keys_and_words_use_the_compatibility_form(spark):
    assert over(spark, ["Ｆｕｌｌ Ｗidth", "ﬁne x²", "éa", "e\u0301a", "İx", "", None], X.loose_key) == ["fullwidth", "finex2", "a", "a", "ix", "", None]
    assert over(spark, ["Ｔｗｏ words", "½ cup", None], X.words_of) == [["two", "words"], ["1", "2", "cup"], None]


@pytest.mark.parametrize("text,mode,inner", [("<p>a b<s>", "both", "a b"), ("<p> a", "partial", "a"), (" a <s>", "partial", "a"), ("\u00a0 a\n", "neither", "a"), ("<p><s>", "both", ""), ("<p>", "partial", ""), ("<s><p>", "neither", "<s><p>")])
def test_unwrap(spark, text, mode, inner):
    r = curate.unwrap(spark.createDataFrame([(text, 1)], "t string, inner_n int"), "t", "<p>", "<s>").first()
    assert (r.wrap, r.inner, r.inner_n) == (mode, inner, 1)


def test_difficulty(spark):
    assert over(spark, ["Advanced", "very HARD", "basic", "Introductory", "medium", None, "", "interview", "easy-hard"], curate.difficulty_level) == ["hard", "hard", "easy", "easy", "medium", "medium", "medium", "medium", "hard"]


GOOD = "def solve(n):\n    return n * 2 + 1\n"


def test_the_best_fence_wins():
    small, large = "x = 1\nprint(x + 1, x + 2)", GOOD + "\nclass A:\n    pass\n\nimport sys"
    assert X.best_code_text(f"text\n```python\n{small}\n```\n```py\n{large}\n```\n```\n{GOOD}```") == large
    assert X.best_code_text(f"```python\n{GOOD}```\n```\n{GOOD.replace('n', 'm')}```") == GOOD.strip()  # the first of equals
    assert X.best_code_text(f"```cpp\n{GOOD}```") is None
    assert X.best_code_text(GOOD) == GOOD.strip() and X.best_code_text(None) is None and X.best_code_text("x = 1") is None
    assert X.best_code_text(f"```python\n<think>{GOOD}```") is None and X.best_code_text("```python\n" + "x = (" * 9 + "\n```") is None
    assert X.code_score(GOOD) == 14 and X.code_score(large) == 18 and X.code_score("#" * 40) is None


def test_style(spark):
    rows = [(GOOD, "assert f(1) == 2", None, "function"), ("x = (", None, None, "unknown"), ("n = int(input())", None, None, "competitive"), (GOOD, None, "Input format: one number", "competitive"), (GOOD, "{}", "", "function"), ("x = 1", None, None, "competitive"), ("import sys\nfor a in sys.stdin: pass", None, None, "competitive"), (None, None, None, "competitive")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, t string, p string, want string")
    assert [(r.x, r.want) for r in df.select("i", "want", curate.code_style(F.col("c"), F.col("t"), F.col("p")).alias("x")).orderBy("i").collect()] == [(r[3], r[3]) for r in rows]


def test_ratios_of_any_length(spark):
    big = "1" + "0" * 40
    got = over(spark, [big, "0.12345678901", "-\\tfrac{2}{-4}", "6/-4", "1,000", "50\\%", "1/0", "\\frac{1}{0}", "x", None, "+3", "\\dfrac{3}{9}", ".5"], X.as_ratio)
    want = [(big, "1"), ("12345678901", "100000000000"), ("1", "2"), ("-3", "2"), ("1000", "1"), None, None, None, None, None, ("3", "1"), ("1", "3"), None]
    assert [None if r.num is None else (r.num, r.den) for r in got] == want


def test_plain_answers_and_boxes(spark):
    assert over(spark, ["$~a\\,b\\quad c\\qquad$", "\\left(1\\right)..", "\\:x", "+ 7", None], X.plain_answer) == ["abc", "(1)", "\\:x", "7", None]
    assert [X.last_boxed_text(t) for t in ("a \\boxed {3} b", "\\fbox {x{y}}", "\\boxed{1} \\boxed{2", "\\boxed", "\\fbox{3} \\boxed 4")] == ["\\boxed {3}", "\\fbox {x{y}}", None, None, None]


def test_window_of_a_candidate(spark):
    long = [f"x{i} = {i}" for i in range(300)]
    long[280] = "async def go (a):"
    cases = [
        ("\n".join(long[:120]), "go", "\n".join(long[:120])),
        ("\n".join(long), "go", "\n".join(long[180:])),
        ("\n".join(long), "none", "\n".join(long[:120])),
        ("```python\ndef go(a): pass\n```\n```\nother\n```", "go", "def go(a): pass\n"),
        ("```python\na\n```\n```cpp\ndef go(x)\n```", "go", "a\n"),
        (None, "go", None),
    ]
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(cases)], "i int, t string, e string")
    assert [r.x for r in df.select("i", score.candidate_window(F.col("t"), F.col("e")).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]


def test_short_items_are_one_gram(spark):
    docs = spark.createDataFrame([(1, "find X!"), (2, "find x now"), (3, None), (4, "a b c d e f g h i j")], "d long, t string")
    items = spark.createDataFrame([(1, "Find x"), (2, "c d e f g h i j k"), (3, None), (4, "!")], "i long, u string")
    got = {(r.d, r.i, r.overlap, r.size) for r in curate.ngram_overlap(docs, items, "d", "t", "i", "u", 8).collect()}
    assert got == {(1, 1, 1, 1), (4, 2, 1, 2)}


def test_containment(spark):
    run = lambda a, b: " ".join(f"t{k}" for k in range(a, b))
    docs = spark.createDataFrame([(1, run(0, 30)), (2, run(20, 40)), (3, run(0, 5)), (4, None)], "d long, t string")
    items = spark.createDataFrame([(1, run(10, 24)), (2, run(0, 3))], "i long, u string")
    got = {(r.d, r.i): round(r.containment, 6) for r in curate.containment(docs, items, "d", "t", "i", "u", 5, 0.0).collect()}
    assert got == {(1, 1): 1.0}  # 2 shares four tokens alone
    assert curate.containment(docs, items, "d", "t", "i", "u", 5, 1.1).count() == 0


def test_containment_cuts_a_text_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "d long, t string")
    items = spark.createDataFrame([(1, "b c d e f g h")], "i long, u string")
    df = curate.containment(docs, items, "d", "t", "i", "u", 5, 0.0)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1  # the items' runs are written


def test_deltas_give_the_map_back(spark):
    maps = [None, {}, {"a": "1"}, {"a": "2", "b": None}, {"b": "x"}, {"a": "1", "c": "é\"q"}]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in maps for b in maps)]
    df = spark.createDataFrame(rows, "i int, a map<string,string>, b map<string,string>").withColumn("d", curate.map_delta(F.col("a"), F.col("b")))
    got = df.withColumn("x", curate.apply_delta(F.col("a"), F.col("d"))).orderBy("i").collect()
    assert [r.x for r in got if r.a is not None and r.b is not None] == [r.b for r in got if r.a is not None and r.b is not None]
    assert all(r.x == r.b for r in got if r.a is None and r.b is not None)
    assert {tuple(sorted(r.d)) for r in got if r.a == r.b} == {()}


def test_first_broken_rule_and_blocks(spark):
    assert over(spark, [1, 5, None], lambda c: curate.first_broken([("small", c < 3), ("odd", c % 2 == 1)]), "int") == ["small", "odd", "ok"]
    assert [curate.blocks_for(n) for n in (10, 10_000, 10**8, 10**10)] == [4, 5, 6, 7]


def test_as_of_with_hot_keys_ties_and_nulls(spark):
    r = random.Random(3)
    t = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=r.randrange(400))
    left = [(r.choice([1, 1, 1, 2, None]), r.choice([t(), t(), None]), i) for i in range(600)]
    right = [(r.choice([1, 1, 2, 3, None]), r.choice([t(), t(), t(), None]), i, f"v{i}") for i in range(400)]
    out = joins.as_of_join(spark.createDataFrame(left, "k int, t timestamp, i int"), spark.createDataFrame(right, "k int, u timestamp, j int, v string"), "t", "u", ["k"]).collect()
    assert len(out) == len(left)
    for x in out:
        fit = [(u, j) for k, u, j, _ in right if k is not None and k == x.k and u is not None and x.t is not None and u <= x.t]
        assert (x.u, x.j) == (max(fit) if fit else (None, None)), x


def test_matched_control_widens_for_each_unit(spark):
    units = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, 900.0)], "u int, x double")
    controls = spark.createDataFrame([(7, 12.0), (8, 8.0), (9, 80.0)], "c int, y double")
    got = {(r.u, r.tolerance, r.c, r.gap) for r in joins.matched_control(units, controls, "u", "c", "x", "y", [3, 40]).collect()}
    assert got == {(1, 3, 7, 2.0), (2, 40, 9, 30.0)}


def test_gates(spark):
    rows = [(1.0, 0.0, 0.9), (0.1, 0.9, 0.1), (0.9, 0.9, 0.1), (0.9, 0.1, 0.1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, gap double, clip double, ess double")
    g = replay.continuation_gate(F.col("gap"), F.lit(1.0), F.col("clip"), F.col("ess"), 0.5, 0.5, 0.5)
    assert [r.g.reason for r in df.select("i", g.alias("g")).orderBy("i").collect()] == ["continue", "learn_gap_exhausted", "off_policy_clipping", "off_policy_ess"]
    assert spark.range(1).select(replay.continuation_gate(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), 0.5, 0.5, 0.5).alias("g")).first().g.ratio == 1.0
    good = {"p": 1.0, "c": 1.0, "k": 1.0, "a": 0.9, "f": 0.1, "e": 0.9}
    cases = [({}, "continue"), ({"p": 0.05}, "no_absolute_progress"), ({"c": -1.0}, "fresh_is_cheaper"), ({"k": 0.0}, "importance_weight_tails"), ({"a": 0.1}, "anchor_ess_collapsed"), ({"f": 0.9}, "off_policy_clipping"), ({"e": 0.1}, "off_policy_ess"), ({"p": None, "e": 0.1}, "no_absolute_progress")]
    df = spark.createDataFrame([(i, *(good | c).values()) for i, (c, _) in enumerate(cases)], "i int, " + ", ".join(f"{k} double" for k in good))
    e = F.lit(0.1)
    g = replay.progress_gate((F.col("p"), e), (F.col("c"), e), (F.col("k"), e), 1.0, F.col("a"), F.col("f"), F.col("e"), 0.5, 0.5)
    got = [(r.g.reason, r.g.passed) for r in df.select("i", g.alias("g")).orderBy("i").collect()]
    assert [x for x, _ in got] == [w for _, w in cases] and [n for _, n in got] == [6, 5, 5, 5, 5, 5, 5, 4]


def test_a_cycle_ends_by_budget_number_or_stop(spark):
    rows = [(1, k, c, False) for k, c in enumerate([10.0, 4.0, 4.0, 4.0, 1.0])] + [(2, k, 1.0, k == 1) for k in range(4)] + [(3, k, 1.0, False) for k in range(9)] + [(4, 1, 1.0, False)]
    got = replay.cycle_draws(spark.createDataFrame(rows, "b int, k int, c double, s boolean"), "b", "k", "c", 1.0, 5, "s").collect()
    assert {(r.b, r.k) for r in got if r.runs} == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)} | {(3, 0), (3, 1)}


def test_inclusion_spends_the_budget_exactly(spark):
    r = random.Random(5)
    rows = [(r.uniform(1, 50), r.choice([0.0, -1.0, r.expovariate(1), 3.0])) for _ in range(400)]
    df = spark.createDataFrame(rows, "c double, s double").repartition(5)
    for share in (0.02, 0.3, 0.9, 0.999):
        budget = share * sum(c for c, _ in rows)
        got = replay.inclusion_probabilities(df, "c", "s", budget).collect()
        assert sum(x.q * x.c for x in got) == pytest.approx(budget, rel=1e-9) and all(0.01 <= x.q <= 1 for x in got)


def test_hits_tables_and_shares(spark):
    rows = [("a", 1, True), ("a", 1, None), ("a", 2, False), ("a", 2, None), ("b", 3, None)]
    got = {r.g: (r.hit_at_k, r.problems, r.least_k, r.most_k) for r in score.pass_at_k(spark.createDataFrame(rows, "g string, p int, ok boolean"), "p", F.col("ok"), ["g"]).collect()}
    assert got == {"a": (0.5, 2, 2, 2), "b": (0.0, 1, 1, 1)}
    t = score.label_table(spark.createDataFrame([("z", "m", 1.0), ("b", "n", 2.0), ("b", "other", 9.0), ("base", "m", 3.0)], "l string, k string, v double"), "l", "k", "v", ["m", "n"], ["base", "z"])
    assert [(r.l, r.m, r.n) for r in t.orderBy("place").collect()] == [("base", 3.0, None), ("z", 1.0, None), ("b", None, 2.0)]
    top = score.top_share(spark.createDataFrame([(i, float(v)) for i, v in enumerate([8, 1, 1, 1, 1, -5, 0])], "i int, v double"), "v", "i").first()
    assert (top["rows"], round(top.share, 6)) == (1, round(8 / 12, 6))


def test_nearest_selected_against_brute_force(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(40, 5))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(40)], "i int, e array<double>").repartition(3)
    order = {3: "a", 7: "b", 11: "c", 20: "d"}
    picked = df.filter(F.col("i").isin(list(order))).withColumn("o", F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("i")])
    got = {x.i: (x.distance, x.nearest) for x in schedule.nearest_selected(df, picked, "i", "e", "o").collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    assert set(got) == set(range(40)) - {7} and got[3] == (None, None)
    for i in got:
        seen = [k for k in (3, 11, 20) if k != i and (i not in order or order[k] < order[i])]
        if seen:
            best = min(seen, key=lambda k: (round(1 - u[i] @ u[k], 9), order[k]))
            assert got[i][1] == best and got[i][0] == pytest.approx(1 - u[i] @ u[best], abs=1e-8)


@pytest.mark.parametrize("largest", [False, True])
def test_ties_of_the_interleave_go_by_hash(spark, largest):
    import hashlib

    rows = [(i, "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, s string")
    got = [r.s for r in schedule.stratified_interleave(df, "i", "s", F.sha2(F.col("i").cast("string"), 256), 30, 9, largest).orderBy("rank").collect()]
    h = {s: hashlib.sha256(f'[9,"stratum","{s}"]'.encode()).hexdigest() for s in "abc"}
    want, taken = [], dict.fromkeys("abc", 0)
    for k in range(1, 31):
        lag = {s: round(k * 10 / 30 - taken[s], 9) if taken[s] < 10 else -1e9 for s in "abc"}
        ties = [s for s in "abc" if lag[s] == max(lag.values())]
        s = (max if largest else min)(ties, key=h.get)
        taken[s] += 1
        want.append(s)
    assert got == want


def test_permutation_of_a_generator(spark, monkeypatch):
    df = spark.createDataFrame([(10 * i,) for i in range(50)], "i long").repartition(4)
    got = {r.place: r.i for r in schedule.seeded_permutation(df, "i", 7).collect()}
    assert [got[k] // 10 for k in range(50)] == np.random.Generator(np.random.PCG64(7)).permutation(50).tolist()
    monkeypatch.setattr(schedule, "MAX_POOL", 49)
    with pytest.raises(ValueError):
        schedule.seeded_permutation(df, "i", 7)


def test_sketch_layouts(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert geometry.select_prefix(df, "v").first().v == [[1.0, 2.0]]
    three = df.select(F.array(F.array("v"), F.array(F.reverse("v"))).alias("v"))
    assert geometry.select_prefix(three, "v", "b", ("a", "b")).first().v == [[2.0, 1.0]]
    for bad in (lambda: geometry.select_prefix(df, "v", "b"), lambda: geometry.select_prefix(three, "v", "c", ("a", "b")), lambda: geometry.select_prefix(three.select(F.array("v").alias("v")), "v")):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [1.0]), ("b", 1, [1.0]), ("c", 1, [1.0]), ("c", 2, [1.0, 2.0])], "g string, m int, v array<double>")
    assert {r.g: r.rectangular for r in geometry.rectangular(rows, "g", "m", "v").collect()} == {"a": False, "b": False, "c": False}
    assert {r.g: r.rectangular for r in geometry.rectangular(rows.filter("g <> 'c'"), "g", "m", "v").collect()} == {"a": True, "b": False}


def test_bounds_overlaps_and_audits():
    r = np.random.default_rng(1)
    base = r.normal(size=20)
    v = np.concatenate([r.normal(size=(32, 20)), base + 0.1 * r.normal(size=(32, 20))])
    low, mean, high = geometry.quartet_gap(v @ v.T, [0, 1, 2, 3], [4, 5, 6, 7], 4, 400, 3)
    assert 0.5 < low <= mean <= high < 1.5
    same = geometry.quartet_gap(np.ones((64, 64)), [0, 1, 2, 3], [4, 5, 6, 7], 4, 50, 3)
    assert same == pytest.approx((0, 0, 0))
    a = r.normal(size=(6, 10))
    assert [(k, round(o, 9)) for k, o, _ in geometry.subspace_overlaps(a, a, [1, 3, 9])] == [(1, 1.0), (3, 1.0)]
    got = geometry.frozen_audit(a, a, [0, 1], 300, 4)
    g = np.eye(2) + a[:2] @ a[:2].T
    assert got["value"] == pytest.approx(np.linalg.slogdet(g)[1]) and got["overlap"] == pytest.approx(1) and 0 <= got["percentile"] <= 1


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").toPandas()
    df["ts"] = df["ts"].astype("datetime64[us]")
    df.to_parquet(path)


def stream_of(spark, tmp_path, batches):
    for k, rows in enumerate(batches):
        write(spark, rows, f"{tmp_path}/e{k}.parquet")
    schema = spark.read.parquet(f"{tmp_path}/e0.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


DAY = datetime.datetime(2024, 3, 1, 12)


def test_complete_mode_holds_each_window_once(spark, tmp_path):
    rows = lambda k: [(10 * k + i, DAY, 1, "a", 1.0) for i in range(5)]
    out = telemetry.run_to_table(telemetry.tumbling(stream_of(spark, tmp_path, [rows(0), rows(1)]), "1 day", "10 days"), "complete").collect()
    assert [r.n for r in out] == [10]


def test_update_mode_keeps_the_newest_of_a_key(spark, tmp_path):
    rows = lambda k: [(10 * k + i, DAY + datetime.timedelta(hours=k * 30), 1, "a", 1.0) for i in range(5)]
    w = telemetry.tumbling(stream_of(spark, tmp_path, [rows(0), rows(0), rows(1)]), "1 day", "10 days")
    out = telemetry.run_to_table(w, "update", ("start", "event_type")).collect()
    assert sorted(r.n for r in out) == [5, 10]


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    import os
    import time

    at = lambda days, n, k: [(100 * k + i, DAY + datetime.timedelta(days=days), 1, "a", 1.0) for i in range(n)]
    stream = stream_of(spark, tmp_path, [at(0, 3, 0), at(9, 2, 1), at(9, 1, 2), at(0, 4, 3), at(20, 1, 4)])
    for k in range(5):  # files are taken in the order they came
        os.utime(f"{tmp_path}/e{k}.parquet", (time.time() - 100 + 10 * k,) * 2)
    out = telemetry.run_to_table(telemetry.tumbling(stream, "1 day", "1 day"), "append").collect()
    # The four rows of day 0 come when the watermark has passed it for a batch; a window is given once it is closed.
    assert sorted((r.start.day, r.n) for r in out) == [(1, 3), (10, 3)]
