from quern.llm import words
from quern.llm.components import connected_components


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(5, 5), (20, 7)]
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 7 for k in [7, *range(20, 60)]}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_word_hashes_follow_the_words():
    texts = ["", "One two, one!", "_a_b 3é", "é" * 300, "x" * 5000 + " y"]
    h, counts, starts, ends = words.word_hashes([t.lower() for t in texts])
    assert counts.tolist() == [0, 3, 3, 1, 2] and h[0] == h[2] != h[1]
    assert [texts[1].lower()[a:b] for a, b in zip(starts[:3], ends[:3])] == ["one", "two", "one"]
    assert words.word_hashes([])[0].size == 0


def test_consistent_form():
    for a, b in [("ａｂｃ", "abc"), ("ﬁne", "fine"), ("é", "é"), ("a​b", "ab"), ("so­ft", "soft"), ("a b", "a b"), ("a‑b", "a-b"), ("Аpple", "Apple"), ("gοοd", "good"), ("е́", "é")]:
        assert words.consistent(a) == b
    for same in ("x²", "“q”", "a—b", "A\r\nb", "ß", "Straße"):
        assert words.consistent(same) == same
    assert words.consistent(None) is None


def test_forms_are_their_own_forms():
    table = words.form_table()
    assert all(ord(c) not in table for f in table.values() for c in f)
