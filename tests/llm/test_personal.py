import random

import pytest
from pyspark.sql import functions as F

from quern.llm import personal

FAMILY = ["Marlowthorpe", "Kesselholt", "Brandwick", "Tannersdale", "Ostermere", "Pellcombe"]
GIVEN = ["Ingrid", "Tobias", "Zelmira", "Oswin", "Sabine", "Quentin"]


def corpus(seed=1, n=260):
    """Texts, and what is in them: (row, type, place)."""
    r = random.Random(seed)
    texts, want = [], []
    for i in range(n):
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        name = r.choice([f"{g} {f}", f"{g.upper()} {f.upper()}", f"{f}, {g}", f"{g} B. {f}", f"{g[0]}. {f}", f"{g} van {f}"])
        phone = r.choice(["+1 415 555 0101", "(415) 555-0101", "415-555-0101", "+44 20 7946 0101"]).replace("01", f"{r.randrange(10, 99)}", 1)
        ssn = r.choice(["931-19-5568", "931 19 5568"]).replace("5568", str(r.randrange(1000, 9999)))
        mail = r.choice([f"{f.lower()}_{i}@mail.kessel.test", f"{f.lower()}{i} (at) kessel [dot] example [dot] org", f"{f.lower()}{i} AT kessel.test"])
        street = r.choice(["12 Old Kessel Lane", "293 Brant St", "17B Ostler Rd."])
        t, put = "", []

        def say(before, kind, what):
            nonlocal t
            t += before
            put.append((i, kind, len(t)))
            t += what

        k = i % 7
        if k == 0:
            say("Entrant record: ", "name", name)
            say(", SSN ", "id_number", ssn)
            t += ", group a."
        elif k == 1:
            say("My social security number is ", "id_number", ssn)
            say(", call me: ", "phone", phone)
            t += ", ask for the desk."
        elif k == 2:
            say("Editorial by ", "name", name)
            say("; reach the organisers on ", "phone", phone)
            t += " before noon."
        elif k == 3:
            say("Post the forms to ", "name", name)
            say(", ", "address", street)
            t += "."
        elif k == 4:
            say("Mail ", "email", mail)
            t += " if the judge rejects it."
        elif k == 5:
            t += f"{g} keeps a row of {i} lamps. By the {f} lemma the cut is 12. Submission id 918-48-{r.randrange(1000, 9999)} was rejudged. The tests 2062-37-251 pass. Use `a @ b.T` here."
        else:
            t += f"Version 72.4.{i} of the judge prints 4155550101{i}. Decide whether {g} can force a win. The houses on {f[:5]} Street form a row of 961."
        texts.append((i, t))
        want += put
    return texts, want


@pytest.fixture(scope="module")
def found(spark):
    texts, want = corpus()
    df = spark.createDataFrame(texts + [(900, None), (901, ""), (902, "word " * 60_000)], "doc_id long, text string").withColumn("kind", F.lit(1)).repartition(3)
    return texts, want, personal.occurrences(df).collect()


def test_held_out_accuracy(found):
    texts, want, got = found
    got = {(r.doc_id, r.pii_type, r["first"]) for r in got}
    hits = len(got & set(want))
    assert hits >= 0.95 * len(want), sorted(set(want) - got)[:10]
    assert hits >= 0.95 * len(got), [(x, dict(texts)[x[0]][x[2] - 20 : x[2] + 30]) for x in sorted(got - set(want))[:10]]


def test_unseen_given_names_are_discovered(found):
    texts, want, got = found
    text = dict(texts)
    assert {"Zelmira", "Oswin"} & {text[r.doc_id][r["first"] : r.stop].split()[0] for r in got if r.pii_type == "name"}


def test_placeholders_keep_the_rest(spark, found):
    texts, _, got = found
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = {r.doc_id: r.text for r in personal.redacted(df).collect()}
    assert len(out) == len(texts)
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r["first"], r.stop, r.pii_type))
    for i, t in texts:
        want, at = "", 0
        for a, b, k in sorted(spans.get(i, [])):
            want += t[at:a] + f"[{k.upper()}]"
            at = b
        assert out[i] == want + t[at:]


def test_copies_count_again(spark):
    texts, _ = corpus(3, 60)
    df = spark.createDataFrame(texts + [(i + 1000, t) for i, t in texts], "doc_id long, text string")
    got = {(r.doc_id, r.pii_type, r["first"]) for r in personal.occurrences(df).collect()}
    assert {(i + 1000, k, a) for i, k, a in got if i < 1000} == {x for x in got if x[0] >= 1000} and got


def test_positions_are_those_of_the_stored_text():
    t = "Z​ü: mail ｊｏｅ＠example.org now"
    rows = [r for r in personal.candidates(t) if r[0] == "email"]
    assert [t[r[1] : r[2]] for r in rows] == ["ｊｏｅ＠example.org"]
    assert personal.fold("a​b") == ("ab", [0, 2]) and personal.fold("ab") == ("ab", None)
    assert personal.fold("ÉéÑ")[0] == "ÉéÑ"


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert personal.occurrences(df).count() == 0 and personal.redacted(df).count() == 0


def test_null_ids_are_redacted_too(spark):
    texts, _ = corpus(5, 70)
    rows = [(i, t) for i, t in texts] + [(None, texts[4][1])]
    out = personal.redacted(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IS NULL").first().text
    assert "[EMAIL]" in out


LONG_STREET = "L" + "inden" * 25 + "weg 12"


@pytest.mark.parametrize("before", ["(", '"', "«", "/", "str.", "d'", "["])
@pytest.mark.parametrize("street", ["Lindenweg 12", "Donaudampfschifffahrtsgesellschaftsstraße 12", LONG_STREET])
def test_one_word_streets_after_marks(before, street):
    t = f"Sent to {before}{street})."
    a = len(t) - len(street) - 2
    assert [r[1:3] for r in personal.candidates(t) if r[0] == "address"] == [(a, a + len(street))]


def test_every_street_that_a_full_scan_finds():
    r = random.Random(4)
    words = ["calle", "C/", "de", "la", "Mayor,", "Mayor", "(Lindenweg", "Lindenstr.", "Am", "An", "der", "Ufer-Tor", "nº", "n.º5", "no.7", "5", "12", "12a", "123456", "x", "d'Arc", "\n", "3:4", "Q" + "r" * 99]
    for _ in range(300):
        t = personal.fold(" ".join(r.choice(words) for _ in range(40)))[0]
        want = {(*m.span(), f"{k} {m['k']}".lower()) for k, s in enumerate(personal._STREET) for m in s.finditer(t)}
        assert {(*x[1:3], x[3]) for x in personal.candidates(t) if x[0] == "address"} == want


def test_streets_after_marks_are_redacted(spark):
    df = spark.createDataFrame([(1, "Send it to (Lindenweg 12) today."), (2, 'Send it to "Eichenstraße 7" today.')], "doc_id long, text string")
    assert {r.text for r in personal.redacted(df).collect()} == {"Send it to ([ADDRESS]) today.", 'Send it to "[ADDRESS]" today.'}
