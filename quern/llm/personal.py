"""Personal information in free text, by bootstrapped contextual extraction (problem 8).

Broad shapes give candidates: pairs of capitalised words or an initial with one (names), digit groups (phones,
identity numbers), number and street (addresses), an at-sign or its spelling with a domain (emails). Most
candidates are mathematics, code or scores. What is real is settled by a graph between instances (a given
name, the shape of a number, a street word, the last label of a domain) and the lexical patterns around them
(the one or two tokens to the left, the token to the right): seed instances give their patterns a precision,
patterns of high precision make new instances trusted, and so on for ROUNDS rounds. Each round is two grouped
sums over the aggregated edges (kind, instance, pattern, n), which map-side combine keeps small.

Texts are read with full-width forms, ligatures, look-alikes, odd spaces and invisible characters folded;
positions always are those of the stored text, from 1, in Unicode characters.

Defined cases: NULL and empty texts hold nothing; copies of a document count again, rows that repeat a
doc_id with another text are read one by one, those with the same text once; NULL ids are
kept; empty tables give no rows; other columns aren't read. Overlaps of two kinds go to the
one that starts first, then to the longer one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.words import form_table
from quern.session import discard, materialize

ROUNDS = 3
#: Least precision of a pattern in the end and while it grows from the seeds (where what isn't trusted yet is
#: unknown rather than wrong), least share of an instance's occurrences in such patterns, least support.
PATTERN, GROWING, GROWING_NAMES, INSTANCE, SUPPORT = 0.6, 0.2, 0.3, 0.5, 3
#: Patterns that stand at over a share of 1 / HOT of all candidates (so fewer than HOT of each place) are looked up by broadcast.
HOT = 1_000
#: The patterns around a candidate: columns and marks.
PATS = {"l2": "<", "l1": "<<", "r1": ">"}
KINDS = ("name", "email", "phone", "id_number", "address")

#: The seed entities. Everything else is found from their contexts.
GIVEN = """
Ingrid Tobias Quentin Gareth Phoebe Maribel Callum Rowan Hollis Della
Sabine Jürgen Heike Volker Annika Thorben
Thibault Bastien Coralie Océane Élodie Gaspard
Marisol Gonzalo Nuria Anselmo Pilar Rocío
""".lower().split()
#: Labels whose patterns are seeds of the graph for identity numbers: trusted in the first round alone, so that they give shapes.
ID_LABELS = ["ssn", "passport", "passeport", "pasaporte", "reisepass", "ausweis", "dni", "nif", "steuer-id", "steuernummer", "id document", "documento", "sécurité sociale"]
#: What carries numbers that are no persons' (negative seeds).
OTHER_LABELS = "submission submissions problem problems build builds ticket tickets version tests book books isbn issn page lot commit run job case soumission problème livre einreichung aufgabe buch envío problema libro entrega version versión".split()
#: By the number of the form in _STREET.
STREETS = {0: "street st lane rd", 1: "rue avenue", 2: "calle plaza", 3: "straße weg", 4: "tor"}
DOMAINS = "com org".split()

_L = r"(?:[^\W\d_]|[̀-ͯ])"
_UP = r"[A-ZÀ-ÖØ-ÞŒŠŽ]"
CAP = rf"(?:{_UP}[̀-ͯ]?(?:{_L}|['’](?={_L}))+(?:-{_UP}{_L}+)*)"
_INI = rf"{_UP}[̀-ͯ]?\."
_SEP = r"(?:[^\S\n]+|[^\S\n]*\n[^\S\n]*)"
_PART = r"(?:(?:[Vv]an|[Vv]on|[Dd]e|[Dd]el|[Dd]i|[Dd]a|[Ll]a|[Ll]e|[Dd]u|[Dd]es|VAN|VON|DE|DEL|DI|DA|LA|LE|DU)(?:[^\S\n]+(?:la|las|los|der|den|le))?)"
_FIRST = re.compile(rf"(?<![\w@.\-/̀-ͯ])({CAP})(?:{_SEP}{_INI}){{0,2}}((?:{_SEP}{_PART})?){_SEP}({CAP})(?![\w@]|\.[\w-]+@)")
_LAST = re.compile(rf"(?<![\w@.\-/̀-ͯ])((?:{_PART}{_SEP})?)({CAP}),{_SEP}({CAP}|{_INI}(?=\W))((?:{_SEP}{_INI}){{0,2}})(?![\w@]|\.[\w-]+@)")
_INITIAL = re.compile(rf"(?<!º )(?<![\w@.\-/'’̀-ͯ])({_INI})(?:[^\S\n]?(?P<next>{_INI}))?((?:{_SEP}{_PART})?){_SEP}(?P<family>{CAP})(?![\w@]|\.[\w-]+@)")
_AT = r"(?:\s?@\s?|\s?[\(\[\{]\s?(?:at|AT|At)\s?[\)\]\}]\s?|\s(?:AT|at)\s)"
_DOT = r"(?:\.|\s?[\(\[\{]\s?(?:dot|DOT|Dot)\s?[\)\]\}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![\w.+@-])([\w](?:[\w.+-]*[\w])?)({_AT})([\w-]+(?:{_DOT}[\w-]+)*{_DOT}([A-Za-z]{{2,}}))(?![\w@-])")
#: Anchors: cheap searches that begin with a set of characters, at which the shapes are tried.
_BRACKETED = re.compile(r"[\(\[\{]\s?(?:at|AT|At)\s?[\)\]\}]")
_CAPITALS = re.compile(rf"{_UP}[\ẁ-ͯ]*")
_COMMA = re.compile(rf",{_SEP}(?={_UP})")
_RUN, _ASCII_RUN = re.compile(r"\d+"), re.compile("[0-9]+")
_PHONE = re.compile(r"(?<![\w.+/-])(?:\(?\+|\()?\d[\d()./ \-]{5,24}\d(?!\w)")
_ID = re.compile(r"(?<![\w./+-])(?:(?!ID|NO|NR|SS)[A-Z]{1,2}[ -]?)?\d(?:[ ./-]?(?:\d|[A-Z](?![a-z]))){4,}(?!\w)")
_STREET = [
    re.compile(rf"(?<![\w.\-])\d{{1,5}}[A-Z]?,?[^\S\n](?:(?:N|S|E|W|Old|New|North|South|East|West)\.?[^\S\n])?{CAP}(?:[^\S\n]{CAP}){{0,2}}[^\S\n](?P<k>{CAP})\b"),
    re.compile(rf"(?<![\w.\-])\d{{1,5}}(?:[^\S\n]?(?:bis|ter|[a-z])\b)?,?[^\S\n](?P<k>[a-zé]{{2,10}})[^\S\n](?:de[^\S\n]la[^\S\n]|de[^\S\n]l['’]|du[^\S\n]|des[^\S\n]|de[^\S\n]|d['’])?{CAP}"),
    re.compile(rf"(?<!\w)(?P<k>{CAP}|C/|[a-zé]{{3,10}})\.?[^\S\n](?:de[^\S\n](?:la[^\S\n]|los[^\S\n])?|del[^\S\n]|du[^\S\n])?{CAP}(?:[^\S\n]{CAP})?,?[^\S\n](?:n\.?[º°o]\.?[^\S\n]?|núm\.[^\S\n])?\d{{1,5}}(?!\d|[.,:]\d)"),
    re.compile(rf"(?<!\w){_UP}{_L}+?(?P<k>weg|straße|strasse|str|platz|gasse|allee|ufer|damm)\.?[^\S\n]\d{{1,5}}(?:[^\S\n]?[a-z])?(?!\w)"),
    re.compile(rf"(?<!\w)(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der)[^\S\n](?:{CAP}[^\S\n])?(?P<k>{CAP})[^\S\n]\d{{1,5}}(?:[^\S\n]?[a-z])?(?!\w)"),
]
#: What stands right before the number of forms 2 to 4: a blank, or a mark that may touch it.
_MARK = re.compile(r"n\.?[º°o]\.?|núm\.")
_CAPITAL = re.compile(rf"(?<!\w){_UP}")
_LETTERS = re.compile(rf"{_L}+")
_TOKEN = re.compile(rf"{_L}+(?:-{_L}+)*|\d+|\S")
#: What may stand right of a capitalised name that is no person.
_THING = re.compile(r"[^\S\n]+(?:lemma|bound|theorem|inequality|conjecture|cup|hall|street|st|lane|square|bridge|island|tree|graph|matrix|sequence)\b", re.I)


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alike characters replaced, and for each character its place in the stored text
    (None where they are the same). Letters with accents stay as they are."""
    table, changed = form_table(), {}
    for ch in set(text):
        if not ch.isascii() and (f := table.get(ord(ch))) is not None and not (len(f) > 1 and unicodedata.combining(f[-1])):
            changed[ch] = f
    if not changed:
        return text, None
    out, at, done = [], [], 0
    for m in re.finditer("[" + re.escape("".join(changed)) + "]", text):
        i = m.start()
        f = changed[m[0]]
        out += [text[done:i], f]
        at += [*range(done, i), *[i] * len(f)]
        done = i + 1
    return "".join(out) + text[done:], [*at, *range(done, len(text))]


def _word(t: str) -> str:
    """A token of a pattern: numbers and capitalised words lose what they say, but for short or all-capital ones."""
    if t[0].isdigit():
        return "0"
    if len(t) > 3 and t[0].isupper() and t.lower() not in _LABELS:
        return "Xx"
    return t.lower()


_LABELS = frozenset("caja rendez-vous quedamos steuer-id steuer-nr passport pasaporte passeport ausweis carte document documento telefon submission problem build ticket version tests book isbn issn page lot commit soumission problème livre einreichung aufgabe buch envío problema libro dank prof frau herr winner contact call mail steuernummer paket teilnehmer candidat participante treffpunkt musterlösung thanks".split())


def _around(text: str, a: int, b: int) -> tuple[str, str, str]:
    left = _TOKEN.findall(text[max(0, a - 40) : a])[-2:]
    right = _TOKEN.findall(text[b : b + 25])[:1]
    w = [_word(x) for x in left]
    return (w[-1] if w else "^"), " ".join(w) if len(w) == 2 else "^ " + (w[0] if w else ""), _word(right[0]) if right else "$"


def _titled(text: str, a: int, b: int) -> bool:
    """Whether nearly all words around are capitalised, so that capitals tell nothing."""
    near = [w for w in _LETTERS.findall(text[max(0, a - 45) : a] + " " + text[b : b + 45])[1:-1] if len(w) > 1]
    return len(near) >= 4 and sum(w[0].isupper() for w in near) >= 0.6 * len(near)


def _shape(s: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s))


def _token(t: str, b: int) -> int:
    """Where the run of non-blanks that ends at b begins."""
    while b > 0 and not t[b - 1].isspace():
        b -= 1
    return b


def _words_before(t: str, p: int) -> int | None:
    """Where the search for forms 2 to 4 with the number at p begins, six words before it, which is the most they
    have; None if what stands before the number can't end one of them."""
    if p < 2:
        return None
    b = p - 1
    if t[b].isspace():
        if not ((x := t[b - 1]).isalpha() or x in ".,º°" or "̀" <= x <= "ͯ"):
            return None
        a = _token(t, b)
        if not (_CAPITAL.search(t, a, b) or _MARK.fullmatch(t, a, b)):
            return None
    else:
        a = next((a for a in range(max(1, p - 4), p - 1) if t[a - 1].isspace() and _MARK.fullmatch(t, a, p)), None)
        if a is None:
            return None
    for _ in range(5):
        if a < 2:
            return 0
        a = _token(t, a - 1)
    return a


def _signs(t: str) -> list[int]:
    """Where an address may have its sign."""
    out = []
    for sign in ("@", "at", "AT"):
        a = t.find(sign)
        while a >= 0:
            if sign == "@":
                out.append(a)
            elif a > 0 and t[a - 1].isspace() and t[a + 2 : a + 3].isspace():
                out.append(a - 1)
            a = t.find(sign, a + 1)
    if "(" in t or "[" in t or "{" in t:
        out += [m.start() for m in _BRACKETED.finditer(t)]
    return sorted(out)


def _family_starts(t: str, c: int, lo: int) -> list[int]:
    """Where a family name that ends at the comma at c may begin, in order: at a particle of one or two words before it,
    or at a capital in it."""
    a = c
    while a > lo and (t[a - 1].isalpha() or t[a - 1] in "-'’" or "̀" <= t[a - 1] <= "ͯ"):
        a -= 1
    caps = [k for k in range(a, c) if t[k].isupper()]
    out = []
    for _ in range(2):
        b = a
        while b > lo and t[b - 1].isspace():
            b -= 1
        if b == a:
            break
        a = b
        while a > lo and t[a - 1].isalpha():
            a -= 1
        if a == b:
            break
        out.insert(0, a)
    return out + caps


def _phone(m: re.Match) -> tuple[int, str] | None:
    """Where the number begins and its text, without a bracket that isn't closed in it."""
    s, a = m[0], m.start()
    if s.count("(") != s.count(")"):
        if ")" in s:
            return None
        s = s[: s.rindex("(")].rstrip() if s.rindex("(") else s[1:]
        a += m[0].startswith("(") and not s.startswith("(")
    return (a, s) if 8 <= sum(c.isdigit() for c in s) <= 15 else None


def candidates(text: str) -> Iterator[tuple]:
    """(kind, first, end, instance, extra, form, left, left two, right) of everything that has a shape."""
    t, at = fold(text)

    def row(kind: str, a: int, b: int, inst: str, extra: str = "", form: str = "") -> tuple:
        l1, l2, r1 = _around(t, a, b)
        first, end = (a, b) if at is None else (at[a], at[b - 1] + 1)
        return kind, first, end, unicodedata.normalize("NFC", inst.lower()), unicodedata.normalize("NFC", extra.lower()), form, l1, l2, r1

    mails = []
    done = 0
    for at_sign in _signs(t):
        a = at_sign - (at_sign > 0 and t[at_sign - 1].isspace())
        while a > done and (t[a - 1].isalnum() or t[a - 1] in "_.+-"):
            a -= 1
        while a < at_sign and t[a] in ".+-":
            a += 1
        m = _EMAIL.match(t, a)
        if not m or m.start(2) > at_sign:
            continue
        mark = m[2].strip()
        spelled = mark != "@"
        if m[2] != "@" and mark == "@" or mark == "at" and not re.search(r"\bdot\b", m[3], re.I):
            continue
        done = m.end()
        mails.append(m.span())
        yield row("email", *m.span(), m[4], "", "spelled" if spelled else "plain")
    inside = lambda a: any(x <= a < y for x, y in mails)
    first_from = initial_from = 0
    for c in _CAPITALS.finditer(t):
        i, e = c.span()
        if i > 0 and ((p := t[i - 1]).isalnum() or p in "_@.-/" or "̀" <= p <= "ͯ"):
            continue
        after = t[e : e + 1]
        if i >= first_from and (after.isspace() and e - i > 1 or after in ("-", "'", "’")) and (m := _FIRST.match(t, i)):
            first_from = m.end(1)
            if not inside(i):
                yield row("name", *m.span(), m[1], m[3][-4:], "first-titled" if _titled(t, *m.span()) else "thing" if _THING.match(t, m.end()) else "first")
        if after == "." and e - i < 3 and i >= initial_from and (m := _INITIAL.match(t, i)):
            initial_from = m.end()
            # Of two initials a first "M." is a title.
            a = m.start("next") if m["next"] and m[1] == "M." else i
            if not inside(a):
                yield row("name", a, m.end(), m["next"] if a > i else m[1], m["family"][-4:], "thing" if _THING.match(t, m.end()) else "initial")
    last_from = 0
    for c in _COMMA.finditer(t):
        for a in _family_starts(t, c.start(), last_from):
            if (m := _LAST.match(t, a)) and m.end(2) == c.start():
                last_from = m.end(2)
                if not inside(m.start()):
                    yield row("name", m.start(2) if not m[1] else m.start(), m.end(), m[3], m[2][-4:], "last")
                break
    phone_from = id_from = 0
    seen = set()
    for run in (_ASCII_RUN if t.isascii() else _RUN).finditer(t):
        p, e = run.span()
        if p >= phone_from:
            for a in (p - 2, p - 1, p):
                if a >= phone_from and (a == p or t[a] in "(+") and (m := _PHONE.match(t, a)):
                    phone_from = m.end()
                    if x := _phone(m):
                        if not inside(x[0]):
                            yield row("phone", x[0], x[0] + len(x[1]), _shape(x[1]))
                    break
        if p >= id_from:
            for a in (p - 3, p - 2, p - 1, p):
                if a >= id_from and (a == p or "A" <= t[a] <= "Z") and (m := _ID.match(t, a)):
                    id_from = m.end()
                    if 7 <= sum(c.isalnum() for c in m[0]) <= 17 and sum(c.isdigit() for c in m[0]) >= 5 and not inside(a):
                        yield row("id_number", *m.span(), _shape(m[0]))
                    break
        if e - p > 5:
            continue
        follows = t[e : e + 1]
        hits = [(k, m) for k in (0, 1) if (m := _STREET[k].match(t, p))] if follows == "," or follows.isspace() or follows.isalpha() else []
        a = _words_before(t, p)
        if a is not None:
            hits += [(k, m) for k in (2, 3, 4) for m in _STREET[k].finditer(t, a, min(len(t), e + 8)) if m.start() < p < m.end()]
        for k, m in hits:
            if (k, m.span()) not in seen and not inside(m.start()):
                seen.add((k, m.span()))
                yield row("address", *m.span(), f"{k} {m['k']}", "", "titled" if _titled(t, *m.span()) else "")


_ROW = "doc_id long, row long, kind string, first int, stop int, inst string, extra string, form string, l1 string, l2 string, r1 string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, rows, texts = (b.column(i).to_pylist() for i in range(3))
        out = [(i, n, *c) for i, n, t in zip(ids, rows, texts) if t for c in candidates(t)]
        if out:
            cols = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _NAMES)


def _seeds(spark: SparkSession) -> DataFrame:
    rows = [("name", x) for x in GIVEN] + [("email", x) for x in DOMAINS] + [("address", f"{k} {x}") for k, v in STREETS.items() for x in v.split()]
    return spark.createDataFrame(rows, "kind string, inst string")


def _scored(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """Each row of edges with the precision of its best pattern (`best`), and of its best one to the left (`left`).
    Rows at hot patterns, found by broadcast, are spread over the tasks of the join for the others, where they match nothing."""
    scores = scores.filter(F.col("score") > 0)
    total = scores.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(scores.filter(F.col("n") > max(10_000, total // HOT)).select("kind", F.col("pat").alias("_p"), F.col("score").alias("_h")))
    cold = scores.select("kind", F.col("pat").alias("_p"), F.col("score").alias("_c"))
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("inst", *PATS), F.lit(4_096)).cast("string"))
    for c in PATS:
        edges = edges.withColumn("_p", F.concat(F.lit(PATS[c]), c)).join(hot, ["kind", "_p"], "left")
        edges = edges.withColumn("_p", F.when(F.col("_h").isNotNull(), spread).otherwise(F.col("_p"))).join(cold, ["kind", "_p"], "left")
        edges = edges.withColumn(f"s_{c}", F.coalesce("_h", "_c", F.lit(0.0))).drop("_p", "_h", "_c")
    left = F.greatest("s_l2", "s_l1")
    return edges.withColumn("left", left).withColumn("best", F.greatest("left", "s_r1")).drop(*(f"s_{c}" for c in PATS))


def bootstrap(found: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Trusted instances (kind, inst) and the precision of patterns (kind, pat, score, n) after so many rounds over
    the graph of found, which has a row for each candidate."""
    spark = found.sparkSession
    clear = found.filter("form not in ('first-titled', 'titled', 'thing')")
    edges = materialize(clear.groupBy("kind", "inst", *PATS).agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    numbers = F.col("kind").isin("phone", "id_number")
    label = (F.col("kind") == "id_number") & F.regexp_replace("pat", "^<+", "").rlike(r"(?:^|\s)(?:" + "|".join(map(re.escape, ID_LABELS)) + ")$")
    # A lone mark or short word left of a number says too little.
    bare = numbers & F.col("pat").rlike(r"^<<(?!\w{3})")
    other = numbers & F.col("pat").rlike(r"(?:^|[<\s])(?:" + "|".join(OTHER_LABELS) + r")(?:$|\s)")
    shapes = edges.filter("kind = 'phone' AND (inst LIKE '+%' OR inst LIKE '(+%')").select("kind", "inst").distinct()
    trusted = materialize(_seeds(spark).unionByName(shapes).distinct(), "pii-trusted")
    for step in range(rounds + 1):
        marked = edges.join(trusted.withColumn("t", F.lit(1)), ["kind", "inst"], "left").withColumn("t", F.coalesce("t", F.lit(0)) * F.col("n"))
        each = marked.select("kind", F.explode(F.array(*(F.concat(F.lit(p), c) for c, p in PATS.items()))).alias("pat"), "n", "t")
        scores = each.groupBy("kind", "pat").agg((F.sum("t") / F.sum("n")).alias("score"), F.sum("t").alias("support"), F.sum("n").alias("n"))
        earned = F.when(F.col("support") >= SUPPORT, F.col("score")).otherwise(0.0)
        if not step:  # a label gives its shapes a start, and is then as good as they make it
            earned = F.when(label, 1.0).otherwise(earned)
        scores = scores.withColumn("score", F.when(bare | other, 0.0).otherwise(earned))
        scores = materialize(scores.select("kind", "pat", "score", "n"), "pii-patterns")
        if step == rounds:
            break
        # Growth looks at both sides of names and addresses people wrote, and to the left of the rest, where labels and words of place stand.
        good = F.when(F.col("kind") == "name", F.col("best") >= GROWING_NAMES).when(F.col("kind") == "email", F.col("best") >= GROWING).otherwise(F.col("left") >= GROWING)
        new = _scored(edges, scores).groupBy("kind", "inst").agg(F.sum(F.when(good, F.col("n")).otherwise(0)).alias("g"), F.sum("n").alias("n"), F.count_distinct(F.when(good, F.col("l2"))).alias("k"))
        share = F.when(numbers, GROWING).otherwise(INSTANCE)
        new = new.filter((F.col("g") >= share * F.col("n")) & (F.col("g") >= SUPPORT) & (numbers | (F.col("kind") == "email") | (F.col("k") >= 3))).select("kind", "inst")
        held = trusted
        trusted = materialize(trusted.unionByName(new).distinct(), "pii-trusted")
        discard(scores, held)
    discard(edges)
    return trusted, scores


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the overlapping spans of a document the first, then the longest, then the surest."""
    for b in batches:
        out = []
        for doc, row, spans in zip(*(c.to_pylist() for c in b.columns)):
            to = -1
            for x in spans:
                if x["first"] >= to:
                    to = -x["end"]
                    out.append((doc, row, x["kind"], x["first"], to))
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "row", "pii_type", "first", "stop"])


def occurrences(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id long, text string. (doc_id, row, pii_type, first, stop): places from 0 in the stored text;
    row tells rows with one doc_id apart."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    return settled(materialize(base.mapInArrow(_extract, _ROW), "pii-candidates"), rounds)


def settled(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The occurrences among the candidates."""
    trusted, scores = bootstrap(found, rounds)
    ok = _scored(found, scores).join(trusted.withColumn("known", F.lit(True)), ["kind", "inst"], "left")
    ok = ok.withColumn("known", F.coalesce("known", F.lit(False)))
    # Endings of family names: those that stand with a trusted given name again and again.
    named = materialize(found.filter("kind = 'name' AND form = 'first'").join(trusted, ["kind", "inst"]).select("extra"), "pii-families")
    for k in (3, 4):
        ends = named.groupBy(F.expr(f"right(extra, {k})").alias("_e")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT).select("_e", F.lit(True).alias(f"family{k}"))
        ok = ok.withColumn("_e", F.expr(f"right(extra, {k})")).join(ends, "_e", "left").drop("_e").withColumn(f"family{k}", F.coalesce(f"family{k}", F.lit(False)))
    initial = F.col("family4") | F.col("family3") & (F.col("left") >= GROWING)
    name = (
        F.when(F.col("form") == "first", F.col("known"))
        .when(F.col("form") == "first-titled", F.col("known") & F.col("family3"))
        .when(F.col("form") == "last", F.when(F.col("inst").rlike(r"^\w\.$"), F.col("family4") & (F.col("left") >= GROWING)).otherwise(F.col("known") & F.col("family3")))
        .when(F.col("form") == "initial", initial)
    )
    number = F.col("known") & (F.col("left") >= PATTERN)
    keep = F.when(F.col("kind") == "name", name).when(F.col("kind").isin("phone", "id_number"), number).otherwise(F.col("known"))
    # "M." may be a title: where the same words are a family and a given name, those begin after it.
    order = F.col("first") + F.when((F.col("form") == "initial") & (F.col("inst") == "m."), 3).otherwise(0)
    kept = ok.filter(F.coalesce(keep, F.lit(False))).select("doc_id", "row", "kind", "first", "stop", "left", order.alias("order")).distinct()
    spans = kept.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("order", (-F.col("stop")).alias("end"), (-F.col("left")).alias("sure"), "kind", "first"))).alias("s"))
    return spans.mapInArrow(_apart, "doc_id long, row long, pii_type string, first int, stop int")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return occurrences(docs).select("doc_id", "pii_type", (F.col("first") + 1).cast("int").alias("start_at"))


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: s["first"]):
                    parts += [text[at : s["first"]], f"[{s['pii_type'].upper()}]"]
                    at = s["stop"]
                text = "".join(parts) + text[at:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a typed placeholder for each occurrence; NULL texts stay NULL."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = occurrences(docs).groupBy("doc_id", "row").agg(F.collect_list(F.struct("pii_type", "first", "stop")).alias("spans"))
    docs, spans = docs.withColumn("row", F.xxhash64("text")), spans.toDF("_id", "_row", "spans")
    same = docs["doc_id"].eqNullSafe(spans["_id"]) & (docs["row"] == spans["_row"])  # a NULL id must not keep its text
    return docs.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(_redact, "doc_id long, text string")


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redacted(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
