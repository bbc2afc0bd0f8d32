"""Broken problem-and-answer pairs, by labelling functions under an EM label model (problem 4).

For every kind of defect several noisy labelling functions look at the row and say yes, no or nothing. One
Arrow pass gives each row the pattern of votes for each kind; patterns are counted over all rows (a kind of k
functions has at most 3^k patterns, so the counts are bounded whatever the data; no row is passed over), and a two-class model with
its own accuracies for each function is fitted to the counts by expectation maximisation. The posterior of a
pattern is then joined back (a broadcast of at most the same bound), and a row keeps every kind whose
posterior exceeds its cutoff. `pair_cutoffs` chooses the cutoffs on labelled rows held out from the model.

Defined cases: a NULL code is `empty`; a NULL or empty tests_json ships no tests and is no defect; with a NULL
problem nothing can be copied from it and its language counts as English; repeated rows and ids are labelled
one by one; empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

import ast
import io
import json
import math
import re
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.words import lowered
from quern.session import materialize

#: Kinds in the order of precedence: (field, defect, number of labelling functions). A defect may have
#: several kinds.
KINDS = [
    ("code", "empty", 5),
    ("code", "refusal", 5),
    ("code", "copied", 4),
    ("code", "wrong_language", 5),  # a program
    ("code", "wrong_language", 5),  # prose
    ("code", "truncated", 5),
    ("tests_json", "empty", 3),
    ("tests_json", "truncated", 3),  # cut off
    ("tests_json", "truncated", 2),  # fewer outputs than inputs
    ("tests_json", "copied", 3),
]
CUTOFFS = [0.5] * len(KINDS)
YES, NO, NONE = 2, 1, 0
ANCHOR = 0.002

FENCE = re.compile(r"```([\w+#-]*)[ \t]*\n?(.*?)(?:```|\Z)", re.S)
TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
#: Phrases that stand for code that isn't there.
PLACEHOLDER = re.compile(
    r"\b(?:to ?do|fix ?me|pass|none|null|n/a|na|tbd|empty|placeholder|(?:your|the|my|write|add|insert|put|some)?\s*(?:code|solution|answer|implementation)(?:\s+(?:goes|comes|is|will be|to be|follows|below|here|added|later|soon|python))*"
    r"|(?:not|to be)\s+(?:yet\s+)?implemented(?:\s+(?:yet|later))?|implement(?:\s+(?:me|this|here))*|here is (?:the|my) (?:code|solution)|raise notimplementederror|not ?implemented ?error|coming soon|ellipsis|here)\b",
    re.I,
)
REFUSE = re.compile(
    r"can(?:'|’)?t (?:help|assist|answer|do|provide|write|solve)|cannot (?:help|assist|answer|provide|write|solve|do)|have to decline|must decline|declin(?:e|ed)\b|won(?:'|’)t be|will not (?:be|provide|answer|write|solve)|not able to|unable to|not be appropriate"
    r"|outside (?:of )?what i can|not (?:something|a thing) i can|guidelines|refuse|no code will|against my"
    r"|ne peux pas|ne peut pas|préfère ne pas|refuse de|impossible de répondre|dois refuser|dois décliner"
    r"|kann ich (?:\w+ )?nicht|kann (?:\w+ ){0,3}nicht helfen|ablehnen|darf ich nicht|nicht beantworten|möchte ich nicht"
    r"|no puedo|no debo|no voy a|no me es posible|debo rechazar|tengo que rechazar|prefiero no",
    re.I,
)
SORRY = re.compile(
    r"^\W*(?:print|sys\.stdout\.write)?\W*(?:i(?:'|’)?\s?a?m (?:very |so |really )?sorry|sorry|apolog|i apologi[sz]e|unfortunately|regrettably|as an? (?:ai|assistant|language)|hello|hi\b|request declined|i can(?:'|’)?t|i cannot|i won|i must|i have to|i am not able"
    r"|désolé|je (?:suis|ne|préfère|regrette|dois)|malheureusement|tut mir|es tut|entschuld|leider|diese anfrage|ich kann|ich muss|lo siento|me temo|lamento|perdón|disculp|desafortunadamente|no puedo)",
    re.I,
)
#: Words in which somebody speaks of themselves.
PERSON = re.compile(r"\b(?:i|i'm|i’m|we|my|je|j'|ich|mir|wir|me|yo|lo siento|no puedo|no voy)\b", re.I)
#: A text without any of these holds no phrase of REFUSE: a cheap look before the search.
REFUSE_HINTS = ("can't ", "can’t ", "cant ", "cannot ", "declin", "won't be", "won’t be", "wont be", "will not ", "able to", "not be appropriate", "outside ", "not something", "not a thing", "guidelines", "refus", "no code will", "against my", "pas", "impossible de", "dois d", "nicht", "ablehnen", "no puedo", "no debo", "no voy", "posible", "debo rechazar", "tengo que", "prefiero no")
#: The words phrases of PLACEHOLDER are made of: a text with another word isn't made of them alone.
PLACEHOLDER_WORDS = frozenset(
    "to do todo fix me fixme pass none null n a na tbd empty placeholder your the my write add insert put some code solution answer implementation goes comes is will be follows below here added later soon python not yet implemented implement this raise notimplementederror error coming ellipsis".split()
)
#: Marks of programs in other languages, each with the texts one of which it can't do without; at least two different marks make a
#: vote.
FOREIGN = [
    (hints, re.compile(x, re.M))
    for hints, x in (
        (("#include",), r"#include\s*<"),
        (("using namespace",), r"using namespace"),
        (("main",), r"\b(?:int|void)\s+main\s*\("),
        (("std::", "cout", "cin", "endl"), r"\bstd::|\bcout\b|\bcin\b|\bendl\b"),
        (("public",), r"\bpublic\s+(?:static|class)\b"),
        (("System.out", "String[]"), r"System\.out|String\[\]"),
        (("package",), r"^\s*package\s+\w+"),
        (("func",), r"\bfunc\s+\w+\s*\("),
        ((":=",), r":="),
        (("fmt.",), r"\bfmt\.\w+"),
        (("fn",), r"^\s*(?:pub\s+)?fn\s+\w+"),
        (("let",), r"\blet\s+(?:mut\s+)?\w+"),
        (("println!", "vec!", "&Vec<", "u64", "i64"), r"println!|&?vec!|&Vec<|\bu64\b|\bi64\b"),
        (("const", "let", "var"), r"^\s*(?:const|let|var)\s+[\w{\[]+.*="),
        (("=>",), r"=>\s*[{(]?"),
        (("function",), r"\bfunction\s+\w*\s*\("),
        (("console.log", "require("), r"console\.log|require\("),
        ((";", "{", "}"), r"[;{}]\s*$"),
        (("end", "puts", "do"), r"\bend\s*$|\bputs\b|\bdo\s*\|"),
        (("<?php", "$"), r"<\?php|\$\w+\s*="),
        (("SELECT",), r"\bSELECT\b.+\bFROM\b"),
        (("fun", "val"), r"\bfun\s+main|\bval\s+\w+\s*="),
        (("Console.Write", "namespace"), r"\bConsole\.Write|\bnamespace\s+\w+"),
        (("long", "vector<"), r"\blong\s+long\b|\bvector<"),
    )
]
PYTHON = re.compile(r"^\s*(?:def \w+\s*\(|class \w+\s*[:(]|import \w+|from \w+ import|for \w.* in |while .+:|if .+:|elif .+:|else:|return\b|print\(|@\w+|\w[\w, ]*\s*[-+*/%&|^]?=\s*\S)", re.M)
#: Frequent words of four languages that the others lack.
STOP = {
    "en": "the of and is are that with for each every which from this it when have has not by after between be as at least most you find number what how into than then given all any".split(),
    "de": "der die das und ist nicht mit den von zu dem ein eine einen auf für im sich auch wird bei nach aus wie werden hat jeder jeden jedem sind über wegen aber am nächsten neben warum gesucht zuerst dann".split(),
    "fr": "le la les des et est une du dans que qui pour pas par sur au aux avec ce cette sont ne se à chaque mais où plus être tous près avant vaut dès côté pourquoi donne d l n s qu".split(),
    "es": "el los las una del y es que para con por no se su al lo como más pero sus son cuando cada entre hasta desde muy este esta qué cuál hallar primero luego junto mi".split(),
}
STOP = {k: frozenset(v) for k, v in STOP.items()}
WORD = re.compile(r"[^\W_]+")
PRINTS = re.compile(r"\s*(?:print|sys\.stdout\.write)\(.*\)\s*", re.S)
COMMENT_MARK = re.compile(r"^\s*(?:#+|//+|\*)\s?", re.M)
PRINTED = re.compile(r'^\s*(?:print|sys\.stdout\.write)\s*\(\s*[frb]?(["\'])(.*)\1\s*\)\s*$', re.S)
QUOTES = re.compile(r'"""|\'\'\'|/\*|\*/')


def _vote(yes: bool) -> int:
    return YES if yes else NO


def language(words: list[str]) -> str | None:
    """The language most of the frequent words belong to, if it is clear."""
    score = sorted(((sum(w in s for w in words), k) for k, s in STOP.items()), reverse=True)
    return score[0][1] if score[0][0] >= 2 and score[0][0] > 1.3 * score[1][0] else None


def body_of(code: str) -> str:
    """What stands in the fences, or the whole text."""
    blocks = FENCE.findall(code)
    return "\n".join(b for _, b in blocks) if blocks else code


def _plain(text: str) -> str:
    """The text without comment marks, quotes and a print around it."""
    t = COMMENT_MARK.sub("", text) if "#" in text or "//" in text or "*" in text else text
    return QUOTES.sub(" ", PRINTED.sub(r"\2", t)).strip()


def parse(body: str) -> tuple[ast.Module | None, bool]:
    """The tree, or None and whether the text stops before it is complete."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(body), False
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        if not isinstance(e, SyntaxError):
            return None, False
        lines = body.rstrip().count("\n") + 1
        open_ended = "never closed" in str(e.msg) or "unterminated" in str(e.msg) or "EOF" in str(e.msg) or "expected an indented block" in str(e.msg)
        return None, (e.lineno or 0) >= lines or open_ended


def _balance(body: str) -> bool:
    """Whether a bracket stays open, strings and comments aside."""
    t = re.sub(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*', "", body)
    return any(t.count(a) > t.count(b) for a, b in ("()", "[]", "{}")) or '"' in t or "'" in t


def _text(n: ast.AST | None) -> bool:
    return isinstance(n, ast.JoinedStr) and not any(isinstance(v, ast.FormattedValue) for v in n.values) or isinstance(n, ast.Constant) and isinstance(n.value, str) or isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add) and _text(n.left) and _text(n.right)


def _blank(n: ast.AST) -> bool:
    """Whether a statement stands for one that isn't there."""
    if isinstance(n, ast.Return):
        return n.value is None or isinstance(n.value, ast.Constant) and n.value.value in (None, ...)
    return isinstance(n, (ast.Pass, ast.Raise)) or isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and n.value.value is ...


def _prints(n: ast.AST) -> bool:
    return isinstance(n, ast.Call) and (isinstance(n.func, ast.Name) and n.func.id == "print" or isinstance(n.func, ast.Attribute) and ast.unparse(n.func) == "sys.stdout.write")


def _idle(n: ast.stmt, stubs: set[str], texts: set[str]) -> bool:
    """Whether a statement computes nothing: imports, stubs, strings that are only assigned or printed. Names of
    functions and classes that are stubs, and of variables that hold strings, are added to stubs and texts."""
    if isinstance(n, (ast.Import, ast.ImportFrom, ast.Pass)):
        return True
    if isinstance(n, ast.Raise):
        e = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
        return isinstance(e, ast.Name) and e.id == "NotImplementedError"
    if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        if not all(_idle(x, stubs, texts) for x in n.body):
            return False
        stubs.add(n.name)
        return True
    if isinstance(n, ast.Return):
        return _blank(n) or _text(n.value)
    if isinstance(n, (ast.Assign, ast.AnnAssign)):
        names = n.targets if isinstance(n, ast.Assign) else [n.target]
        if not (_text(n.value) and all(isinstance(x, ast.Name) for x in names)):
            return False
        texts.update(x.id for x in names)
        return True
    if isinstance(n, ast.If):
        main = isinstance(n.test, ast.Compare) and isinstance(n.test.left, ast.Name) and n.test.left.id == "__name__"
        return main and not n.orelse and all(_idle(x, stubs, texts) for x in n.body)
    if not isinstance(n, ast.Expr):
        return False
    e = n.value
    if isinstance(e, ast.Call) and not e.keywords:
        if isinstance(e.func, ast.Name) and e.func.id in stubs:
            return all(isinstance(a, ast.Constant) for a in e.args)
        if _prints(e):
            return all(isinstance(a, ast.Constant) or _text(a) or isinstance(a, ast.Name) and a.id in texts for a in e.args)
    return isinstance(e, ast.Constant) or _text(e)


def message(body: str, tree: ast.Module) -> tuple[str, bool] | None:
    """None if the program computes something; else its comments and strings, as comments, and whether it is only
    stubs. Imports alone say nothing and are no stub: also None."""
    stubs, texts = set(), set()
    try:
        if not all(_idle(n, stubs, texts) for n in tree.body):
            return None
        said = [(t.start, t.string.lstrip("#")) for t in tokenize.generate_tokens(io.StringIO(body).readline) if t.type == tokenize.COMMENT]
        nodes = list(ast.walk(tree))
        stub = any(map(_blank, nodes)) and not any(isinstance(n, (ast.Assign, ast.AnnAssign)) or _prints(n) for n in nodes)
    except (tokenize.TokenError, SyntaxError, RecursionError):
        return None
    said += [((n.lineno, n.col_offset), str(n.value)) for n in nodes if isinstance(n, ast.Constant) and n.value not in (None, ..., "__main__")]
    if not said and not stub:
        return None
    return "\n".join(["# " + x for _, text in sorted(said) for x in text.splitlines() if x.strip()] + ["pass"] * stub), stub


def code_votes(problem: str | None, code: str | None) -> list[list[int]]:
    """The votes of all functions on a row. Every function looks at every row; the last one of each kind only knows
    whether the text is Python that computes something, and abstains where it isn't."""
    code = code or ""
    body = body_of(code)
    tree, stops = parse(body)
    computes = stub = False
    if tree is not None and any(not isinstance(n, (ast.Expr, ast.Pass)) for n in tree.body):
        frame = message(body, tree)
        if frame is None:
            computes = True
        else:
            # A frame without a program: judged by what is said in it.
            body, stub = frame
            code, (tree, stops) = body, parse(body)
    works = NO if computes else NONE
    plain = _plain(body)
    bare = TAG.sub(" ", plain)
    words = WORD.findall(lowered(bare))
    only_stands_for = PLACEHOLDER_WORDS.issuperset(words) and not WORD.search(PLACEHOLDER.sub(" ", bare))
    only_prose = "```" in code and not body.strip() and len(WORD.findall(lowered(FENCE.sub(" ", code)))) >= 12
    trivial = tree is not None and not computes and all(
        isinstance(n, ast.Pass) or isinstance(n, ast.Expr) and (isinstance(n.value, ast.Constant) and not isinstance(n.value.value, str) or isinstance(n.value, ast.Name)) or ast.unparse(n).upper() in ("N / A", "''", '""') for n in tree.body
    )
    has_python = PYTHON.search(body) is not None and not PRINTS.fullmatch(body)
    empty = [_vote(not words and not only_prose), _vote(only_stands_for and not only_prose), NONE if tree is None or words and not tree.body else _vote(trivial and len(words) <= 8), _vote(len(words) <= 5 and not has_python), works]

    talk = plain if "```" not in code else plain + "\n" + FENCE.sub(" ", code)
    low = talk.lower()
    refuses, sorry = any(x in low for x in REFUSE_HINTS) and bool(REFUSE.search(talk)), bool(SORRY.search(plain))
    prose = not has_python and not re.search(r"[;{}]\s*$|^\s*(?:#include|package |fn |func )", body, re.M)
    refusal = [_vote(refuses), _vote(sorry), _vote(prose and len(words) <= 60), YES if PERSON.search(plain[:80]) else NONE, works]

    if problem is None or len(words) < 5:
        copied = [NONE if problem is None else NO, NONE if problem is None else NO, _vote(False) if len(words) < 5 else NONE, works]
    else:
        own = WORD.findall(lowered(problem))
        there, said, known = " " + " ".join(own), " ".join(words), set(own)
        strange = sum(w not in known for w in words)
        labelled = strange < 5 and any(" " + " ".join(words[k:]) in there for k in range(0, min(5, len(words) - 4)))
        share = 0.0
        if strange <= 0.2 * len(words) + 2:  # each other word is in a run of three of its own
            grams = set(zip(own, own[1:], own[2:]))
            mine = list(zip(words, words[1:], words[2:]))
            share = sum(g in grams for g in mine) / max(1, len(mine))
        copied = [_vote(labelled), _vote(share >= 0.8), _vote(len(said) <= 1.2 * len(there) and not has_python), works]

    if stub and not refuses and not sorry and YES not in copied[:2]:
        empty = [_vote(not words), YES, YES, YES, NONE]  # what its docstrings say is no answer

    marks = sum(any(x in body for x in hints) and bool(r.search(body)) for hints, r in FOREIGN)
    ends = body.count(";") + body.count("{") + body.count("}")
    foreign = [_vote(marks >= 2), _vote(tree is None and not stops), _vote(ends >= 3 and ";" in body), _vote(not has_python and marks >= 1), works]

    speech = words if prose else []
    lang = language(speech) if len(speech) >= 5 else None
    of_problem = (language(WORD.findall(lowered(problem))) if problem else None) or "en"
    other = lang is not None and lang != of_problem
    hits = sum(w in STOP[of_problem] for w in speech)
    human = [_vote(other), _vote(other and bool(speech) and sum(w in STOP[lang] for w in speech) >= 0.15 * len(speech)), _vote(prose and len(words) >= 5 and hits < 0.12 * len(speech)), _vote(prose and tree is None and len(words) >= 8), works]

    truncated = [_vote(tree is None), _vote(tree is None and stops), _vote(has_python and marks < 3), _vote(tree is None and _balance(body)), works]
    return [empty, refusal, copied, foreign, human, truncated]


def _strings(x) -> list[str]:
    return [v if isinstance(v, str) else json.dumps(v) for v in x] if isinstance(x, list) else []


def tests_votes(tests: str | None) -> list[list[int]]:
    if tests is None or tests == "":
        return [[NONE] * n for f, _, n in KINDS if f == "tests_json"]
    try:
        o, good = json.loads(tests), True
    except ValueError:
        o, good = None, False
    ins, outs = (_strings(o.get("inputs")), _strings(o.get("outputs"))) if isinstance(o, dict) else ([], [])
    nothing = good and (not ins or not outs or not any(x.strip() for x in outs))
    literal = re.search(r'"outputs"\s*:\s*\[((?:\s*"(?:[^"\\]|\\.)*"\s*,?)*)\s*\]', tests)
    said = literal and re.sub(r"\\[nrt]", " ", literal[1]).replace('"', " ").replace(",", " ").strip()
    empty = [_vote(nothing), _vote(good and not said), _vote(good and not re.search(r"\w", re.sub(r'"(?:inputs|outputs|fn_name)"', "", tests)) or good and bool(literal) and not said)]
    stripped = tests.rstrip()
    cut = [_vote(not good), _vote(stripped[-1:] not in ("}", "]") or tests.count("[") != tests.count("]") and not good), _vote(tests.count("{") > tests.count("}") or tests.count("[") > tests.count("]"))]
    fewer = good and bool(outs) and len(outs) < len(ins)
    arrays = re.findall(r"\[((?:[^\[\]\"]|\"(?:[^\"\\]|\\.)*\")*)\]", tests) if good else []
    sizes = [len(re.findall(r'"(?:[^"\\]|\\.)*"|[^\s,"]+', a)) for a in arrays]
    few = [_vote(fewer), _vote(len(sizes) >= 2 and min(sizes) > 0 and sizes[0] != sizes[1] and fewer)]
    pairs = list(zip(ins, outs))
    same = bool(pairs) and len(ins) == len(outs) and any(o.strip() for o in outs)
    copied = [_vote(same and all(a.strip() == b.strip() for a, b in pairs)), _vote(same and sorted(x.strip() for x in ins) == sorted(x.strip() for x in outs)), _vote(same and sum(a.split() == b.split() for a, b in pairs) > 0.99 * len(pairs))]
    return [empty, cut, few, copied]


def _pattern(votes: list[int]) -> int:
    out = 0
    for v in votes:
        out = 3 * out + v
    return out


def _unpattern(p: int, k: int) -> list[int]:
    return [p // 3 ** (k - 1 - i) % 3 for i in range(k)]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [[_pattern(v) for v in code_votes(p, c) + tests_votes(t)] for p, c, t in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
        cols = [pa.array([r[i] for r in rows], pa.int32()) for i in range(len(KINDS))]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *(f"k{i}" for i in range(len(KINDS)))])


def fit(counts: dict[int, float], k: int, rounds: int = 100, anchored: bool = False) -> dict[int, float]:
    """Posterior of each vote pattern under a two-class model fitted by EM: a share of defective rows, and for
    each function and class the chances of its votes. It starts from the share of yes among the votes, and
    each chance carries a weak prior towards functions that are right four times in five. anchored: the last function
    only ever says no or nothing, and its chance to say no of a defective row is ANCHOR rather than learned, so that a class
    of sound rows that other functions take for defective ones can't pull the model to itself."""
    patterns = {p: _unpattern(p, k) for p in counts}
    post = {}
    for p, v in patterns.items():
        said = [x for x in v if x != NONE]
        post[p] = 0.0 if not said else min(0.98, max(0.02, sum(x == YES for x in said) / len(said))) ** 2
    total = sum(counts.values())
    for _ in range(rounds):
        bad = sum(counts[p] * post[p] for p in counts)
        prior = (bad + 1) / (total + 20)
        table = []
        for i in range(k):
            chance = {}
            for y in (0, 1):
                held = [1.0, 1.0, 1.0]
                held[YES if y else NO] += 3
                for p, v in patterns.items():
                    held[v[i]] += counts[p] * (post[p] if y else 1 - post[p])
                chance[y] = [x / sum(held) for x in held]
            if anchored and i == k - 1:
                chance[1][NO] = ANCHOR
            table.append(chance)
        new = {}
        for p, v in patterns.items():
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[i][1][x] / table[i][0][x]) for i, x in enumerate(v) if x != NONE)
            new[p] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
        moved = max((abs(new[p] - post[p]) for p in new), default=0)
        post = new
        if moved < 1e-9:
            break
    return post


def defects(df: DataFrame, id_col: str, problem: str, code: str, tests: str) -> DataFrame:
    """(id, field, defect, rank, posterior): every kind of defect of every row whose posterior exceeds the
    cutoff. rank orders the defects of a field by precedence."""
    spark = df.sparkSession
    base = df.select(F.col(id_col).cast("long").alias("id"), *(F.col(c).cast("string") for c in (problem, code, tests)))
    cols = [f"k{i}" for i in range(len(KINDS))]
    votes = materialize(base.mapInArrow(_label, "id long, " + ", ".join(f"{c} int" for c in cols)), "pair-votes")
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("pattern")) for i, c in enumerate(cols)))).alias("v")
    long = votes.select("id", kinds).select("id", "v.kind", "v.pattern")
    counted = long.groupBy("kind", "pattern").count().collect()  # at most the sum of 3^k over KINDS
    rows = []
    for i, (field, defect, k) in enumerate(KINDS):
        post = fit({r.pattern: r["count"] for r in counted if r.kind == i}, k, anchored=field == "code")
        rows += [(i, p, field, defect, x) for p, x in post.items() if x > CUTOFFS[i]]
    labels = spark.createDataFrame(rows, "kind int, pattern int, field string, defect string, posterior double")
    return long.join(F.broadcast(labels), ["kind", "pattern"]).groupBy("id", "field", "defect").agg(F.min("kind").alias("rank"), F.max("posterior").alias("posterior"))


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every defect of every row, several for a field where they hold together."""
    cand = spark.read.parquet(f"{d}/sft_candidate.parquet")
    found = defects(cand, "cand_id", "problem", "code", "tests_json")
    return found.select(F.col("id").alias("cand_id"), "field", "defect", "posterior")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The first defect that applies to each field."""
    cand = spark.read.parquet(f"{d}/sft_candidate.parquet")
    found = defects(cand, "cand_id", "problem", "code", "tests_json")
    first = found.groupBy("id", "field").agg(F.min_by("defect", "rank").alias("defect"))
    return first.select(F.col("id").alias("cand_id"), "field", "defect")
