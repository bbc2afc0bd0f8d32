"""Text expressions that stay in the JVM, and Arrow UDFs for what it lacks."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s+"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(c: Column) -> Column:
    """Compatibility composition. Only texts that aren't ASCII leave the JVM for it."""
    odd = c.rlike(r"[^\x00-\x7F]")
    return F.when(odd, nfkc(F.when(odd, c))).otherwise(c)


def squeezed(c: Column) -> Column:
    """White space runs to one blank, ends trimmed; case kept."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalized(c: Column) -> Column:
    return squeezed(compatible(c))


def loose_key(c: Column) -> Column:
    """Lower case, ASCII letters and digits only, of the compatibility form, so full-width letters count and accented ones,
    however they are written, don't."""
    return F.regexp_replace(F.lower(compatible(c)), "[^0-9a-z]", "")


def words_of(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of the compatibility form."""
    return F.filter(F.split(F.regexp_replace(F.lower(compatible(c)), "[^0-9a-z]+", " "), " "), lambda w: w != "")


def code_tokens(c: Column) -> Column:
    """Identifiers and numbers of a program text, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z_0-9]*|[0-9]+)"), F.lit(1)), F.lower)


def ngrams(words: Column, n: int, short_whole: bool = False, sep: str = " ") -> Column:
    """Distinct runs of n words. A shorter text gives its whole string (short_whole) or none."""
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice(words, k + 1, many).alias(f"w{k}") for k in range(n)))  # words may hold a UDF, a lambda may not
    runs = F.transform(shifted, lambda z: F.concat_ws(sep, *(z[f"w{k}"] for k in range(n))))
    none = F.expr("cast(array() as array<string>)")
    short = F.when(F.size(words) > 0, F.array(F.array_join(words, sep))).otherwise(none) if short_whole else none
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(short))


def ngram_hashes(words: Column, n: int, short_whole: bool = False) -> Column:
    """64-bit hashes of the distinct runs of n words; a shorter text gives its whole (short_whole) or none. words should
    be a column of the input, since it is read once for each run."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    none = F.expr("cast(array() as array<bigint>)")
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(none) if short_whole else none
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(short))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


@F.pandas_udf(T.LongType())
def simhash64(tokens: pd.Series) -> pd.Series:
    """64-bit SimHash of a token list with BLAKE2b token hashes; a bit is set where the balance is not
    negative; 0 for no tokens."""
    import numpy as np

    cache: dict[str, np.ndarray] = {}

    def bits(t: str) -> np.ndarray:
        if t not in cache:
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            cache[t] = np.array([1 if h >> i & 1 else -1 for i in range(64)], np.int32)
        return cache[t]

    def one(ts) -> int:
        if ts is None or len(ts) == 0:
            return 0
        total = sum(bits(t) for t in ts)
        h = sum(1 << i for i in range(64) if total[i] >= 0)
        return h - (1 << 64) if h >= 1 << 63 else h

    return tokens.map(one)


def band(h: Column, i: int) -> Column:
    """The i-th 16-bit band of a 64-bit hash, from the low end."""
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def last_boxed_text(text: str | None) -> str | None:
    """The last boxed expression with its braces, which may stand apart from the command; NULL if there is none or it
    isn't closed."""
    if text is None:
        return None
    at = max(text.rfind("\\boxed"), -1)
    at = text.rfind("\\fbox") if at < 0 else at
    if at < 0:
        return None
    depth = 0
    for m in re.finditer(r"[{}]", text[at:]):
        depth += 1 if m[0] == "{" else -1
        if m[0] == "}" and depth == 0:
            return text[at : at + m.end()]
    return None


@F.pandas_udf(T.StringType())
def last_boxed(s: pd.Series) -> pd.Series:
    return s.map(last_boxed_text)


def unboxed(c: Column) -> Column:
    """What stands in a boxed expression; NULL for any other text."""
    return F.when(c.startswith("\\boxed{") & c.endswith("}"), F.substring(c, F.lit(8), F.length(c) - 8))


#: The commands of an answer that only size, and those that only space.
SIZING = ("\\left", "\\right")
SPACING = ("\\!", "\\,", "\\;", "\\quad", "\\qquad", "~")


def plain_answer(c: Column) -> Column:
    """A mathematical answer without sizing and spacing commands, dollars, white space, final full stops and a
    leading plus sign."""
    for x in (*SIZING, *SPACING, "$"):
        c = F.replace(c, F.lit(x), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", ""), r"\.+$", "")
    return F.regexp_replace(c, r"^\+", "")


NUMERIC = r"^[-+]?(?:[0-9]+(?:\.[0-9]+)?|[0-9]+/[-+]?[0-9]+|\\[dt]?frac\{-?[0-9]+\}\{-?[0-9]+\})$"


@F.pandas_udf(T.StructType([T.StructField("num", T.StringType()), T.StructField("den", T.StringType())]))
def _lowest_terms(s: pd.Series) -> pd.DataFrame:
    from fractions import Fraction

    def one(t):
        if t is None:
            return None, None
        m = re.fullmatch(r"([-+]?)\\[dt]?frac\{(-?\d+)\}\{(-?\d+)\}|([-+]?\d+)/([-+]?\d+)", t)
        if m is None:
            x = Fraction(t)
        else:
            a, b = (int(m[2]), int(m[3])) if m[2] else (int(m[4]), int(m[5]))
            if b == 0:
                return None, None
            x = Fraction(-a if m[1] == "-" else a, b)
        return str(x.numerator), str(x.denominator)

    return pd.DataFrame([one(t) for t in s], columns=["num", "den"])


def as_ratio(c: Column) -> Column:
    """struct(num, den) in lowest terms, as decimal texts of any length, of an integer, decimal, a/b or LaTeX fraction with
    thousands commas dropped; fields are NULL for anything else, percentages and zero denominators included. Only texts of
    such a shape leave the JVM."""
    t = F.replace(c, F.lit(","), F.lit(""))
    return _lowest_terms(F.when(t.rlike(NUMERIC), t))


def last_fence(c: Column) -> Column:
    """The content of the last fence marked python, else of the last fence, else NULL."""
    python = F.regexp_extract_all(c, F.lit(r"```(?:python|py)[ \t]*\n([\s\S]*?)```"), F.lit(1))
    any_ = F.regexp_extract_all(c, F.lit(r"```[^\n`]*\n([\s\S]*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(python, F.lit(-1)), F.try_element_at(any_, F.lit(-1)))


def after_think(c: Column) -> Column:
    """What follows the last closing think tag, left-trimmed; empty if there is none."""
    return F.when(F.contains(c, F.lit("</think>")), F.regexp_replace(F.substring_index(c, "</think>", -1), r"^(?U)\s+", "")).otherwise("")


def parsed(code: str):
    """The syntax tree of a Python text, or None."""
    import ast
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def python_ok_text(code: str | None) -> bool:
    return code is not None and parsed(code) is not None


#: What marks a text as thinking aloud, the labels of a Python fence, and the weights of what a program defines.
THINKING = ("<think>", "</think>", "/think", "/no_think")
PYTHON_LABELS = ("", "py", "python", "python3")
LEAST_CODE, BASE, FUNCTION, CLASS, IMPORT = 20, 10, (5, 4), (3, 3), (3, 1)


def code_score(code: str) -> int | None:
    """How much a program defines; NULL for a text that is too short, thinks aloud, is no Python or holds nothing."""
    import ast

    if len(code) < LEAST_CODE or any(x in code for x in THINKING):
        return None
    tree = parsed(code)
    if tree is None or not tree.body:
        return None
    nodes = list(ast.walk(tree))
    count = lambda of, kinds: sum(isinstance(n, kinds) for n in of)
    found = ((FUNCTION, count(nodes, (ast.FunctionDef, ast.AsyncFunctionDef))), (CLASS, count(nodes, ast.ClassDef)), (IMPORT, count(tree.body, (ast.Import, ast.ImportFrom))))
    return BASE + sum(min(n, most) * weight for (most, weight), n in found)


def clean_code_text(code: str) -> str:
    return re.sub(r"^(?:python|python3|py)\s*\n", "", code.strip(), flags=re.I).strip()


def best_code_text(text: str | None) -> str | None:
    """The program of the fence with the highest score, the first of equals; without one the whole text if it is a program."""
    text = (text or "").strip()
    best = None
    for label, body in re.findall(r"```[ \t]*([A-Za-z0-9_+\-.]*)[ \t]*\n(.*?)```", text, re.S):
        if label.lower() in PYTHON_LABELS:
            code = clean_code_text(body)
            points = code_score(code)
            if points is not None and (best is None or points > best[0]):
                best = points, code
    if best is not None:
        return best[1]
    code = clean_code_text(text)
    return code if code_score(code) is not None else None


@F.pandas_udf(T.StringType())
def best_code(s: pd.Series) -> pd.Series:
    return s.map(best_code_text)


@F.pandas_udf(T.BooleanType())
def python_ok(s: pd.Series) -> pd.Series:
    return s.map(python_ok_text)


@F.pandas_udf(T.StringType())
def blake_hex(s: pd.Series) -> pd.Series:
    """16 bytes of BLAKE2b, in hex."""
    return s.map(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest(), na_action="ignore")


def json_escape(c: Column) -> Column:
    """A text as a JSON string literal, non-ASCII left as it is."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":|\}$', "")


def stable_hash(*parts: Column | int | str) -> Column:
    """SHA-256 hex of the JSON array of the parts, without blanks: its order is that of the 256-bit number."""
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p)
        else:
            out.append(F.lit(str(p) if isinstance(p, int) else '"' + re.sub(r'(["\\])', r"\\\1", p) + '"'))
    inner = F.concat_ws(",", *out)
    return F.sha2(F.concat(F.lit("["), inner, F.lit("]")), 256)


def canonical_json(*cols: str) -> Column:
    """JSON object of the columns in the order of their names, NULLs kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(cols))), {"ignoreNullFields": "false"})


def item_hash(*cols: str) -> Column:
    return F.sha2(canonical_json(*cols), 256)


#: What wrapping adds to the names of parameters.
WRAPPERS = ("_fsdp_wrapped_module.", "_checkpoint_wrapped_module.", "_orig_mod.")


def parameter_name(c: Column) -> Column:
    """A parameter's name without what wrappers put into it."""
    for x in WRAPPERS:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def parameter_group(c: Column) -> Column:
    """embedding, lm_head, layer_N, final_norm or other."""
    return (
        F.when(F.contains(c, F.lit("embed_tokens")), "embedding")
        .when(F.contains(c, F.lit("lm_head")), "lm_head")
        .when(c.rlike(r"layers\.[0-9]+\."), F.concat(F.lit("layer_"), F.regexp_extract(c, r"layers\.([0-9]+)\.", 1)))
        .when(F.contains(c, F.lit("norm")), "final_norm")
        .otherwise("other")
    )
