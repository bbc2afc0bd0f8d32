"""Extraction of answers from model outputs, comparison, and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.operators.ranks import ranked


def answers_equal(a: Column, b: Column) -> Column:
    """Whether two plain answers are the same text or the same rational number, however many digits it has."""
    p, q = X.as_ratio(a), X.as_ratio(b)
    by_text = a == b
    by_number = (p["num"] == q["num"]) & (p["den"] == q["den"])
    return F.coalesce(by_text, F.lit(False)) | F.coalesce(by_number, F.lit(False))


def outputs_equivalent(a: Column, b: Column) -> Column:
    """Program outputs compared token by token: integers by value, other numbers within 1e-6 (relative for
    large ones), anything else as text."""
    tokens = lambda c: F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda t: t != "")
    x, y = tokens(a), tokens(b)

    def same(p: Column, q: Column) -> Column:
        whole = p.rlike(r"^[+-]?[0-9]{1,18}$") & q.rlike(r"^[+-]?[0-9]{1,18}$")
        m, n = p.try_cast("double"), q.try_cast("double")
        close = F.abs(m - n) <= F.greatest(F.lit(1e-6), 1e-6 * F.greatest(F.abs(m), F.abs(n)))
        return (p == q) | F.coalesce(F.when(whole, p.try_cast("long") == q.try_cast("long")).otherwise(close & ~F.isnan(m) & ~F.isnan(n)), F.lit(False))

    pairs = F.arrays_zip(x.alias("p"), y.alias("q"))
    return (F.size(x) == F.size(y)) & F.forall(F.transform(pairs, lambda z: same(z["p"], z["q"])), lambda ok: ok)


def choice_answers(text: Column) -> Column:
    """All letters A-D given as an answer line, in order, upper-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)answer\s*:\s*\$?\\?(?:boxed\{)?\(?([A-D])\b"), F.lit(1)), F.upper)


#: Fixed value: lines of a candidate that are looked at.
WINDOW = 120


@F.pandas_udf(T.StringType())
def candidate_window(text: pd.Series, entry: pd.Series) -> pd.Series:
    """The program text that defines the entry point: the last plain or Python fence with its definition, else the last
    such fence, else the whole text. A text of up to WINDOW lines stays whole; of a longer one WINDOW lines are kept, from 20
    above the last definition or from as near as the end allows, or from the top if nothing defines it."""
    import re

    def one(t, e):
        if t is None:
            return None
        blocks = re.findall(r"```(?:[Pp]ython)?\n(.*?)```", t, re.S)
        defines = re.compile(rf"\b(?:async\s+)?def\s+{re.escape(e or '')}\s*\(")
        body = next((b for b in reversed(blocks) if defines.search(b)), blocks[-1] if blocks else t)
        lines = body.split("\n")
        if len(lines) <= WINDOW:
            return body
        at = max((i for i, x in enumerate(lines) if defines.search(x)), default=0)
        first = min(max(0, at - 20), len(lines) - WINDOW)
        return "\n".join(lines[first : first + WINDOW])

    return pd.Series([one(t, e) for t, e in zip(text, entry)])


def mean_at_k(df: DataFrame, problem: str, correct: Column, by: list[str]) -> DataFrame:
    """mean@k and hit@k: each problem's share of correct samples and whether any is, averaged over problems.
    Problems are combined map-side, so one with very many samples is one row a task."""
    per = df.groupBy(*by, problem).agg(F.avg(correct.cast("double")).alias("_m"), F.max(correct.cast("int")).alias("_h"), F.count(F.lit(1)).alias("_k"))
    return per.groupBy(*by).agg(F.avg("_m").alias("mean_at_k"), F.avg("_h").alias("hit_at_k"), F.count(F.lit(1)).alias("problems"), F.sum("_k").alias("samples"))


def pass_at_k(df: DataFrame, problem: str, correct: Column, by: list[str]) -> DataFrame:
    """hit@k: the share of problems with any correct sample, and the least and largest number of samples a problem has."""
    per = df.groupBy(*by, problem).agg(F.bool_or(F.coalesce(correct, F.lit(False))).alias("_h"), F.count(F.lit(1)).alias("_k"))
    return per.groupBy(*by).agg(F.avg(F.col("_h").cast("int")).alias("hit_at_k"), F.count(F.lit(1)).alias("problems"), F.min("_k").alias("least_k"), F.max("_k").alias("most_k"))


def label_table(summaries: DataFrame, label: str, benchmark: str, value: str, benchmarks: list[str], first: list[str]) -> DataFrame:
    """A row for each label with a column for each benchmark (NULL where it has no summary) and the label's place: those of
    `first` in their order, then the others by name. A later summary of a pair replaces an earlier one by its larger value."""
    wide = summaries.groupBy(label).pivot(benchmark, benchmarks).agg(F.max(value))
    known = F.coalesce(*(F.when(F.col(label) == x, F.lit(i)) for i, x in enumerate(first)), F.lit(len(first)))
    return ranked(wide.withColumn("_f", known), ["_f", label], "place").drop("_f")


def top_share(df: DataFrame, value: str, tie: str, share: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """For each group the share of its positive values' sum that the top `share` of them holds (one at least), and how many
    those are."""
    r = ranked(df.filter(F.col(value) > 0).select(*by, value, tie), [F.col(value).desc(), F.col(tie)], "_r", by, "_n")
    top = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return r.groupBy(*by).agg(F.count(F.when(top, 1)).alias("rows"), (F.sum(F.when(top, F.col(value))) / F.sum(value)).alias("share"))
