"""A small register: each module of quern.plans makes a Book and files its queries in it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """By rule from the Unicode data: characters whose compatibility form is one ASCII letter or digit, those, and the
    ligatures and fractions whose form holds several."""
    one, several = {}, {}
    for i in range(128, 0x1FFFF):
        if 0xD800 <= i < 0xE000:
            continue
        f = unicodedata.normalize("NFKC", chr(i))
        if f != chr(i) and len(f) == 1 and f.isascii() and f.isalnum():
            one[chr(i)] = f
        elif f != chr(i) and (0xFB00 <= i <= 0xFB06 or 0xBC <= i <= 0xBE or i in (0x2116, 0x2122)):
            several[chr(i)] = f
    return "".join(one), "".join(one.values()), several


def nfkc_sql(column: str) -> str:
    """What compatibility composition does to the letters and digits of a column, in SQL."""
    a, b, several = _compatible()
    out = f"translate({column}, '{a}', '{b}')"
    for x, y in several.items():
        out = f"replace({out}, '{x}', '{y}')"
    return f"nfc_normalize({out})"


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def file(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = re.sub(r"NFKC\(([\w.]+)\)", lambda m: nfkc_sql(m[1]), sql)
            return f

        return file


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
