"""Exact quantiles from distributed ranks: no task holds all values or their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranks import ranked


def quantiles(df: DataFrame, value: str, tie: list, qs: dict[str, float], by: tuple[str, ...] = (), how: str = "linear") -> DataFrame:
    """One row for each group with a column for each quantile of the non-NULL values. how: "linear"
    interpolates between neighbours; "floor" takes the value at floor(q * (n - 1))."""
    r = ranked(df.filter(F.col(value).isNotNull()), [value, *tie], "_r", by, "_n")
    aggs = []
    for name, q in qs.items():
        at = F.col("_n").cast("double") - 1
        at = at * F.lit(q)
        lo = F.floor(at)
        pick = lambda k: F.max(F.when(F.col("_r") - 1 == k, F.col(value).cast("double")))
        if how == "floor":
            aggs.append(pick(lo).alias(name))
        else:
            part = F.max(at - lo)
            hi = F.ceil(at)
            aggs.append((pick(lo) + (pick(hi) - pick(lo)) * part).alias(name))
    return r.groupBy(*by).agg(*aggs)
