"""Joins Spark has no operator for."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import materialize


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Inner join where the two values differ by at most width: equi-join on cells of that width (the right
    side stands in its own cell and both neighbours), then the exact test. Columns of the sides must differ,
    but for those in `on`."""
    a = left.withColumn("_cell", F.floor(F.col(left_value) / width))
    b = right.withColumn("_own", F.floor(F.col(right_value) / width)).withColumn("_cell", F.explode(F.array(*(F.col("_own") + k for k in (-1, 0, 1))))).drop("_own")
    return a.join(b, [*on, "_cell"]).filter(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("_cell")


def matched_control(units: DataFrame, controls: DataFrame, unit: str, control: str, unit_value: str, control_value: str, tolerances: list[float], on: tuple[str, ...] = ()) -> DataFrame:
    """(unit, tolerance, control, gap): for each unit that has a control within the widest tolerance, the narrowest one that
    leaves it any, and the nearest control (of equal gaps the smallest id). Tolerances widen in rounds: only units without a
    control go on to the next, so a wide one is joined for few."""
    out, left = None, units.select(unit, unit_value, *on)
    for t in sorted(tolerances):
        pairs = range_join(left, controls.select(control, control_value, *on), unit_value, control_value, float(t), on)
        gap = F.abs(F.col(unit_value) - F.col(control_value))
        best = pairs.groupBy(unit).agg(F.min(F.struct(F.round(gap, 6).alias("r"), F.col(control).alias("c"), gap.alias("gap"))).alias("b"))
        found = materialize(best.select(unit, F.lit(t).alias("tolerance"), F.col("b.c").alias(control), F.col("b.gap").alias("gap")), "matched")
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(unit), unit, "left_anti")
    return out


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, on: list[str]) -> DataFrame:
    """Each left row with the latest right row at or before it (NULLs if there is none), of several at one time the one
    whose other columns are largest. Both sides are range partitioned by key and time together, each row takes the last
    right row of its partition before it, and the last ones of earlier partitions of the key are carried over; so no task
    sorts a whole key, and the cost is one sort. NULL keys and times match nothing. Right columns must not clash."""
    values = [c for c in right.columns if c not in on]
    keys = [f"_k{i}" for i in range(len(on))]
    named = [F.col(c).alias(k) for c, k in zip(on, keys)]
    row = F.struct(*(F.col(c) for c in left.columns))
    last = F.struct(*(F.col(c) for c in [right_time, *(v for v in values if v != right_time)]))
    a = left.select(*named, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.select(last.alias("x")).schema["x"].dataType).alias("_last"))
    b = right.filter(F.col(right_time).isNotNull()).select(*named, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType).alias("_row"), last.alias("_last"))
    both = a.unionByName(b).repartitionByRange(*keys, "_t", "_side").withColumn("_part", F.spark_partition_id())
    both = materialize(both, "as-of")
    inside = W.partitionBy("_part", *keys).orderBy("_t", "_side", "_last").rowsBetween(W.unboundedPreceding, 0)
    local = both.withColumn("_in", F.last("_last", ignorenulls=True).over(inside)).filter("_side = 1")
    ends = both.groupBy("_part", *keys).agg(F.max("_last").alias("_end"))  # right rows of a partition, by time first
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition of the key
    ends = ends.select(F.col("_part").alias("_p"), *(F.col(k).alias(k + "r") for k in keys), F.last("_end", ignorenulls=True).over(before).alias("_before"))
    same = local["_part"] == ends["_p"]
    for k in keys:
        same = same & (local[k] == ends[k + "r"])
    out = local.join(ends, same, "left")
    found = F.when(F.col("_t").isNotNull() & functools.reduce(operator.and_, (F.col(k).isNotNull() for k in keys), F.lit(True)), F.coalesce("_in", "_before"))
    return out.select(*(F.col("_row")[c].alias(c) for c in left.columns), *(found[v].alias(v) for v in values))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """The key of a pair whose order doesn't matter."""
    return F.least(a, b), F.greatest(a, b)
