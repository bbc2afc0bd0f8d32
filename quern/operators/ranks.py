"""Ranks over whole tables and over skewed groups, without a window that holds an unbounded group.

A window without partition, or over a group with a third of all rows, sorts in one task. Here rows are range
partitioned by group and order, ranked inside each partition, and the counts of earlier partitions added.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import materialize


def _columns(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def ranked(df: DataFrame, order: list, name: str = "rank", by: tuple[str, ...] = (), size: str | None = None) -> DataFrame:
    """df with the 1-based row number in `order` (which must leave no ties) within each group of `by`; with the
    size of the group in column `size` if one is named."""
    order, by = _columns(order), list(by)
    spread = materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    local = spread.withColumn("_local", F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)))
    counts = spread.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    within = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row for each partition of the group
    counts = counts.withColumn("_base", F.sum("_n").over(within.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).withColumn("_all", F.sum("_n").over(within))
    keys = ["_part", *by]
    right = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_base", "_all")
    same = functools.reduce(operator.and_, (local[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)))
    out = local.join(right, same).withColumn(name, (F.col("_base") + F.col("_local")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("_all").cast("long"))
    return out.drop("_part", "_local", "_base", "_all", *(f"_k{i}" for i in range(len(keys))))


def rank_bins(df: DataFrame, value: str, tie: list, bins: int, name: str = "bin", by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-count bins: floor(rank * bins / n) of the 0-based rank by value and tie. Bin sizes differ from
    ntile's."""
    out = ranked(df, [value, *tie], "_rank", by, "_size")
    return out.withColumn(name, F.floor((F.col("_rank") - 1) * bins / F.col("_size")).cast("int")).drop("_rank", "_size")


def running_sum(df: DataFrame, value: str, order: list, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of value over the rows up to and with each row, in the same two steps."""
    return running_sums(df, {value: name}, order, by)


def running_sums(df: DataFrame, names: dict[str, str], order: list, by: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of several columns, each under the name given for it, from one sort."""
    order, by = _columns(order), list(by)
    spread = materialize(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "running")
    rows = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = spread.select("*", *(F.sum(v).over(rows).alias(f"_local{i}") for i, v in enumerate(names)))
    sums = spread.groupBy("_part", *by).agg(*(F.sum(v).alias(f"_n{i}") for i, v in enumerate(names)))
    within = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    keys = ["_part", *by]
    right = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"_n{i}").over(within), F.lit(0)).alias(f"_base{i}") for i in range(len(names))))
    same = functools.reduce(operator.and_, (local[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)))
    out = local.join(right, same)
    for i, name in enumerate(names.values()):
        out = out.withColumn(name, F.col(f"_base{i}") + F.coalesce(f"_local{i}", F.lit(0))).drop(f"_base{i}", f"_local{i}")
    return out.drop("_part", *(f"_k{i}" for i in range(len(keys))))
