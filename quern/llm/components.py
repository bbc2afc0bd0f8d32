"""Connected components of a long-id graph by alternating large-star and small-star contractions.

Each round is two grouped minima and two joins over the edge table, written to the shared folder, so an
executor loss costs one round at most. Rounds grow with the logarithm of the longest path, edges never grow
in number. Self loops, repeated and reversed edges are allowed; an empty edge table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialize


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    small = _minima(large)
    return large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, root) for every vertex that has an edge to another; root is the smallest vertex of its
    component, and is listed itself."""
    e = edges.select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")).filter("u <> v").distinct()
    e = materialize(e, "cc")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == tuple(now):
            break
        state = tuple(now)
        e = materialize(_star(e), "cc")
    out = e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return out.unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
