"""Budgeted replay sampling: inclusion probabilities, draws, weights, staleness, sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.mixing import mix
from quern.functions.text import stable_hash
from quern.operators.ranks import ranked, running_sums


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) from 52 bits of the stable hash of the parts."""
    return F.conv(F.substring(stable_hash(*parts), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def inclusion_probabilities(df: DataFrame, cost: str, score: str, budget: float, least: float = 0.01) -> DataFrame:
    """q = clip(lambda * score, least, 1) with the sum of q * cost equal to the budget. The spending grows with lambda in
    straight pieces that bend where a row leaves `least` and where it reaches 1; one sort of the bends and its running sums
    give the piece that holds the budget, and so lambda exactly. The driver holds scalars. Scores of 0 or less count as the
    smallest positive one; a budget over the total gives 1, one under least * total gives least."""
    floor = df.filter(F.col(score) > 0).agg(F.min(score)).first()[0]
    if floor is None:
        raise ValueError("no score is positive")
    base = df.withColumn("_s", F.greatest(F.col(score).cast("double"), F.lit(float(floor))))
    total = base.agg(F.sum(F.col(cost).cast("double"))).first()[0]
    if budget >= total:
        return df.withColumn("q", F.lit(1.0))
    if budget <= least * total:
        return df.withColumn("q", F.lit(float(least)))
    c, s = F.col(cost).cast("double"), F.col("_s")
    bend = lambda at, slope, more: F.struct(at.alias("at"), slope.alias("slope"), more.alias("more"))
    bends = base.select(F.explode(F.array(bend(least / s, c * s, -least * c), bend(1 / s, -c * s, c))).alias("b")).select("b.*")
    bends = bends.groupBy("at").agg(F.sum("slope").alias("slope"), F.sum("more").alias("more"))
    sums = running_sums(bends, {"slope": "k", "more": "m"}, ["at"])
    spent = F.lit(least * total) + F.col("m") + F.col("k") * F.col("at")
    piece = sums.withColumn("f", spent).filter(F.col("f") >= budget * (1 - 1e-9)).agg(F.min_by(F.struct("at", "f", "k", "slope"), "at").alias("x")).first().x
    rate = piece.at - (piece.f - budget) / (piece.k - piece.slope)
    return base.withColumn("q", F.least(F.lit(1.0), F.greatest(F.lit(least), F.lit(rate) * s))).drop("_s")


def bernoulli_draw(df: DataFrame, row_id: str, q: str, seed: int, draw: int) -> DataFrame:
    """Rows whose number is below q, with the weight 1/q; the row of largest q if none is."""
    u = uniform(seed, "draw", draw, F.col(row_id).cast("string"))
    picked = df.withColumn("u", u).filter(F.col("u") < F.col(q))
    if not picked.take(1):
        picked = df.withColumn("u", u).orderBy(F.desc(q), row_id).limit(1)
    return picked.withColumn("weight", 1 / F.col(q))


def ess(weight: Column) -> Column:
    """Effective sample size as a share of the rows."""
    return F.sum(weight) * F.sum(weight) / (F.sum(weight * weight) * F.count(F.lit(1)))


@F.pandas_udf(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("sign", T.IntegerType())]))
def sketch_cell(index: pd.Series, seed: pd.Series, buckets: pd.Series) -> pd.DataFrame:
    """Bucket and sign of a coordinate in a count sketch (splitmix64)."""
    h = mix(index.to_numpy().astype(np.uint64) + mix(seed.to_numpy().astype(np.uint64)))
    return pd.DataFrame({"bucket": (h % buckets.to_numpy().astype(np.uint64)).astype(np.int64), "sign": np.where(h >> np.uint64(63), 1, -1).astype(np.int32)})


def count_sketch(df: DataFrame, key: str, index: str, value: str, seed: int, buckets: int) -> DataFrame:
    """(key, bucket, value): linear, so sketches of parts add up; partial sums are combined map-side."""
    cell = sketch_cell(F.col(index), F.lit(seed), F.lit(buckets))
    rows = df.withColumn("_c", cell).select(key, F.col("_c.bucket").alias("bucket"), (F.col("_c.sign") * F.col(value)).alias("v"))
    return rows.groupBy(key, "bucket").agg(F.sum("v").alias("value"))


def continuation_gate(gap: Column, first_gap: Column, clipped: Column, ess_share: Column, gap_floor: float, clip_ceiling: float, ess_floor: float) -> Column:
    """struct(ratio, reason): whether to draw from a batch again, and the first gate that says no. The gap is compared with
    that of the first draw; without a positive one the ratio is 1."""
    ratio = F.when(first_gap > 0, gap / first_gap).otherwise(1.0)
    reason = (
        F.when(ratio < gap_floor, "learn_gap_exhausted")
        .when(clipped > clip_ceiling, "off_policy_clipping")
        .when(ess_share < ess_floor, "off_policy_ess")
        .otherwise("continue")
    )
    return F.struct(ratio.alias("ratio"), reason.alias("reason"))


def progress_gate(progress: tuple[Column, Column], contrast: tuple[Column, Column], capped: tuple[Column, Column], z: float, anchor_ess: Column, clipped: Column, ess_share: Column, clip_ceiling: float, ess_floor: float) -> Column:
    """struct of the three lower confidence bounds (mean less z standard errors), the six conditions, and the first one that
    fails. The gain itself, its contrast with a fresh update and that contrast with capped weights must all be positive
    beyond noise, and neither the weights nor the update may have gone stale."""
    bounds = {n: m - z * e for n, (m, e) in (("progress", progress), ("contrast", contrast), ("capped", capped))}
    checks = {
        "no_absolute_progress": bounds["progress"] > 0,
        "fresh_is_cheaper": bounds["contrast"] > 0,
        "importance_weight_tails": bounds["capped"] > 0,
        "anchor_ess_collapsed": anchor_ess >= ess_floor,
        "off_policy_clipping": clipped <= clip_ceiling,
        "off_policy_ess": ess_share >= ess_floor,
    }
    reason = F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()), F.lit("continue"))
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks.values()), F.lit(0))
    return F.struct(*(v.alias(f"{n}_bound") for n, v in bounds.items()), passed.alias("passed"), reason.alias("reason"))


def cycle_draws(costs: DataFrame, batch: str, draw: str, cost: str, fraction: float, most: int, stop: str | None = None) -> DataFrame:
    """Which replay draws of a cycle run: in the order of draw, while what the batch's draws have spent stays within a fraction
    of the fresh batch's own tokens (its draw 0), at most `most` of them, and none after one whose `stop` holds. A cycle has
    few draws, so a window over its batch is bounded."""
    w = W.partitionBy(batch).orderBy(draw)
    fresh = F.max(F.when(F.col(draw) == 0, F.col(cost))).over(W.partitionBy(batch))
    spent = F.sum(F.when(F.col(draw) > 0, F.col(cost)).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    halted = F.max(F.coalesce(F.col(stop), F.lit(False)).cast("int") if stop else F.lit(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = (F.col(draw) == 0) | ((spent <= fraction * fresh) & (F.col(draw) <= most) & (F.coalesce(halted, F.lit(0)) == 0))
    return costs.withColumn("_fresh", fresh).withColumn("spent", spent).withColumn("runs", runs).filter("_fresh IS NOT NULL").drop("_fresh")


def fifo_buffer(rows: DataFrame, run: str, batch: str, capacity: int) -> DataFrame:
    """(run, batch, rows_in, age): the batches a buffer of `capacity` holds for each run after all have been pushed in order; the
    newest has age 0, older ones than the capacity were evicted. Rows are counted map-side, so only batches are ranked."""
    held = rows.filter(F.col(batch).isNotNull()).groupBy(run, batch).agg(F.count(F.lit(1)).alias("rows_in"))
    return ranked(held, [F.col(batch).desc()], "age", (run,)).withColumn("age", F.col("age") - 1).filter(F.col("age") < capacity)


def cycle_schedule(steps: DataFrame, step: str, capacity: int, draws: int, every: int) -> DataFrame:
    """(step, replays, refresh): with the buffer full, from the capacity-th fresh batch on, a step is followed by `draws` replays, and
    every `every`-th such step refreshes; before that nothing is replayed."""
    k = ranked(steps.select(step), [step], "_k")
    full = F.col("_k") >= capacity
    return k.select(step, F.when(full, draws).otherwise(0).alias("replays"), (full & ((F.col("_k") - capacity) % every == 0)).alias("refresh"))
