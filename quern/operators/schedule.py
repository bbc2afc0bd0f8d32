"""Selection orders, apportionment and balanced presentation schedules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import stable_hash
from quern.operators.ranks import ranked

MAX_STRATA = 10_000
MAX_POOL = 1_000_000
#: Numbers (rows selected times dimension) that may be broadcast.
MAX_SELECTED = 4_000_000


def exposure_targets(support: DataFrame, item: str, total: int, hash_of: Column) -> DataFrame:
    """How often each item is presented: total div M, and once more for the total mod M items of smallest hash."""
    r = ranked(support.select(item, hash_of.alias("_h")), ["_h", item], "_r", (), "_m")
    q = F.floor(F.lit(total) / F.col("_m"))
    return r.select(item, (q + (F.col("_r") <= F.lit(total) - q * F.col("_m")).cast("long")).alias("target"), F.col("_m").alias("size"))


def balanced_schedule(targets: DataFrame, item: str, seed: int, tag: str, batch: int, item_text: Column | None = None) -> DataFrame:
    """One row for each presentation: round p lists the items with more than p presentations by hash(seed, tag, p,
    item). Rounds before the last are full, so a row's place is p * size + its rank in the round, and no global
    sort is needed."""
    text = F.col(item).cast("string") if item_text is None else item_text
    rows = targets.filter("target > 0").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("target") - 1)))
    rows = rows.withColumn("_h", stable_hash(seed, tag, F.col("round").cast("string"), text))
    rows = ranked(rows, ["_h", item], "_r", ("round",))
    index = F.col("round") * F.col("size") + F.col("_r") - 1
    rows = rows.withColumn("schedule_index", index.cast("long"))
    return rows.select(item, "round", "schedule_index", F.floor(F.col("schedule_index") / batch).alias("step"), (F.col("schedule_index") % batch).alias("position"))


def apportion(strata: DataFrame, stratum: str, weight: str, quota: int, hash_of: Column) -> DataFrame:
    """Largest remainders: the floor of each share of the quota, and one more for the largest fractions, the
    smaller hash winning ties. strata has one row each."""
    total = strata.agg(F.sum(weight).cast("double").alias("_t"))
    exact = F.col(weight) * F.lit(quota) / F.col("_t")
    rows = strata.crossJoin(F.broadcast(total)).withColumn("_f", F.floor(exact)).withColumn("_rest", F.round(exact - F.col("_f"), 9)).withColumn("_h", hash_of)  # one row
    rows = ranked(rows, [F.col("_rest").desc(), F.col("_h")], "_r")
    given = rows.agg(F.sum("_f").alias("_g"))
    return rows.crossJoin(F.broadcast(given)).select(*strata.columns, (F.col("_f") + (F.col("_r") <= F.lit(quota) - F.col("_g")).cast("long")).cast("long").alias("quota"))  # one row


def stratified_interleave(df: DataFrame, row_id: str, stratum: str, within: Column, support: int, tie_seed: int | None = None, largest: bool = False) -> DataFrame:
    """The first `support` rows of the largest-deficit interleave of strata, with their rank. Among equal deficits the first
    name wins, or with a tie_seed the stratum whose hash of seed and name is smallest, or largest. Only the table of
    stratum sizes (at most MAX_STRATA rows, checked) and the prefix of the sequence are on the driver; rows are
    ranked in their strata by a distributed sort and joined to the sequence."""
    spark = df.sparkSession
    rows = ranked(df.select(row_id, stratum, within.alias("_h")), ["_h", row_id], "offset", (stratum,), "_n")
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).orderBy(stratum).limit(MAX_STRATA + 1).collect()
    if len(sizes) > MAX_STRATA:
        raise ValueError("too many strata")
    names = [str(r[0]) for r in sizes]
    n, total = np.array([r.n for r in sizes], float), sum(r.n for r in sizes)
    keys = names
    if tie_seed is not None:
        keys = [hashlib.sha256(json.dumps([tie_seed, "stratum", x], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for x in names]
    place = np.argsort(np.argsort(keys)) * (-1 if largest else 1)
    taken, seq = np.zeros(len(n)), []
    for k in range(1, min(support, total) + 1):
        lag = np.where(taken < n, k * n / total - taken, -np.inf)
        best = np.flatnonzero(lag >= lag.max() - 1e-12)
        s = int(best[np.argmin(place[best])])
        taken[s] += 1
        seq.append((k, sizes[s][0], int(taken[s])))
    plan = spark.createDataFrame(seq, f"rank long, {stratum} {df.schema[stratum].dataType.simpleString()}, offset long")
    return rows.join(plan, (rows[stratum].eqNullSafe(plan[stratum])) & (rows["offset"] == plan["offset"])).select(row_id, rows[stratum], "rank")


def farthest_first(df: DataFrame, row_id: str, vector: str, k: int, seed: str) -> DataFrame:
    """k rows, each the least similar (by cosine) to those before; the first lies nearest to the mean direction.
    Each step is one pass over the unit vectors with the newest one as a literal; the similarity to the nearest
    selected one is kept in a table. The driver holds k vectors."""
    from quern.session import materialize

    spark = df.sparkSession
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = df.select(row_id, F.transform(vector, lambda x: x.cast("double") / norm).alias("_v"), F.sha2(F.concat(F.lit(seed + ":"), F.col(row_id).cast("string")), 256).alias("_h"))
    unit = materialize(unit.filter(norm > 0), "farthest")
    centre = unit.select(F.posexplode("_v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # one row a dimension
    mean = np.array([r.m for r in centre])
    dot = lambda v: F.aggregate(F.zip_with("_v", F.array(*(F.lit(float(x)) for x in v)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    first = unit.select(row_id, "_v", "_h", F.round(dot(mean / (np.linalg.norm(mean) or 1)), 9).alias("s")).orderBy(F.desc("s"), "_h").first()
    chosen = [(first[row_id], first["_v"], 1)]
    held = unit.withColumn("_near", F.lit(-2.0))
    while len(chosen) < k:
        held = held.withColumn("_near", F.greatest("_near", F.round(dot(chosen[-1][1]), 9)))
        if len(chosen) % 8 == 0:
            held = materialize(held, "farthest")
        ids = [c[0] for c in chosen]
        nxt = held.filter(~F.col(row_id).isin(ids)).orderBy("_near", "_h").first()
        if nxt is None:
            break
        chosen.append((nxt[row_id], nxt["_v"], len(chosen) + 1))
    return spark.createDataFrame([(c[0], c[2]) for c in chosen], f"{row_id} {df.schema[row_id].dataType.simpleString()}, rank int")


def greedy_d_optimal(df: DataFrame, row_id: str, vector: str, k: int, cost: str | None = None, power: float = 0.0, ridge: float = 1.0) -> DataFrame:
    """Greedy D-optimal design: each step takes the row with the largest log(1 + z' A^-1 z), divided by the cost
    relative to its median to a power; ties go to the smallest id. A^-1 (dimension squared numbers) and the k
    chosen rows are on the driver; gains of all rows are computed where they lie, one pass a step."""
    spark = df.sparkSession
    base = df.select(row_id, F.transform(vector, lambda x: x.cast("double")).alias("z"), (F.col(cost).cast("double") if cost else F.lit(1.0)).alias("c"))
    mid = base.agg(F.percentile_approx("c", 0.5, 10_000)).first()[0] or 1.0
    dim = base.select(F.size("z")).first()[0]
    inv, chosen = np.eye(dim) / ridge, []

    def gains(a: np.ndarray, done: list):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for f in frames:
                f = f[~f[row_id].isin(done)]
                if not len(f):
                    continue
                z = np.stack(f["z"].to_numpy())
                g = np.round(np.log1p(np.einsum("ij,jk,ik->i", z, a, z)) / (f["c"].to_numpy() / mid) ** power, 9)
                top = f.assign(g=g).sort_values(["g", row_id], ascending=[False, True]).head(1)
                if best is None or (-top.g.iloc[0], top[row_id].iloc[0]) < (-best.g.iloc[0], best[row_id].iloc[0]):
                    best = top
            if best is not None:
                yield best[[row_id, "z", "g"]]

        return run

    kind = df.schema[row_id].dataType.simpleString()
    while len(chosen) < k:
        top = base.mapInPandas(gains(inv, [c[0] for c in chosen]), f"{row_id} {kind}, z array<double>, g double").orderBy(F.desc("g"), row_id).first()
        if top is None:
            break
        z = np.array(top.z)
        az = inv @ z
        inv -= np.outer(az, az) / (1 + z @ az)
        chosen.append((top[row_id], len(chosen) + 1, float(top.g)))
    return spark.createDataFrame(chosen, f"{row_id} {kind}, rank int, gain double")



def seeded_permutation(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """(row_id, place): the rows in ascending id, permuted by a PCG64 generator. Rows are ranked where they lie; the generator's
    order of at most MAX_POOL numbers is made on the driver and joined by rank. A larger pool is refused: use a hash order."""
    n = df.count()
    if n > MAX_POOL:
        raise ValueError(f"a pool of over {MAX_POOL} rows has no generator's order")
    order = np.random.Generator(np.random.PCG64(seed)).permutation(n)
    places = df.sparkSession.createDataFrame(pd.DataFrame({"_r": order + 1, "place": np.arange(n)}))
    return ranked(df.select(row_id), [row_id], "_r").join(places, "_r").select(row_id, F.col("place").cast("long").alias("place"))


def nearest_selected(df: DataFrame, selected: DataFrame, row_id: str, vector: str, order: str) -> DataFrame:
    """(row_id, distance, nearest): for each row the cosine distance to the nearest selected row, itself aside, and its id;
    a row that is selected sees only those selected before it, so the first one has none. selected is the small side, checked
    to hold at most MAX_SELECTED numbers, and is broadcast; ties go to the earliest. NULL and zero vectors are left out."""
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))
    good = lambda d: d.filter(F.exists(vector, lambda x: x != 0))
    picked = good(selected).select(row_id, order, unit(F.col(vector)).alias("v"))
    size = picked.agg(F.count(F.lit(1)) * F.max(F.size("v"))).first()[0] or 0
    if size > MAX_SELECTED:
        raise ValueError("too much is selected to be broadcast")
    all_of = picked.agg(F.array_sort(F.collect_list(F.struct(order, F.col(row_id).alias("id"), "v"))).alias("s"))  # the checked small side
    rows = good(df).join(picked.select(row_id, order), row_id, "left").select(row_id, order, unit(F.col(vector)).alias("v"))
    rows = rows.crossJoin(F.broadcast(all_of))  # one row
    seen = F.filter("s", lambda x: (x["id"] != F.col(row_id)) & (F.col(order).isNull() | (x[order] < F.col(order))))
    dot = lambda x: F.aggregate(F.zip_with(x["v"], F.col("v"), lambda a, b: a * b), F.lit(0.0), lambda a, y: a + y)
    best = F.array_min(F.transform(seen, lambda x: F.struct(F.round(1 - dot(x), 9).alias("d"), x[order].alias("o"), x["id"].alias("id"))))
    return rows.select(row_id, best.alias("b")).select(row_id, F.col("b.d").alias("distance"), F.col("b.id").alias("nearest"))
