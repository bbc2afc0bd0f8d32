"""Comparisons of models as vectors: Gram tables, cosines, restricted distributions, variance components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Side of a matrix that may come to the driver.
MAX_SIDE = 384


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def long_form(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def mean_vectors(df: DataFrame, group: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(group, pos, m): weighted mean of the vectors of each group, coordinate by coordinate."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(group, w.alias("w"), F.posexplode(vector).alias("pos", "x"))
    return rows.groupBy(group, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), F.sum("w").alias("mass"))


def gram(means: DataFrame, label: str, value: str = "m", domain: str | None = None) -> DataFrame:
    """(domain, a, b, dot) for a <= b over labels, and with a domain also the concatenation of all domains under
    NULL, in one pass. Labels are few; coordinates meet by equi-join."""
    on = ["pos", domain] if domain else ["pos"]
    cols = [*on, label, value]
    left = means.select(*cols).withColumnRenamed(label, "a").withColumnRenamed(value, "x")
    right = means.select(*cols).withColumnRenamed(label, "b").withColumnRenamed(value, "y")
    pairs = left.join(right, on).filter("a <= b").withColumn("p", F.col("x") * F.col("y"))
    if not domain:
        return pairs.groupBy("a", "b").agg(F.sum("p").alias("dot"))
    return pairs.groupingSets([[F.col(domain), F.col("a"), F.col("b")], [F.col("a"), F.col("b")]], domain, "a", "b").agg(F.sum("p").alias("dot"))


def cosines(g: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A Gram table with norms, cosine, the least-squares scale of b by a and the residual's share of b. A zero
    norm gives NULLs."""
    by = by or []
    norm = g.filter("a = b").select(*by, F.col("a").alias("l"), F.sqrt("dot").alias("norm"))
    out = g
    for s in ("a", "b"):
        right = norm.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("l").alias("_l"), F.col("norm").alias(f"norm_{s}"))
        cond = out[s] == right["_l"]
        for c in by:
            cond = cond & out[c].eqNullSafe(right[f"_{c}"])
        out = out.join(right, cond).drop("_l", *(f"_{c}" for c in by))
    na, nb = F.nullif("norm_a", F.lit(0.0)), F.nullif("norm_b", F.lit(0.0))
    cos = F.col("dot") / (na * nb)
    return out.withColumn("cosine", cos).withColumn("scale", F.col("dot") / (na * na)).withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), 1 - cos * cos)))


def local_matrix(g: DataFrame, value: str = "dot") -> tuple[list, np.ndarray]:
    """A symmetric table (a, b, value) as a matrix; refuses sides over MAX_SIDE."""
    rows = g.select("a", "b", value).limit(MAX_SIDE * (MAX_SIDE + 1) // 2 + 1).collect()
    labels = sorted({r.a for r in rows} | {r.b for r in rows})
    if len(labels) > MAX_SIDE:
        raise ValueError("matrix too large for the driver")
    at = {x: i for i, x in enumerate(labels)}
    m = np.zeros((len(labels),) * 2)
    for r in rows:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r[value]
    return labels, m


def spectrum(g: DataFrame) -> DataFrame:
    """Eigenvalues of a Gram table in falling order, their shares, and the participation ratio and stable rank."""
    spark = g.sparkSession
    _, m = local_matrix(g)
    ev = np.maximum(np.linalg.eigvalsh(m)[::-1], 0)
    total = ev.sum() or 1.0
    part = float(total**2 / (ev**2).sum()) if (ev**2).sum() else None
    return spark.createDataFrame([(i + 1, float(x), float(x / total), part, float(total / ev[0]) if ev[0] else None) for i, x in enumerate(ev)], "k int, value double, share double, participation double, stable_rank double")


def residual_gram(g: DataFrame, teacher) -> DataFrame:
    """Gram table of what is left of each label after its part along `teacher`: the Schur complement."""
    t = g.filter((F.col("a") == teacher) | (F.col("b") == teacher)).select(F.when(F.col("a") == teacher, F.col("b")).otherwise(F.col("a")).alias("l"), F.col("dot").alias("with"))
    own = g.filter((F.col("a") == teacher) & (F.col("b") == teacher)).select(F.col("dot").alias("own"))
    out = g.filter((F.col("a") != teacher) & (F.col("b") != teacher)).join(t.toDF("a", "wa"), "a").join(t.toDF("b", "wb"), "b").crossJoin(F.broadcast(own))  # one row
    return out.select("a", "b", (F.col("dot") - F.col("wa") * F.col("wb") / F.nullif("own", F.lit(0.0))).alias("dot"))


def variance_components(df: DataFrame, group: str, value: str) -> DataFrame:
    """Common, between and within energies of a one-way layout, and the between component with the within noise
    taken off. From grouped sums: no group is collected."""
    v = F.col(value).cast("double")
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = per.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    common = F.col("s") * F.col("s") / F.col("n")
    between, within = F.col("b") - common, F.col("q") - F.col("b")
    msb, msw = between / (F.col("groups") - 1), within / (F.col("n") - F.col("groups"))
    size = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("groups") - 1)
    return t.select(common.alias("common"), between.alias("between"), within.alias("within"), ((msb - msw) / size).alias("component"))


def permutation_p(x: list[float], y: list[float]) -> float:
    """Exact two-sided permutation p of the correlation of three to nine pairs."""
    import itertools

    a, b = np.array(x) - np.mean(x), np.array(y) - np.mean(y)
    if not 3 <= len(a) <= 9 or not a.any() or not b.any():
        return float("nan")
    perms = np.array(list(itertools.permutations(range(len(b)))))
    stats = np.abs((a * b[perms]).sum(1))
    return float((stats >= abs((a * b).sum()) - 1e-12).mean())


def bootstrap_cosines(stats: DataFrame, draws: int, seed: int) -> DataFrame:
    """stats: one row a probe with sums ab, aa, bb. 2.5, 50 and 97.5 % quantiles of the cosine when whole probes
    are drawn anew: each row gets a Poisson(1) count in every draw, hashed from probe and draw, so draws are
    grouped sums over the table and nothing but `draws` sums comes to the driver."""
    rows = stats.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "probe", "draw"), F.lit(1 << 40)) / float(1 << 40)
    cut, p, count = 0.0, float(np.exp(-1)), F.lit(0)
    for k in range(0, 8):
        cut += p
        count = F.when(u >= cut, k + 1).otherwise(count) if k else F.when(u >= cut, 1).otherwise(0)
        p /= k + 1
    sums = rows.withColumn("c", count).groupBy("draw").agg(*(F.sum(F.col("c") * F.col(x)).alias(x) for x in ("ab", "aa", "bb")))
    cos = sums.select((F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("cosine"))
    return cos.agg(*(F.percentile("cosine", q).alias(n) for n, q in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))))


def clip_factor(norm: Column, most: float) -> Column:
    """What a gradient of this norm is multiplied with so that it is no longer than `most`; 1 for a zero norm."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(norm, F.lit(1e-24)))


def participation(g: DataFrame) -> DataFrame:
    """(participation, trace) of a Gram table (a, b, dot) with a <= b, from its traces."""
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    trace = F.sum(F.when(F.col("a") == F.col("b"), F.col("dot")))
    return g.agg((trace * trace / F.nullif(F.sum(twice * F.col("dot") * F.col("dot")), F.lit(0.0))).alias("participation"), trace.alias("trace"))


def select_prefix(df: DataFrame, sketch: str, prefix: str = "full", prefixes: tuple[str, ...] = ()) -> DataFrame:
    """df with the sketch as an array of seeds, each an array of numbers, whatever it came as: a bare vector (only of the full
    response), vectors by seed, or those by prefix, of which the named one is taken."""
    depth, kind = 0, df.schema[sketch].dataType
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    if depth == 1:
        if prefix != "full":
            raise ValueError("a bare vector is of the full response alone")
        return df.withColumn(sketch, F.array(sketch))
    if depth == 2:
        return df
    if depth != 3:
        raise ValueError(f"a sketch of depth {depth}")
    if prefix not in prefixes:
        raise ValueError(f"{prefix!r} is none of {prefixes}")
    return df.withColumn(sketch, F.col(sketch)[prefixes.index(prefix)])


def rectangular(df: DataFrame, group: str, member: str, vector: str) -> DataFrame:
    """(group, members, dimension, rectangular): whether every group has as many distinct members, and vectors of one length,
    as the largest group has."""
    g = df.groupBy(group, member).agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"), F.count(F.lit(1)).alias("n"))
    g = g.groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("dimension"), F.max("n").alias("n"))
    most = g.agg(F.max("members").alias("_m"), F.max("dimension").alias("_d"))
    same = (F.col("members") == F.col("_m")) & (F.col("lo") == F.col("_d")) & (F.col("n") == 1)
    return g.crossJoin(F.broadcast(most)).select(group, "members", "dimension", same.alias("rectangular"))  # one row


def quartet_gap(gram: np.ndarray, low: list[int], high: list[int], split: int, draws: int, seed: int) -> tuple[float, float, float]:
    """5 %, mean and 95 % of how much more alike the prompts of high are to each other than those of low, when the responses of
    every half are drawn anew. gram has 2 * split rows for each prompt, in order; two prompts are compared by the mean cosine
    of one's first half with the other's second. Counts of a half are multinomial, so no draw touches the vectors."""
    rng, prompts = np.random.Generator(np.random.PCG64(seed)), [*low, *high]
    counts = rng.multinomial(split, np.full(split, 1 / split), size=(draws, len(prompts), 2)) / split
    rows = np.array([[np.arange(split) + (2 * p + h) * split for h in (0, 1)] for p in prompts])
    inner = lambda i, a, j, b: np.einsum("dx,xy,dy->d", counts[:, i, a], gram[np.ix_(rows[i, a], rows[j, b])], counts[:, j, b])
    norm = {(i, h): np.sqrt(np.maximum(inner(i, h, i, h), 1e-24)) for i in range(len(prompts)) for h in (0, 1)}

    def alike(members: range) -> np.ndarray:
        pairs = [(i, j) for i in members for j in members if i < j]
        return sum(inner(i, a, j, 1 - a) / norm[i, a] / norm[j, 1 - a] / 2 for i, j in pairs for a in (0, 1)) / len(pairs)

    gap = alike(range(len(low), len(prompts))) - alike(range(len(low)))
    return float(np.percentile(gap, 5)), float(gap.mean()), float(np.percentile(gap, 95))


def subspace_overlaps(a: np.ndarray, b: np.ndarray, ranks: list[int]) -> list[tuple[int, float, float]]:
    """(rank, overlap, least cosine) of the leading row spaces of two matrices: the mean squared and the least canonical cosine.
    Ranks beyond what either matrix has are left out."""
    u, v = (np.linalg.svd(x, full_matrices=False) for x in (a, b))
    most = min(int((s[1] > 1e-12 * max(s[1][0], 1e-300)).sum()) for s in (u, v))
    out = []
    for r in (r for r in ranks if r <= most):
        c = np.linalg.svd(u[2][:r] @ v[2][:r].T, compute_uv=False)
        out.append((r, float((c**2).mean()), float(c.min())))
    return out


def frozen_audit(discovery: np.ndarray, confirmation: np.ndarray, chosen: list[int], draws: int, seed: int, ridge: float = 1.0) -> dict:
    """A selection made on discovery rows, looked at on confirmation rows only: its log determinant there, where that stands
    among random sets of its size, and how well the two halves' leading spaces agree. Nothing is selected anew."""
    gram = confirmation @ confirmation.T / ridge
    value = lambda s: float(np.linalg.slogdet(np.eye(len(s)) + gram[np.ix_(s, s)])[1])
    rng = np.random.Generator(np.random.PCG64(seed))
    ref = np.array([value(rng.choice(len(gram), len(chosen), replace=False)) for _ in range(draws)])
    own, sd = value(chosen), float(ref.std(ddof=1))
    (_, overlap, _), *_ = subspace_overlaps(discovery, confirmation, [len(chosen)]) or [(0, float("nan"), 0.0)]
    return {"value": own, "mean": float(ref.mean()), "sd": sd, "z": (own - float(ref.mean())) / (sd or 1.0), "percentile": float((ref <= own).mean()), "overlap": overlap}


def small_matrix(means: DataFrame, label: str) -> tuple[list, np.ndarray]:
    """Labels and their mean vectors (label, pos, m) as a matrix; refuses over MAX_SIDE labels or 4096 coordinates."""
    rows = means.select(label, "pos", "m").limit(MAX_SIDE * 4_096 + 1).collect()
    labels, dims = sorted({r[label] for r in rows}), max((r.pos for r in rows), default=-1) + 1
    if len(labels) > MAX_SIDE or dims > 4_096:
        raise ValueError("matrix too large for the driver")
    at, out = {x: i for i, x in enumerate(labels)}, np.zeros((len(labels), dims))
    for r in rows:
        out[at[r[label]], r.pos] = r.m
    return labels, out


def influence(df: DataFrame, loss: str, base: str, teacher: str) -> DataFrame:
    """df with the gain of a model over the base and its share of the teacher's gap. A gap that isn't positive is an error, since no
    share of it means anything; NULL losses give NULLs."""
    gap = F.col(base) - F.col(teacher)
    checked = F.when(gap <= 0, F.raise_error(F.lit("the teacher is no better than the base")).cast("double")).otherwise(gap)
    gain = F.col(base) - F.col(loss)
    return df.withColumn("gain", gain).withColumn("fraction", gain / checked)
