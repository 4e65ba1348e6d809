"""Orientation distribution from bulk data, coarse to fine."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rotations as rot
from ..operators import polefigure
from .state import materialise


def random_zone(spark: SparkSession, n: int, ops: DataFrame, seed: int = 1) -> DataFrame:
    """n uniform random orientations in the fundamental zone (subgroup algorithm on three uniforms)."""
    u = [F.rand(seed + i) for i in range(3)]
    rows = spark.range(n).select(F.col("id").cast("int").alias("k"), *[c.alias(f"u{i}") for i, c in enumerate(u)])
    a, b = F.sqrt(1 - F.col("u0")), F.sqrt(F.col("u0"))
    t, s = 2 * math.pi * F.col("u1"), 2 * math.pi * F.col("u2")
    quats = rows.select("k", (a * F.sin(t)).alias("qx"), (a * F.cos(t)).alias("qy"), (b * F.sin(s)).alias("qz"), (b * F.cos(s)).alias("qw"))
    return rot.fundamental_zone(quats, ops)


def halton_ball(spark: SparkSession, n: int, radius: float, normalise: bool = True) -> DataFrame:
    """n low-discrepancy rotation vectors in a ball, as quaternions with weights w.

    Points are even in rotation-vector space, where rotations have the density (sin(r/2) / (r/2))^2 / (8 pi^2): a
    weight is that density times the point's share of the ball. Weights add up to 1, or (``normalise`` off) to
    the ball's part of all rotations, (radius - sin(radius)) / pi.
    """

    def radical(base: int):
        i, f, out = F.col("id") + 1, 1.0, F.lit(0.0)
        for _ in range(math.ceil(math.log(n + 1, base)) + 1):
            f /= base
            out = out + f * (i % base)
            i = F.floor(i / base)
        return out

    u = [radical(b) for b in (2, 3, 5)]
    r, z, t = radius * F.pow(u[0], F.lit(1 / 3)), 2 * u[1] - 1, 2 * math.pi * u[2]
    flat = F.sqrt(1 - z * z)
    q = rot.from_rotvec(r * flat * F.cos(t), r * flat * F.sin(t), r * z)
    w = F.pow(F.sin(r / 2) / (r / 2), F.lit(2.0)) * (radius**3 / (6 * math.pi * n))
    made = spark.range(n).select(F.col("id").cast("int").alias("k"), *[c.alias(f"q{x}") for c, x in zip(q, "xyzw")], w.alias("w"))
    return made.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy())) if normalise else made


def support(odf: DataFrame, rel: float = 1e-2, keep_mass: float | None = None) -> DataFrame:
    """Rows above ``rel`` of the largest weight; with ``keep_mass``, the strongest that hold that share of the whole.

    The running sum is over one level's basis, in blocks of decreasing weight: block totals first.
    """
    top = odf.crossJoin(F.broadcast(odf.agg(F.max("w").alias("_m"), F.sum("w").alias("_s")))).where(F.col("w") > rel * F.col("_m"))
    if keep_mass is None:
        return top.drop("_m", "_s")
    blocks = top.withColumn("_b", F.floor(-F.log2(F.col("w") / F.col("_m"))))  # decreasing weight, a few dozen blocks
    sums = blocks.groupBy("_b").agg(F.sum("w").alias("_t"))
    before = sums.select("_b", (F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_t")).alias("_before"))
    order = Window.partitionBy("_b").orderBy(F.desc("w"), "k")
    run = blocks.join(F.broadcast(before), "_b").withColumn("_c", F.col("_before") + F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("_c") - F.col("w") < keep_mass * F.col("_s")).drop("_m", "_s", "_b", "_t", "_before", "_c")


def fit_bulk(pf: DataFrame, data: DataFrame, niter: int, step: float | None = None) -> DataFrame:
    """Non-negative least squares of data(a, j, b) by accelerated gradients: odf(k, w)."""
    pf = materialise(pf)
    if step is None:
        rows = pf.groupBy("a", "j").agg(F.sum("v").alias("s"))
        bound = pf.join(rows, ["a", "j"]).groupBy("k").agg(F.sum(F.col("v") * F.col("s")).alias("c")).agg(F.max("c")).first()[0]
        step = 1.0 / bound  # the largest column sum of A^T A bounds its norm
    x = y = materialise(pf.select("k").distinct().withColumn("w", F.lit(0.0)))
    t = 1.0
    for _ in range(niter):
        model = pf.join(y, "k").groupBy("a", "j").agg(F.sum(F.col("v") * F.col("w")).alias("m"))
        r = data.join(model, ["a", "j"], "full").select("a", "j", (F.coalesce("m", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("r"))
        grad = pf.join(r, ["a", "j"]).groupBy("k").agg(F.sum(F.col("v") * F.col("r")).alias("g"))
        t2 = 0.5 * (1 + math.sqrt(1 + 4 * t * t))
        beta, t = (t - 1) / t2, t2
        both = y.withColumnRenamed("w", "y").join(grad, "k", "left").join(x.withColumnRenamed("w", "x"), "k")
        state = materialise(both.select("k", "x", F.greatest(F.lit(0.0), F.col("y") - step * F.coalesce("g", F.lit(0.0))).alias("n")))
        x = state.select("k", F.col("n").alias("w"))
        y = state.select("k", (F.col("n") + beta * (F.col("n") - F.col("x"))).alias("w"))
    return x


def reconstruct(spark: SparkSession, data: DataFrame, basis: DataFrame, axes: DataFrame, angle: DataFrame, ring: DataFrame, n_eta: int, ops: DataFrame, spacing: float, levels: int = 2, niter: int = 20, keep_rel: float = 1e-3, factor: float = 0.6) -> list[DataFrame]:
    """Levels of odf(k, w, qx .. qw, spacing, sigma); each refines around the strong orientations of the one before."""
    out, h = [], spacing
    n_rings = ring.count()
    for level in range(levels):
        sigma = factor * h
        poles = polefigure.poles(basis.withColumn("sigma", F.lit(math.radians(sigma))), axes)
        pf = polefigure.pf_table(poles, angle, ring, n_eta).select("a", "k", (F.col("c") * n_rings + F.col("r")).cast("int").alias("j"), "v")
        got = fit_bulk(pf, data, niter)
        odf = materialise(basis.join(got, "k").withColumn("spacing", F.lit(h)).withColumn("sigma", F.lit(sigma)))
        out.append(odf)
        if level + 1 < levels:
            strong = support(odf, keep_rel)
            kids = rot.children(strong, math.radians(h) / 2, 12).withColumn("k", F.col("parent").cast("long") * 32 + F.col("child"))
            kids = rot.fundamental_zone(kids.select("k", "qx", "qy", "qz", "qw"), ops)
            chosen = rot.thin_cells(kids, math.radians(0.8 * h / 2)).select("k")
            kept = materialise(kids.join(chosen, "k", "left_semi"))
            basis = materialise(renumbered(kept))
            h /= 2
    return out


def renumbered(orientations: DataFrame) -> DataFrame:
    """k from 0 on in the order of k, so that numbers stay small over many levels: counts of parts first."""
    parted = orientations.repartitionByRange("k").sortWithinPartitions("k")
    rows = materialise(parted.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before = {p: sum(n for q, n in counts if q < p) for p, _ in counts}
    if not before:
        return rows.drop("_at").withColumn("k", F.col("k").cast("int"))
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[part]
    return rows.withColumn("k", (offset + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")).drop("_at")


def sample(odf: DataFrame, n: int, sigma: float, seed: int = 3, parts: int = 1024) -> DataFrame:
    """n orientations drawn by weight, with Gaussian jitter.

    The running sum is kept in ``parts`` buckets of k: totals of the buckets go through the driver, a
    draw finds its bucket by them and its row by a join within the bucket. Intervals of buckets and of rows
    share their ends and the last ones are open, so rounding loses no draw.
    """
    placed = odf.select("k", "w", *[f"q{c}" for c in "xyzw"], F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("_b"))
    sums = sorted((r["_b"], r["s"]) for r in placed.where("w > 0").groupBy("_b").agg(F.sum("w").alias("s")).collect())  # at most `parts` rows
    ends = [sum(s for _, s in sums[: i + 1]) for i in range(len(sums))]
    order = Window.partitionBy("_b").orderBy("k")
    run = placed.where("w > 0").withColumn("_hi", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumns({"_lo": F.coalesce(F.lag("_hi").over(order), F.lit(float("-inf"))), "_hi": F.when(F.lead("_hi").over(order).isNull(), F.lit(float("inf"))).otherwise(F.col("_hi"))})
    draws = odf.sparkSession.range(n).select(F.col("id").cast("int").alias("m"), (F.rand(seed) * (ends[-1] if ends else 0.0)).alias("_u"), *[F.randn(seed + 1 + i).alias(f"e{i}") for i in range(3)])
    starts = odf.sparkSession.createDataFrame([(b, float(lo), float(hi)) for (b, _), lo, hi in zip(sums, [0.0, *ends], [*ends[:-1], math.inf])], "_b int, _from double, _to double")
    dealt = draws.join(F.broadcast(starts), (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).withColumn("_u", F.col("_u") - F.col("_from"))
    hit = dealt.join(run, "_b").where((F.col("_u") < F.col("_hi")) & (F.col("_u") >= F.col("_lo")))
    q = rot.product(rot.quat(), rot.from_rotvec(*[sigma * F.col(f"e{i}") for i in range(3)]))
    return hit.select(F.col("m").alias("k"), *[c.alias(f"q{x}") for c, x in zip(q, "xyzw")], F.col("k").alias("parent"))


def fit_bulk_phases(pfs: dict[str, DataFrame], data: DataFrame, niter: int) -> dict[str, DataFrame]:
    """Several phases at once: their bases stacked along k, fitted together, then told apart again."""
    stacked, offsets, at = None, {}, 0
    for name, pf in pfs.items():
        n = (pf.agg(F.max("k")).first()[0] or 0) + 1
        part = pf.select("a", "j", (F.col("k") + at).cast("int").alias("k"), "v")
        stacked = part if stacked is None else stacked.unionByName(part)
        offsets[name] = (at, at + n)
        at += n
    got = fit_bulk(stacked, data, niter)
    return {name: got.where((F.col("k") >= lo) & (F.col("k") < hi)).select((F.col("k") - lo).alias("k"), "w") for name, (lo, hi) in offsets.items()}
