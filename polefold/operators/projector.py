"""Parallel-beam projection as a table of footprint weights, and its transpose.

Weights are made once by a generated range join: a pixel and an angle touch a computed interval of
detector bins, which is exploded; no product with all bins is formed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def angles(spark: SparkSession, n: int, first: float = 0.0, last: float = math.pi, subsets: int = 1) -> DataFrame:
    """angle(a, theta, subset, fitted): midpoints of n equal steps; blocks of five, every fifth held out."""
    a = F.col("id").cast("int")
    return spark.range(n).select(
        a.alias("a"), (F.lit(first) + (a + 0.5) * (last - first) / n).alias("theta"), (a % subsets).alias("subset"), ((F.floor(a / 5) % 5) != 2).alias("fitted")
    )


def geometry(angle: DataFrame, nx: int, ny: int, ns: int, rho: float = 1.0, shift: float = 0.0) -> DataFrame:
    """angle with gx, gy, t0: pixel (x, y) lands at gx x + gy y + t0, in detector bins."""
    turned = F.col("theta") - math.pi / 2
    gx, gy = F.cos(turned) / rho, F.sin(turned) / rho
    return angle.withColumns({"gx": gx, "gy": gy, "t0": (ns - 1) / 2.0 - gx * ((nx - 1) / 2.0) - gy * ((ny - 1) / 2.0) - shift})


def radon_weights(geo: DataFrame, nx: int, ny: int, ns: int, kernel: str = "trapezoid", scale: float = 1.0) -> DataFrame:
    """radon(a, y, p, w). ``kernel``: "trapezoid" (distance driven) or "hat"."""
    spark = geo.sparkSession
    pixels = spark.range(nx * ny).select(F.col("id").cast("int").alias("p"))
    p = F.col("p")
    both = pixels.crossJoin(F.broadcast(geo.select("a", "gx", "gy", "t0")))  # the angles are the scan's dimension table
    both = both.select("a", "p", (F.col("gx") * (p % nx) + F.col("gy") * F.floor(p / nx) + F.col("t0")).alias("t"), F.greatest(F.abs("gx"), F.abs("gy")).alias("big"))
    half = (1 + F.col("big")) / 2 if kernel == "trapezoid" else F.lit(1.0)
    low, high = F.greatest(F.ceil(F.col("t") - half), F.lit(0)), F.least(F.floor(F.col("t") + half), F.lit(ns - 1))
    bins = both.where(low <= high).select("a", "p", "t", "big", F.explode(F.sequence(low, high)).alias("y"))
    d = F.abs(F.col("t") - F.col("y"))
    w = F.least(F.greatest((1 + F.col("big")) / 2 - d, F.lit(0.0)), F.least(F.lit(1.0), F.col("big"))) / F.col("big") if kernel == "trapezoid" else F.greatest(1 - d, F.lit(0.0))
    return bins.select("a", F.col("y").cast("int").alias("y"), "p", (w * scale).alias("w")).where("w > 1e-9")


def forward(coef: DataFrame, radon: DataFrame) -> DataFrame:
    """sino(a, y, k, v)."""
    return coef.join(radon, "p").groupBy("a", "y", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def adjoint(sino: DataFrame, radon: DataFrame) -> DataFrame:
    """coef(k, p, v): the transpose of ``forward``."""
    return sino.join(radon, ["a", "y"]).groupBy("k", "p").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def adjoint_listed(sino: DataFrame, radon: DataFrame, pixels: DataFrame, listed: DataFrame) -> DataFrame:
    """Backprojection at the pixels p and angles a that are listed; both lists reduce the weights first."""
    return adjoint(sino, radon.join(pixels.select("p"), "p", "left_semi").join(listed.select("a"), "a", "left_semi"))


def restricted(radon: DataFrame, angle: DataFrame, condition: str) -> DataFrame:
    """Weights of the angles for which the condition on ``angle`` holds."""
    return radon.join(F.broadcast(angle.where(condition).select("a")), "a", "left_semi")


def fov_mask(geo: DataFrame, nx: int, ny: int, ns: int, margin: float = 0.0) -> DataFrame:
    """support(p): pixels that fall on the detector at every angle."""
    spark = geo.sparkSession
    p = F.col("p")
    pixels = spark.range(nx * ny).select(F.col("id").cast("int").alias("p"))
    t = F.col("gx") * (p % nx) + F.col("gy") * F.floor(p / nx) + F.col("t0")
    seen = pixels.crossJoin(F.broadcast(geo.select("gx", "gy", "t0"))).select("p", F.abs(t - (ns - 1) / 2.0).alias("off"))
    return seen.groupBy("p").agg(F.max("off").alias("off")).where(F.col("off") <= (ns - 1) / 2.0 - margin + 1e-9).select("p")


def beam_blur(data: DataFrame, weights: dict[int, float], ns: int) -> DataFrame:
    """Blur along the translation axis, zero outside; the kernel is a short literal."""
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in sorted(weights.items())])
    spread = data.select("a", "y", "j", "b", F.explode(taps).alias("t")).select("a", (F.col("y") + F.col("t.o")).alias("y"), "j", (F.col("b") * F.col("t.w")).alias("b"))
    return spread.where(f"y >= 0 and y < {ns}").groupBy("a", "y", "j").agg(F.sum("b").alias("b"))
