"""Derivatives of the model: grouped normal equations, projector shifts, absorption, windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import erf

PARAMETERS = ("rx", "ry", "rz", "sigma")


def pf_sensitivity(data: DataFrame, sino: DataFrame, pf: DataFrame) -> DataFrame:
    """g(a, k, j, v): data gradient against the projections, on the entries that the pole figures have."""
    rows = data.join(sino.withColumnRenamed("v", "s"), ["a", "y"]).groupBy("a", "k", "j").agg(F.sum(F.col("v") * F.col("s")).alias("v"))
    return rows.join(pf.select("a", "k", "j"), ["a", "k", "j"], "left_semi")


def model_entries(data: DataFrame, sino: DataFrame, slopes: DataFrame) -> DataFrame:
    """Entries of :func:`normal_blocks` from the model: ``data``(a, y, j, r, c), ``sino``(a, y, k, v), ``slopes``(a, k, j, d_*).

    The model is the sum of v times the pole figure, so both sums over y come before the derivatives.
    """
    both = data.join(sino.withColumnRenamed("v", "_s"), ["a", "y"])
    rows = both.groupBy("a", "k", "j").agg(F.sum(F.col("r") * F.col("_s")).alias("r"), F.sum(F.col("c") * F.col("_s") * F.col("_s")).alias("c"))
    return rows.join(slopes.select("a", "k", "j", *[f"d_{p}" for p in PARAMETERS]), ["a", "k", "j"])


def parameter_gradients(data: DataFrame, sino: DataFrame, slopes: DataFrame, n_rings: int) -> DataFrame:
    """(parameter, i, g): the model's transposed derivative applied to a gradient of the data.

    ``data``(a, y, j, v), ``sino``(a, y, k, v), ``slopes``(a, k, j, d_*). Turns and widths are summed per
    orientation, the sample's rotation per angle, the Bragg angle per ring, the azimuth's offset over all.
    """
    both = data.join(sino.withColumnRenamed("v", "_s"), ["a", "y"]).groupBy("a", "k", "j").agg(F.sum(F.col("v") * F.col("_s")).alias("_g"))
    rows = both.join(slopes, ["a", "k", "j"])
    places = {p: F.col("k") for p in PARAMETERS} | {"omega": F.col("a"), "two_theta": F.pmod("j", F.lit(n_rings)), "eta": F.lit(0)}
    parts = F.array(*[F.struct(F.lit(p).alias("parameter"), at.cast("int").alias("i"), (F.col("_g") * F.col(f"d_{p}")).alias("g")) for p, at in places.items()])
    return rows.select(F.explode(parts).alias("x")).groupBy("x.parameter", "x.i").agg(F.sum("x.g").alias("g")).select("parameter", "i", "g")


def normal_blocks(entries: DataFrame) -> DataFrame:
    """Per orientation: gradient (4) and upper triangle (10) of the Gauss-Newton block.

    ``entries``: k, residual weight r, curvature c and derivative columns d_rx .. d_sigma. One aggregate.
    """
    sums = [F.sum(F.col("r") * F.col(f"d_{p}")).alias(f"g_{p}") for p in PARAMETERS]
    sums += [F.sum(F.col("c") * F.col(f"d_{p}") * F.col(f"d_{q}")).alias(f"h_{p}_{q}") for i, p in enumerate(PARAMETERS) for q in PARAMETERS[i:]]
    return entries.groupBy("k").agg(*sums)


def newton_steps(blocks: DataFrame, damping: float = 1e-3, max_rot: float = math.radians(0.2)) -> DataFrame:
    """Damped 4 x 4 solves, one per orientation, rotation part cut to a trust region. Arrow batches."""
    import numpy as np
    import pandas as pd

    names = list(PARAMETERS)

    def work(parts):
        for part in parts:
            n = len(part)
            h, g = np.zeros((n, 4, 4)), np.zeros((n, 4))
            for i, p in enumerate(names):
                g[:, i] = part[f"g_{p}"]
                for j in range(i, 4):
                    h[:, i, j] = h[:, j, i] = part[f"h_{p}_{names[j]}"]
            trace = np.trace(h, axis1=1, axis2=2)
            eye = np.eye(4)
            damped = h + damping * np.einsum("kii->ki", h)[:, :, None] * eye + (1e-12 * np.maximum(trace, 1e-30))[:, None, None] * eye
            good = trace > 0
            step = np.zeros((n, 4))
            if good.any():
                step[good] = -np.linalg.solve(damped[good], g[good][..., None])[..., 0]
            size = np.linalg.norm(step[:, :3], axis=1)
            step[:, :3] *= np.minimum(1.0, max_rot / np.maximum(size, 1e-30))[:, None]
            yield pd.DataFrame({"k": part["k"], **{f"s_{p}": step[:, i] for i, p in enumerate(names)}})

    return blocks.mapInPandas(work, "k int, " + ", ".join(f"s_{p} double" for p in names))


def refine(solve, evaluate, newton, x: DataFrame, orientations: DataFrame, steps: int, alphas: tuple[float, ...] = (1.0, 0.5, 0.25, 0.1), max_dsigma: float = 0.3) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Driver loop of the refinement: x, the refined orientations and the history.

    ``newton(x, orientations)`` -> steps (k, s_*), ``evaluate(x, orientations)`` -> deviance; the first step length
    that lowers it is applied (none: the orientations stay), then ``solve(x, orientations)`` refits the coefficients.
    """
    from ..plans.state import materialise

    history = []
    for _ in range(steps):
        f0 = evaluate(x, orientations)
        wide = newton(x, orientations).join(orientations.select("k", (max_dsigma * F.col("sigma")).alias("_m")), "k")
        found = materialise(wide.withColumn("s_sigma", F.greatest(F.least("s_sigma", "_m"), -F.col("_m"))).drop("_m"))
        taken, f = 0.0, f0
        for alpha in alphas:
            moved = materialise(updated_orientations(orientations, found, alpha))
            value = evaluate(x, moved)
            if value < f0:
                taken, f, orientations = alpha, value, moved
                break
        x = solve(x, orientations)
        history.append({"alpha": taken, "f0": f0, "f": f, "f_fit": evaluate(x, orientations)})
    return x, orientations, history


def shift_weights(geo: DataFrame, nx: int, ny: int, ns: int, h: float = 1e-4) -> DataFrame:
    """d radon / d shift by a central difference of the footprint: the same generated join at two shifts."""
    from .projector import radon_weights

    up = radon_weights(geo.withColumn("t0", F.col("t0") + h), nx, ny, ns).select("a", "y", "p", (F.col("w") / (2 * h)).alias("w"))
    down = radon_weights(geo.withColumn("t0", F.col("t0") - h), nx, ny, ns).select("a", "y", "p", (-F.col("w") / (2 * h)).alias("w"))
    return up.unionByName(down).groupBy("a", "y", "p").agg(F.sum("w").alias("w"))


def angle_gradient(residual: DataFrame, coef: DataFrame, weights: DataFrame) -> DataFrame:
    """Per angle: sum of residual(a, y, k, v) times the shifted projection."""
    moved = coef.join(weights, "p").groupBy("a", "y", "k").agg(F.sum(F.col("v") * F.col("w")).alias("m"))
    return residual.join(moved, ["a", "y", "k"]).groupBy("a").agg(F.sum(F.col("v") * F.col("m")).alias("g"))


def overlap(q: Column, lo: Column, hi: Column, rel: float) -> Column:
    """Share of a Gaussian profile at q (relative width ``rel``) inside the window [lo, hi]."""
    s = 2.0**0.5 * rel * q
    return 0.5 * (erf((hi - q) / s) - erf((lo - q) / s))


def windows_to_rings(reflections: DataFrame, windows: DataFrame, rel: float, least: float = 1e-3) -> DataFrame:
    """window, reflection and overlap, for overlaps above ``least``; windows are a dimension table."""
    both = reflections.crossJoin(F.broadcast(windows))
    return both.withColumn("w", overlap(F.col("q"), F.col("lo"), F.col("hi"), rel)).where(F.col("w") > least)


def window_mean(reflections: DataFrame, windows: DataFrame, rel: float) -> DataFrame:
    """Overlap-weighted mean two-theta and summed amplitude of every window."""
    rows = windows_to_rings(reflections, windows, rel)
    return rows.groupBy("win").agg((F.sum(F.col("w") * F.col("two_theta")) / F.sum("w")).alias("two_theta"), F.sum(F.col("w") * F.col("mult")).alias("amp"))


def attenuation(rays: DataFrame, mu: DataFrame) -> DataFrame:
    """att(dir, p, t): exp(-line integral) of mu(p2, m) along ray(dir, p, p2, len)."""
    return rays.join(mu, "p2").groupBy("dir", "p").agg(F.exp(-F.sum(F.col("len") * F.col("m"))).alias("t"))


def both_ways(into: DataFrame, out: DataFrame) -> DataFrame:
    """att(dir, p, t) of the way in and the way out together; ``out`` is keyed by the angle (class) that it belongs to."""
    return into.join(out.withColumnRenamed("t", "_o"), ["dir", "p"]).select("dir", "p", (F.col("t") * F.col("_o")).alias("t"))


def attenuated_forward(coef: DataFrame, radon: DataFrame, att: DataFrame) -> DataFrame:
    """Projection with the attenuation of each (direction of the angle, pixel) as an extra factor."""
    weights = radon.join(att, (radon["a"] == att["dir"]) & (radon["p"] == att["p"])).select(radon["a"], "y", radon["p"], (F.col("w") * F.col("t")).alias("w"))
    return coef.join(weights, "p").groupBy("a", "y", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def mu_gradient(residual: DataFrame, coef: DataFrame, radon: DataFrame, att: DataFrame, rays: DataFrame) -> DataFrame:
    """d/d mu(p2) of the sum of residual times the attenuated projection."""
    hit = residual.join(radon, ["a", "y"]).withColumnRenamed("v", "r").join(coef, ["k", "p"])
    per = hit.groupBy("a", "p").agg(F.sum(F.col("r") * F.col("w") * F.col("v")).alias("s"))
    lost = per.join(att, (per["a"] == att["dir"]) & (per["p"] == att["p"])).select(per["a"].alias("dir"), per["p"], (F.col("s") * F.col("t")).alias("s"))
    return rays.join(lost, ["dir", "p"]).groupBy("p2").agg((-F.sum(F.col("len") * F.col("s"))).alias("g"))


def direction_rays(directions: DataFrame, nx: int, ny: int) -> DataFrame:
    """ray(dir, p, p2, len): weights of the line integral from each pixel on along ``directions``(dir, dx, dy), unit vectors.

    A square frame of unit steps is turned to the direction; values between pixels are bilinear, zero
    outside. Along a row of the frame the integral is the sum of what follows and half of the point
    itself, and it is taken back to the pixels bilinearly. Rows of one frame meet by (dir, row).
    """
    from .interp import bilinear

    m = math.ceil(math.sqrt(2) * max(nx, ny)) + 3
    cm, cx, cy = (m - 1) / 2, (nx - 1) / 2, (ny - 1) / 2
    spark, dx, dy = directions.sparkSession, F.col("dx"), F.col("dy")
    frame = directions.crossJoin(spark.range(m * m)).withColumns({"u": (F.col("id") % m).cast("int"), "r": F.floor(F.col("id") / m).cast("int")})
    du, dr = F.col("u") - cm, F.col("r") - cm
    points = frame.select(F.struct("dir", "r", "u").alias("id"), (cx + du * dx - dr * dy).alias("x"), (cy + du * dy + dr * dx).alias("y"))
    seen = bilinear(points, nx, ny).select("id.dir", "id.r", F.col("id.u").alias("u2"), F.col("p").alias("p2"), F.col("w").alias("w2"))
    pixels = directions.crossJoin(spark.range(nx * ny)).withColumns({"px": F.col("id") % nx - cx, "py": F.floor(F.col("id") / nx) - cy})
    back = pixels.select(F.struct("dir", F.col("id").cast("int").alias("p")).alias("id"), (F.col("px") * dx + F.col("py") * dy + cm).alias("x"), (F.col("py") * dx - F.col("px") * dy + cm).alias("y"))
    here = bilinear(back, m, m).select("id.dir", F.col("id.p").alias("p"), (F.col("p") % m).cast("int").alias("u"), F.floor(F.col("p") / m).cast("int").alias("r"), "w")
    both = here.join(seen, ["dir", "r"]).where(F.col("u2") >= F.col("u"))
    size = F.col("w") * F.col("w2") * F.when(F.col("u2") == F.col("u"), 0.5).otherwise(1.0)
    return both.groupBy("dir", "p", "p2").agg(F.sum(size).alias("len"))


def axis_rays(spark, nx: int, ny: int) -> DataFrame:
    """ray(dir, p, p2, len) along +x (dir 0) and -x (dir 1): half of the own pixel, whole ones behind it."""
    pixels = spark.range(nx * ny).selectExpr("cast(id as int) p", f"cast(id % {nx} as int) x", f"cast(id div {nx} as int) y")
    ahead = pixels.select(F.lit(0).alias("dir"), "p", "x", "y", F.explode(F.sequence(F.col("x"), F.lit(nx - 1))).alias("x2"))
    behind = pixels.select(F.lit(1).alias("dir"), "p", "x", "y", F.explode(F.sequence(F.lit(0), F.col("x"))).alias("x2"))
    both = ahead.unionByName(behind)
    return both.select("dir", "p", (F.col("x2") + nx * F.col("y")).cast("int").alias("p2"), F.when(F.col("x2") == F.col("x"), 0.5).otherwise(1.0).alias("len"))


def metric_tensor(a: float, b: float, c: float, alpha: float, beta: float, gamma: float):
    """Direct metric tensor, and its derivatives by a, b, c and the three angles (per degree)."""
    import numpy as np

    lengths, angles = (a, b, c), [math.radians(t) for t in (gamma, beta, alpha)]
    pairs = ((0, 1), (0, 2), (1, 2))
    g = np.diag([x * x for x in lengths])
    d = np.zeros((6, 3, 3))
    for i, x in enumerate(lengths):
        d[i, i, i] = 2 * x
    for (i, j), t, slot in zip(pairs, angles, (5, 4, 3)):
        x, y = lengths[i], lengths[j]
        g[i, j] = g[j, i] = x * y * math.cos(t)
        d[i, i, j] = d[i, j, i] = y * math.cos(t)
        d[j, i, j] = d[j, j, i] = x * math.cos(t)
        d[slot, i, j] = d[slot, j, i] = -x * y * math.sin(t) * math.pi / 180
    return g, d


def q_and_derivatives(hkl: DataFrame, cell: tuple[float, ...]) -> DataFrame:
    """hkl with q and dq by the six cell parameters, as expressions of literals."""
    import numpy as np

    g, d = metric_tensor(*cell)
    inv = np.linalg.inv(g)

    def form(m) -> Column:
        return sum((float(m[i, j]) * F.col(x) * F.col(y) for i, x in enumerate("hkl") for j, y in enumerate("hkl")), F.lit(0.0))

    q = 2 * math.pi * F.sqrt(form(inv))
    slopes = {f"dq_{n}": (2 * math.pi) ** 2 * form(-inv @ d[i] @ inv) / (2 * q) for i, n in enumerate(("a", "b", "c", "alpha", "beta", "gamma"))}
    return hkl.withColumns({"q": q, **slopes})


def updated_orientations(orientations: DataFrame, steps: DataFrame, alpha: float = 1.0, limits: tuple[float, float] = (1e-4, 0.1)) -> DataFrame:
    """Orientations turned (from the left) by alpha times their step, widths moved and kept within limits."""
    from ..functions import rotations as rot

    both = orientations.join(steps, "k", "left").fillna(0.0, [f"s_{p}" for p in PARAMETERS])
    turn = rot.from_rotvec(*[alpha * F.col(f"s_r{c}") for c in "xyz"])
    made = rot.product(turn, rot.quat())
    width = F.least(F.greatest(F.col("sigma") + alpha * F.col("s_sigma"), F.lit(limits[0])), F.lit(limits[1]))
    return both.select("k", *[m.alias(f"q{c}") for m, c in zip(made, "xyzw")], width.alias("sigma"))
