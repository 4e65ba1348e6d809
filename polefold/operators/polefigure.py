"""Probed directions, pole axes and the sparse pole-figure table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rotations as rot
from . import quadrature

CUT = 8.0  # fixed value: exponents from here on contribute nothing


def _nodes(spark: SparkSession, rule: tuple[int, int] | None) -> DataFrame:
    """node(s, x, wq) of a bin in one direction; its middle alone without a rule."""
    return quadrature.node_table(spark, rule or (1, 1))


def probes(angle: DataFrame, n_eta: int, ring: DataFrame, rule: quadrature.Rule | None = None, d_omega: float = 0.0) -> DataFrame:
    """probe(a, c, r, vx, vy, vz): the crystal direction that each angle, azimuth and ring probes.

    Rotation axis z, beam along y, azimuth from x to z. Small dimension tables are crossed. With a rule the
    directions at all nodes of a bin of ``d_omega`` radians and an azimuth's width, with s, t (the node's
    numbers) and wq (its weight, 1 a bin).
    """
    spark, step = angle.sparkSession, 2 * math.pi / n_eta
    at = _nodes(spark, rule.eta if rule else None).select(F.col("s").alias("t"), F.col("x").alias("xt"), F.col("wq").alias("wt"))
    eta = spark.range(n_eta).crossJoin(F.broadcast(at)).select(F.col("id").cast("int").alias("c"), "t", "wt", ((F.col("id") + F.col("xt")) * step).alias("eta"))
    cells = angle.select("a", "theta").crossJoin(F.broadcast(_nodes(spark, rule.omega if rule else None)))
    cells = cells.crossJoin(F.broadcast(eta)).crossJoin(F.broadcast(ring.select("r", "two_theta")))
    th, eta, om = F.col("two_theta") / 2, F.col("eta"), F.col("theta") + (F.col("x") - 0.5) * d_omega
    x, y, z = F.cos(th) * F.cos(eta), -F.sin(th), F.cos(th) * F.sin(eta)
    more = ["s", "t", (F.col("wq") * F.col("wt")).alias("wq")] if rule else []
    return cells.select("a", "c", "r", *more, (F.cos(om) * x - F.sin(om) * y).alias("vx"), (F.sin(om) * x + F.cos(om) * y).alias("vy"), z.alias("vz"))


def pole_axes(normals: DataFrame, ops: DataFrame) -> DataFrame:
    """axis(r, nx, ny, nz, cnt): distinct images of the normals of each ring up to sign, with summed shares."""
    turned = normals.crossJoin(F.broadcast(ops))
    x, y, z = (F.round(c, 6) + F.lit(0.0) for c in rot.rotate(rot.quat(), (F.col("hx"), F.col("hy"), F.col("hz"))))
    sign = F.when(F.abs(x) > 1e-6, F.signum(x)).when(F.abs(y) > 1e-6, F.signum(y)).otherwise(F.signum(z))
    images = turned.select("r", "share", x.alias("x"), y.alias("y"), z.alias("z"), sign.alias("s"))
    keyed = images.select("r", "share", *[(F.col(c) * F.col("s") + F.lit(0.0)).alias(f"n{c}") for c in "xyz"])
    return keyed.groupBy("r", "nx", "ny", "nz").agg(F.sum("share").alias("cnt"))


def poles(orientations: DataFrame, axes: DataFrame) -> DataFrame:
    """pole(k, r, px, py, pz, cnt, sigma): every axis in the sample frame of every orientation."""
    both = orientations.crossJoin(F.broadcast(axes))
    x, y, z = rot.rotate(rot.quat(), (F.col("nx"), F.col("ny"), F.col("nz")))
    return both.select("k", "r", "cnt", "sigma", x.alias("px"), y.alias("py"), z.alias("pz"))


def density(d: Column, sigma: Column) -> Column:
    """Even in the sign of the axis; both terms are cut."""
    near, far = (1 - F.abs(d)) / (sigma * sigma), (1 + F.abs(d)) / (sigma * sigma)
    return F.when(near < CUT, F.exp(-near)).otherwise(0.0) + F.when(far < CUT, F.exp(-far)).otherwise(0.0)


def _hits(pole: DataFrame, angle: DataFrame, ring: DataFrame, n_eta: int, offsets: tuple[float, ...] = (0.5,)) -> DataFrame:
    """Poles at azimuths c, for each pole and angle only bins with a node (at ``offsets`` of a bin) that can pass the cut.

    With the rotation undone, a pole p meets azimuth eta at amp cos(eta - phi) - off; |.| > tau holds on
    two arcs, whose bins are generated and then evaluated; ``side`` is the sign on the arc, 0 for a
    kernel too wide for arcs, which takes all azimuths. The full product is never formed.
    """
    angle = angle.select("a", "theta", *(["wa"] if "wa" in angle.columns else []))
    cells = pole.crossJoin(F.broadcast(angle)).join(F.broadcast(ring.select("r", "two_theta")), "r")
    om, th = F.col("theta"), F.col("two_theta") / 2
    x = F.cos(om) * F.col("px") + F.sin(om) * F.col("py")
    y = -F.sin(om) * F.col("px") + F.cos(om) * F.col("py")
    cells = cells.select("a", "k", "r", "cnt", "sigma", *(c for c in angle.columns if c == "wa"), om.alias("om"), th.alias("th"), x.alias("x"), y.alias("y"), "pz", (F.cos(th) * F.hypot(x, F.col("pz"))).alias("amp"), F.atan2(F.col("pz"), x).alias("phi"), (F.sin(th) * y).alias("off"))
    tau = 1 - CUT * F.col("sigma") * F.col("sigma")
    step = 2 * math.pi / n_eta

    def arc(sign: int) -> Column:
        # sign (amp cos(eta - phi) - off) > tau; c is the cosine that the azimuth's distance must exceed
        c = (tau + sign * F.col("off")) / F.col("amp")
        centre = F.col("phi") + (0.0 if sign > 0 else math.pi)
        wide = tau <= 0
        half = F.when((c <= -1) | wide, F.lit(math.pi)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(c, F.lit(1.0)))))
        low, high = F.ceil((centre - half) / step - max(offsets)), F.floor((centre + half) / step - min(offsets))
        meets = ((c <= 1) | wide) if sign > 0 else ((c <= 1) & ~wide)
        high = F.least(high, low + (n_eta - 1))
        return F.when(meets & (low <= high), F.struct(low.alias("low"), high.alias("high"), F.when(wide, 0).otherwise(sign).alias("side")))

    # the arcs' ends first, so that the bins of an arc are generated from two numbers
    arcs = cells.where("amp > 1e-12").withColumns({"one": arc(1), "two": arc(-1)}).where("one is not null or two is not null")
    arcs = arcs.withColumn("arc", F.explode(F.array("one", "two"))).drop("one", "two").where("arc is not null")
    kept = [c for c in arcs.columns if c != "arc"]
    bins = arcs.select(*kept, F.col("arc.side").alias("side"), F.explode(F.sequence("arc.low", "arc.high")).alias("e"))
    return bins.withColumn("c", F.pmod("e", F.lit(n_eta)).cast("int")).drop("e")


def _cosine(offset: float, n_eta: int) -> Column:
    return F.col("amp") * F.cos((F.col("c") + offset) * (2 * math.pi / n_eta) - F.col("phi")) - F.col("off")


def pf_table(pole: DataFrame, angle: DataFrame, ring: DataFrame, n_eta: int, rule: quadrature.Rule | None = None, d_omega: float = 0.0) -> DataFrame:
    """pf(a, k, c, r, v), on the azimuths of :func:`_hits`.

    Without a rule a bin has the density at its middle. With one it has the mean over the bin (``d_omega``
    radians by an azimuth) by the rule's nodes: a bin counts where any of its nodes passes the cut, the nodes
    of its azimuth are added in the row, those of its angle before the shuffle.
    """
    eta = quadrature.nodes(*rule.eta) if rule else [(0.5, 1.0)]
    if rule:
        at = F.broadcast(_nodes(angle.sparkSession, rule.omega))
        angle = angle.crossJoin(at).select("a", (F.col("theta") + (F.col("x") - 0.5) * d_omega).alias("theta"), F.col("wq").alias("wa"))
    bins = _hits(pole, angle, ring, n_eta, tuple(x for x, _ in eta))
    s = F.col("sigma")
    value = None
    for x, w in eta:
        d = _cosine(x, n_eta)
        # a bin that both arcs reach is met once a side
        part = w * F.when((F.col("side") == 0) | (F.col("side") * d > 0), density(d, s)).otherwise(0.0)
        value = part if value is None else value + part
    value = F.col("cnt") * value / (8 * math.pi * s * s)
    value = value * F.col("wa") if rule else value
    return bins.select("a", "k", "c", "r", value.alias("v")).where("v > 0").groupBy("a", "k", "c", "r").agg(F.sum("v").alias("v"))


def pf_slopes(pole: DataFrame, angle: DataFrame, ring: DataFrame, n_eta: int) -> DataFrame:
    """pf(a, k, c, r, v) and its derivatives on the entries of :func:`pf_table`.

    d_rx, d_ry, d_rz: turns of the orientation from the left, in radians; d_sigma: its width; d_eta: an
    offset of the azimuth; d_two_theta: the ring's angle; d_omega: the sample's rotation.
    """
    both, d = _hits(pole, angle, ring, n_eta), _cosine(0.5, n_eta)
    s, eta = F.col("sigma"), (F.col("c") + 0.5) * 2 * math.pi / n_eta
    gaps = {n: (1 + sign * F.abs(d)) / (s * s) for n, sign in (("near", -1), ("far", 1))}
    near, far = (F.when(g < CUT, F.exp(-g)).otherwise(0.0) for g in gaps.values())
    scale = F.col("cnt") / (8 * math.pi * s * s)
    by_d = scale * F.signum(d) * (near - far) / (s * s)
    by_sigma = scale * 2 / s * (near * (gaps["near"] - 1) + far * (gaps["far"] - 1))
    # pole x probe with the rotation undone, then turned back
    px, py, pz, vx, vy, vz = F.col("x"), F.col("y"), F.col("pz"), F.cos("th") * F.cos(eta), -F.sin("th"), F.cos("th") * F.sin(eta)
    cx, cy, cz = py * vz - pz * vy, pz * vx - px * vz, px * vy - py * vx
    turned = (F.cos("om") * cx - F.sin("om") * cy, F.sin("om") * cx + F.cos("om") * cy, cz)
    by_eta = by_d * F.cos("th") * (pz * F.cos(eta) - px * F.sin(eta))
    by_ring = by_d * -0.5 * (F.sin("th") * (px * F.cos(eta) + pz * F.sin(eta)) + F.cos("th") * py)
    slopes = {f"d_r{n}": by_d * t for t, n in zip(turned, "xyz")} | {"d_sigma": by_sigma, "d_eta": by_eta, "d_two_theta": by_ring, "d_omega": by_d * (py * vx - px * vy)}
    rows = both.select("a", "k", "c", "r", (scale * (near + far)).alias("v"), *[c.alias(n) for n, c in slopes.items()])
    return rows.where("v > 0").groupBy("a", "k", "c", "r").agg(*[F.sum(n).alias(n) for n in ("v", *slopes)])


def scale_by_ring(pf: DataFrame, ring: DataFrame, n_rings: int) -> DataFrame:
    """pf(a, k, j, v) times the intensity of the ring j % n_rings."""
    keyed = pf.withColumn("r", F.pmod("j", F.lit(n_rings)).cast("int"))
    return keyed.join(F.broadcast(ring.select("r", "intensity")), "r").select("a", "k", "j", (F.col("v") * F.col("intensity")).alias("v"))


def project_to_sphere(orientations: DataFrame, direction: tuple[float, float, float]) -> DataFrame:
    """R^T d: a sample direction in each crystal frame."""
    x, y, z = rot.rotate(rot.inverse(rot.quat()), tuple(F.lit(float(c)) for c in direction))
    return orientations.select("k", x.alias("sx"), y.alias("sy"), z.alias("sz"))


def stereographic(directions: DataFrame) -> DataFrame:
    """Equal-angle projection of the upper half (opposite directions coincide)."""
    s = F.when(F.col("sz") < 0, -1.0).otherwise(1.0)
    return directions.select("k", (s * F.col("sx") / (1 + F.abs("sz"))).alias("u"), (s * F.col("sy") / (1 + F.abs("sz"))).alias("v"))


def bragg_matrix(orientations: DataFrame, beams: DataFrame, table: DataFrame, lam: DataFrame, volume: float, spread: float, e0: float, kind: str = "legacy", tail=None, ball: DataFrame | None = None) -> DataFrame:
    """bmat(a, k, l, v): single-crystal attenuation profiles. ``beams``: a, angle (radians); ``lam``: l, lam.

    The Bragg wavelength of each (orientation, beam, reflection) is filtered to the window before the
    wavelengths are crossed in; beams, reflections and wavelengths are dimension tables. With ``ball``, turns
    (q, w) that each orientation is given from the right, the matrix is their weighted mean.
    """
    from ..functions.scalar import edge_profile, pulse_tail

    window = lam.agg(F.min("lam"), F.max("lam")).first()
    beam = (-F.sin("angle"), F.cos("angle"), F.lit(0.0))
    nx, ny, nz = rot.rotate(rot.inverse(rot.quat()), beam)
    orientations = orientations.select("k", "qx", "qy", "qz", "qw", F.lit(1.0).alias("wq"))
    if ball is not None:
        turns = ball.select(*[F.col(f"q{c}").alias(f"t{c}") for c in "xyzw"], "w")
        q = rot.product(rot.quat(), tuple(F.col(f"t{c}") for c in "xyzw"))
        orientations = orientations.crossJoin(F.broadcast(turns)).select("k", *[x.alias(f"q{c}") for x, c in zip(q, "xyzw")], F.col("w").alias("wq"))
    seen = orientations.crossJoin(F.broadcast(beams)).select("k", "wq", "a", nx.alias("bx"), ny.alias("by"), nz.alias("bz"))
    both = seen.crossJoin(F.broadcast(table.select("gx", "gy", "gz", "d", "f2")))
    g2 = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz")
    lam0 = 2 * (F.col("bx") * F.col("gx") + F.col("by") * F.col("gy") + F.col("bz") * F.col("gz")) / g2
    hit = both.select("a", "k", "wq", "d", "f2", lam0.alias("lam0")).where(F.col("lam0").between(window[0], window[1]))
    ratio = F.greatest(F.least(F.col("lam0") / (2 * F.col("d")), F.lit(1.0)), F.lit(-1.0))
    sin2 = F.greatest(ratio * ratio, F.lit(1e-30))
    l4 = F.pow(F.col("lam0"), F.lit(4.0))
    amplitude = F.col("wq") * l4 * F.col("f2") / (volume * volume * 2 * sin2)
    sigma = F.col("lam0") * F.sqrt((1 - ratio * ratio) / (ratio * ratio) * spread * spread + e0 * e0)
    alpha = (tail or pulse_tail)(F.col("lam0")) / 10000.0
    peaks = hit.select("a", "k", "lam0", amplitude.alias("amp"), sigma.alias("sigma"), alpha.alias("alpha"))
    cells = peaks.crossJoin(F.broadcast(lam))
    v = F.col("amp") * edge_profile(F.col("lam") - F.col("lam0"), F.col("sigma"), F.col("alpha"), kind)
    return cells.groupBy("a", "k", "l").agg(F.sum(v).alias("v"))


def ring_table(spark: SparkSession, two_theta: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(two_theta)], "r int, two_theta double")


def window_fraction(two_theta, lo, hi, depth, depth_var, sigma2, inv_distance: float, lorentz: float = 0.0, gamma: Column | None = None) -> Column:
    """Share of a radial profile inside [lo, hi], its ring shifted and widened by the depth along the beam.

    A grain at depth x sees its ring at two_theta - x / D sin cos; the variance of depths widens it.
    ``lorentz``: share of a Lorentzian of half width ``gamma`` (pseudo-Voigt).
    """
    from ..functions.scalar import erf

    tilt = F.sin(two_theta) * F.cos(two_theta) * inv_distance
    at = two_theta - depth * tilt
    scale = F.sqrt(2 * (sigma2 + tilt * tilt * depth_var))
    share = 0.5 * (erf((hi - at) / scale) - erf((lo - at) / scale))
    if lorentz:
        share = (1 - lorentz) * share + lorentz * (F.atan((hi - at) / gamma) - F.atan((lo - at) / gamma)) / math.pi
    return share


def axis_directions(probe_plane: DataFrame, axes: DataFrame) -> DataFrame:
    """One Bragg angle per pole axis: v = cos(th) u - sin(th) w from the in-plane and the beam parts.

    ``probe_plane``: a, c, ux, uy, uz, wx, wy, wz; ``axes``: r, ax, two_theta (a dimension table).
    """
    both = probe_plane.crossJoin(F.broadcast(axes.select("r", "ax", "two_theta")))
    c, s = F.cos(F.col("two_theta") / 2), F.sin(F.col("two_theta") / 2)
    return both.select("a", "c", "r", "ax", *[(c * F.col(f"u{x}") - s * F.col(f"w{x}")).alias(f"v{x}") for x in "xyz"])


def plane_parts(angle: DataFrame, n_eta: int) -> DataFrame:
    """u (azimuth in the detector plane) and w (beam) turned by every angle."""
    eta = angle.sparkSession.range(n_eta).select(F.col("id").cast("int").alias("c"), ((F.col("id") + 0.5) * 2 * math.pi / n_eta).alias("eta"))
    cells = angle.select("a", "theta").crossJoin(F.broadcast(eta))
    om, e = F.col("theta"), F.col("eta")
    return cells.select(
        "a", "c", (F.cos(om) * F.cos(e)).alias("ux"), (F.sin(om) * F.cos(e)).alias("uy"), F.sin(e).alias("uz"),
        (-F.sin(om)).alias("wx"), F.cos(om).alias("wy"), F.lit(0.0).alias("wz"),
    )
