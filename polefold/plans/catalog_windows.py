"""Queries over radial windows: their channels, the operator that mixes reflections into them, and the lattice's slopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import erf_text, r4
from ..operators import polefigure, projector, windows
from ..sources import bindings as B
from ..sources.bindings import R, sql
from .catalog_operators import _radon
from .catalog_orientations import _POLE, _PROBE, _SLOPES
from .catalog_physics import _FCC, _MULT, A0, LAM, _cubic, _fcc
from .registry import query
from .state import materialise

REL, ETA, CELL = 0.02, 6, (A0, A0, A0, 90.0, 90.0, 90.0)
_EDGES = [(0, 2.6, 2.8), (1, 2.9, 3.2), (2, 4.0, 4.6), (3, 5.0, 5.5)]
_ERF = "(0.5::DOUBLE * ({} - {}))".format(erf_text("uh"), erf_text("ul")).replace("0D", "0").replace("D)", ")").replace("D*", "*").replace("D-", "-").replace("D+", "+")
_X = windows.PARAMETERS
_BELL = "exp(-{0} * {0}) / sqrt(pi())"


def _slopes_of(name: str, by: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}_{x}" for x, text in by.items())


_CELL_SLOPES = {"a": "-q * h * h / (%r * s)" % A0, "b": "-q * k * k / (%r * s)" % A0, "c": "-q * l * l / (%r * s)" % A0, "alpha": "q * radians(1) * k * l / s", "beta": "q * radians(1) * h * l / s", "gamma": "q * radians(1) * h * k / s"}
_STEPS = {
    "win_t": "SELECT * FROM (VALUES " + ", ".join(f"({n}, {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in _EDGES) + ") t(win, lo, hi)",
    "fam": f"SELECT *, h*h + k*k + l*l AS s, (h * 16 + k) * 16 + l AS f, {_MULT} AS mult, 2 * pi() / {A0} * sqrt(h*h + k*k + l*l) AS q FROM ({_FCC})",
    "c0": f"SELECT *, (hi - q) / (sqrt(2) * {REL} * q) AS uh, (lo - q) / (sqrt(2) * {REL} * q) AS ul, {LAM} * q / (4 * pi()) AS sine FROM fam, win_t",
    "c1": f"SELECT *, {_ERF} AS w, 2 * asin(sine) AS tf, {_BELL.format('uh')} * -hi / (sqrt(2) * {REL} * q * q) - {_BELL.format('ul')} * -lo / (sqrt(2) * {REL} * q * q) AS wq, "
    f"{_BELL.format('uh')} * -uh / {REL} - {_BELL.format('ul')} * -ul / {REL} AS wr, 2 * {LAM} / (4 * pi()) / sqrt(1 - sine * sine) AS fq, " + _slopes_of("dq", _CELL_SLOPES) + " FROM c0",
    "c2": "SELECT *, mult * w / sum(mult * w) OVER x AS share, sum(w * tf) OVER x / sum(w) OVER x AS tth, " + _slopes_of("dw", {x: f"wq * dq_{x}" for x in windows.CELL} | {"rel": "wr"}) + ", " + _slopes_of("df", {x: f"fq * dq_{x}" for x in windows.CELL} | {"rel": "0"}) + " FROM c1 WHERE w > 1e-3 WINDOW x AS (PARTITION BY win)",
    "chan": f"SELECT win * {windows.STRIDE} + f AS r, win, f, h, k, l, w, share, tth, " + _slopes_of("ds", {x: f"(mult * dw_{x} - share * sum(mult * dw_{x}) OVER x) / sum(mult * w) OVER x" for x in _X}) + ", "
    + _slopes_of("dt", {x: f"sum(dw_{x} * (tf - tth) + w * df_{x}) OVER x / sum(w) OVER x" for x in _X}) + " FROM c2 WINDOW x AS (PARTITION BY win)",
    "axf": "SELECT (m[1] * 16 + m[2]) * 16 + m[3] AS f, h / sqrt(h*h + k*k + l*l) AS nx, k / sqrt(h*h + k*k + l*l) AS ny, l / sqrt(h*h + k*k + l*l) AS nz, 24.0 / count(*) OVER (PARTITION BY m) AS cnt FROM "
    "(SELECT h, k, l, list_sort([abs(h), abs(k), abs(l)]) AS m FROM range(-6, 7) a(h), range(-6, 7) b(k), range(-6, 7) c(l)) WHERE h > 0 OR (h = 0 AND (k > 0 OR (k = 0 AND l > 0)))",
}
_FIGURES = _STEPS | {
    "rings": "SELECT r, tth FROM chan", "ax": "SELECT r, nx, ny, nz, cnt FROM axf JOIN chan USING (f)", "pole": _POLE.format(o="(SELECT * FROM orient WHERE k IN (SELECT k FROM coef))"), "probe": _PROBE.format(n=ETA), "slopes": _SLOPES,
    "sn": "SELECT a, y, k, sum(v * w) AS v FROM coef JOIN radon USING (p) GROUP BY 1, 2, 3", "wd": f"SELECT a, y, j // {len(_EDGES)} AS c, j % {len(_EDGES)} AS win, b FROM dat",
}


def _channels(spark):
    rows = _fcc(spark).select("h", "k", "l", "mult").withColumn("m", F.array_sort(F.array(*[F.abs(c) for c in "hkl"])))
    families = rows.select(((F.col("m")[0] * 16 + F.col("m")[1]) * 16 + F.col("m")[2]).alias("f"), *[F.col("m")[i].alias(c) for i, c in enumerate("hkl")], "mult")
    edges = spark.createDataFrame(_EDGES, "win int, lo double, hi double")
    return materialise(windows.channels(families, edges, CELL, REL, LAM)), families


def _tables(spark, d):
    """Channels, coefficients, projection weights and the channels' pole figures with slopes."""
    channel, families = _channels(spark)
    n = F.sqrt(F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l"))
    normals = families.select(F.col("f").alias("r"), *[(F.col(c) / n).alias(f"h{x}") for c, x in zip("hkl", "xyz")], F.lit(1.0).alias("share"))
    axes = polefigure.pole_axes(normals, _cubic(spark))
    # six-decimal keys are only for finding the distinct axes; indices are whole numbers
    axes = axes.join(families.select(F.col("f").alias("r"), n.alias("n")), "r")
    axes = windows.channel_axes(axes.select("r", "cnt", *[(F.round(F.col(f"n{c}") * F.col("n")) / F.col("n")).alias(f"n{c}") for c in "xyz"]), channel)
    coef = B.coef(spark, d)
    used = B.orientations(spark, d).join(coef.select("k").distinct(), "k", "left_semi")
    pf = polefigure.pf_slopes(polefigure.poles(used, axes), projector.angles(spark, R), channel.select("r", "two_theta"), ETA)
    return channel, coef, _radon(spark), materialise(pf.select("a", "k", "c", "r", "v", "d_two_theta"))


def _data(spark, d):
    return B.data(spark, d).selectExpr("a", "y", f"j div {len(_EDGES)} c", f"j % {len(_EDGES)} win", "b v")


@query("window_channels", sql("SELECT win, f, round(w, 4) AS w, round(share, 4) AS share, round(tth, 6) AS two_theta, " + ", ".join(f"round(d{c}_{x}, 4) + 0.0 AS d{c}_{x}" for c in "st" for x in _X) + " FROM chan", **_STEPS))
def window_channels(spark, d):
    found = _channels(spark)[0]
    return found.select("win", "f", r4(F.col("w")).alias("w"), r4(F.col("share")).alias("share"), r4(F.col("two_theta"), 6).alias("two_theta"), *[r4(F.col(f"d{c}_{x}")).alias(f"d{c}_{x}") for c in "st" for x in _X])


@query("windowed_forward", sql("SELECT a, y, c, win, round(sum(sn.v * s.v * share) / 1e3, 3) + 0.0 AS v FROM sn JOIN slopes s USING (a, k) JOIN chan USING (r) GROUP BY 1, 2, 3, 4", "coef", "radon", "orient", "angle", "dat", **_FIGURES))
def windowed_forward(spark, d):
    channel, coef, radon, pf = _tables(spark, d)
    made = windows.windowed(radon, pf, channel).forward(coef)
    return made.select("a", "y", "c", "win", r4(F.col("v") / 1e3, 3).alias("v"))


@query("windowed_adjoint", sql(
    "SELECT k, p, round(sum(z.v * w) / 1e3, 3) + 0.0 AS v FROM (SELECT a, y, s.k, sum(b * s.v * share) AS v FROM wd JOIN chan USING (win) JOIN slopes s USING (a, c, r) GROUP BY 1, 2, 3) z JOIN radon USING (a, y) GROUP BY 1, 2", "coef", "radon", "orient", "angle", "dat", **_FIGURES))
def windowed_adjoint(spark, d):
    channel, _, radon, pf = _tables(spark, d)
    made = windows.windowed(radon, pf, channel).adjoint(_data(spark, d))
    return made.select("k", "p", r4(F.col("v") / 1e3, 3).alias("v"))


@query("lattice_gradient", sql(
    "SELECT parameter, round(g / 1e5, 1) + 0.0 AS g FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS parameter, sum(ds_{x} * t + share * dt * dt_{x}) AS g FROM both_t" for x in _X) + ")", "coef", "radon", "orient", "angle", "dat", **_FIGURES,
    seen="SELECT a, k, c, win, sum(b * v) AS g FROM wd JOIN sn USING (a, y) GROUP BY 1, 2, 3, 4", both_t="SELECT * FROM chan JOIN (SELECT s.r, sum(g * s.v) AS t, sum(g * s.d_two_theta) AS dt FROM slopes s JOIN (SELECT r, win AS w_of FROM chan) o USING (r) JOIN seen ON seen.a = s.a AND seen.k = s.k AND seen.c = s.c AND seen.win = w_of GROUP BY 1) USING (r)"))
def lattice_gradient(spark, d):
    channel, coef, radon, pf = _tables(spark, d)
    found = windows.lattice_gradient(_data(spark, d), coef, radon, pf, channel)
    return found.select("parameter", r4(F.col("g") / 1e5, 1).alias("g"))
