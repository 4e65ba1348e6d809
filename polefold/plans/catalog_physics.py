"""Queries over rotations, crystals, pole figures, search, interpolation and derivatives."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rotations as rot
from ..functions import scalar
from ..functions.scalar import erf_text, r4
from ..operators import crystal, derivs, interp, polefigure, projector, quadrature, search, tree
from ..sources import bindings as B
from ..sources import cif
from ..sources.bindings import NX, NY, R, sql
from . import odf as odf_plans
from .catalog_operators import _geo, _noisy, _out, _radon, _sino_data
from .registry import query
from .state import materialise

_O = " UNION ALL ".join("SELECT {} AS g, {!r}::DOUBLE AS sx, {!r}::DOUBLE AS sy, {!r}::DOUBLE AS sz, {!r}::DOUBLE AS sw".format(i, *map(float, q)) for i, q in enumerate(rot.group("O")))
_TURN = "qw*sx + qx*sw + qy*sz - qz*sy AS tx, qw*sy - qx*sz + qy*sw + qz*sx AS ty, qw*sz + qx*sy - qy*sx + qz*sw AS tz, qw*sw - qx*sx - qy*sy - qz*sz AS tw"


def _cubic(spark):
    return rot.symops(spark, "O")


@query("fundamental_zone_cubic", sql("SELECT k, round(arg_max(abs(tw), m * 100 - g), 4) AS qw, round(max(abs(tw)), 4) AS best FROM (SELECT k, g, tw, round(abs(tw), 9) * 1e7 AS m FROM (SELECT k, g, " + _TURN + " FROM orient, o)) GROUP BY k", "orient", o=_O))
def fundamental_zone(spark, d):
    zone = rot.fundamental_zone(B.orientations(spark, d), _cubic(spark))
    return zone.select("k", r4(F.col("qw")).alias("qw"), r4(F.col("qw")).alias("best"))


@query("nearest_misorientation", sql("SELECT k, round(degrees(2 * acos(least(max(c), 1))), 3) AS angle FROM (SELECT x.k, abs(x.qx*e.tx + x.qy*e.ty + x.qz*e.tz + x.qw*e.tw) AS c FROM orient x, (SELECT k, " + _TURN + " FROM orient, o WHERE label = 0) e WHERE x.label <> 0) GROUP BY k", "orient", o=_O))
def nearest(spark, d):
    o = B.orientations(spark, d)
    got = rot.nearest_misorientation(o.where("label <> 0"), o.where("label = 0"), _cubic(spark))
    return got.select("k", r4(F.col("angle"), 3).alias("angle"))


@query("thin_cells", sql("SELECT min(k) AS k, count(*) AS members FROM (SELECT k, floor(qx * s / 0.6) AS x, floor(qy * s / 0.6) AS y, floor(qz * s / 0.6) AS z FROM (SELECT *, sign(qw) * 2 * acos(abs(qw)) / sin(acos(abs(qw))) AS s FROM orient)) GROUP BY x, y, z", "orient"))
def thin_cells(spark, d):
    return rot.thin_cells(B.orientations(spark, d), 0.6).select("k", "members")


@query("thin_greedy")
def thin_greedy(spark, d):
    return rot.thin_greedy(B.orientations(spark, d), _cubic(spark), 25.0)


@query("children_stencil", sql("SELECT k AS parent, child::INT AS child, round(qw * cos(0.05) - (qx * x + qy * y + qz * z) * sin(0.05), 4) + 0.0 AS qw, round(qw * x * sin(0.05) + qx * cos(0.05) + qy * z * sin(0.05) - qz * y * sin(0.05), 4) + 0.0 AS qx FROM orient, (VALUES (0, -1, 0, 0), (1, 0, -1, 0), (2, 0, 0, -1), (3, 0, 0, 1), (4, 0, 1, 0), (5, 1, 0, 0)) s(child, x, y, z)", "orient"))
def children(spark, d):
    return _out(rot.children(B.orientations(spark, d), 0.1, 6), "parent", "child", qw="qw", qx="qx")


_ROT = "(1 - 2*(qy*qy + qz*qz))*{a} + 2*(qx*qy - qz*qw)*{b} + 2*(qx*qz + qy*qw)*{c}", "2*(qx*qy + qz*qw)*{a} + (1 - 2*(qx*qx + qz*qz))*{b} + 2*(qy*qz - qx*qw)*{c}", "2*(qx*qz - qy*qw)*{a} + 2*(qy*qz + qx*qw)*{b} + (1 - 2*(qx*qx + qy*qy))*{c}"


@query("poles_on_sphere", sql("SELECT k, " + ", ".join(f"round({t.format(a='ux', b='uy', c='uz')}, 4) + 0.0 AS p{n}" for t, n in zip(_ROT, "xyz")) + " FROM orient", "orient"))
def poles_on_sphere(spark, d):
    x, y, z = rot.rotate(rot.quat(), (F.col("ux"), F.col("uy"), F.col("uz")))
    return B.orientations(spark, d).select("k", r4(x).alias("px"), r4(y).alias("py"), r4(z).alias("pz"))


@query("pole_projection", sql("SELECT k, round(sign(sz) * sx / (1 + abs(sz)), 4) + 0.0 AS u, round(sign(sz) * sy / (1 + abs(sz)), 4) + 0.0 AS v FROM (SELECT k, 2*(qx*qz - qy*qw) AS sx, 2*(qy*qz + qx*qw) AS sy, 1 - 2*(qx*qx + qy*qy) AS sz FROM orient)", "orient"))
def pole_projection(spark, d):
    return _out(polefigure.stereographic(polefigure.project_to_sphere(B.orientations(spark, d), (0, 0, 1))), "k", u="u", v="v")


A0, LAM = 4.05, 0.35
_FCC = f"""SELECT DISTINCT x[1] AS h, x[2] AS k, x[3] AS l FROM (SELECT list_sort([abs(h), abs(k), abs(l)]) AS x FROM range(-6, 7) a(h), range(-6, 7) b(k), range(-6, 7) c(l)
  WHERE (h <> 0 OR k <> 0 OR l <> 0) AND 2 * pi() / {A0} * sqrt(h*h + k*k + l*l) <= 7.5 AND (h + k) % 2 = 0 AND (k + l) % 2 = 0)"""


def _fcc(spark, q_max=7.5):
    b = crystal.reciprocal(crystal.lattice_matrix(A0, A0, A0, 90, 90, 90))
    hkl = crystal.enumerate_hkl(spark, b, 0.0, q_max).where(crystal.centering("F"))
    return crystal.with_angles(crystal.families(hkl, crystal.integer_ops("cubic")), LAM)


_MULT = "CASE WHEN h = 0 AND k = 0 THEN 6 WHEN h = 0 AND k = l THEN 12 WHEN h = k AND k = l THEN 8 WHEN h = 0 OR h = k OR k = l THEN 24 ELSE 48 END"


_NEUTRON = "SELECT h::INT AS h, k::INT AS k, l::INT AS l, 3.6 / sqrt(h*h + k*k + l*l) AS d, 0.01 * (re * re + im * im) AS f2 FROM (SELECT h, k, l, sum(9.5 * exp(-4 * pi() * pi() * (h*h + k*k + l*l) / (3.6 * 3.6) * 0.005 / 2) * cos(2 * pi() * (h * x + k * y + l * z))) AS re, sum(9.5 * exp(-4 * pi() * pi() * (h*h + k*k + l*l) / (3.6 * 3.6) * 0.005 / 2) * sin(2 * pi() * (h * x + k * y + l * z))) AS im FROM range(-3, 4) a(h), range(-3, 4) b(k), range(-3, 4) c(l), (VALUES (0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)) s(x, y, z) WHERE h <> 0 OR k <> 0 OR l <> 0 GROUP BY h, k, l) WHERE 0.01 * (re * re + im * im) > 1e-3 AND 2 * 3.6 / sqrt(h*h + k*k + l*l) >= 1.5"


def _neutron(spark):
    b = crystal.reciprocal(crystal.lattice_matrix(3.6, 3.6, 3.6, 90, 90, 90))
    sites = spark.createDataFrame([(x, y, z, 9.5, 0.005) for x, y, z in ((0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0))], "x double, y double, z double, b_coh double, u2 double")
    return crystal.neutron_table(spark, b, sites, 1.5, 3)


_LAMS = "SELECT l::INT AS l, 1.5 + 0.05 * l AS lam FROM range(40) t(l)"


@query("bragg_edge_gauss", sql(
    "SELECT a, k, l, round(sum(amp * exp(-(lam - lam0) * (lam - lam0) / (2 * sg * sg)) / (sg * sqrt(2 * pi()))) * 1e3, 3) + 0.0 AS v FROM ("
    "SELECT a, k, lam0, pow(lam0, 4) * f2 / (pow(3.6, 6) * 2 * greatest(ratio * ratio, 1e-30)) AS amp, lam0 * sqrt((1 - ratio * ratio) / (ratio * ratio) * 0.0025 + 0.0004) AS sg FROM ("
    "SELECT *, lam0 / (2 * d) AS ratio FROM (SELECT a, k, d, f2, 2 * (bx * gx + by_ * gy + bz * gz) / (gx * gx + gy * gy + gz * gz) AS lam0 FROM "
    "(SELECT k, a, " + ", ".join(f"{t.format(a='vx', b='vy', c='0')} AS {n}" for t, n in zip((_ROT[0].replace('qw', '(-qw)'), _ROT[1].replace('qw', '(-qw)'), _ROT[2].replace('qw', '(-qw)')), ("bx", "by_", "bz")))
    + " FROM orient, (SELECT a::INT AS a, -sin(0.3 + 0.7 * a) AS vx, cos(0.3 + 0.7 * a) AS vy FROM range(3) t(a))) s, "
    "(SELECT *, h / 3.6 AS gx, k / 3.6 AS gy, l / 3.6 AS gz FROM n) g(h, kk, l, d, f2, gx, gy, gz)) WHERE lam0 BETWEEN 1.5 AND 3.45)), lams GROUP BY 1, 2, 3", "orient", n=_NEUTRON, lams=_LAMS).replace("SELECT *, h / 3.6 AS gx, k / 3.6 AS gy, l / 3.6 AS gz FROM n", "SELECT h, k, l, d, f2, h / 3.6, k / 3.6, l / 3.6 FROM n"))
def bragg_edge(spark, d):
    beams = spark.range(3).selectExpr("cast(id as int) a", "0.3 + 0.7 * id as angle")
    lam = spark.range(40).selectExpr("cast(id as int) l", "1.5D + 0.05D * id as lam")
    flat = lambda x: F.lit(1e-9)  # noqa: E731  no tail: the plain Gaussian everywhere
    got = polefigure.bragg_matrix(B.orientations(spark, d), beams, _neutron(spark), lam, 3.6**3, 0.05, 0.02, tail=flat)
    return got.select("a", "k", "l", r4(F.col("v") * 1e3, 3).alias("v"))


def _tailed(u: str) -> str:
    """SQL of a Gaussian (x, s) with an exponential tail t, from the argument of its error function."""
    power = "(s * s / (2 * t * t) - x / t)"
    far = f"{scalar.erfcx_text(f'greatest({u}, 0)')} * exp(greatest(least({power} - {u} * {u}, 700), -800))"
    near = f"(2 - {scalar.erfcx_text(f'abs({u})')} * exp(-{u} * {u})) * exp(greatest(least({power}, 700), -800))"
    return f"(CASE WHEN {u} >= 0 THEN {far} ELSE {near} END / (2 * t))"


_EMG, _OLD = _tailed("((s / t - x / s) / sqrt(2.0))"), _tailed("(s / t - x / (sqrt(2.0) * s))")


_TTH = [2 * math.asin(LAM * math.sqrt(s) / (2 * A0)) for s in (3, 4, 8)]
_RINGS = " UNION ALL ".join(f"SELECT {i} AS r, {t!r}::DOUBLE AS tth" for i, t in enumerate(_TTH))


def _normals(spark):
    rows = []
    for r, (h, k, l) in enumerate(((1, 1, 1), (2, 0, 0), (2, 2, 0))):
        n = math.sqrt(h * h + k * k + l * l)
        rows.append((r, h / n, k / n, l / n, 1.0))
    return spark.createDataFrame(rows, "r int, hx double, hy double, hz double, share double")


def _axes(spark):
    return polefigure.pole_axes(_normals(spark), _cubic(spark))


_AX = "SELECT 0 AS r, sx / sqrt(3.0) AS nx, sy / sqrt(3.0) AS ny, sz / sqrt(3.0) AS nz, 6.0 AS cnt FROM (VALUES (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1)) t(sx, sy, sz) UNION ALL SELECT 1, sx, sy, sz, 8.0 FROM (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1)) t(sx, sy, sz) UNION ALL SELECT 2, sx / sqrt(2.0), sy / sqrt(2.0), sz / sqrt(2.0), 4.0 FROM (VALUES (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1)) t(sx, sy, sz)"


def _poles(spark, d):
    """Exact unit axes; six-decimal keys are only for finding the distinct ones."""
    axes = _axes(spark)
    n = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return polefigure.poles(B.orientations(spark, d), axes.select("r", "cnt", *[(F.col(f"n{c}") / n).alias(f"n{c}") for c in "xyz"]))


@query("pf_matrix", sql(
    "SELECT a, k, c, r, round(v, 2) + 0.0 AS v FROM (SELECT a, k, c::INT AS c, r, sum(cnt * (CASE WHEN (1 - abs(dd)) / (sigma * sigma) < 8 THEN exp(-(1 - abs(dd)) / (sigma * sigma)) ELSE 0 END) / (8 * pi() * sigma * sigma)) AS v FROM ("
    "SELECT a, k, c, r, sigma, cnt, px * (cos(theta) * x - sin(theta) * y) + py * (sin(theta) * x + cos(theta) * y) + pz * z AS dd FROM "
    "(SELECT k, r, cnt, sigma, " + ", ".join(f"{t.format(a='nx', b='ny', c='nz')} AS p{n}" for t, n in zip(_ROT, "xyz")) + " FROM orient, ax) JOIN "
    "(SELECT a, theta, c, r, cos(tth / 2) * cos((c + 0.5) * 2 * pi() / 36) AS x, -sin(tth / 2) AS y, cos(tth / 2) * sin((c + 0.5) * 2 * pi() / 36) AS z FROM angle, range(36) e(c), rings) USING (r)) GROUP BY 1, 2, 3, 4) WHERE v > 0.05", "orient", "angle", rings=_RINGS, ax=_AX))
def pf_matrix(spark, d):
    got = polefigure.pf_table(_poles(spark, d), projector.angles(spark, R), polefigure.ring_table(spark, _TTH), 36)
    return got.where("v > 0.05").select("a", "k", "c", "r", r4(F.col("v"), 2).alias("v"))


#: nodes of a bin of pi / R radians by 10 degrees, for kernels no narrower than those of ``orient``
_RULE = quadrature.choose(math.pi / R, 2 * math.pi / 36, 0.07, 0.05, math.exp(-polefigure.CUT))
_NODES = {n: " UNION ALL ".join(f"SELECT {i} AS {n[0]}, {x!r}::DOUBLE AS x{n[0]}, {w!r}::DOUBLE AS w{n[0]}" for i, (x, w) in enumerate(quadrature.nodes(*rule))) for n, rule in (("son", _RULE.omega), ("ten", _RULE.eta))}


@query("pf_matrix_nodes", sql(
    "SELECT a, k, c, r, round(v, 2) + 0.0 AS v FROM (SELECT a, k, c::INT AS c, r, sum(wq * cnt * (CASE WHEN (1 - abs(dd)) / (sigma * sigma) < 8 THEN exp(-(1 - abs(dd)) / (sigma * sigma)) ELSE 0 END) / (8 * pi() * sigma * sigma)) AS v FROM ("
    "SELECT a, k, c, r, wq, sigma, cnt, px * (cos(om) * x - sin(om) * y) + py * (sin(om) * x + cos(om) * y) + pz * z AS dd FROM "
    "(SELECT k, r, cnt, sigma, " + ", ".join(f"{t.format(a='nx', b='ny', c='nz')} AS p{n}" for t, n in zip(_ROT, "xyz")) + " FROM orient, ax) JOIN "
    f"(SELECT a, theta + (xs - 0.5) * pi() / {R} AS om, c, r, ws * wt AS wq, cos(tth / 2) * cos((c + xt) * 2 * pi() / 36) AS x, -sin(tth / 2) AS y, cos(tth / 2) * sin((c + xt) * 2 * pi() / 36) AS z FROM angle, range(36) e(c), rings, son, ten) USING (r)) GROUP BY 1, 2, 3, 4) WHERE v > 0.05", "orient", "angle", rings=_RINGS, ax=_AX, **_NODES))
def pf_matrix_nodes(spark, d):
    """Bin means by the nodes that the bound asks for."""
    angle = projector.angles(spark, R)
    got = polefigure.pf_table(_poles(spark, d), angle, polefigure.ring_table(spark, _TTH), 36, _RULE, math.pi / R)
    return got.where("v > 0.05").select("a", "k", "c", "r", r4(F.col("v"), 2).alias("v"))


@query("topk_per_pixel", "SELECT p, k, z0, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY z0 DESC, k)::INT AS r FROM (SELECT (user_id % 64)::INT AS p, event_id AS k, value AS z0 FROM events)) WHERE r <= 5")
def topk(spark, d):
    rows = B.events(spark, d).select((F.col("user_id") % 64).cast("int").alias("p"), F.col("event_id").alias("k"), F.col("value").alias("z0"))
    return search.top_k(rows, 5).select("p", "k", "z0", "rank")


def _z(spark, d):
    e = B.events(spark, d)
    return e.select((F.col("user_id") % 64).cast("int").alias("p"), (F.col("event_id") % 500).cast("int").alias("k"), F.col("value").alias("z0"), (F.col("value") * (1 + F.col("event_id") % 3)).alias("z1"), (F.col("event_id") % 7 == 0).alias("is_null"))


_PEAKS = "WITH z AS (SELECT (user_id % 64)::INT AS p, (event_id % 500)::INT AS k, value AS z0, value * (1 + event_id % 3) AS z1, event_id % 7 = 0 AS n FROM events), b AS (SELECT p, max(z0) AS n0, max(z1) AS n1 FROM z WHERE n GROUP BY p)"


@query("candidate_peaks", _PEAKS + " SELECT z.p, k, z0, round(z1, 4) AS z1 FROM z JOIN b USING (p) WHERE NOT n AND z0 >= 0.9 * n0 AND z1 >= 0.9 * n1")
def candidate_peaks(spark, d):
    z = _z(spark, d)
    null = z.where("is_null").withColumn("z1", F.col("z1") * 0.9)
    return search.peaks(z.where("not is_null"), null, 0.9).select("p", "k", "z0", r4(F.col("z1")).alias("z1"))


_IMAGES = "SELECT k, " + _TURN + " FROM (SELECT DISTINCT orient.* FROM orient SEMI JOIN found USING (k)), o"
_DOT = "abs(x.qx*e.tx + x.qy*e.ty + x.qz*e.tz + x.qw*e.tw)"


@query("select_candidates", sql(
    "SELECT arg_min(k, [-z0, k])::INT AS k, round(sum(z0), 4) AS score, array_to_string(list_sort(list(DISTINCT p)), ',') AS tiles FROM (SELECT n.*, least(n.id, coalesce(r.root, n.id)) AS root FROM nodes n LEFT JOIN (SELECT id, min(other) AS root FROM reach GROUP BY id) r USING (id)) GROUP BY root",
    "orient", o=_O,
    z="SELECT (user_id % 64)::INT AS p, (event_id % 500)::INT AS k, value AS z0, value * (1 + event_id % 3) AS z1, event_id % 7 = 0 AS n FROM events",
    found="SELECT z.p, z.k, max(z.z0) AS z0 FROM z JOIN (SELECT p, max(z0) AS n0, max(z1) AS n1 FROM z WHERE n GROUP BY p) b USING (p) SEMI JOIN orient ON orient.k = z.k WHERE NOT n AND z0 >= 0.8 * n0 AND z1 >= n1 GROUP BY 1, 2",
    placed="SELECT *, row_number() OVER (PARTITION BY p ORDER BY z0 DESC, k) AS i FROM found",
    images=_IMAGES,
    near=f"SELECT x.k, e.k AS t, max({_DOT}) AS c FROM (SELECT DISTINCT orient.* FROM orient SEMI JOIN found USING (k)) x, images e GROUP BY 1, 2",
    seq="SELECT x.p, x.i, x.k, x.z0, list(y.k) FILTER (y.k IS NOT NULL) AS ts FROM placed x LEFT JOIN (SELECT y0.p, y0.i, y0.k, n.k AS other FROM placed y0 JOIN near n ON n.t = y0.k AND n.c > cos(radians(8.0) / 2)) y ON y.p = x.p AND y.i < x.i AND y.other = x.k GROUP BY 1, 2, 3, 4",
    walk="SELECT DISTINCT p, 0::BIGINT AS i, []::INT[] AS kept FROM found UNION ALL SELECT s.p, s.i, CASE WHEN len(w.kept) < 3 AND len(list_intersect(w.kept, coalesce(s.ts, []))) = 0 THEN list_append(w.kept, s.k) ELSE w.kept END FROM walk w JOIN seq s ON s.p = w.p AND s.i = w.i + 1",
    kept="SELECT p, unnest(kept) AS k FROM walk SEMI JOIN (SELECT p, max(i) AS i FROM placed GROUP BY p) USING (p, i)",
    nodes="SELECT p, k, z0, p::BIGINT * 4294967296 + k AS id FROM kept JOIN found USING (p, k)",
    links="SELECT x.id, y.id AS other FROM nodes x JOIN nodes y ON x.id <> y.id AND abs(x.p % 8 - y.p % 8) <= 1 AND abs(x.p // 8 - y.p // 8) <= 1 JOIN near n ON n.k = x.k AND n.t = y.k AND n.c > cos(radians(25.0) / 2)",
    reach="SELECT id, other FROM links UNION SELECT r.id, l.other FROM reach r JOIN links l ON l.id = r.other"))
def select_candidates(spark, d):
    z, o = _z(spark, d), B.orientations(spark, d)
    found = materialise(search.peaks(z.where("not is_null"), z.where("is_null"), 0.8).groupBy("p", "k").agg(F.max("z0").alias("z0")))
    kept = search.apart(found, o, _cubic(spark), 8.0, 3)
    got = search.linked(kept, o, _cubic(spark), 8, 8, 25.0, 1)
    return got.select("k", r4(F.col("score")).alias("score"), F.array_join(F.col("tiles").cast("array<string>"), ",").alias("tiles"))


@query("prune_added", sql("SELECT k, w, k < 3 OR w >= 1.0 * (SELECT median(w) FROM t WHERE k >= 3 AND w > 0) AS keep FROM t", "coef", t="SELECT k, sum(v) AS w FROM coef GROUP BY k"))
def prune_added(spark, d):
    totals = B.coef(spark, d).groupBy("k").agg(F.sum("v").alias("w"))
    return search.prune_added(totals, 3, 1.0)


@query("best_per_candidate", "SELECT (user_id % 16)::INT AS id, arg_min(event_id, event_id) AS k, value AS z FROM events JOIN (SELECT user_id % 16 AS u, max(value) AS value FROM events GROUP BY 1) m USING (value) WHERE user_id % 16 = u GROUP BY 1, 3")
def best_per_candidate(spark, d):
    rows = B.events(spark, d).select((F.col("user_id") % 16).cast("int").alias("id"), F.col("event_id").alias("k"), F.col("value").alias("z"))
    return search.best_per(rows, "id").select("id", "k", "z")


@query("so3_interp", sql("SELECT m, round(sum(exp(-ang * ang / 0.08) * (k % 10 + 1)), 4) AS v FROM (SELECT m, k, 2 * acos(least(max(c), 1)) AS ang FROM (SELECT x.k AS m, e.k, abs(x.qx*e.tx + x.qy*e.ty + x.qz*e.tz + x.qw*e.tw) AS c FROM orient x, (SELECT k, " + _TURN + " FROM orient, o WHERE label = 0) e) WHERE c >= cos(radians(15.0)) GROUP BY 1, 2) GROUP BY m", "orient", o=_O))
def so3_interp(spark, d):
    o = B.orientations(spark, d)
    grid = o.where("label = 0").withColumn("v", F.col("k") % 10 + 1.0)
    return _out(interp.so3_gather(o, grid, _cubic(spark), 0.2, 30.0), "m", v="v")


@query("s2_interp", sql("SELECT m, round(sum(exp(-acos(least(c, 1)) * acos(least(c, 1)) / 0.08) * (k % 10 + 1)), 4) AS v FROM (SELECT x.k AS m, g.k, abs(x.ux*g.ux + x.uy*g.uy + x.uz*g.uz) AS c FROM orient x, orient g WHERE g.label = 0) WHERE c >= cos(radians(20.0)) GROUP BY m", "orient"))
def s2_interp(spark, d):
    o = B.orientations(spark, d)
    grid = o.where("label = 0").withColumn("v", F.col("k") % 10 + 1.0)
    return _out(interp.s2_gather(o, grid, 0.2, 20.0), "m", v="v")


@query("interp_theta", "SELECT id, round(sum(w * i * i), 4) AS v FROM (SELECT event_id AS id, lo AS i, 1 - (x - lo) AS w FROM (SELECT event_id, x, least(floor(x), 62) AS lo FROM (SELECT event_id, least(greatest(value / 7 - 1, 0), 63) AS x FROM events)) UNION ALL SELECT event_id, lo + 1, x - lo FROM (SELECT event_id, x, least(floor(x), 62) AS lo FROM (SELECT event_id, least(greatest(value / 7 - 1, 0), 63) AS x FROM events))) GROUP BY id")
def interp_theta(spark, d):
    nodes = spark.range(64).selectExpr("cast(id as int) i", "cast(id * id as double) v")
    points = B.events(spark, d).select(F.col("event_id").alias("id"), (F.col("value") / 7 - 1).alias("x"))
    return _out(interp.linear(nodes, points, 64), "id", v="v")


@query("bilinear_sampling", "SELECT id, (ix + 16 * iy)::INT AS p, round(w, 4) AS w FROM (SELECT event_id AS id, floor(x) + dx AS ix, floor(y) + dy AS iy, (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w FROM (SELECT event_id, value / 29.3 - 0.7 AS x, (user_id % 150) / 9.7 - 0.6 AS y FROM events), range(2) a(dx), range(2) b(dy)) WHERE ix BETWEEN 0 AND 15 AND iy BETWEEN 0 AND 15 AND w > 0")
def bilinear_sampling(spark, d):
    points = B.events(spark, d).select(F.col("event_id").alias("id"), (F.col("value") / 29.3 - 0.7).alias("x"), ((F.col("user_id") % 150) / 9.7 - 0.6).alias("y"))
    return _out(interp.bilinear(points, NX, NY), "id", F.col("p").cast("int").alias("p"), w="w")


@query("odf_support_mass", sql("SELECT k, w FROM (SELECT k, w, sum(w) OVER (ORDER BY w DESC, k ROWS UNBOUNDED PRECEDING) - w AS before, sum(w) OVER () AS s, max(w) OVER () AS m FROM t) WHERE w > 0.01 * m AND before < 0.7 * s", "coef", t="SELECT p AS k, sum(v) AS w FROM coef GROUP BY p"))
def odf_support_mass(spark, d):
    odf = B.coef(spark, d).groupBy(F.col("p").alias("k")).agg(F.sum("v").alias("w"))
    return odf_plans.support(odf, 0.01, 0.7).select("k", "w")


@query("odf_levels")
def odf_levels(spark, d):
    ops = _cubic(spark)
    basis = materialise(rot.fundamental_zone(B.orientations(spark, d).where("label = 0").select("k", "qx", "qy", "qz", "qw"), ops))
    data = B.data(spark, d).groupBy("a", "j").agg(F.sum("b").alias("b"))
    levels = odf_plans.reconstruct(spark, data, basis, _axes(spark), projector.angles(spark, R), polefigure.ring_table(spark, _TTH), 8, ops, 20.0, 2, 3)
    return levels[0].unionByName(levels[1]).groupBy("spacing").agg(F.count("*").alias("n"), r4(F.sum("w"), 2).alias("mass"))


@query("angle_shift_gradient", sql("SELECT a, round(sum(s.v * m.v) / 1e4, 3) + 0.0 AS g FROM sd s JOIN (SELECT a, y, k, sum(v * w) AS v FROM coef JOIN dw USING (p) GROUP BY 1, 2, 3) m USING (a, y, k) GROUP BY a", "coef", "geo", "dat", sd="SELECT a, y, (j % 7)::INT AS k, sum(b) AS v FROM dat GROUP BY 1, 2, 3", dw="SELECT a, y::INT AS y, p::INT AS p, (least(greatest((1 + big) / 2 - abs(t + 1e-4 - y), 0), least(1, big)) - least(greatest((1 + big) / 2 - abs(t - 1e-4 - y), 0), least(1, big))) / big / 2e-4 AS w FROM (SELECT *, gx * (p % 16) + gy * (p // 16) + t0 AS t FROM geo, range(256) q(p)), range(17) s(y)"))
def angle_shift_gradient(spark, d):
    g = derivs.angle_gradient(_sino_data(spark, d), B.coef(spark, d), derivs.shift_weights(_geo(spark), NX, NY, 17))
    return g.select("a", r4(F.col("g") / 1e4, 3).alias("g"))


def _mu(spark):
    return spark.range(NX * NY).selectExpr("cast(id as int) p2", "0.01D * (1 + id % 3) as m")


_ATT = "SELECT d.dir, a.p::INT AS p, exp(-sum(CASE WHEN b.x = a.p % 16 THEN 0.5 ELSE 1 END * 0.01 * (1 + (b.x + 16 * (a.p // 16)) % 3))) AS t FROM (VALUES (0), (1)) d(dir), range(256) a(p), range(16) b(x) WHERE (d.dir = 0 AND b.x >= a.p % 16) OR (d.dir = 1 AND b.x <= a.p % 16) GROUP BY 1, 2"


@query("absorption_forward", sql("SELECT r.a, r.y, c.k, round(sum(c.v * r.w * t.t), 4) + 0.0 AS v FROM coef c JOIN radon r USING (p) JOIN att t ON t.dir = r.a AND t.p = r.p GROUP BY 1, 2, 3", "coef", "radon", att=_ATT))
def absorption_forward(spark, d):
    att = derivs.attenuation(derivs.axis_rays(spark, NX, NY), _mu(spark))
    return _out(derivs.attenuated_forward(B.coef(spark, d), _radon(spark), att), "a", "y", "k", v="v")


@query("mu_gradient", sql("SELECT p2, round(-sum(len * s * t) / 1e6, 4) + 0.0 AS g FROM (SELECT l.a AS dir, l.p, sum(s.v * l.w * c.v) AS s FROM sd s JOIN radon l USING (a, y) JOIN coef c ON c.k = s.k AND c.p = l.p WHERE l.a <= 1 GROUP BY 1, 2) x JOIN att USING (dir, p) JOIN (SELECT d.dir, a.p::INT AS p, (b.x + 16 * (a.p // 16))::INT AS p2, CASE WHEN b.x = a.p % 16 THEN 0.5 ELSE 1 END AS len FROM (VALUES (0), (1)) d(dir), range(256) a(p), range(16) b(x) WHERE (d.dir = 0 AND b.x >= a.p % 16) OR (d.dir = 1 AND b.x <= a.p % 16)) USING (dir, p) GROUP BY p2", "coef", "radon", "dat", att=_ATT, sd="SELECT a, y, (j % 7)::INT AS k, sum(b) AS v FROM dat GROUP BY 1, 2, 3"))
def mu_gradient(spark, d):
    rays = derivs.axis_rays(spark, NX, NY)
    got = derivs.mu_gradient(_sino_data(spark, d), B.coef(spark, d), _radon(spark), derivs.attenuation(rays, _mu(spark)), rays)
    return got.select("p2", r4(F.col("g") / 1e6).alias("g"))


@query("cif_tokens", "SELECT doc_id, len(regexp_extract_all(text, '(''[^'']*''|\\S+)'))::INT AS n_tokens, len(list_filter(regexp_extract_all(text, '(''[^'']*''|\\S+)'), lambda t: regexp_full_match(regexp_replace(t, '\\([0-9]*\\)$', ''), '[+-]?[0-9]*\\.?[0-9]+')))::INT AS n_numeric FROM documents")
def cif_tokens(spark, d):
    rows = B.read(spark, d, "documents", "doc_id", "text").select("doc_id", F.col("text").alias("value"))
    return cif.token_counts(rows).select("doc_id", "n_tokens", "n_numeric")


@query("tree_levels", sql("SELECT level, count(*) AS n, sum((k % 3 <> 0)::INT)::BIGINT AS n_active, round(max(qw), 4) AS best FROM (SELECT k, CASE WHEN k < 50 THEN 0 WHEN k < 200 THEN 1 ELSE 2 END AS level, qw FROM orient) GROUP BY 1", "orient"))
def tree_levels(spark, d):
    return tree.per_level(_tree(spark, d)).select("level", "n", "n_active", r4(F.col("best")).alias("best"))


def _tree(spark, d):
    k = F.col("k")
    return B.orientations(spark, d).select("k", F.when(k < 50, 0).when(k < 200, 1).otherwise(2).alias("level"), F.when(k >= 50, (k % 50).cast("int")).alias("parent"), (k % 3 != 0).alias("active"), "qx", "qy", "qz", "qw", "sigma", F.col("qw").alias("score"))


@query("tree_leaves", sql("SELECT k FROM orient WHERE k NOT IN (SELECT k % 50 FROM orient WHERE k >= 50)", "orient"))
def tree_leaves(spark, d):
    return tree.leaves(_tree(spark, d)).select("k")


@query("node_sums", sql("SELECT (k // 2)::INT AS node, p, sum(v) AS v FROM coef GROUP BY 1, 2", "coef"))
def node_sums(spark, d):
    nodes = spark.range(7).selectExpr("cast(id div 2 as int) node", "cast(id as int) k")
    return tree.node_sums(B.coef(spark, d), nodes)


_PAR = "SELECT k, a::INT AS a, 0.14 - x * tilt AS ctr, sqrt(2 * (0.0004 + tilt * tilt * y)) AS sc FROM (SELECT k, a, 20 * ux + a AS x, 4 + uy AS y, sin(0.14) * cos(0.14) / 800 AS tilt FROM orient, range(4) t(a))"


@query("window_parallax", sql(f"SELECT k, a, round(0.5 * ({erf_text('((0.15 - ctr) / sc)')} - {erf_text('((0.13 - ctr) / sc)')}), 4) AS f FROM par".replace("D", ""), "orient", par=_PAR))
def window_parallax(spark, d):
    rows = B.orientations(spark, d).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("a")))
    lit = F.lit
    share = polefigure.window_fraction(lit(0.14), lit(0.13), lit(0.15), 20 * F.col("ux") + F.col("a"), 4 + F.col("uy"), lit(0.0004), 1 / 800)
    return rows.select("k", "a", r4(share).alias("f"))


@query("quadrature_rules")
def quadrature_rules(spark, d):
    rows = [(float(s), *(r := quadrature.choose(math.radians(0.5), math.radians(1.0), math.radians(s), 1e-3)).omega, *r.eta, r.size) for s in (0.4, 1.0, 2.0, 4.0)]
    return spark.createDataFrame(rows, "sigma double, omega_points int, omega_panels int, eta_points int, eta_panels int, n int")


@query("odf_residual", sql("SELECT round(sqrt(sum((m - b) * (m - b))) / sqrt(sum(b * b)), 4) AS residual FROM (SELECT a, j, sum(b) AS b FROM dat GROUP BY 1, 2) JOIN (SELECT pf.a, pf.j, sum(c.v * pf.v) / 10 AS m FROM (SELECT k, sum(v) AS v FROM coef GROUP BY k) c JOIN pf USING (k) GROUP BY 1, 2) USING (a, j)", "dat", "coef", "pf"))
def odf_residual(spark, d):
    total = B.coef(spark, d).groupBy("k").agg((F.sum("v") / 10).alias("v"))
    from ..operators import linop

    model = linop.bulk(B.pf_surrogate(spark)).forward(total)
    b = B.data(spark, d).groupBy("a", "j").agg(F.sum("b").alias("b"))
    r = F.col("v") - F.col("b")
    return b.join(model, ["a", "j"]).agg(r4(F.sqrt(F.sum(r * r)) / F.sqrt(F.sum(F.col("b") * F.col("b")))).alias("residual"))


@query("refine_candidates")
def refine_candidates(spark, d):
    o = B.orientations(spark, d)
    start = o.where("label = 0").select(F.col("k").alias("id"), "qx", "qy", "qz", "qw")
    goal = (0.5, 0.5, 0.5, 0.5)  # trials are scored by their closeness to one fixed orientation

    def closeness(trials, sigma):
        return trials.select("k", F.round(F.abs(sum(F.col(f"q{c}") * g for c, g in zip("xyzw", goal))), 9).alias("z"))

    return _out(search.refine_candidates(start, closeness, ((2.0, 4.0, 1.0), (0.5, 1.0, 0.4))), "id", qx="qx", qy="qy", qz="qz", qw="qw")


@query("cell_spectra", "SELECT a::INT AS a, r::INT AS r, l::INT AS l, round(1 / (4 * d), 3) AS v FROM range(2) x(a), (VALUES (0, 2.0), (1, 1.2)) t(r, d), range(8) z(l) WHERE 0.2 + 0.4 * l <= 2 * d")
def cell_spectra(spark, d):
    """Cells of all orientations without symmetry tile the rotations: their spectra add up to the powder's."""
    from ..operators import cells

    centres = B.orientations(spark, d).where("label = 0").select("k", "qx", "qy", "qz", "qw")
    walls = cells.half_spaces(centres, rot.symops(spark, "C1"), math.pi)
    beams = spark.createDataFrame([(0, 0.0, 1.0, 0.0), (1, 0.6, 0.8, 0.0)], "a int, bx double, by double, bz double")
    table = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 2.0), (1, 0.6, 0.0, 0.8, 1.2)], "r int, gx double, gy double, gz double, d double")
    lam = spark.range(8).selectExpr("cast(id as int) l", "0.2D + 0.4D * id as lam")
    return cells.spectra(walls, beams, table, lam).groupBy("a", "r", "l").agg(r4(F.sum("v"), 3).alias("v"))


@query("support_from_candidates", sql("SELECT DISTINCT x.k, e.p FROM orient x, (SELECT k, (k % 256)::INT AS p, " + _TURN + " FROM orient, o WHERE label = 1) e WHERE abs(x.qx*e.tx + x.qy*e.ty + x.qz*e.tz + x.qw*e.tw) >= cos(radians(6.0))", "orient", o=_O))
def support_from_candidates(spark, d):
    o = B.orientations(spark, d)
    chosen = o.where("label = 1").select(F.col("k").alias("id"), "qx", "qy", "qz", "qw", (F.col("k") % 256).cast("int").alias("p"))
    return search.support_from_candidates(o, chosen, _cubic(spark), 12.0)
