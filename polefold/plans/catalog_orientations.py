"""Queries over orientation sets, pole-figure derivatives and sampling, with SQL for the greedy and enumerating ones."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import rotations as rot
from ..functions.scalar import r4
from ..operators import derivs, linop, polefigure, projector, tree
from ..sources import bindings as B
from ..sources.bindings import R, sql
from . import odf as odf_plans
from .catalog_operators import _BM, _noisy, _out, _radon
from .catalog_physics import _AX, _O, _RINGS, _ROT, _TTH, _TURN, _axes, _cubic, _neutron, _poles
from .registry import ORACLE, QUERIES, query


def _greedy(source: str, min_deg: float, name: str, within: str = "0") -> dict[str, str]:
    """SQL of the sequential rule over ``source`` (k, q, and the cell that ``within`` names): table ``name``(k)."""
    pairs = f"SELECT DISTINCT x.k, e.k AS t FROM {source} x, (SELECT k, {within} AS cell, {_TURN} FROM {source}, o) e WHERE e.k < x.k AND e.cell = {within.replace('cell', 'x.cell')} AND abs(x.qx*e.tx + x.qy*e.ty + x.qz*e.tz + x.qw*e.tw) > cos(radians({min_deg}) / 2)"
    seq = f"SELECT x.k, row_number() OVER (ORDER BY x.k) AS i, coalesce(p.ts, []) AS ts FROM {source} x LEFT JOIN (SELECT k, list(t) AS ts FROM {name}_pairs GROUP BY k) p USING (k)"
    walk = f"SELECT 0::BIGINT AS i, []::INT[] AS kept UNION ALL SELECT s.i, CASE WHEN len(list_intersect(w.kept, s.ts)) = 0 THEN list_append(w.kept, s.k) ELSE w.kept END FROM {name}_walk w JOIN {name}_seq s ON s.i = w.i + 1"
    kept = f"SELECT unnest(kept) AS k FROM {name}_walk WHERE i = (SELECT max(i) FROM {name}_walk)"
    return {f"{name}_pairs": pairs, f"{name}_seq": seq, f"{name}_walk": walk, name: kept}


def _register(name: str, text: str) -> None:
    """SQL for a query that another module has registered."""
    query(name, text)(QUERIES[name])


_register("thin_greedy", sql("SELECT k FROM g", "orient", o=_O, **_greedy("orient", 25.0, "g")))


def _nearest(source: str, kept: str, within: str = "0") -> str:
    """k and node: the nearest of ``kept`` in the same cell, the smallest number on ties."""
    images = f"SELECT k, {within} AS cell, {_TURN} FROM {source} SEMI JOIN {kept} USING (k), o"
    near = f"SELECT x.k, e.k AS t, round(max(least(abs(x.qx*e.tx + x.qy*e.ty + x.qz*e.tz + x.qw*e.tw), 1)), 12) AS c FROM {source} x JOIN ({images}) e ON e.cell = {within.replace('cell', 'x.cell')} GROUP BY 1, 2"
    return f"SELECT k, arg_min(t, [-c, t]) AS node FROM ({near}) GROUP BY k"


@query("nested_cells", sql(
    "SELECT 0 AS level, node, k FROM n0 UNION ALL SELECT 1, node, k FROM n1", "orient", o=_O, few="SELECT k, qx, qy, qz, qw FROM orient",
    **_greedy("few", 40.0, "g0"), n0=_nearest("few", "g0"), fine="SELECT few.*, node AS cell FROM few JOIN n0 USING (k)", **_greedy("fine", 20.0, "g1", "cell"), n1=_nearest("fine", "g1", "cell")))
def nested_cells(spark, d):
    return tree.nested_cells(B.orientations(spark, d), _cubic(spark), (40.0, 20.0)).select("level", "node", "k")


_PROBE = (
    "SELECT a, theta, c, r, cos(theta) * x - sin(theta) * y AS vx, sin(theta) * x + cos(theta) * y AS vy, z AS vz, cos(theta) * ex AS e1, sin(theta) * ex AS e2, ez AS e3, "
    "cos(theta) * fx - sin(theta) * fy AS f1, sin(theta) * fx + cos(theta) * fy AS f2, fz AS f3 FROM (SELECT a, theta, c, r, cos(h) * cos(e) AS x, -sin(h) AS y, cos(h) * sin(e) AS z, -cos(h) * sin(e) AS ex, cos(h) * cos(e) AS ez, "
    "-sin(h) * cos(e) / 2 AS fx, -cos(h) / 2 AS fy, -sin(h) * sin(e) / 2 AS fz FROM (SELECT a, theta, c, r, tth / 2 AS h, (c + 0.5) * 2 * pi() / {n} AS e FROM angle, range({n}) t(c), rings))"
)
_POLE = "SELECT k, r, cnt, sigma, " + ", ".join(f"{t.format(a='nx', b='ny', c='nz')} AS p{n}" for t, n in zip(_ROT, "xyz")) + " FROM {o}, ax"
_SLOPES = """SELECT a, k, c::INT AS c, r, sum(s * e) AS v, sum(s * e * sign(dd) / (sigma * sigma) * (py * vz - pz * vy)) AS d_rx, sum(s * e * sign(dd) / (sigma * sigma) * (pz * vx - px * vz)) AS d_ry,
  sum(s * e * sign(dd) / (sigma * sigma) * (px * vy - py * vx)) AS d_rz, sum(2 * s / sigma * e * ((1 - abs(dd)) / (sigma * sigma) - 1)) AS d_sigma,
  sum(s * e * sign(dd) / (sigma * sigma) * (px * e1 + py * e2 + pz * e3)) AS d_eta, sum(s * e * sign(dd) / (sigma * sigma) * (px * f1 + py * f2 + pz * f3)) AS d_two_theta, sum(s * e * sign(dd) / (sigma * sigma) * (py * vx - px * vy)) AS d_omega
FROM (SELECT *, cnt / (8 * pi() * sigma * sigma) AS s, exp(-(1 - abs(dd)) / (sigma * sigma)) AS e FROM (SELECT *, px * vx + py * vy + pz * vz AS dd FROM pole JOIN probe USING (r)) WHERE (1 - abs(dd)) / (sigma * sigma) < 8)
GROUP BY a, k, 3, r"""


def _slopes(spark, d, condition: str, n_eta: int):
    poles = _poles(spark, d).where(condition) if condition else _poles(spark, d)
    return polefigure.pf_slopes(poles, projector.angles(spark, R), polefigure.ring_table(spark, _TTH), n_eta)


_ALL = (*derivs.PARAMETERS, "eta", "two_theta", "omega")


@query("pf_derivatives", sql("SELECT a, k, c, r, " + ", ".join(f"round(d_{p}, 2) + 0.0 AS d_{p}" for p in _ALL) + " FROM slopes WHERE v > 0.05", "orient", "angle", rings=_RINGS, ax=_AX, pole=_POLE.format(o="(SELECT * FROM orient WHERE k < 40)"), probe=_PROBE.format(n=36), slopes=_SLOPES))
def pf_derivatives(spark, d):
    got = _slopes(spark, d, "k < 40", 36).where("v > 0.05")
    return got.select("a", "k", "c", "r", *[r4(F.col(f"d_{p}"), 2).alias(f"d_{p}") for p in _ALL])


_SLOPES24 = {"rings": _RINGS, "ax": _AX, "pole": _POLE.format(o="(SELECT * FROM orient WHERE k < 7)"), "probe": _PROBE.format(n=8), "slopes": _SLOPES}
_SUMS = [f"sum(r * d_{p}) AS g_{p}" for p in derivs.PARAMETERS] + [f"sum(c * d_{p} * d_{q}) AS h_{p}_{q}" for i, p in enumerate(derivs.PARAMETERS) for q in derivs.PARAMETERS[i:]]
_BLOCKS = f"""SELECT k, {', '.join(_SUMS)} FROM (SELECT n.a, s.k, n.j, sum((n.mu - n.b) * s.v) AS r, sum(n.w / n.g * s.v * s.v) AS c FROM noisy n JOIN sino s USING (a, y) GROUP BY 1, 2, 3)
  JOIN (SELECT a, k, (c * 3 + r)::INT AS j, {', '.join(f'd_{p}' for p in derivs.PARAMETERS)} FROM slopes) USING (a, k, j) GROUP BY k"""
_DIGITS = ", ".join(f"CASE WHEN {n} = 0 THEN 0.0 ELSE round({n} / pow(10, floor(log10(abs({n})))), 6) END AS {n}" for n in [f"g_{p}" for p in derivs.PARAMETERS] + [f"h_{p}_{q}" for i, p in enumerate(derivs.PARAMETERS) for q in derivs.PARAMETERS[i:]])


def _entries(spark, d):
    """Model entries of seven orientations with the derivatives of their own pole figures."""
    sino = _radon(spark).join(B.coef(spark, d), "p").groupBy("a", "y", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    data = _noisy(spark, d).select("a", "y", "j", (F.col("mu") - F.col("b")).alias("r"), (F.col("w") / F.col("g")).alias("c"))
    slopes = _slopes(spark, d, "k < 7", 8).withColumn("j", (F.col("c") * 3 + F.col("r")).cast("int"))
    return derivs.model_entries(data, sino, slopes)


@query("normal_blocks", sql(f"SELECT k, {_DIGITS} FROM blocks", "noisy", "sino", "orient", "angle", **_SLOPES24, blocks=_BLOCKS))
def normal_blocks(spark, d):
    """Gradients and blocks, each as six digits after the first of its mantissa."""
    blocks = derivs.normal_blocks(_entries(spark, d))
    digits = lambda n: F.when(F.col(n) == 0, 0.0).otherwise(F.round(F.col(n) / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(n)))), 6)).alias(n)
    return blocks.select("k", *[digits(n) for n in blocks.columns if n != "k"])


_PARTS = " UNION ALL ".join(f"SELECT '{p}' AS parameter, {at}::INT AS i, sum(g * d_{p}) AS g FROM entries GROUP BY 2" for p, at in [(p, "k") for p in derivs.PARAMETERS] + [("omega", "a"), ("two_theta", "(j % 3)"), ("eta", "0")])


@query("parameter_gradients", sql(
    "SELECT parameter, i, CASE WHEN g = 0 THEN 0.0 ELSE round(g / pow(10, floor(log10(abs(g)))), 5) END AS g FROM parts", "noisy", "sino", "orient", "angle", **_SLOPES24,
    entries="SELECT a, k, j, g, " + ", ".join(f"d_{p}" for p in _ALL) + " FROM (SELECT n.a, s.k, n.j, sum((n.mu - n.b) * s.v) AS g FROM noisy n JOIN sino s USING (a, y) GROUP BY 1, 2, 3) JOIN (SELECT *, (c * 3 + r)::INT AS j FROM slopes) USING (a, k, j)", parts=_PARTS))
def parameter_gradients(spark, d):
    """Gradient of all parameters of the model, each as five digits after the first of its mantissa."""
    sino = _radon(spark).join(B.coef(spark, d), "p").groupBy("a", "y", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    data = _noisy(spark, d).select("a", "y", "j", (F.col("mu") - F.col("b")).alias("v"))
    slopes = _slopes(spark, d, "k < 7", 8).withColumn("j", (F.col("c") * 3 + F.col("r")).cast("int")).drop("c", "r", "v")
    got = derivs.parameter_gradients(data, sino, slopes, 3)
    return got.select("parameter", "i", F.when(F.col("g") == 0, 0.0).otherwise(F.round(F.col("g") / F.pow(F.lit(10.0), F.floor(F.log10(F.abs("g")))), 5)).alias("g"))


@query("gauss_newton_step")
def gauss_newton_step(spark, d):
    return _out(derivs.newton_steps(derivs.normal_blocks(_entries(spark, d))), "k", **{f"s_{p}": f"s_{p}" for p in derivs.PARAMETERS})


_RADICAL = "list_sum(list_transform(range(0, 9), lambda d: (((i + 1) // pow({b}, d)::BIGINT) % {b}) / pow({b}, d + 1)))"

_FACT = "(CASE WHEN {n} < 2 THEN 1.0::DOUBLE ELSE list_product(range(2, ({n}) + 1)::DOUBLE[]) END)"
_CHOOSE = f"{_FACT.format(n='n - 1')} / {_FACT.format(n='n - 1 - m')} / {_FACT.format(n='m')}"
_register("quadrature_rules", sql(
    "SELECT sigma, pa AS omega_points, na AS omega_panels, pb AS eta_points, nb AS eta_panels, (pa * na * pb * nb)::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY sigma ORDER BY pa * na * pb * nb, ba + bb, pa, na, pb, nb) AS place FROM "
    "(SELECT a.sigma, a.p AS pa, a.n AS na, a.b AS ba, b.p AS pb, b.n AS nb, b.b AS bb FROM best a JOIN best b USING (sigma) WHERE a.side = 0 AND b.side = 1 AND a.b + b.b <= 1e-3)) WHERE place = 1",
    sizes="SELECT * FROM (VALUES (0.4::DOUBLE), (1.0), (2.0), (4.0)) s(sigma)",
    # even moments one after the other: m[n] = a * sum of C(n - 1, m) m[m] over even m
    moment="SELECT sigma, pow(radians(sigma), -2) AS a, 0 AS n, [1.0::DOUBLE] AS ms FROM sizes UNION ALL SELECT sigma, a, n + 2, list_append(ms, a * list_sum(list_transform(range(0, n // 2 + 1), lambda h: "
    + _CHOOSE.replace("n - 1 - m", "n + 1 - 2 * h").replace("n - 1", "n + 1").replace("(m)", "(2 * h)").replace("m < 2", "2 * h < 2").replace("2, (m", "2, (2 * h") + " * ms[h + 1]))) FROM moment WHERE n < 16",
    bounds="SELECT side, sigma, p::INT AS p, n::INT AS n, pow(" + _FACT.format(n="p") + ", 4) / ((2 * p + 1) * pow(" + _FACT.format(n="2 * p") + ", 3)) * pow(width / n, 2 * p) * ms[p + 1] AS b "
    "FROM (SELECT sigma, ms FROM moment WHERE n = 16), range(1, 9) x(p), range(1, 65) y(n), (VALUES (0, radians(0.5)), (1, radians(1.0))) w(side, width) WHERE p * n <= 64",
    best="SELECT side, sigma, p, n, b FROM (SELECT *, row_number() OVER (PARTITION BY side, sigma, p * n ORDER BY b, p, n) AS place FROM bounds) WHERE place = 1"))


@query("random_zone", "SELECT 2000::BIGINT AS n, 2000::BIGINT AS distinct_n, 2000::BIGINT AS in_zone, true AS unit, true AS even")
def random_zone(spark, d):
    """Random orientations: all in the zone, of length one, and as often on either side of each axis."""
    ops = _cubic(spark)
    q = odf_plans.random_zone(spark, 2000, ops, 5)
    best = rot.equivalents(q.withColumn("own", F.col("qw")), ops).groupBy("k").agg(F.max(F.abs("qw")).alias("top"), F.max("own").alias("own"))
    sides = q.agg(F.count("*").alias("n"), F.countDistinct("qx", "qy", "qz", "qw").alias("distinct_n"), F.max(F.abs(rot.dot(rot.quat(), rot.quat()) - 1)).alias("off"), *[F.avg(F.signum(f"q{c}")).alias(f"m{c}") for c in "xyz"])
    inside = best.where("own >= top - 1e-6").agg(F.count("*").alias("in_zone"))
    even = (F.abs("mx") < 0.1) & (F.abs("my") < 0.1) & (F.abs("mz") < 0.1)
    return sides.crossJoin(inside).select("n", "distinct_n", "in_zone", (F.col("off") < 1e-9).alias("unit"), even.alias("even"))


@query("sample_odf", "SELECT 4000::BIGINT AS n, true AS by_weight, true AS near_parent")
def sample_odf(spark, d):
    """Draws from two orientations of weights 3 and 1, and how far they are from the one drawn."""
    rows = spark.createDataFrame([(3, 3.0, 0.0, 0.0, 0.0, 1.0), (8, 1.0, 0.0, 0.6, 0.0, 0.8)], "k int, w double, qx double, qy double, qz double, qw double")
    got = odf_plans.sample(rows, 4000, 0.01)
    own = rows.select(F.col("k").alias("parent"), *[F.col(f"q{c}").alias(f"p{c}") for c in "xyzw"])
    cosine = F.abs(sum(F.col(f"q{c}") * F.col(f"p{c}") for c in "xyzw"))
    return got.join(own, "parent").agg(F.count("*").alias("n"), (F.abs(F.avg((F.col("parent") == 3).cast("double")) - 0.75) < 0.03).alias("by_weight"), (F.min(cosine) > math.cos(0.04)).alias("near_parent"))


@query("powder_column", sql("SELECT s.a, s.y, m.l, round(sum(s.v * m.v), 4) + 0.0 AS v FROM sino s JOIN bp m ON s.a = m.a AND s.k = m.k GROUP BY 1, 2, 3", "sino", bm=_BM, bp="SELECT a, k, l, v FROM bm WHERE k < 6 UNION ALL SELECT DISTINCT a, 6, l, 0.1 + l / 100.0 FROM bm"))
def powder_column(spark, d):
    """The matrix operator of six orientations and a powder spectrum as the seventh column."""
    cells = spark.range(R * 7 * 8).selectExpr("cast(id div 56 as int) a", "cast((id div 8) % 7 as int) k", "cast(id % 8 as int) l").where("k < 6")
    b = cells.withColumn("v", 1.0 / (2 + (F.col("a") + 2 * F.col("k") + 3 * F.col("l")) % 7))
    powder = spark.range(8).select(F.col("id").cast("int").alias("l"), (0.1 + F.col("id") / 100).alias("v"))
    return _out(linop.matrix(_radon(spark), linop.with_powder(b, powder, 6)).forward(B.coef(spark, d)), "a", "y", "l", v="v")


@query("matrix_adjoint", sql("SELECT m.k, w.p, round(sum(n.b * m.v * w.w), 2) + 0.0 AS v FROM (SELECT a, y, j AS l, b FROM dat WHERE j < 8) n JOIN bm m ON m.a = n.a AND m.l = n.l JOIN radon w ON w.a = n.a AND w.y = n.y GROUP BY 1, 2", "dat", "radon", bm=_BM))
def matrix_adjoint(spark, d):
    cells = spark.range(R * 7 * 8).selectExpr("cast(id div 56 as int) a", "cast((id div 8) % 7 as int) k", "cast(id % 8 as int) l")
    b = cells.withColumn("v", 1.0 / (2 + (F.col("a") + 2 * F.col("k") + 3 * F.col("l")) % 7))
    y = B.data(spark, d).where("j < 8").select("a", "y", F.col("j").alias("l"), F.col("b").alias("v"))
    return linop.matrix(_radon(spark), b).adjoint(y).select("k", "p", r4(F.col("v"), 2).alias("v"))


@query("scatter_nodes", sql("SELECT k::INT AS k, p, sum(v) AS v FROM (SELECT (k // 2)::INT AS node, p, sum(v) AS v FROM coef GROUP BY 1, 2) JOIN range(7) t(k) ON k // 2 = node GROUP BY 1, 2", "coef"))
def scatter_nodes(spark, d):
    nodes = spark.range(7).selectExpr("cast(id div 2 as int) node", "cast(id as int) k")
    return tree.scatter(tree.node_sums(B.coef(spark, d), nodes), nodes)


BALL, BALL_RADIUS = 6, 0.1
_TURNED = "SELECT o.k, w, o.qw*t.x + o.qx*t.w + o.qy*t.z - o.qz*t.y AS qx, o.qw*t.y - o.qx*t.z + o.qy*t.w + o.qz*t.x AS qy, o.qw*t.z + o.qx*t.y - o.qy*t.x + o.qz*t.w AS qz, o.qw*t.w - o.qx*t.x - o.qy*t.y - o.qz*t.z AS qw FROM orient o, turns t"
_EDGE = ORACLE["bragg_edge_gauss"]
for _old, _new in ((" FROM orient, (SELECT a::INT", " FROM turned, (SELECT a::INT"), ("(SELECT k, a, ", "(SELECT k, w, a, "), ("SELECT a, k, d, f2, 2 *", "SELECT a, k, w, d, f2, 2 *"), ("pow(lam0, 4) * f2", "w * pow(lam0, 4) * f2"), ("* 0.0025 +", f"* {(1.2 * BALL_RADIUS / BALL ** (1 / 3)) ** 2!r} +"),
                   (", lams AS (", ", h AS (SELECT i::INT AS k, " + ", ".join(f"{_RADICAL.format(b=b)} AS u{n}" for n, b in enumerate((2, 3, 5))) + f" FROM range({BALL}) x(i)), turns AS (SELECT sin(r / 2) * sqrt(1 - c * c) * cos(t) AS x, sin(r / 2) * sqrt(1 - c * c) * sin(t) AS y, sin(r / 2) * c AS z, cos(r / 2) AS w_, m / sum(m) OVER () AS w FROM (SELECT *, pow(sin(r / 2) / (r / 2), 2) AS m FROM (SELECT {BALL_RADIUS} * pow(u0, 1 / 3.0) AS r, 2 * u1 - 1 AS c, 2 * pi() * u2 AS t FROM h))), turned AS ({_TURNED.replace('t.w', 't.w_')}), lams AS (")):
    if _old not in _EDGE:
        raise ValueError(_old)
    _EDGE = _EDGE.replace(_old, _new)


@query("bragg_edge_ball", _EDGE)
def bragg_edge_ball(spark, d):
    """The matrix of edges averaged over a ball of turns around every orientation."""
    beams = spark.range(3).selectExpr("cast(id as int) a", "0.3 + 0.7 * id as angle")
    lam = spark.range(40).selectExpr("cast(id as int) l", "1.5D + 0.05D * id as lam")
    ball = odf_plans.halton_ball(spark, BALL, BALL_RADIUS)
    got = polefigure.bragg_matrix(B.orientations(spark, d), beams, _neutron(spark), lam, 3.6**3, 1.2 * BALL_RADIUS / BALL ** (1 / 3), 0.02, tail=lambda x: F.lit(1e-9), ball=ball)
    return got.select("a", "k", "l", r4(F.col("v") * 1e3, 3).alias("v"))
