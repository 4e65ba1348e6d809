"""Queries over sources and sinks, streams, group rotations, phases, updates and small dense solves."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..operators import derivs, fields, search
from ..sources import bindings as B
from ..sources import tables
from ..sources.bindings import NX, NY, sql
from ..streaming import incremental
from . import odf as odf_plans
from . import solvers
from .catalog_operators import _out
from .catalog_orientations import _BLOCKS, _SLOPES24
from .catalog_solvers import TAU, _all_cells, _fwd, _stored_op
from .registry import QUERIES, query
from .state import state_dir


@query("completed_cells", sql("SELECT a::INT AS k, b::INT AS p, coalesce(c.v, 0)::DOUBLE AS v FROM range(9) x(a) CROSS JOIN range(256) y(b) LEFT JOIN coef c ON c.k = a AND c.p = b", "coef"))
def completed_cells(spark, d):
    coef = B.coef(spark, d).withColumn("v", F.col("v").cast("double"))
    return tables.completed(coef, {"k": 9, "p": 256}).select("k", "p", "v")


@query("streamed_totals", sql("SELECT a, sum(b)::DOUBLE AS total, count(*) AS n FROM dat GROUP BY a", "dat"))
def streamed_totals(spark, d):
    """Data rows that arrive in files, one micro-batch a file, update totals kept as a state."""
    root = f"{state_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = B.data(spark, d).select("a", "y", "j", F.col("b").cast("double").alias("b"))
    for part in range(3):
        rows.where(F.col("a") % 3 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    start = spark.createDataFrame([], "a int, total double, n long")

    def add(x, batch):
        new = batch.groupBy("a").agg(F.sum("b").alias("total"), F.count("*").alias("n"))
        return x.unionByName(new).groupBy("a").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    run = incremental.fit_stream(incremental.data_stream(spark, f"{root}/in"), add, start, f"{root}/state", f"{root}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{root}/state/gen={run.lastProgress['batchId'] + 1}").select("a", "total", "n")


_LISTED = {
    "4/mmm": ("tetragonal", ["x,y,z", "-y,x,z", "-x,-y,z", "y,-x,z", "x,-y,-z", "-x,y,-z", "y,x,-z", "-y,-x,-z", "-x,-y,-z", "y,-x,-z"]),
    "6/m": ("hexagonal", ["x,y,z", "x-y,x,z", "-y,x-y,z", "-x,-y,z", "-x+y,-x,z", "y,-x+y,z", "-x,-y,-z"]),
    "2/m": ("monoclinic", ["x,y,z", "-x,y+1/2,-z+1/2", "-x,-y,-z", "x,-y+1/2,z+1/2"]),
}


_PHASES = "SELECT a, j, k, v FROM pf UNION ALL SELECT a, ((j + 5) % 24)::INT, k + 7, v / 2 FROM pf"
_PHASE_STEPS = {
    "pfs": _PHASES, "bb": "SELECT a, j, sum(b) AS b FROM dat GROUP BY 1, 2",
    "bound": "SELECT 1.0 / max(c) AS step FROM (SELECT k, sum(v * s) AS c FROM pfs JOIN (SELECT a, j, sum(v) AS s FROM pfs GROUP BY 1, 2) USING (a, j) GROUP BY k)",
    "x1": "SELECT k, greatest(0, (SELECT step FROM bound) * sum(v * b)) AS w FROM pfs JOIN bb USING (a, j) GROUP BY k",
    "m1": "SELECT a, j, sum(v * w) AS m FROM pfs JOIN x1 USING (k) GROUP BY 1, 2",
    "x2": "SELECT k, greatest(0, x1.w - (SELECT step FROM bound) * g) AS w FROM x1 JOIN (SELECT k, sum(v * (coalesce(m, 0) - coalesce(b, 0))) AS g FROM pfs JOIN (m1 FULL JOIN bb USING (a, j)) USING (a, j) GROUP BY k) USING (k)",
}


@query("two_phase_odf", sql("SELECT CASE WHEN k < 7 THEN 'one' ELSE 'two' END AS phase, (k % 7)::INT AS k, round(w, 4) + 0.0 AS w FROM x2", "dat", "pf", **_PHASE_STEPS))
def two_phase_odf(spark, d):
    pf = B.pf_surrogate(spark)
    other = pf.select("a", "k", ((F.col("j") + 5) % 24).cast("int").alias("j"), (F.col("v") / 2).alias("v"))
    data = B.data(spark, d).groupBy("a", "j").agg(F.sum("b").alias("b"))
    got = odf_plans.fit_bulk_phases({"one": pf, "two": other}, data, 2)
    made = [df.select(F.lit(n).alias("phase"), F.col("k").cast("int").alias("k"), r4(F.col("w")).alias("w")) for n, df in got.items()]
    return made[0].union(made[1])


@query("updated_orientations", sql(
    "SELECT k, round(sw * qx + sx * qw + sy * qz - sz * qy, 4) + 0.0 AS qx, round(sw * qy - sx * qz + sy * qw + sz * qx, 4) + 0.0 AS qy, round(sw * qz + sx * qy - sy * qx + sz * qw, 4) + 0.0 AS qz, round(sw * qw - sx * qx - sy * qy - sz * qz, 4) + 0.0 AS qw, round(least(greatest(sigma + 0.5 * dsig, 1e-4), 0.1), 4) AS sigma "
    "FROM (SELECT *, cos(t / 2) AS sw, sin(t / 2) * rx / t AS sx, sin(t / 2) * ry / t AS sy, sin(t / 2) * rz / t AS sz FROM (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS t FROM (SELECT *, 0.5 * 0.01 * (1 + k % 3) AS rx, 0.5 * 0.02 AS ry, -0.5 * 0.01 * (k % 2) AS rz, 0.1 * (k % 5 - 2) AS dsig FROM orient)))", "orient"))
def updated_orientations(spark, d):
    o, k = B.orientations(spark, d), F.col("k")
    steps = o.select("k", (0.01 * (1 + k % 3)).alias("s_rx"), F.lit(0.02).alias("s_ry"), (-0.01 * (k % 2)).alias("s_rz"), (0.1 * (k % 5 - 2)).alias("s_sigma"))
    got = derivs.updated_orientations(o.select("k", "qx", "qy", "qz", "qw", "sigma"), steps, 0.5)
    return got.select("k", *[r4(F.col(c)).alias(c) for c in ("qx", "qy", "qz", "qw", "sigma")])


@query("local_basis_forward", sql("SELECT a, y, j, round(v, 4) + 0.0 AS v FROM f", "coef", "radon", "pf", kept="SELECT k, p, v FROM coef WHERE (k + p) % 3 = 0", f=_fwd("kept")))
def local_basis_forward(spark, d):
    """The operator on a basis of its own at every voxel: coefficients off the support take no part."""
    support = _all_cells(spark).where("(k + p) % 3 = 0")
    return _out(_stored_op(spark).forward(fields.project_support(B.coef(spark, d), support)), "a", "y", "j", v="v")


@query("stopped_by_callback", "SELECT * FROM (VALUES (1), (2)) t(iter)")
def stopped_by_callback(spark, d):
    """Iterations that a solver ran before its callback stopped it."""
    seen: list[int] = []
    solvers.fista(_stored_op(spark), B.data(spark, d), TAU, 9, callback=lambda it, x, stats: seen.append(it) or it == 2)
    return spark.createDataFrame([(i,) for i in seen], "iter int")


def _solve_sql(damping: float = 1e-3, most: float = math.radians(0.2)) -> str:
    """Damped 4 x 4 systems by elimination, one step a table; the rotation part is cut to a trust region."""
    names = derivs.PARAMETERS
    h = lambda i, j: f"h_{names[min(i, j)]}_{names[max(i, j)]}"
    trace = " + ".join(h(i, i) for i in range(4))
    first = ", ".join([f"{h(i, j)}" + (f" * {1 + damping} + 1e-12 * greatest({trace}, 1e-30)" if i == j else "") + f" AS a{i}{j}" for i in range(4) for j in range(4)] + [f"-g_{names[i]} AS b{i}" for i in range(4)])
    steps = {"e0": f"SELECT k, {trace} AS tr, {first} FROM blocks"}
    for c in range(4):
        cells = []
        for i in range(4):
            for j in range(4):
                cells.append(f"a{i}{j}" + (f" - a{i}{c} * a{c}{j} / a{c}{c}" if i != c else "") + f" AS a{i}{j}")
            cells.append(f"b{i}" + (f" - a{i}{c} * b{c} / a{c}{c}" if i != c else "") + f" AS b{i}")
        steps[f"e{c + 1}"] = f"SELECT k, tr, {', '.join(cells)} FROM e{c}"
    steps["st"] = "SELECT k, " + ", ".join(f"CASE WHEN tr > 0 THEN b{i} / a{i}{i} ELSE 0 END AS s{i}" for i in range(4)) + " FROM e4"
    steps["cut"] = f"SELECT *, least(1.0, {most!r} / greatest(sqrt(s0 * s0 + s1 * s1 + s2 * s2), 1e-30)) AS f FROM st"
    return sql("SELECT k, " + ", ".join(f"round(s{i}{' * f' if i < 3 else ''}, 4) + 0.0 AS s_{names[i]}" for i in range(4)) + " FROM cut", "noisy", "sino", "orient", "angle", **_SLOPES24, blocks=_BLOCKS, **steps)


query("gauss_newton_step", _solve_sql())(QUERIES["gauss_newton_step"])


def _refined_sql(levels: tuple[tuple[float, float, float], ...]) -> str:
    steps, now = {}, "SELECT k AS id, qx, qy, qz, qw FROM orient WHERE label = 0"
    for n, (spacing, radius, _) in enumerate(levels):
        points = ", ".join(f"({i}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (x, y, z) in enumerate(search.lattice(spacing, radius)))
        steps[f"c{n}"] = now
        steps[f"l{n}"] = f"SELECT i, cos(t / 2) AS sw, CASE WHEN t < 1e-12 THEN 0.5 ELSE sin(t / 2) / t END AS f, x, y, z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS t FROM (VALUES {points}) v(i, x, y, z))"
        turn = "qw*sx + qx*sw + qy*sz - qz*sy AS qx, qw*sy - qx*sz + qy*sw + qz*sx AS qy, qw*sz + qx*sy - qy*sx + qz*sw AS qz, qw*sw - qx*sx - qy*sy - qz*sz AS qw"
        steps[f"t{n}"] = f"SELECT id, i, {turn} FROM c{n}, (SELECT i, sw, f * x AS sx, f * y AS sy, f * z AS sz FROM l{n})"
        now = f"SELECT id, qx, qy, qz, qw FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(0.5 * qx + 0.5 * qy + 0.5 * qz + 0.5 * qw), 9) DESC, i) AS place FROM t{n}) WHERE place = 1"
    return sql("SELECT id, " + ", ".join(f"round(q{c}, 4) + 0.0 AS q{c}" for c in "xyzw") + " FROM last_level", "orient", **steps, last_level=now)


query("refine_candidates", _refined_sql(((2.0, 4.0, 1.0), (0.5, 1.0, 0.4))))(QUERIES["refine_candidates"])


_M = math.ceil(math.sqrt(2) * 16) + 3
_CORNERS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(ox, oy)"


def _bilinear_sql(points: str, columns: str, n: int) -> str:
    """Corners (ix, iy) and weights of points (x, y) on an n x n grid."""
    return f"SELECT {columns}, floor(x) + ox AS ix, floor(y) + oy AS iy, (CASE ox WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE oy WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w FROM {points}, {_CORNERS} WHERE floor(x) + ox BETWEEN 0 AND {n - 1} AND floor(y) + oy BETWEEN 0 AND {n - 1}"


_RAYS = {
    "dirs": "SELECT d::INT AS dir, cos(0.3 + 0.9 * d) AS dx, sin(0.3 + 0.9 * d) AS dy FROM range(3) t(d)",
    "frame": f"SELECT dir, r, u, 7.5 + (u - {(_M - 1) / 2}) * dx - (r - {(_M - 1) / 2}) * dy AS x, 7.5 + (u - {(_M - 1) / 2}) * dy + (r - {(_M - 1) / 2}) * dx AS y FROM dirs, range({_M}) a(r), range({_M}) b(u)",
    "seen": _bilinear_sql("frame", "dir, r, u", 16),
    "spots": f"SELECT dir, p, (p % 16 - 7.5) * dx + (p // 16 - 7.5) * dy + {(_M - 1) / 2} AS x, (p // 16 - 7.5) * dx - (p % 16 - 7.5) * dy + {(_M - 1) / 2} AS y FROM dirs, range(256) t(p)",
    "here": _bilinear_sql("spots", "dir, p", _M),
    "rays": "SELECT h.dir, h.p::INT AS p, (s.ix + 16 * s.iy)::INT AS p2, sum(h.w * s.w * CASE WHEN s.u = h.ix THEN 0.5 ELSE 1 END) AS len FROM here h JOIN seen s ON s.dir = h.dir AND s.r = h.iy AND s.u >= h.ix GROUP BY 1, 2, 3",
}


def _rays(spark):
    directions = spark.range(3).select(F.col("id").cast("int").alias("dir"), F.cos(0.3 + 0.9 * F.col("id")).alias("dx"), F.sin(0.3 + 0.9 * F.col("id")).alias("dy"))
    return derivs.direction_rays(directions, NX, NY)


_TWO = "SELECT i.a, i.p, i.t * o.t AS t FROM att i JOIN att o ON o.p = i.p AND o.dir = (i.a + 1) % 3"


@query("absorbed_both_ways", sql(
    "SELECT r.a, r.y, c.k, round(sum(c.v * r.w * t.t), 3) + 0.0 AS v FROM coef c JOIN radon r USING (p) JOIN both_ways t ON t.a = r.a AND t.p = r.p GROUP BY 1, 2, 3", "coef", "radon", **_RAYS,
    att="SELECT dir, dir AS a, p, exp(-sum(len * 0.01 * (1 + p2 % 3))) AS t FROM rays GROUP BY 1, 2, 3", both_ways=_TWO))
def absorbed_both_ways(spark, d):
    """Projection with the attenuation on the way in and on the way out, by classes of exit direction."""
    from .catalog_operators import _radon

    mu = spark.range(NX * NY).selectExpr("cast(id as int) p2", "0.01D * (1 + id % 3) as m")
    att = derivs.attenuation(_rays(spark), mu)
    both = derivs.both_ways(att, att.withColumn("dir", F.pmod(F.col("dir") + 2, F.lit(3))))
    return derivs.attenuated_forward(B.coef(spark, d), _radon(spark), both).select("a", "y", "k", r4(F.col("v"), 3).alias("v"))
