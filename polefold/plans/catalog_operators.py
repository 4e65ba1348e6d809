"""Queries over projection, pole-figure operators, data terms and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import nonneg_soft, r4, soft
from ..operators import blocks, fields, linop, projector, terms
from ..sources import bindings as B
from ..sources.bindings import NJ, NS, NX, NY, R, sql
from .registry import query

N0 = "+ 0.0"


def _geo(spark, n=R):
    return projector.geometry(projector.angles(spark, n), NX, NY, NS, 1.0, B.OFFSET)


def _radon(spark):
    return projector.radon_weights(_geo(spark), NX, NY, NS)


def _op(spark):
    return linop.tomographic(_radon(spark), B.pf_surrogate(spark))


def _out(df, *keys, **values):
    return df.select(*keys, *[r4(F.col(c)).alias(n) for n, c in values.items()])


@query("radon_forward", sql("SELECT a, y, k, round(v, 4) + 0.0 AS v FROM sino", "sino"))
def radon_forward(spark, d):
    return _out(projector.forward(B.coef(spark, d), _radon(spark)), "a", "y", "k", v="v")


BX, BS = 32, 47  # side and bins of the block queries' grid
_BGEO = f"""SELECT a, theta, cos(theta - pi() / 2) AS gx, sin(theta - pi() / 2) AS gy, ({BS} - 1) / 2.0 - cos(theta - pi() / 2) * ({BX} - 1) / 2.0 - sin(theta - pi() / 2) * ({BX} - 1) / 2.0 - {B.OFFSET} AS t0,
  greatest(abs(cos(theta - pi() / 2)), abs(sin(theta - pi() / 2))) AS big FROM angle"""
_BRADON = f"""SELECT a, y, p, w FROM (SELECT a, y::INT AS y, p::INT AS p, least(greatest((1 + big) / 2 - abs(gx * (p % {BX}) + gy * (p // {BX}) + t0 - y), 0), least(1, big)) / big AS w
  FROM bgeo, range({BX * BX}) q(p), range({BS}) s(y)) WHERE w > 1e-9"""
_BCOEF = f"SELECT (l_orderkey % 200)::INT AS k, (l_partkey % {BX * BX})::INT AS p, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2"


def _blocks(spark, side=BX, bins=BS, n=R, block=64):
    geo = projector.geometry(projector.angles(spark, n), side, side, bins, 1.0, B.OFFSET)
    return blocks.BlockProjection(geo, side, side, bins, block)


def _block_coef(spark, d, channels=200, side=BX):
    rows = B.read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    keys = [(F.col("l_orderkey") % channels).cast("int").alias("k"), (F.col("l_partkey") % (side * side)).cast("int").alias("p")]
    return rows.groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("v"))


@query("block_forward", sql("SELECT a, y, k, round(sum(v * w), 4) + 0.0 AS v FROM bcoef JOIN bradon USING (p) GROUP BY 1, 2, 3", "angle", bgeo=_BGEO, bradon=_BRADON, bcoef=_BCOEF))
def block_forward(spark, d):
    return _out(_blocks(spark).forward(_block_coef(spark, d)), "a", "y", "k", v="v")


@query("block_adjoint", sql("SELECT k, p, round(sum(v * w), 4) + 0.0 AS v FROM bsino JOIN bradon USING (a, y) GROUP BY 1, 2", "angle", bgeo=_BGEO, bradon=_BRADON, bsino=f"SELECT (l_orderkey % 30)::INT AS a, (l_suppkey % {BS})::INT AS y, (l_partkey % 100)::INT AS k, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2, 3"))
def block_adjoint(spark, d):
    rows = B.read(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity")
    keys = [(F.col("l_orderkey") % 30).cast("int").alias("a"), (F.col("l_suppkey") % BS).cast("int").alias("y"), (F.col("l_partkey") % 100).cast("int").alias("k")]
    return _out(_blocks(spark).adjoint(rows.groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("v"))), "k", "p", v="v")


_SINO_DATA = "SELECT a, y, (j % 7)::INT AS k, sum(b) AS v FROM dat GROUP BY 1, 2, 3"


def _sino_data(spark, d):
    return B.data(spark, d).groupBy("a", "y", (F.col("j") % 7).cast("int").alias("k")).agg(F.sum("b").alias("v"))


@query("radon_adjoint", sql("SELECT s.k, r.p, round(sum(s.v * r.w), 4) + 0.0 AS v FROM sd s JOIN radon r USING (a, y) GROUP BY 1, 2", "radon", "dat", sd=_SINO_DATA))
def radon_adjoint(spark, d):
    return _out(projector.adjoint(_sino_data(spark, d), _radon(spark)), "k", "p", v="v")


@query("radon_adjoint_pixels", sql("SELECT s.k, r.p, round(sum(s.v * r.w), 4) + 0.0 AS v FROM sd s JOIN radon r USING (a, y) WHERE r.p % 5 = 0 AND r.a % 3 = 1 GROUP BY 1, 2", "radon", "dat", sd=_SINO_DATA))
def radon_adjoint_pixels(spark, d):
    pixels = spark.range(NX * NY).select(F.col("id").cast("int").alias("p")).where("p % 5 = 0")
    listed = projector.angles(spark, R).where("a % 3 = 1")
    return _out(projector.adjoint_listed(_sino_data(spark, d), _radon(spark), pixels, listed), "k", "p", v="v")


@query("adjoint_identity", sql("SELECT round((SELECT sum(f.v * s.v) FROM sino f JOIN sd s USING (a, y, k)) / 1e6, 4) AS lhs, round((SELECT sum(c.v * t.v) FROM coef c JOIN (SELECT s.k, r.p, sum(s.v * r.w) AS v FROM sd s JOIN radon r USING (a, y) GROUP BY 1, 2) t USING (k, p)) / 1e6, 4) AS rhs", "sino", "dat", sd=_SINO_DATA))
def adjoint_identity(spark, d):
    coef, data, radon = B.coef(spark, d), _sino_data(spark, d), _radon(spark)
    left = projector.forward(coef, radon).withColumnRenamed("v", "f").join(data, ["a", "y", "k"]).agg(r4(F.sum(F.col("f") * F.col("v")) / 1e6).alias("lhs"))
    right = projector.adjoint(data, radon).withColumnRenamed("v", "f").join(coef, ["k", "p"]).agg(r4(F.sum(F.col("f") * F.col("v")) / 1e6).alias("rhs"))
    return left.crossJoin(right)


@query("subset_forward", sql("SELECT a, y, k, round(v, 4) + 0.0 AS v FROM sino WHERE a % 4 = 2", "sino"))
def subset_forward(spark, d):
    angle = projector.angles(spark, R, subsets=4)
    return _out(projector.forward(B.coef(spark, d), projector.restricted(_radon(spark), angle, "subset = 2")), "a", "y", "k", v="v")


@query("pf_forward", sql("SELECT a, y, j, round(v, 4) + 0.0 AS v FROM pred", "pred"))
def pf_forward(spark, d):
    return _out(_op(spark).forward(B.coef(spark, d)), "a", "y", "j", v="v")


_ADJ = "SELECT k, p, sum(z.v * r.w) AS v FROM (SELECT d.a, d.y, pf.k, sum(d.b * pf.v) AS v FROM dat d JOIN pf USING (a, j) GROUP BY 1, 2, 3) z JOIN radon r USING (a, y) GROUP BY 1, 2"


@query("full_adjoint", sql("SELECT k, p, round(v / 1000, 4) + 0.0 AS v FROM adj", "dat", "pf", "radon", adj=_ADJ))
def full_adjoint(spark, d):
    back = _op(spark).adjoint(B.data(spark, d).select("a", "y", "j", F.col("b").alias("v")))
    return back.select("k", "p", r4(F.col("v") / 1000).alias("v"))


@query("pf_adjoint", sql("SELECT d.a, d.y, pf.k, round(sum(d.b * pf.v), 4) + 0.0 AS v FROM dat d JOIN pf USING (a, j) GROUP BY 1, 2, 3", "dat", "pf"))
def pf_adjoint(spark, d):
    return _out(_op(spark).links[1].adjoint(B.data(spark, d).select("a", "y", "j", F.col("b").alias("v"))), "a", "y", "k", v="v")


@query("multi_adjoint", sql("SELECT input, rowset, k, p, round(sum(z.v * r.w) / 1000, 4) + 0.0 AS v FROM (SELECT i.input, i.rowset, i.a, i.y, pf.k, sum(i.v * pf.v) AS v FROM i JOIN pf USING (a, j) GROUP BY 1, 2, 3, 4, 5) z JOIN radon r USING (a, y) GROUP BY 1, 2, 3, 4", "dat", "pf", "radon", i="SELECT a, y, j, 'data' AS input, (a % 2)::INT AS rowset, b AS v FROM dat UNION ALL SELECT a, y, j, 'model', (a % 2)::INT, mu FROM dat"))
def multi_adjoint(spark, d):
    data = B.data(spark, d).withColumn("rowset", (F.col("a") % 2).cast("int"))
    both = data.select("a", "y", "j", "rowset", F.explode(F.array(F.struct(F.lit("data").alias("input"), F.col("b").alias("v")), F.struct(F.lit("model").alias("input"), F.col("mu").alias("v")))).alias("s"))
    back = _op(spark).adjoint(both.select("a", "y", "j", "rowset", "s.input", "s.v"), ("input", "rowset"))
    return back.select("input", "rowset", "k", "p", r4(F.col("v") / 1000).alias("v"))


@query("bulk_forward", sql("SELECT pf.a, pf.j, round(sum(c.v * pf.v), 4) + 0.0 AS v FROM (SELECT k, sum(v) AS v FROM coef GROUP BY k) c JOIN pf USING (k) GROUP BY 1, 2", "coef", "pf"))
def bulk_forward(spark, d):
    total = B.coef(spark, d).groupBy("k").agg(F.sum("v").alias("v"))
    return _out(linop.bulk(B.pf_surrogate(spark)).forward(total), "a", "j", v="v")


@query("bulk_adjoint", sql("SELECT pf.k, round(sum(x.b * pf.v), 4) + 0.0 AS v FROM (SELECT a, j, sum(b) AS b FROM dat GROUP BY 1, 2) x JOIN pf USING (a, j) GROUP BY 1", "dat", "pf"))
def bulk_adjoint(spark, d):
    summed = B.data(spark, d).groupBy("a", "j").agg(F.sum("b").alias("v"))
    return _out(linop.bulk(B.pf_surrogate(spark)).adjoint(summed), "k", v="v")


@query("bulk_data", sql("SELECT a, j, sum(b) AS b FROM dat GROUP BY 1, 2", "dat"))
def bulk_data(spark, d):
    return B.data(spark, d).groupBy("a", "j").agg(F.sum("b").alias("b"))


_BM = "SELECT a::INT AS a, k::INT AS k, l::INT AS l, 1.0::DOUBLE / (2 + (a + 2 * k + 3 * l) % 7) AS v FROM range(30) x(a), range(7) z(k), range(8) u(l)"


@query("matrix_forward", sql("SELECT s.a, s.y, m.l, round(sum(s.v * m.v), 4) + 0.0 AS v FROM sino s JOIN bm m ON s.a = m.a AND s.k = m.k GROUP BY 1, 2, 3", "sino", bm=_BM))
def matrix_forward(spark, d):
    cells = spark.range(R * 7 * 8).selectExpr("cast(id div 56 as int) a", "cast((id div 8) % 7 as int) k", "cast(id % 8 as int) l")
    b = cells.withColumn("v", 1.0 / (2 + (F.col("a") + 2 * F.col("k") + 3 * F.col("l")) % 7))
    return _out(linop.matrix(_radon(spark), b).forward(B.coef(spark, d)), "a", "y", "l", v="v")


@query("multi_phase_forward", sql("SELECT a, y, j, round(sum(v), 4) + 0.0 AS v FROM (SELECT a, y, j, v FROM pred UNION ALL SELECT s.a, s.y, p2.j, sum(s.v * p2.v) FROM sino s JOIN p2 ON s.a = p2.a AND s.k = p2.k GROUP BY 1, 2, 3) GROUP BY 1, 2, 3", "pred", p2="SELECT a, k, ((j + 5) % 24)::INT AS j, v / 2 AS v FROM pf"))
def multi_phase_forward(spark, d):
    pf, radon, coef = B.pf_surrogate(spark), _radon(spark), B.coef(spark, d)
    other = pf.select("a", "k", ((F.col("j") + 5) % NJ).cast("int").alias("j"), (F.col("v") / 2).alias("v"))
    return _out(linop.phases_forward({"one": (linop.tomographic(radon, pf), coef), "two": (linop.tomographic(radon, other), coef)}), "a", "y", "j", v="v")


_D = "w / g * (greatest(mu, 0) + bg + 0.001 * g - b + CASE WHEN b > 0 THEN b * ln(b / (greatest(mu, 0) + bg + 0.001 * g)) ELSE 0 END)"


def _noisy(spark, d):
    return B.with_noise(B.data(spark, d))


@query("poisson_deviance", sql(f"SELECT round(sum({_D}) / 1000, 4) AS deviance, count(*) AS points, round(sum({_D}) / count(*), 4) AS per_point FROM noisy WHERE w <> 0", "noisy"))
def poisson_deviance(spark, d):
    return terms.poisson_deviance(_noisy(spark, d)).select(r4(F.col("deviance") / 1000).alias("deviance"), "points", r4(F.col("per_point")).alias("per_point"))


@query("heldout_deviance", sql(f"SELECT (a // 5) % 5 <> 2 AS fitted, count(*) AS points, round(sum({_D}) / count(*), 4) AS per_point FROM noisy WHERE w <> 0 GROUP BY 1", "noisy"))
def heldout_deviance(spark, d):
    data = _noisy(spark, d).withColumn("fitted", F.floor(F.col("a") / 5) % 5 != 2)
    return terms.poisson_deviance(data, ("fitted",)).select("fitted", "points", r4(F.col("per_point")).alias("per_point"))


@query("wls_objective", sql("SELECT round(sum(0.5 * w / g / greatest(b, g) * (mu + bg - b) * (mu + bg - b)) / 1000, 4) AS wls FROM noisy WHERE w <> 0", "noisy"))
def wls_objective(spark, d):
    return terms.wls_objective(_noisy(spark, d)).select(r4(F.col("wls") / 1000).alias("wls"))


@query("huber_loss", sql("SELECT round(sum(r * r) / 1000, 4) AS sumsq, round(sum(CASE WHEN abs(r) <= 2 THEN 0.5 * r * r ELSE 2 * (abs(r) - 1) END) / 1000, 4) AS huber, sum((abs(r) > 2)::INT)::BIGINT AS clipped FROM (SELECT w * (mu - b) AS r FROM noisy)", "noisy"))
def huber_loss(spark, d):
    return terms.residual_norms(_noisy(spark, d), 2.0).select(r4(F.col("sumsq") / 1000).alias("sumsq"), r4(F.col("huber") / 1000).alias("huber"), "clipped")


@query("asinh_misfit", sql("SELECT round(sum(0.5 * w * CASE WHEN r > 0 THEN 0.5 ELSE 1 END * r * r), 4) AS misfit FROM (SELECT w, 4.0 * asinh(mu / 4.0) - 4.0 * asinh(b / 4.0) AS r FROM noisy)", "noisy"))
def asinh_misfit(spark, d):
    return terms.asinh_misfit(_noisy(spark, d), 4.0, 0.5).select(r4(F.col("misfit")).alias("misfit"))


@query("curvature", sql("SELECT a, y, j, round(CASE WHEN w <> 0 THEN w / g * greatest(b, m) / (m * m) ELSE 0 END, 4) + 0.0 AS c FROM (SELECT *, greatest(greatest(mu, 0) + bg, g) AS m FROM noisy)", "noisy"))
def curvature(spark, d):
    data = _noisy(spark, d)
    return data.select("a", "y", "j", r4(terms.curvature(data)).alias("c"))


@query("score_inputs", sql("SELECT a, y, j, round(CASE WHEN w > 0 THEN w / g * (b / m - 1) ELSE 0 END, 4) + 0.0 AS e, round(CASE WHEN w > 0 THEN w / (g * m) ELSE 0 END, 4) + 0.0 AS d FROM (SELECT *, greatest(greatest(mu, 0), 0.25 * g) AS m FROM noisy)", "noisy"))
def score_inputs(spark, d):
    return _out(terms.score_inputs(_noisy(spark, d)), "a", "y", "j", e="e", d="d")


@query("gain_from_pairs", "WITH l AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 8)::INT AS s, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2, 3) SELECT x.s, round(sum((x.q - y.q) * (x.q - y.q) / 2) / sum((x.q + y.q) / 2), 4) AS gain, count(*) AS pairs FROM l x JOIN l y USING (l_orderkey) WHERE x.l_linenumber = 1 AND y.l_linenumber = 2 GROUP BY 1")
def gain_from_pairs(spark, d):
    rows = B.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_linenumber <= 2")
    pairs = rows.groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))).alias("x"), F.sum(F.when(F.col("l_linenumber") == 2, F.col("l_quantity"))).alias("y"))
    pairs = pairs.where("x is not null and y is not null").withColumn("s", (F.col("l_orderkey") % 8).cast("int"))
    return terms.gain_from_pairs(pairs, ("s",)).select("s", r4(F.col("gain")).alias("gain"), "pairs")


@query("coverage", "WITH p AS (SELECT value / 1000 AS t, (event_id % 720) / 2.0 AS eta FROM events WHERE event_type <> 'error') SELECT floor(eta / 10.0)::INT AS c, win, round(count(*) * 1e-4 / (2 * pi() / 36 * (cos(lo) - cos(hi))), 4) AS ratio FROM p JOIN (VALUES (0, 0.0, 0.1), (1, 0.1, 0.25), (2, 0.2, 0.4)) v(win, lo, hi) ON t >= lo AND t < hi GROUP BY 1, 2, lo, hi")
def coverage(spark, d):
    pixels = B.events(spark, d).select((F.col("value") / 1000).alias("two_theta"), ((F.col("event_id") % 720) / 2).alias("eta"), F.lit(1e-4).alias("omega"), (F.col("event_type") != "error").alias("valid"))
    return _out(terms.coverage(pixels, 36, [(0.0, 0.1), (0.1, 0.25), (0.2, 0.4)]), "c", "win", ratio="ratio")


@query("integration_gain", "SELECT win, round(avg(CASE WHEN s > 0 THEN 1 / s END), 4) AS gain FROM (SELECT (user_id % 4)::INT AS win, (event_id % 16)::INT AS bin, sum(value) / 1000 AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def integration_gain(spark, d):
    pixels = B.events(spark, d).selectExpr("cast(user_id % 4 as int) win", "cast(event_id % 16 as int) bin", "value / 1000 as norm")
    return _out(terms.integration_gain(pixels), "win", gain="gain")


def _em_sql(rounds: int) -> str:
    steps = {"f": "SELECT c.c, c.a, c.y, c.j, c.v, (c.j % 3)::INT AS ch, n.b, n.w, n.g, n.bg FROM comp c JOIN noisy n USING (a, y, j) WHERE n.w <> 0", "s0": "SELECT DISTINCT c, ch, 1.0::DOUBLE AS s FROM f"}
    for i in range(rounds):
        steps[f"m{i}"] = f"SELECT a, y, j, sum(s * v) AS mu FROM f JOIN s{i} USING (c, ch) GROUP BY 1, 2, 3"
        steps[f"s{i + 1}"] = f"SELECT c, ch, max(s) * sum(w / g * v * b / (greatest(mu, 0) + bg + 0.001 * g)) / sum(w / g * v) AS s FROM f JOIN s{i} USING (c, ch) JOIN m{i} USING (a, y, j) GROUP BY 1, 2"
    return sql(f"SELECT c, ch, round(s, 4) AS s FROM s{rounds}", "comp", "noisy", **steps)


@query("em_scales_3it", _em_sql(3))
def em_scales(spark, d):
    got = terms.em_scales(B.components(spark, d), _noisy(spark, d), (F.col("j") % 3).cast("int"), 3)
    return _out(got, "c", "ch", s="s")


@query("intensity_layer_vjp", sql("SELECT 'a' AS axis, a AS i, round(sum(mu), 4) AS v FROM dat GROUP BY 2 UNION ALL SELECT 'y', y, round(sum(mu), 4) FROM dat GROUP BY 2 UNION ALL SELECT 'r', (j % 3)::INT, round(sum(mu), 4) FROM dat GROUP BY 2 UNION ALL SELECT 'j', j, round(sum(mu), 4) FROM dat GROUP BY 2", "dat"))
def intensity_layer_vjp(spark, d):
    return _out(terms.intensity_vjp(B.data(spark, d).select("a", "y", "j", F.col("mu").alias("v"))), "axis", F.col("i").cast("int").alias("i"), v="v")


@query("tv_gradient", sql("SELECT k, p, coalesce(lead(v) OVER (PARTITION BY k, p // 16 ORDER BY p) - v, 0) AS gx, coalesce(lead(v) OVER (PARTITION BY k, p % 16 ORDER BY p) - v, 0) AS gy FROM dense", "coef", dense="SELECT k, p::INT AS p, coalesce(v, 0) AS v FROM (SELECT DISTINCT k FROM coef) x CROSS JOIN range(256) q(p) LEFT JOIN coef USING (k, p)"))
def tv_gradient(spark, d):
    return fields.tv_gradient(_dense(spark, d), NX, NY).select("k", "p", "gx", "gy")


_DENSE = "SELECT k, p::INT AS p, coalesce(v, 0) AS v FROM (SELECT DISTINCT k FROM coef) x CROSS JOIN range(256) q(p) LEFT JOIN coef USING (k, p)"


def _dense(spark, d):
    coef = B.coef(spark, d)
    return fields.dense(coef, coef, NX * NY)


_DIV = "CASE WHEN p % 16 < 15 THEN -px ELSE 0 END + CASE WHEN p // 16 < 15 THEN -py ELSE 0 END + coalesce(lag(px) OVER (PARTITION BY k, p // 16 ORDER BY p), 0) + coalesce(lag(py) OVER (PARTITION BY k, p % 16 ORDER BY p), 0)"


@query("tv_divergence", sql(f"SELECT k, p, {_DIV} AS div FROM (SELECT k, p, v AS px, 2 * v AS py FROM dense)", "coef", dense=_DENSE))
def tv_divergence(spark, d):
    field = _dense(spark, d).select("k", "p", F.col("v").alias("px"), (2 * F.col("v")).alias("py"))
    return fields.tv_divergence(field, NX, NY)


@query("tv_value", sql("SELECT k, round(sum(sqrt(gx * gx + gy * gy)), 4) AS tv FROM (SELECT k, coalesce(lead(v) OVER (PARTITION BY k, p // 16 ORDER BY p) - v, 0) AS gx, coalesce(lead(v) OVER (PARTITION BY k, p % 16 ORDER BY p) - v, 0) AS gy FROM dense) GROUP BY k", "coef", dense=_DENSE))
def tv_value(spark, d):
    return _out(fields.tv_value(fields.tv_gradient(_dense(spark, d), NX, NY)), "k", tv="tv")


def _tv_sql(rounds: int, weight: float) -> str:
    steps = {"dense": _DENSE, "q0": "SELECT k, p, v, 0.0::DOUBLE AS px, 0.0::DOUBLE AS py, v AS u FROM dense"}
    for i in range(rounds):
        steps[f"g{i}"] = f"SELECT k, p, v, px + 0.25 * coalesce(lead(u) OVER (PARTITION BY k, p // 16 ORDER BY p) - u, 0) AS px, py + 0.25 * coalesce(lead(u) OVER (PARTITION BY k, p % 16 ORDER BY p) - u, 0) AS py FROM q{i}"
        steps[f"h{i}"] = f"SELECT k, p, v, px / greatest(1, sqrt(px * px + py * py) / {weight}) AS px, py / greatest(1, sqrt(px * px + py * py) / {weight}) AS py FROM g{i}"
        steps[f"q{i + 1}"] = f"SELECT k, p, v, px, py, v - ({_DIV}) AS u FROM h{i}"
    return sql(f"SELECT k, p, round(greatest(u, 0), 4) + 0.0 AS v FROM q{rounds}", "coef", **steps)


@query("tv_prox_3it", _tv_sql(3, 20.0))
def tv_prox(spark, d):
    return _out(fields.tv_prox(_dense(spark, d), NX, NY, 20.0, 3), "k", "p", v="v")


@query("prox_soft", sql("SELECT k, p, sign(v - 300) * greatest(abs(v - 300) - 50, 0) + 0.0 AS soft, greatest(v - 250, 0) + 0.0 AS nonneg FROM coef", "coef"))
def prox_soft(spark, d):
    return B.coef(spark, d).select("k", "p", (soft(F.col("v") - 300, 50.0) + F.lit(0.0)).alias("soft"), (nonneg_soft(F.col("v"), 250.0) + F.lit(0.0)).alias("nonneg"))


@query("support_project", sql("SELECT k, p, v FROM coef WHERE p IN (SELECT p FROM (SELECT p, max(abs(gx * (p % 16) + gy * (p // 16) + t0 - 8)) AS m FROM geo, range(256) q(p) GROUP BY p) WHERE m <= 8 + 1e-9)", "coef", "geo"))
def support_project(spark, d):
    return fields.project_support(B.coef(spark, d), projector.fov_mask(_geo(spark), NX, NY, NS))


_PAIRS = "SELECT DISTINCT (l_linenumber - 1)::INT AS k, (l_partkey % 256)::INT AS p FROM lineitem WHERE l_quantity > 45 AND l_discount > 0.065"


def _pairs(spark, d):
    return B.read(spark, d, "lineitem", "l_linenumber", "l_partkey", "l_quantity", "l_discount").where("l_quantity > 45 and l_discount > 0.065").selectExpr("cast(l_linenumber - 1 as int) k", "cast(l_partkey % 256 as int) p").distinct()


_SPARSE = "SELECT DISTINCT (l_linenumber - 1)::INT AS k, (l_partkey % 256)::INT AS p FROM lineitem WHERE l_quantity > 48 AND l_discount > 0.085"


def _sparse(spark, d):
    return B.read(spark, d, "lineitem", "l_linenumber", "l_partkey", "l_quantity", "l_discount").where("l_quantity > 48 and l_discount > 0.085").selectExpr("cast(l_linenumber - 1 as int) k", "cast(l_partkey % 256 as int) p").distinct()


@query("dilate_disk", sql("SELECT DISTINCT k, (p % 16 + dx + 16 * (p // 16 + dy))::INT AS p FROM s, range(-2, 3) x(dx), range(-2, 3) z(dy) WHERE dx * dx + dy * dy <= 2.25 AND p % 16 + dx BETWEEN 0 AND 15 AND p // 16 + dy BETWEEN 0 AND 15", s=_SPARSE))
def dilate_disk(spark, d):
    return fields.dilate(_sparse(spark, d), fields.disk(1.5), NX, NY)


@query("support_union", sql("SELECT k, p FROM s UNION SELECT k, p FROM coef WHERE v > 400", "coef", s=_PAIRS))
def support_union(spark, d):
    return _pairs(spark, d).union(B.coef(spark, d).where("v > 400").select("k", "p")).distinct()


@query("restrict_mask", sql("SELECT k, p FROM s WHERE p % 16 BETWEEN 4 AND 11", s=_PAIRS))
def restrict_mask(spark, d):
    mask = spark.range(NX * NY).select(F.col("id").cast("int").alias("p")).where("p % 16 between 4 and 11")
    return fields.restrict(_pairs(spark, d), mask)


@query("bounding_boxes", sql("SELECT k, min(p % 16)::INT AS x0, max(p % 16)::INT AS x1, min(p // 16)::INT AS y0, max(p // 16)::INT AS y1, count(*) AS n FROM s GROUP BY k", s=_PAIRS))
def bounding_boxes(spark, d):
    return fields.bounding_boxes(_pairs(spark, d), NX)


@query("support_tiles", sql("SELECT k, p, (p % 16) // 4 AS tx, (p // 16) // 4 AS ty FROM s", s=_PAIRS))
def support_tiles(spark, d):
    return fields.tiles(_pairs(spark, d), NX, 4)


@query("regions", sql("SELECT k, p, min(q)::INT AS region FROM reach GROUP BY 1, 2", s=_SPARSE, reach="SELECT k, p, p AS q FROM s UNION SELECT s.k, s.p, r.q FROM reach r JOIN s ON s.k = r.k AND abs(s.p % 16 - r.p % 16) <= 1 AND abs(s.p // 16 - r.p // 16) <= 1"))
def regions(spark, d):
    return fields.regions(_sparse(spark, d), NX, NY)


_WIDE = 40
_SPOTS = f"SELECT DISTINCT (l_linenumber - 1)::INT AS k, (l_partkey % {_WIDE * _WIDE})::INT AS p FROM lineitem WHERE l_quantity > 47 AND l_discount > 0.075"


def _spots(spark, d):
    rows = B.read(spark, d, "lineitem", "l_linenumber", "l_partkey", "l_quantity", "l_discount").where("l_quantity > 47 and l_discount > 0.075")
    return rows.selectExpr("cast(l_linenumber - 1 as int) k", f"cast(l_partkey % {_WIDE * _WIDE} as int) p").distinct()


def _patch_steps(spots: str, n: int, gap: int, fill: float, rounds: int = 6) -> dict[str, str]:
    """Tables s (voxels) and patch: clusters by reach, their boxes, and rounds of merging (more than it takes), with the numbers and offsets of the boxes left."""
    reach = 2 * gap + 1
    steps = {
        "s": f"SELECT k, p, p % {n} AS x, p // {n} AS y FROM ({spots})",
        "whole": f"SELECT k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) < {fill} * (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS loose FROM s GROUP BY k",
        "l": "SELECT s.* FROM s JOIN whole USING (k) WHERE loose",
        "reach": f"SELECT k, p, x, y, p AS q, x AS qx, y AS qy FROM l UNION SELECT r.k, r.p, r.x, r.y, l.p, l.x, l.y FROM reach r JOIN l ON l.k = r.k AND abs(l.x - r.qx) <= {reach} AND abs(l.y - r.qy) <= {reach}",
        "box0": "SELECT DISTINCT k, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT k, p, x, y, min(q) AS c FROM reach GROUP BY ALL) GROUP BY k, c",
    }
    for i in range(rounds):
        steps[f"ibox{i}"] = f"SELECT *, row_number() OVER () AS id FROM box{i}"
        steps[f"rbox{i}"] = f"SELECT id, id AS o FROM ibox{i} UNION SELECT r.id, b.id FROM rbox{i} r JOIN ibox{i} a ON a.id = r.o JOIN ibox{i} b ON a.k = b.k AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"
        steps[f"box{i + 1}"] = f"SELECT k, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM ibox{i} JOIN (SELECT id, min(o) AS c FROM rbox{i} GROUP BY id) USING (id) GROUP BY k, c"
    steps["boxes"] = f"SELECT *, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h FROM (SELECT * FROM box{rounds} UNION ALL SELECT k, x0, x1, y0, y1 FROM whole WHERE NOT loose)"
    steps["patch"] = "SELECT *, row_number() OVER (ORDER BY k, y0, y1, x0, x1) - 1 AS patch, (sum(w * h) OVER (ORDER BY k, y0, y1, x0, x1) - w * h)::BIGINT AS coff FROM boxes"
    return steps


@query("patches", sql("SELECT patch, k, x0, y0, w, h, coff FROM patch", **_patch_steps(_SPOTS, _WIDE, 1, 0.5)))
def patches(spark, d):
    from ..operators.patches import patches as boxes

    return boxes(_spots(spark, d), _WIDE, gap=1)[0]


@query("patch_pairs", sql("SELECT s.k, s.p, patch, coff + (y - y0) * w + x - x0 AS i FROM s JOIN patch ON s.k = patch.k AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1", **_patch_steps(_SPOTS, _WIDE, 0, 0.5)))
def patch_pairs(spark, d):
    """Clusters of touching voxels alone, every voxel with its patch and its place in the flat vector."""
    from ..operators.patches import patches as boxes

    return boxes(_spots(spark, d), _WIDE, gap=0)[1]


@query("local_support_topn", sql("SELECT k, p FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY v DESC, k) AS r, max(v) OVER (PARTITION BY p) AS best FROM coef WHERE v > 0) WHERE r <= 3 AND v >= 0.9 * best AND best >= 0.6 * (SELECT max(v) FROM coef)", "coef"))
def local_support_topn(spark, d):
    return fields.local_support(B.coef(spark, d), 3, 0.9, 0.6)


@query("spatial_moments", sql("SELECT k, w, round(sx / w, 4) AS mx, round(sy / w, 4) AS my, round(sxx / w - sx / w * (sx / w), 4) AS cxx, round(syy / w - sy / w * (sy / w), 4) AS cyy, round(sxy / w - sx / w * (sy / w), 4) + 0.0 AS cxy FROM (SELECT k, sum(v) AS w, sum(v * (p % 16)) AS sx, sum(v * (p // 16)) AS sy, sum(v * (p % 16) * (p % 16)) AS sxx, sum(v * (p // 16) * (p // 16)) AS syy, sum(v * (p % 16) * (p // 16)) AS sxy FROM coef GROUP BY k)", "coef"))
def spatial_moments(spark, d):
    return _out(fields.spatial_moments(B.coef(spark, d), NX), "k", "w", mx="mx", my="my", cxx="cxx", cyy="cyy", cxy="cxy")


@query("density_dominant", sql("SELECT p, sum(v) AS density, (list(k ORDER BY v DESC, k))[1] AS dominant FROM coef GROUP BY p", "coef"))
def density_dominant(spark, d):
    return fields.density(B.coef(spark, d))


@query("line_integral", sql("SELECT k, (p % 16)::INT AS ix, (p // 16)::INT AS iy, sum(v) OVER (PARTITION BY k, p // 16 ORDER BY p % 16 ROWS UNBOUNDED PRECEDING) - v / 2 AS s FROM coef", "coef"))
def line_integral(spark, d):
    image = B.coef(spark, d).selectExpr("k", "cast(p % 16 as int) ix", "cast(p div 16 as int) iy", "v")
    return fields.line_integrals(image)


@query("scramble_eta", sql("SELECT a, y, (((j // 3) + (7 * (a // 5) + 3 * (j % 3)) % 8) % 8 * 3 + j % 3)::INT AS j, b FROM dat", "dat"))
def scramble_eta(spark, d):
    shifts = spark.range(6 * 3).selectExpr("cast(id div 3 as int) block", "cast(id % 3 as int) ch").withColumn("shift", (7 * F.col("block") + 3 * F.col("ch")) % 8)
    return fields.scramble(B.data(spark, d).select("a", "y", "j", "b"), shifts, 8, 3)


@query("beam_blur", sql("SELECT a, (y + o)::INT AS y, j, round(sum(b * w), 4) AS b FROM dat, (VALUES (-1, 0.25), (0, 0.5), (1, 0.25)) t(o, w) WHERE y + o BETWEEN 0 AND 16 GROUP BY 1, 2, 3", "dat"))
def beam_blur(spark, d):
    return _out(projector.beam_blur(B.data(spark, d), {-1: 0.25, 0: 0.5, 1: 0.25}, NS), "a", "y", "j", b="b")
