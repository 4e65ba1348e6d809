"""Queries over iterative solvers: a few iterations, with the same iterations unrolled as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import r4
from ..operators import linop
from ..operators.patches import patches
from ..sources import bindings as B
from ..sources.bindings import NX, NY, sql
from . import solvers
from .catalog_operators import _SPARSE, _noisy, _op, _out, _patch_steps, _radon, _sparse
from .registry import query
from .state import materialise

TAU = 1e-4


def _stored_op(spark):
    """The operator over written weight tables: solvers read them again in every iteration."""
    return linop.tomographic(materialise(_radon(spark)), materialise(B.pf_surrogate(spark)))


def _fwd(x: str, where: str = "", v: str = "v") -> str:
    cond = f"WHERE {where}" if where else ""
    return f"SELECT s.a, s.y, pf.j, sum(s.v * pf.v) AS v FROM (SELECT r.a, r.y, c.k, sum(c.{v} * r.w) AS v FROM {x} c JOIN radon r USING (p) {cond} GROUP BY 1, 2, 3) s JOIN pf ON s.a = pf.a AND s.k = pf.k GROUP BY 1, 2, 3"


def _adj(rows: str, where: str = "", v: str = "v") -> str:
    cond = f"WHERE {where}" if where else ""
    return f"SELECT z.k, r.p, sum(z.v * r.w) AS v FROM (SELECT d.a, d.y, pf.k, sum(d.{v} * pf.v) AS v FROM {rows} d JOIN pf ON d.a = pf.a AND d.j = pf.j {cond} GROUP BY 1, 2, 3) z JOIN radon r ON z.a = r.a AND z.y = r.y GROUP BY 1, 2"


def _fista_sql(n: int, delta: float | None, weighted: bool, lam: float) -> str:
    steps = {"cells": _adj("dat", v="b"), "x0": "SELECT k, p, 0.0::DOUBLE AS v FROM cells", "y0": "SELECT k, p, 0.0::DOUBLE AS v FROM cells"}
    t = 1.0
    for i in range(n):
        w = "CASE WHEN j % 7 = 0 THEN 0.0 ELSE 1.0 END *" if weighted else ""
        r = f"{w} (coalesce(m.v, 0) - coalesce(d.b, 0))"
        r = f"least(greatest({r}, -{delta}), {delta})" if delta is not None else r
        steps[f"m{i}"] = _fwd(f"y{i}")
        steps[f"r{i}"] = f"SELECT a, y, j, {r} AS v FROM m{i} m FULL JOIN dat d USING (a, y, j)"
        steps[f"g{i}"] = _adj(f"r{i}")
        t2 = 0.5 * (1 + (1 + 4 * t * t) ** 0.5)
        beta, t = (t - 1) / t2, t2
        steps[f"x{i + 1}"] = f"SELECT k, p, greatest(y.v - {TAU} * g.v - {TAU * lam}, 0) AS v FROM y{i} y JOIN g{i} g USING (k, p)"
        steps[f"y{i + 1}"] = f"SELECT k, p, n.v + {beta!r} * (n.v - o.v) AS v FROM x{i + 1} n JOIN x{i} o USING (k, p)"
    return sql(f"SELECT k, p, round(v, 4) + 0.0 AS v FROM x{n}", "dat", "radon", "pf", **{k: v for k, v in steps.items()})


@query("fista_l2_3it", _fista_sql(3, None, False, 0.0))
def fista_l2(spark, d):
    return _out(solvers.fista(_stored_op(spark), B.data(spark, d), TAU, 3), "k", "p", v="v")


@query("fista_huber_3it", _fista_sql(3, 40.0, True, 5.0))
def fista_huber(spark, d):
    weights = spark.range(24).selectExpr("cast(id as int) j", "case when id % 7 = 0 then 0.0D else 1.0D end w")
    return _out(solvers.fista(_stored_op(spark), B.data(spark, d), TAU, 3, delta=40.0, weights=weights, lam=5.0), "k", "p", v="v")


@query("fista_blocks_3it", _fista_sql(3, None, False, 0.0))
def fista_blocks(spark, d):
    """The same iterations over the dense-block projection."""
    from .catalog_operators import _blocks

    op = linop.tomographic_blocks(_blocks(spark, NX, 17, block=4), materialise(B.pf_surrogate(spark)))
    return _out(solvers.fista(op, B.data(spark, d), TAU, 3), "k", "p", v="v")


_DUAL = "CASE WHEN w = 0 OR sig = 0 THEN 0 ELSE 0.5 * (vv + w / g - sqrt((vv - w / g) * (vv - w / g) + 4 * sig * (w / g) * b)) END"
_CELLS = "SELECT k::INT AS k, p::INT AS p, 1.0::DOUBLE AS v FROM range(7) a(k), range(256) b(p)"
_ROWS = "SELECT n.a, n.y, n.j, n.b, n.w, n.g, n.bg, CASE WHEN n.w <> 0 AND coalesce(o.v, 0) > 0 THEN 1 / o.v ELSE 0 END AS sig FROM noisy n LEFT JOIN ax1 o USING (a, y, j)"


def _pdhg_sql(n: int, lam: float) -> str:
    steps = {"cells": _CELLS, "ax1": _fwd("cells"), "rws": _ROWS, "cnt": "SELECT a, y, j, 1.0::DOUBLE AS v FROM noisy WHERE w <> 0", "cols": _adj("cnt")}
    steps["stp"] = "SELECT k, p, CASE WHEN coalesce(c.v, 0) > 0 THEN 1 / c.v ELSE 0 END AS t FROM cells LEFT JOIN cols c USING (k, p)"
    steps["p0"] = "SELECT k, p, v AS x, v AS xb FROM cells"
    steps["d0"] = "SELECT a, y, j, 0.0::DOUBLE AS v FROM rws"
    for i in range(n):
        steps[f"f{i}"] = _fwd(f"p{i}", v="xb")
        steps[f"e{i}"] = f"SELECT r.*, q.v + sig * coalesce(f.v, 0) + sig * (bg + 0.001 * g) AS vv FROM rws r JOIN d{i} q USING (a, y, j) LEFT JOIN f{i} f USING (a, y, j)"
        steps[f"d{i + 1}"] = f"SELECT a, y, j, {_DUAL} AS v FROM e{i}"
        steps[f"b{i}"] = _adj(f"d{i + 1}")
        steps[f"p{i + 1}"] = f"SELECT k, p, n AS x, 2 * n - x AS xb FROM (SELECT k, p, x, CASE WHEN t > 0 THEN greatest(0, x - t * (coalesce(b.v, 0) + {lam})) ELSE 0 END AS n FROM p{i} JOIN stp USING (k, p) LEFT JOIN b{i} b USING (k, p))"
    return sql(f"SELECT k, p, round(x, 4) + 0.0 AS v FROM p{n}", "noisy", "radon", "pf", **steps)


def _all_cells(spark):
    return spark.range(7 * NX * NY).selectExpr("cast(id div 256 as int) k", "cast(id % 256 as int) p")


@query("pdhg_2it", _pdhg_sql(2, 0.01))
def pdhg(spark, d):
    x, _ = solvers.pdhg(_stored_op(spark), _noisy(spark, d), 2, _all_cells(spark), lam=0.01)
    return _out(x, "k", "p", v="v")


def _spdhg_sql(order: list[int], subsets: int, lam: float) -> str:
    steps = {"cells": _CELLS, "ax1": _fwd("cells"), "rws": _ROWS, "cnt": "SELECT a, y, j, 1.0::DOUBLE AS v FROM noisy WHERE w <> 0"}
    for m in range(subsets):
        steps[f"c{m}"] = _adj("cnt", f"d.a % {subsets} = {m}")
    union = " UNION ALL ".join(f"SELECT * FROM c{m}" for m in range(subsets))
    steps["stp"] = f"SELECT k, p, CASE WHEN coalesce(c.v, 0) > 0 THEN 1 / ({subsets} * c.v) ELSE 0 END AS t FROM cells LEFT JOIN (SELECT k, p, max(v) AS v FROM ({union}) GROUP BY 1, 2) c USING (k, p)"
    steps["p0"] = "SELECT k, p, t, 1.0::DOUBLE AS x, 0.0::DOUBLE AS z FROM stp"
    steps["d0"] = "SELECT a, y, j, 0.0::DOUBLE AS v FROM rws"
    for i, m in enumerate(order):
        steps[f"f{i}"] = _fwd(f"p{i}", f"r.a % {subsets} = {m}", v="x")
        steps[f"e{i}"] = f"SELECT r.*, q.v AS old, q.v + sig * coalesce(f.v, 0) + sig * (bg + 0.001 * g) AS vv FROM rws r JOIN d{i} q USING (a, y, j) LEFT JOIN f{i} f USING (a, y, j)"
        steps[f"d{i + 1}"] = f"SELECT a, y, j, CASE WHEN a % {subsets} = {m} THEN {_DUAL} ELSE old END AS v, CASE WHEN a % {subsets} = {m} THEN {_DUAL} ELSE old END - old AS dv FROM e{i}"
        steps[f"b{i}"] = _adj(f"d{i + 1}", f"d.a % {subsets} = {m}", v="dv")
        steps[f"p{i + 1}"] = f"SELECT k, p, t, CASE WHEN t > 0 THEN greatest(0, x - t * (z + coalesce(b.v, 0) + {subsets} * coalesce(b.v, 0) + {lam})) ELSE 0 END AS x, z + coalesce(b.v, 0) AS z FROM p{i} LEFT JOIN b{i} b USING (k, p)"
    return sql(f"SELECT k, p, round(x, 4) + 0.0 AS v FROM p{len(order)}", "noisy", "radon", "pf", **steps)


@query("spdhg_1epoch", _spdhg_sql([2, 0, 1], 3, 0.01))
def spdhg(spark, d):
    return _out(solvers.spdhg(_stored_op(spark), _noisy(spark, d), [2, 0, 1], _all_cells(spark), None, 3, lam=0.01), "k", "p", v="v")


def _osem_sql(order: list[int], subsets: int) -> str:
    steps = {"x0": _CELLS}
    for i, m in enumerate(order):
        steps[f"f{i}"] = _fwd(f"x{i}", f"r.a % {subsets} = {m}")
        steps[f"r{i}"] = f"SELECT n.a, n.y, n.j, w / g * b / (greatest(coalesce(f.v, 0), 0) + bg + 0.001 * g) AS q, w / g AS s FROM noisy n LEFT JOIN f{i} f USING (a, y, j) WHERE w <> 0 AND n.a % {subsets} = {m}"
        steps[f"b{i}"] = _adj(f"r{i}", v="q")
        steps[f"s{i}"] = _adj(f"r{i}", v="s")
        steps[f"x{i + 1}"] = f"SELECT k, p, CASE WHEN s.v > 0 THEN x.v * b.v / s.v ELSE x.v END AS v FROM x{i} x LEFT JOIN b{i} b USING (k, p) LEFT JOIN s{i} s USING (k, p)"
    return sql(f"SELECT k, p, round(v, 4) + 0.0 AS v FROM x{len(order)}", "noisy", "radon", "pf", **steps)


@query("osem_1epoch", _osem_sql([1, 2, 0], 3))
def osem(spark, d):
    x0 = _all_cells(spark).withColumn("v", F.lit(1.0))
    return _out(solvers.osem(_stored_op(spark), _noisy(spark, d), [1, 2, 0], x0, 3), "k", "p", v="v")


def _sum_sql(n: int) -> str:
    steps = {"pf2": "SELECT a, k, ((j + 5) % 24)::INT AS j, v / 2 AS v FROM pf", "cu": _adj("dat", v="b"), "cv": _adj("dat", v="b").replace("pf", "pf2")}
    for q in "uv":
        steps[f"x{q}0"] = steps[f"y{q}0"] = f"SELECT k, p, 0.0::DOUBLE AS v FROM c{q}"
    t = 1.0
    for i in range(n):
        steps[f"m{i}"] = f"SELECT a, y, j, sum(v) AS v FROM ({_fwd(f'yu{i}')} UNION ALL {_fwd(f'yv{i}').replace('pf', 'pf2')}) GROUP BY 1, 2, 3"
        steps[f"r{i}"] = f"SELECT a, y, j, d.w * CASE WHEN coalesce(m.v, 0) > d.b THEN 0.5 ELSE 1 END * (coalesce(m.v, 0) - d.b) AS v FROM noisy d LEFT JOIN m{i} m USING (a, y, j)"
        t2 = 0.5 * (1 + (1 + 4 * t * t) ** 0.5)
        beta, t = (t - 1) / t2, t2
        for q, pf, l1 in (("u", "pf", 0.0), ("v", "pf2", 2.0)):
            steps[f"g{q}{i}"] = _adj(f"r{i}").replace("pf", pf)
            steps[f"x{q}{i + 1}"] = f"SELECT k, p, greatest(0, y.v - {TAU} * coalesce(g.v, 0) - {TAU * l1}) AS v FROM y{q}{i} y LEFT JOIN g{q}{i} g USING (k, p)"
            steps[f"y{q}{i + 1}"] = f"SELECT k, p, n.v + {beta!r} * (n.v - o.v) AS v FROM x{q}{i + 1} n JOIN x{q}{i} o USING (k, p)"
    return sql(f"SELECT 'u' AS phase, k, p, round(v, 4) + 0.0 AS v FROM xu{n} UNION ALL SELECT 'v', k, p, round(v, 4) + 0.0 FROM xv{n}", "dat", "noisy", "radon", "pf", **steps)


@query("fista_sum_2it", _sum_sql(2))
def fista_sum(spark, d):
    radon, pf = materialise(_radon(spark)), materialise(B.pf_surrogate(spark))
    other = pf.select("a", "k", ((F.col("j") + 5) % 24).cast("int").alias("j"), (F.col("v") / 2).alias("v"))
    got = solvers.fista_sum({"u": linop.tomographic(radon, pf), "v": linop.tomographic(radon, other)}, _noisy(spark, d), TAU, 2, l1={"v": 2.0}, over_weight=0.5)
    return got["u"].select(F.lit("u").alias("phase"), "k", "p", r4(F.col("v")).alias("v")).union(got["v"].select(F.lit("v").alias("phase"), "k", "p", r4(F.col("v")).alias("v")))


def _poisson_sql(n: int) -> str:
    """Iterations whose first step length is accepted (momentum starts with the second)."""
    steps = {"cells": _CELLS, "rws": "SELECT * FROM noisy WHERE w <> 0", "x0": "SELECT k, p, v FROM cells", "y0": "SELECT k, p, v FROM cells"}
    t = 1.0
    for i in range(n):
        steps[f"m{i}"] = _fwd(f"y{i}")
        steps[f"u{i}"] = f"SELECT d.*, greatest(coalesce(m.v, 0), 0) AS m FROM rws d LEFT JOIN m{i} m USING (a, y, j)"
        steps[f"r{i}"] = f"SELECT a, y, j, w / g * (1 - b / (m + bg + 0.001 * g)) AS v FROM u{i}"
        steps[f"g{i}"] = _adj(f"r{i}")
        if i == 0:
            steps["cu"] = "SELECT a, y, j, m * (w / g * greatest(b, greatest(m + bg, g)) / (greatest(m + bg, g) * greatest(m + bg, g))) AS v FROM u0"
            steps["met"] = _adj("cu")
        t2 = 0.5 * (1 + (1 + 4 * t * t) ** 0.5)
        beta, t = (t - 1) / t2, t2
        steps[f"x{i + 1}"] = f"SELECT k, p, CASE WHEN coalesce(h.v, 0) > 0 THEN greatest(0, y.v - coalesce(g.v, 0) / h.v) ELSE 0 END AS v FROM y{i} y LEFT JOIN g{i} g USING (k, p) LEFT JOIN met h USING (k, p)"
        steps[f"y{i + 1}"] = f"SELECT k, p, n.v + {beta!r} * (n.v - o.v) AS v FROM x{i + 1} n JOIN x{i} o USING (k, p)"
    return sql(f"SELECT k, p, round(v, 4) + 0.0 AS v FROM x{n}", "noisy", "radon", "pf", **steps)


@query("fista_poisson_2it", _poisson_sql(2))
def fista_poisson(spark, d):
    x0 = _all_cells(spark).withColumn("v", F.lit(1.0))
    x, _ = solvers.fista_poisson(_stored_op(spark), _noisy(spark, d), x0, 2)
    return _out(x, "k", "p", v="v")


def _power_sql(n: int) -> str:
    steps = {"x0": "SELECT k::INT AS k, p::INT AS p, 1.0::DOUBLE + (k + p) % 3 AS v FROM range(7) a(k), range(256) b(p)"}
    for i in range(n):
        steps[f"n{i}"] = f"SELECT k, p, v / (SELECT sqrt(sum(v * v)) FROM x{i}) AS v FROM x{i}"
        steps[f"f{i}"] = _fwd(f"n{i}")
        steps[f"x{i + 1}"] = _adj(f"f{i}")
    rows = " UNION ALL ".join(f"SELECT {i + 1} AS round_no, round((SELECT sum(n.v * x.v) FROM n{i} n JOIN x{i + 1} x USING (k, p)), 4) AS l" for i in range(n))
    return sql(rows, "radon", "pf", **steps)


@query("power_iteration_3", _power_sql(3))
def power_iteration(spark, d):
    x0 = _all_cells(spark).withColumn("v", 1.0 + (F.col("k") + F.col("p")) % 3)
    found = linop.power_iteration(_stored_op(spark), x0, ("k", "p"), 3)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(found)], "round_no int, l double").select("round_no", r4(F.col("l")).alias("l"))


@query("score_test", sql("SELECT k, p, round(CASE WHEN dd > 0 THEN ee / sqrt(dd) ELSE 0 END, 4) + 0.0 AS z FROM (SELECT e.k, e.p, e.v AS ee, d.v AS dd FROM be e JOIN bd d USING (k, p))", "noisy", "radon", "pf", inp="SELECT a, y, j, CASE WHEN w > 0 THEN w / g * (b / m - 1) ELSE 0 END AS e, CASE WHEN w > 0 THEN w / (g * m) ELSE 0 END AS d FROM (SELECT *, greatest(greatest(mu, 0), 0.25 * g) AS m FROM noisy)", be=_adj("inp", v="e"), bd=_adj("inp", v="d")))
def score_test(spark, d):
    from ..operators import search, terms

    inputs = terms.score_inputs(_noisy(spark, d)).withColumn("input", F.lit("real"))
    return _out(search.score(_op(spark), inputs), "k", "p", z="z")


def _fit_sql(rounds: int) -> str:
    """The alternating fit unrolled: one table a block, scales per angle, translation and ring and a background per segment."""
    keys = {"a": "a", "y": "y", "r": "(j % 3)", "bg": "j"}
    steps = {"a_0": "SELECT DISTINCT a AS i, 1.0::DOUBLE AS s FROM noisy", "y_0": "SELECT DISTINCT y AS i, 1.0::DOUBLE AS s FROM noisy", "r_0": "SELECT DISTINCT j % 3 AS i, 1.0::DOUBLE AS s FROM noisy", "bg_0": "SELECT DISTINCT j AS i, 0.0::DOUBLE AS s FROM noisy"}
    now = {n: f"{n}_0" for n in keys}
    for turn in range(rounds):
        for n in keys:
            joins = " ".join(f"JOIN {now[m]} t{m} ON t{m}.i = {'d.' + k if k != '(j % 3)' else 'd.j % 3'}" for m, k in keys.items())
            own = keys[n] if n == "r" else f"d.{keys[n]}"
            if n == "bg":
                text = f"SELECT {own} AS i, sum(w * (b - mu * ta.s * ty.s * tr.s)) / sum(w) AS s FROM noisy d {joins} GROUP BY 1"
            else:
                model = " * ".join(["mu", *[f"t{m}.s" for m in ("a", "y", "r") if m != n]])
                text = f"SELECT {own.replace('j', 'd.j') if n == 'r' else own} AS i, CASE WHEN sum(w * {model} * {model}) > 0 THEN sum(w * {model} * (b - tbg.s)) / sum(w * {model} * {model}) ELSE max(t{n}.s) END AS s FROM noisy d {joins} GROUP BY 1"
            steps[f"{n}_{turn}f"] = text.replace("sum(w)", "greatest(sum(w), 1e-300)")
            now[n] = f"{n}_{turn}f"
        level = f"(SELECT avg(s) FROM a_{turn}f) * (SELECT avg(s) FROM y_{turn}f)"
        for n in ("a", "y"):
            steps[f"{n}_{turn}n"] = f"SELECT i, s / (SELECT avg(s) FROM {n}_{turn}f) AS s FROM {n}_{turn}f"
        steps[f"r_{turn}n"] = f"SELECT i, s * {level} AS s FROM r_{turn}f"
        now |= {n: f"{n}_{turn}n" for n in ("a", "y", "r")}
    return sql(" UNION ALL ".join(f"SELECT '{n}' AS axis, i::INT AS i, round(s, 4) + 0.0 AS s FROM {now[n]}" for n in keys), "noisy", **steps)


@query("fit_linear_2it", _fit_sql(2))
def fit_linear(spark, d):
    from ..operators import terms

    return _out(terms.fit_linear(_noisy(spark, d), 2, background=True), "axis", "i", s="s")


_START = {"cells": _CELLS, "one": _fwd("cells"), "rws": "SELECT n.*, coalesce(o.v, 0) AS ones FROM noisy n LEFT JOIN one o USING (a, y, j) WHERE w <> 0"}


@query("poisson_start_uniform", sql("SELECT round(sum(w / g * b) / sum(w / g * ones), 6) AS v, 1792 AS n FROM rws", "noisy", "radon", "pf", **_START))
def poisson_start_uniform(spark, d):
    got = solvers.poisson_start(_stored_op(spark), _noisy(spark, d), _all_cells(spark), "uniform")
    return got.agg(r4(F.max("v"), 6).alias("v"), F.count("*").cast("int").alias("n"))


def _wls_sql(n: int, lam: float) -> str:
    weight = "w / (g * greatest(b, g))"
    steps = dict(_START) | {"mw": f"SELECT a, y, j, {weight} * ones AS v FROM rws", "met": _adj("mw"), "x0": "SELECT k, p, 0.0::DOUBLE AS v FROM cells", "y0": "SELECT k, p, 0.0::DOUBLE AS v FROM cells"}
    t = 1.0
    for i in range(n):
        steps[f"m{i}"] = _fwd(f"y{i}")
        steps[f"r{i}"] = f"SELECT d.a, d.y, d.j, {weight} * (coalesce(m.v, 0) + bg - b) AS v FROM rws d LEFT JOIN m{i} m USING (a, y, j)"
        steps[f"g{i}"] = _adj(f"r{i}")
        t2 = 0.5 * (1 + (1 + 4 * t * t) ** 0.5)
        beta, t = (t - 1) / t2, t2
        steps[f"x{i + 1}"] = f"SELECT k, p, CASE WHEN coalesce(h.v, 0) > 0 THEN greatest(0, y.v - (coalesce(g.v, 0) + {lam}) / h.v) ELSE 0 END AS v FROM y{i} y LEFT JOIN g{i} g USING (k, p) LEFT JOIN met h USING (k, p)"
        steps[f"y{i + 1}"] = f"SELECT k, p, n.v + {beta!r} * (n.v - o.v) AS v FROM x{i + 1} n JOIN x{i} o USING (k, p)"
    return sql(f"SELECT k, p, round(v, 4) + 0.0 AS v FROM x{n}", "noisy", "radon", "pf", **steps)


@query("poisson_start_wls", _wls_sql(3, 0.01))
def poisson_start_wls(spark, d):
    return _out(solvers.poisson_start(_stored_op(spark), _noisy(spark, d), _all_cells(spark), "wls", 3, 0.01), "k", "p", v="v")


@query("resumed_solvers", "SELECT * FROM (VALUES ('fista', true), ('fista_poisson', true), ('pdhg', true), ('spdhg', true)) t(solver, same)")
def resumed_solvers(spark, d):
    """Two iterations and two more give what four in one go give."""
    op, data, cells = _stored_op(spark), _noisy(spark, d), _all_cells(spark)
    ones = cells.select("k", "p", F.lit(1.0).alias("v"))

    def same(x, y) -> bool:
        worst = x.withColumnRenamed("v", "x").join(y, ["k", "p"], "full").agg(F.max(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))) / (1 + F.abs(F.coalesce("v", F.lit(0.0))))))
        return worst.first()[0] < 1e-9

    whole = solvers.fista(op, data, TAU, 2)
    _, state = solvers.fista(op, data, TAU, 1, resumable=True)
    found = [("fista", same(solvers.fista(op, data, TAU, 1, state=state), whole))]
    whole, _ = solvers.fista_poisson(op, data, ones, 2)
    _, _, state = solvers.fista_poisson(op, data, ones, 1, resumable=True)
    found.append(("fista_poisson", same(solvers.fista_poisson(op, data, ones, 1, state=state)[0], whole)))
    whole, _ = solvers.pdhg(op, data, 2, cells)
    _, state = solvers.pdhg(op, data, 1, cells)
    found.append(("pdhg", same(solvers.pdhg(op, data, 1, cells, state=state)[0], whole)))
    whole = solvers.spdhg(op, data, [1, 0], cells, None, 2)
    _, state = solvers.spdhg(op, data, [1], cells, None, 2, resumable=True)
    found.append(("spdhg", same(solvers.spdhg(op, data, [0], cells, None, 2, state=state), whole)))
    return spark.createDataFrame(found, "solver string, same boolean")


def _tv_sql(order: list[int | str], subsets: int, tv: float, cells: str = _CELLS, levels: tuple[tuple[str, float], ...] = (), leaf_edge: float = 1.0, **more: str) -> str:
    """The stochastic epoch with total-variation blocks, unrolled: tables p (state), d (duals) and q (edges).

    ``cells`` may have a patch; ``levels``: the node of an orientation k as an expression, and its edge.
    """
    p_tv = 1 / (subsets + 1)
    share, own = (1 - p_tv) / subsets, p_tv / (1 + len(levels))
    patch = "patch" in cells
    steps = more | {"cells": cells, "ax1": _fwd("cells"), "rws": _ROWS, "cnt": "SELECT a, y, j, 1.0::DOUBLE AS v FROM noisy WHERE w <> 0"}
    for m in range(subsets):
        steps[f"c{m}"] = _adj("cnt", f"d.a % {subsets} = {m}")
    union = " UNION ALL ".join(f"SELECT * FROM c{m}" for m in range(subsets))
    steps["p0"] = f"SELECT k, p, CASE WHEN coalesce(c.v, 0) > 0 THEN {share} / c.v ELSE 0 END AS t, 1.0::DOUBLE AS x, 0.0::DOUBLE AS z FROM cells LEFT JOIN (SELECT k, p, max(v) AS v FROM ({union}) GROUP BY 1, 2) c USING (k, p)"
    steps["d0"] = "SELECT a, y, j, 0.0::DOUBLE AS v FROM rws"
    duals, edges = "d0", [""] * (1 + len(levels))

    def block(name: str, free: str, lam: float, level: int, same: str) -> None:
        before = edges[level] or f"(SELECT k, p, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy FROM f{name})"
        steps[f"f{name}"] = free
        steps[f"n{name}"] = (
            f"SELECT c.k, c.p, c.x, coalesce(q.qx, 0) AS qx, coalesce(q.qy, 0) AS qy, r.x AS xr, b.x AS xd, greatest(coalesce(c.t + r.t, 0), coalesce(c.t + b.t, 0)) AS top FROM f{name} c LEFT JOIN f{name} r ON r.k = c.k AND r.p = c.p + 1 AND r.p % {NX} > 0 {same.format('r')} "
            f"LEFT JOIN f{name} b ON b.k = c.k AND b.p = c.p + {NX} {same.format('b')} LEFT JOIN {before} q ON q.k = c.k AND q.p = c.p"
        )
        steps[f"s{name}"] = f"SELECT *, CASE WHEN xr IS NULL THEN 0 ELSE qx + st * (xr - x) END AS ax, CASE WHEN xd IS NULL THEN 0 ELSE qy + st * (xd - x) END AS ay FROM (SELECT *, CASE WHEN top > 0 THEN {0.99 * own / 4} / top ELSE 0 END AS st FROM n{name})"
        steps[f"v{name}"] = f"SELECT k, p, qx, qy, ax / sz AS nx, ay / sz AS ny FROM (SELECT *, greatest(1, sqrt(ax * ax + ay * ay) / {lam}) AS sz FROM s{name})"
        steps[f"q{name}"] = f"SELECT k, p, nx AS qx, ny AS qy FROM v{name}"
        steps[f"b{name}"] = f"SELECT k, p, sum(v) AS v FROM (SELECT k, p, qx - nx + qy - ny AS v FROM v{name} UNION ALL SELECT k, p + 1, nx - qx FROM v{name} UNION ALL SELECT k, p + {NX}, ny - qy FROM v{name}) WHERE v <> 0 GROUP BY 1, 2"
        edges[level] = f"q{name}"

    for i, m in enumerate(order):
        if m == "tv":
            block(f"{i}_0", f"SELECT * FROM p{i} JOIN cells USING (k, p) WHERE t > 0", tv * leaf_edge, 0, "AND {}.patch = c.patch" if patch else "")
            parts = [f"SELECT k, p, v FROM b{i}_0"]
            for n, (node, edge) in enumerate(levels, 1):
                block(f"{i}_{n}", f"SELECT * FROM (SELECT {node} AS k, p, sum(t) AS t, sum(x) AS x FROM p{i} GROUP BY 1, 2) WHERE t > 0", tv * edge, n, "")
                parts.append(f"SELECT c.k, c.p, b.v FROM cells c JOIN b{i}_{n} b ON b.k = {node.replace('k', 'c.k')} AND b.p = c.p")
            steps[f"b{i}"] = f"SELECT k, p, sum(v) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"
            factor = 1 / p_tv
        else:
            steps[f"f{i}"] = _fwd(f"p{i}", f"r.a % {subsets} = {m}", v="x")
            steps[f"e{i}"] = f"SELECT r.*, q.v AS old, q.v + sig * coalesce(f.v, 0) + sig * (bg + 0.001 * g) AS vv FROM rws r JOIN {duals} q USING (a, y, j) LEFT JOIN f{i} f USING (a, y, j)"
            steps[f"d{i + 1}"] = f"SELECT a, y, j, CASE WHEN a % {subsets} = {m} THEN {_DUAL} ELSE old END AS v, CASE WHEN a % {subsets} = {m} THEN {_DUAL} ELSE old END - old AS dv FROM e{i}"
            steps[f"b{i}"] = _adj(f"d{i + 1}", f"d.a % {subsets} = {m}", v="dv")
            duals, factor = f"d{i + 1}", 1 / share
        steps[f"p{i + 1}"] = f"SELECT k, p, t, CASE WHEN t > 0 THEN greatest(0, x - t * (z + coalesce(b.v, 0) + {factor} * coalesce(b.v, 0))) ELSE 0 END AS x, z + coalesce(b.v, 0) AS z FROM p{i} LEFT JOIN b{i} b USING (k, p)"
    return sql(f"SELECT k, p, round(x, 4) + 0.0 AS v FROM p{len(order)}", "noisy", "radon", "pf", **steps)


@query("spdhg_tv_epoch", _tv_sql([1, "tv", 0, 2, "tv"], 3, 0.5))
def spdhg_tv(spark, d):
    got = solvers.spdhg_tv(_stored_op(spark), _noisy(spark, d), [1, "tv", 0, 2, "tv"], _all_cells(spark), 3, NX, NY, 0.5)
    return _out(got, "k", "p", v="v")


_TREE = [1, "tv", 0, 2, "tv"]
_BOXES = _patch_steps(_SPARSE, NX, 0, 0.5)


@query("spdhg_tree_tv", _tv_sql(_TREE, 3, 0.5, "SELECT s.k, s.p, 1.0::DOUBLE AS v, patch FROM s JOIN patch ON s.k = patch.k AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1", (("(k // 2)", 0.7), ("(k * 0)", 0.3)), 0.4, **_BOXES))
def spdhg_tree_tv(spark, d):
    """Support in patches, orientations in a tree of two levels: differences within patches and of nodes' sums."""
    pair = materialise(patches(_sparse(spark, d), NX, gap=0)[1])
    of = pair.select("k").distinct()
    levels = [(of.selectExpr("k", "cast(floor(k / 2) as int) node"), 0.7), (of.selectExpr("k", "0 node"), 0.3)]
    got = solvers.spdhg_tv(_stored_op(spark), _noisy(spark, d), _TREE, pair.select("k", "p", "patch"), 3, NX, NY, 0.5, levels=levels, leaf_edge=0.4)
    return _out(got, "k", "p", v="v")
