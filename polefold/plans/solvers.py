"""Iterative solvers: a driver loop of plans over state tables in shared storage.

An operator is any object with forward(df) and adjoint(df) on (k, p, v) and (a, y, j, v). Scalars of
an iteration come from one aggregate. A callback(iteration, x, stats) that returns true stops a run.
Tables of an iteration are deleted once the one after it is written; what a callback is given is
valid while it runs. With ``resumable`` a solver also returns its state, a dict of tables and numbers
that it takes back as ``state`` and goes on from as if it had never stopped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..operators import terms
from .state import discard, materialise

D, X = ["a", "y", "j"], ["k", "p"]
MAX_BACKTRACKS = 60


def combine(keys: list[str], **tables: DataFrame) -> DataFrame:
    """Sparse vectors side by side (absent entries 0), by one union and one aggregate."""
    parts = []
    for name, df in tables.items():
        parts.append(df.select(*keys, *[(F.col("v") if n == name else F.lit(0.0)).alias(n) for n in tables]))
    union = reduce(DataFrame.unionByName, parts)
    return union.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in tables])


def _stop(callback: Callable | None, it: int, x: DataFrame, stats: dict) -> bool:
    return bool(callback and callback(it, x, stats))


def fista(op, data: DataFrame, tau: float, niter: int, x0: DataFrame | None = None, delta: float | None = None, weights: DataFrame | None = None, lam: float = 0.0, support: DataFrame | None = None, callback: Callable | None = None, state: dict | None = None, resumable: bool = False):
    """Accelerated proximal gradient for least squares, or the clipped (Huber) residual; x >= 0."""
    b = data.select(*D, F.col("b").alias("v"))
    if state is not None:
        x, y, t = state["x"], state["y"], state["t"]
    else:
        x = y = materialise(x0 if x0 is not None else op.adjoint(b).select(*X, F.lit(0.0).alias("v")))
        t = 1.0
    old = None
    for it in range(niter):
        both = combine(D, m=op.forward(y), b=b)
        if weights is not None:
            both = both.join(weights, [c for c in weights.columns if c in D], "left")
        r = (F.coalesce("w", F.lit(1.0)) if weights is not None else F.lit(1.0)) * (F.col("m") - F.col("b"))
        r = clip(r, -delta, delta) if delta is not None else r
        grad = op.adjoint(both.select(*D, r.alias("v")))
        t_new = 0.5 * (1 + math.sqrt(1 + 4 * t * t))
        beta = (t - 1) / t_new
        cells = combine(X, x=x, y=y, grad=grad)
        new = F.greatest(F.col("y") - tau * F.col("grad") - tau * lam, F.lit(0.0))
        moved = cells.select(*X, "x", new.alias("n"))
        if support is not None:
            moved = moved.join(support, [c for c in X if c in support.columns], "left_semi")
        moved = materialise(moved)
        discard(old)
        old = moved
        x = moved.select(*X, F.col("n").alias("v"))
        y = moved.select(*X, (F.col("n") + beta * (F.col("n") - F.col("x"))).alias("v"))
        t = t_new
        if _stop(callback, it + 1, x, {"iter": it + 1}):
            break
    return (x, {"x": x, "y": y, "t": t}) if resumable else x


def _noise(data: DataFrame) -> DataFrame:
    return data.select(*D, "b", "w", "g", "bg")


def _dual(y: Column, sig: Column, ax: Column) -> Column:
    s = F.col("w") / F.col("g")
    r = F.col("bg") + terms.EPS * F.col("g")
    v = y + sig * ax + sig * r
    root = 0.5 * (v + s - F.sqrt((v - s) * (v - s) + 4 * sig * s * F.col("b")))
    return F.when((F.col("w") == 0) | (sig == 0), F.lit(0.0)).otherwise(root)


def _on(data: DataFrame, **vectors: DataFrame) -> DataFrame:
    """``data`` with vectors of the same keys as columns; absent entries are 0."""
    for name, df in vectors.items():
        data = data.join(df.select(*D, F.col("v").alias(name)), D, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return data


def pdhg(op, data: DataFrame, niter: int, cells: DataFrame, lam: float = 0.0, tau0: float = 1.0, sigma0: float = 1.0, state: dict | None = None, callback: Callable | None = None) -> tuple[DataFrame, dict]:
    """Primal-dual iterations for the Poisson deviance with diagonal steps. ``cells``: allowed (k, p)."""
    ones = cells.select(*X, F.lit(1.0).alias("v"))
    d = _noise(data)
    rows = _on(d, s=op.forward(ones))
    rows = materialise(rows.withColumn("sig", F.when((F.col("w") != 0) & (F.col("s") > 0), sigma0 / F.col("s")).otherwise(0.0)).drop("s"))
    cols = op.adjoint(d.where("w <> 0").select(*D, F.lit(1.0).alias("v")))
    steps = materialise(cells.join(cols, X, "left").select(*X, F.when(F.col("v") > 0, tau0 / F.col("v")).otherwise(0.0).alias("t")))
    prim = materialise(state["primal"] if state else ones.select(*X, F.col("v").alias("x"), F.col("v").alias("xb")))
    dual = state["dual"] if state else rows.select(*D, F.lit(0.0).alias("v"))
    for it in range(niter):
        ax = op.forward(prim.select(*X, F.col("xb").alias("v")))
        before, old = dual, prim
        dual = materialise(_on(rows, yd=dual, ax=ax).select(*D, _dual(F.col("yd"), F.col("sig"), F.col("ax")).alias("v")))
        grad = op.adjoint(dual).withColumnRenamed("v", "grad")
        both = prim.join(steps, X).join(grad, X, "left")
        new = F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.col("x") - F.col("t") * (F.coalesce("grad", F.lit(0.0)) + lam))).otherwise(0.0)
        prim = materialise(both.withColumn("n", new).select(*X, F.col("n").alias("x"), (2 * F.col("n") - F.col("x")).alias("xb")))
        discard(before, old)
        if _stop(callback, it + 1, prim, {"iter": it + 1}):
            break
    return prim.select(*X, F.col("x").alias("v")), {"primal": prim, "dual": dual}


def spdhg(op, data: DataFrame, order: list[int], cells: DataFrame, subset_of: Callable[[str], Column] | None, subsets: int, lam: float = 0.0, tau0: float = 1.0, sigma0: float = 1.0, callback: Callable | None = None, state: dict | None = None, resumable: bool = False):
    """One subset of angles a step, in the given order; z holds A^T y. ``subset_of``: condition text -> restricted operator.

    Rows and duals are one table a subset, so a step reads and writes its own subset alone.
    """
    ones = cells.select(*X, F.lit(1.0).alias("v"))
    d = _noise(data)
    chosen = [op.restrict(f"a % {subsets} = {m}") for m in range(subsets)]
    sums, rows = None, {}
    for m in range(subsets):
        own = d.where(f"a % {subsets} = {m}")
        found = _on(own, s=chosen[m].forward(ones)).withColumn("sig", F.when((F.col("w") != 0) & (F.col("s") > 0), sigma0 / F.col("s")).otherwise(0.0)).drop("s")
        rows[m] = materialise(found)
        part = chosen[m].adjoint(own.where("w <> 0").select(*D, F.lit(1.0).alias("v"))).select(*X, F.col("v").alias("c"))
        sums = part if sums is None else sums.unionByName(part)
    if state is not None:
        prim, dual = state["primal"], {m: state[f"dual{m}"] for m in range(subsets)}
    else:
        steps = sums.groupBy(*X).agg(F.max("c").alias("c"))
        size = F.when(F.col("c") > 0, tau0 / (subsets * F.col("c"))).otherwise(0.0)
        prim = materialise(cells.join(steps, X, "left").select(*X, size.alias("t"), F.lit(1.0).alias("x"), F.lit(0.0).alias("z")))
        dual = {m: materialise(rows[m].select(*D, F.lit(0.0).alias("v"))) for m in range(subsets)}
    for step, m in enumerate(order):
        ax = chosen[m].forward(prim.select(*X, F.col("x").alias("v")))
        old, before = dual[m], prim
        moved = materialise(_on(rows[m], yd=dual[m], ax=ax).select(*D, F.col("yd"), _dual(F.col("yd"), F.col("sig"), F.col("ax")).alias("v")))
        dz = chosen[m].adjoint(moved.select(*D, (F.col("v") - F.col("yd")).alias("v"))).withColumnRenamed("v", "dz")
        dual[m] = moved
        both = prim.join(dz, X, "left").withColumn("dz", F.coalesce("dz", F.lit(0.0)))
        z = F.col("z") + F.col("dz")
        new = F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.col("x") - F.col("t") * (z + subsets * F.col("dz") + lam))).otherwise(0.0)
        prim = materialise(both.select(*X, "t", new.alias("x"), z.alias("z")))
        discard(old, before)
        if _stop(callback, step + 1, prim, {"step": step + 1}):
            break
    x = prim.select(*X, F.col("x").alias("v"))
    return (x, {"primal": prim} | {f"dual{m}": df for m, df in dual.items()}) if resumable else x


def random_order(subsets: int, epochs: int, seed: int) -> list[int]:
    """Permutations of the subsets, none beginning with the one that the last ended with."""
    import random

    rng, order = random.Random(seed), []
    for _ in range(epochs):
        while True:
            turn = rng.sample(range(subsets), subsets)
            if not order or subsets < 2 or turn[0] != order[-1]:
                break
        order += turn
    return order


def osem(op, data: DataFrame, order: list[int], x0: DataFrame, subsets: int, lam: float = 0.0, callback: Callable | None = None) -> DataFrame:
    """Multiplicative updates x * A^T(ratio) / (A^T(w/g) + lam), one subset of angles at a time."""
    d = _noise(data)
    x = materialise(x0)
    for step, m in enumerate(order):
        chosen = op.restrict(f"a % {subsets} = {m}") if subsets > 1 else op
        part = _on(d.where(f"a % {subsets} = {m} and w <> 0"), mu=chosen.forward(x))
        wg = F.col("w") / F.col("g")
        ratio = wg * F.col("b") / terms.expected(F.col("mu"), F.col("bg"), F.col("g"))
        both = part.select(*D, ratio.alias("r"), wg.alias("s"))
        back = chosen.adjoint(both.select(*D, F.col("r").alias("v"))).withColumnRenamed("v", "back")
        sens = chosen.adjoint(both.select(*D, F.col("s").alias("v"))).withColumnRenamed("v", "sens")
        cur = x.join(back, X, "left").join(sens, X, "left")
        old = x
        x = materialise(cur.select(*X, F.when(F.col("sens") > 0, F.col("v") * F.col("back") / (F.col("sens") + lam)).otherwise(F.col("v")).alias("v")))
        discard(old)
        if _stop(callback, step + 1, x, {"step": step + 1}):
            break
    return x


def start_floor(x0: DataFrame, share: float = 0.01) -> DataFrame:
    """Every allowed coefficient at least ``share`` of the (approximate) median of the positive ones."""
    floor = x0.where("v > 0").agg((share * F.percentile_approx("v", 0.5, 10_000)).alias("floor"))
    return x0.crossJoin(F.broadcast(floor)).select(*X, F.greatest("v", F.coalesce("floor", F.lit(0.0))).alias("v"))


def poisson_start(op, data: DataFrame, cells: DataFrame, kind: str = "wls", n: int = 20, lam: float = 0.0, floor: float = 1.0) -> DataFrame:
    """A start for the Poisson deviance, which has its barrier at zero, on the allowed ``cells`` (k, p).

    "uniform": one value everywhere, with the data's weighted total. "wls": n accelerated steps from
    zero on the quadratic approximation of the deviance at the data, in the metric A^T W A 1.
    """
    d = _noise(data).where("w <> 0")
    ones = materialise(_on(d, one=op.forward(cells.select(*X, F.lit(1.0).alias("v")))))
    if kind == "uniform":
        wg = F.col("w") / F.col("g")
        value = F.sum(wg * F.col("b")) / F.sum(wg * F.col("one"))
        return cells.crossJoin(F.broadcast(ones.agg(F.coalesce(value, F.lit(0.0)).alias("v")))).select(*X, "v")
    if kind != "wls":
        raise ValueError("a start is wls or uniform")
    weight = F.col("w") / (F.col("g") * F.greatest(F.col("b"), F.col("g") * floor))
    metric = materialise(op.adjoint(ones.select(*D, (weight * F.col("one")).alias("v"))))
    x = y = cells.select(*X, F.lit(0.0).alias("v"))
    t, old = 1.0, None
    for _ in range(n):
        grad = op.adjoint(_on(d, m=op.forward(y)).select(*D, (weight * (F.col("m") + F.col("bg") - F.col("b"))).alias("v")))
        t_new = 0.5 * (1 + math.sqrt(1 + 4 * t * t))
        beta, t = (t - 1) / t_new, t_new
        new = F.when(F.col("h") > 0, F.greatest(F.lit(0.0), F.col("y") - (F.col("g") + lam) / F.col("h"))).otherwise(0.0)
        moved = materialise(combine(X, x=x, y=y, g=grad, h=metric).join(cells.select(*X), X, "left_semi").select(*X, "x", new.alias("n")))
        discard(old)
        old = moved
        x = moved.select(*X, F.col("n").alias("v"))
        y = moved.select(*X, (F.col("n") + beta * (F.col("n") - F.col("x"))).alias("v"))
    return x


def fista_poisson(
    op, data: DataFrame, x0: DataFrame, niter: int, lam: float = 0.0, floor: float = 1.0, refresh: int = 10, rho0: float = 1.0, callback: Callable | None = None, start: str = "x0", n_start: int = 20, state: dict | None = None, resumable: bool = False
):
    """Poisson deviance in a diagonal metric: descent-lemma backtracking, metric refresh, function restart.

    ``start``: "x0" as given, or "wls" or "uniform" on its cells. Returns x and one dict an iteration.
    An iteration without an acceptable step among ``MAX_BACKTRACKS`` is an error.
    """
    d = _noise(data).where("w <> 0")

    def value_grad(y: DataFrame) -> tuple[float, DataFrame]:
        rows = materialise(_on(d, mu=op.forward(y)))
        f = rows.agg(F.sum(terms.deviance_term(*[F.col(c) for c in ("b", "mu", "w", "g", "bg")]))).first()[0]
        wg = F.col("w") / F.col("g")
        return f, rows.withColumn("gr", wg * (1 - F.col("b") / terms.expected(F.col("mu"), F.col("bg"), F.col("g"))))

    if state is not None:
        x, y, metric = state["x"], state["y"], state["metric"]
        t, rho, last, done = (state[n] for n in ("t", "rho", "last", "it"))
    else:
        x = y = materialise(x0 if start == "x0" else poisson_start(op, data, x0.select(*X), start, n_start, lam, floor))
        t, rho, last, done, metric = 1.0, rho0, math.inf, 0, None
    stats, old = [], None
    for it in range(done, done + niter):
        f_y, rows = value_grad(y)
        grad = op.adjoint(rows.select(*D, F.col("gr").alias("v")))
        if it % refresh == 0 or metric is None:
            ones = op.forward(x.select(*X, F.lit(1.0).alias("v")))
            metric = materialise(op.adjoint(_on(rows, one=ones).select(*D, (F.col("one") * terms.curvature(rows, floor)).alias("v"))))
        for _ in range(MAX_BACKTRACKS):
            cells = combine(X, x=x, y=y, g=grad, h=metric)
            new = F.when(F.col("h") > 0, F.greatest(F.lit(0.0), F.col("y") - (F.col("g") + lam) / (rho * F.col("h")))).otherwise(0.0)
            moved = materialise(cells.withColumn("n", new))
            step = F.col("n") - F.col("y")
            lin, quad, l1 = moved.agg(F.sum(F.col("g") * step), F.sum(F.col("h") * step * step), F.sum("n")).first()
            f_new, tried = value_grad(moved.select(*X, F.col("n").alias("v")))
            discard(tried)
            if f_new <= f_y + lin + 0.5 * rho * quad + 1e-9 * abs(f_y):
                break
            discard(moved)
            rho *= 2
        else:
            raise ArithmeticError(f"iteration {it + 1}: no step length lowers the deviance")
        discard(old)
        old = moved
        obj = f_new + lam * l1
        if obj > last:
            t = 1.0
        last = obj
        t_new = 0.5 * (1 + math.sqrt(1 + 4 * t * t))
        beta, t = (t - 1) / t_new, t_new
        x = moved.select(*X, F.col("n").alias("v"))
        y = moved.select(*X, (F.col("n") + beta * (F.col("n") - F.col("x"))).alias("v"))
        stats.append({"iter": it + 1, "f": f_new, "rho": rho})
        if _stop(callback, it + 1, x, stats[-1]):
            break
    if resumable:
        return x, stats, {"x": x, "y": y, "metric": metric, "t": t, "rho": rho, "last": last, "it": done + len(stats)}
    return x, stats


def fista_sum(ops: dict[str, object], data: DataFrame, tau: float, niter: int, l1: dict[str, float] | None = None, volume: dict[str, float] | None = None, volume_weight: float = 0.0, log_scale: float | None = None, over_weight: float = 1.0, delta: float | None = None, offset: DataFrame | None = None) -> dict[str, DataFrame]:
    """One data term, several operators with their own coefficients: A = [A_1 ... A_P]. ``data``: b, w."""
    b = data.select(*D, "b", "w")
    xs = {n: materialise(op.adjoint(b.select(*D, F.col("b").alias("v"))).select(*X, F.lit(0.0).alias("v"))) for n, op in ops.items()}
    ys, t = dict(xs), 1.0
    for _ in range(niter):
        u = reduce(DataFrame.unionByName, [op.forward(ys[n]).select(*D, "v") for n, op in ops.items()] + ([offset] if offset is not None else []))
        rows = _on(b, u=u.groupBy(*D).agg(F.sum("v").alias("v")))
        if log_scale is None:
            r = F.col("u") - F.col("b")
            w = F.col("w") * F.when(r > 0, over_weight).otherwise(1.0)
            g = w * (clip(r, -delta, delta) if delta is not None else r)
        else:
            q = F.col("u") / log_scale
            g = F.col("w") * (log_scale * F.asinh(q) - log_scale * F.asinh(F.col("b") / log_scale)) / F.sqrt(1 + q * q)
        g = materialise(rows.select(*D, g.alias("v")))
        extra = dict.fromkeys(ops, 0.0)
        if volume and volume_weight:
            total = {n: ys[n].agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0] for n in ops}
            on = sum(total[n] for n in volume)
            e = {n: total[n] - volume[n] * on for n in volume}
            mean = sum(volume[n] * e[n] for n in volume)
            extra |= {n: volume_weight * (e[n] - mean) for n in volume}
        t_new = 0.5 * (1 + math.sqrt(1 + 4 * t * t))
        beta, t = (t - 1) / t_new, t_new
        for n, op in ops.items():
            cells = combine(X, x=xs[n], y=ys[n], g=op.adjoint(g))
            new = F.greatest(F.lit(0.0), F.col("y") - tau * F.col("g") - tau * (extra[n] + (l1 or {}).get(n, 0.0)))
            state = materialise(cells.select(*X, "x", new.alias("n")))
            xs[n] = state.select(*X, F.col("n").alias("v"))
            ys[n] = state.select(*X, (F.col("n") + beta * (F.col("n") - F.col("x"))).alias("v"))
    return xs


def tv_step(state: DataFrame, dual: DataFrame, nx: int, ny: int, lam: float, p_tv: float) -> tuple[DataFrame, DataFrame]:
    """One total-variation block: the dual (qx, qy) of every pixel and dz(k, p, v), its change carried back.

    Differences exist where both pixels are free (t > 0) and, if ``state`` has the column patch, of one patch;
    the dual step of a pixel follows from the largest of its differences' summed primal steps. Neighbours come
    by a shifted self-join on (k, p).
    """
    place = [*X, *(["patch"] if "patch" in state.columns else [])]
    free = state.where("t > 0").select(*place, "t", "x")

    def neighbour(shift: int, inside: Column, name: str) -> DataFrame:
        return free.where(inside).withColumns({"p": F.col("p") - shift}).withColumnsRenamed({"t": f"t{name}", "x": f"x{name}"})

    right = neighbour(1, F.col("p") % nx > 0, "r")
    below = neighbour(nx, F.col("p") >= nx, "d")
    wide = free.join(right, place, "left").join(below, place, "left").join(dual, X, "left").fillna(0.0, ["qx", "qy"])
    top = F.greatest(F.coalesce(F.col("t") + F.col("tr"), F.lit(0.0)), F.coalesce(F.col("t") + F.col("td"), F.lit(0.0)))
    step = F.when(top > 0, 0.99 * p_tv / (4 * top)).otherwise(0.0)
    ax = F.when(F.col("tr").isNotNull(), F.col("qx") + step * (F.col("xr") - F.col("x"))).otherwise(0.0)
    ay = F.when(F.col("td").isNotNull(), F.col("qy") + step * (F.col("xd") - F.col("x"))).otherwise(0.0)
    size = F.greatest(F.lit(1.0), F.sqrt(ax * ax + ay * ay) / lam)
    moved = materialise(wide.select(*X, (ax / size).alias("nx"), (ay / size).alias("ny"), "qx", "qy"))
    dx, dy = F.col("nx") - F.col("qx"), F.col("ny") - F.col("qy")
    parts = F.array(F.struct(F.col("p").alias("p"), (-dx - dy).alias("v")), F.struct((F.col("p") + 1).alias("p"), dx.alias("v")), F.struct((F.col("p") + nx).alias("p"), dy.alias("v")))
    spread = moved.select("k", F.explode(parts).alias("s")).select("k", "s.p", "s.v").where("v <> 0")
    dz = spread.groupBy(*X).agg(F.sum("v").alias("v"))
    made = moved.select(*X, F.col("nx").alias("qx"), F.col("ny").alias("qy"))
    made.state_path = moved.state_path
    return made, dz


def spdhg_tv(op, data: DataFrame, order: list[int | str], cells: DataFrame, subsets: int, nx: int, ny: int, tv: float, p_tv: float | None = None, lam: float = 0.0, levels: list[tuple[DataFrame, float]] | None = None, leaf_edge: float = 1.0, state: dict | None = None, resumable: bool = False):
    """As ``spdhg`` with one more block: an entry "tv" in the order takes the total-variation step.

    ``cells`` with a column patch have differences within a patch only. ``levels``: for each level of an
    orientation tree its node(k, node) and the length of its edges; the sums of a node's members are
    penalised as an orientation is, with ``tv`` times the edge (the leaves' with ``leaf_edge``), the block's
    step is shared evenly, and a node's primal step is the sum of its members'.
    """
    levels = levels or []
    p_tv = p_tv if p_tv is not None else 1.0 / (subsets + 1)
    share, own = (1 - p_tv) / subsets, p_tv / (1 + len(levels))
    place = [*X, *(["patch"] if "patch" in cells.columns else [])]
    ones = cells.select(*X, F.lit(1.0).alias("v"))
    d = _noise(data)
    chosen = [op.restrict(f"a % {subsets} = {m}") for m in range(subsets)]
    rows, sums = {}, []
    for m in range(subsets):
        part = d.where(f"a % {subsets} = {m}")
        found = _on(part, s=chosen[m].forward(ones))
        rows[m] = materialise(found.withColumn("sig", F.when((F.col("w") != 0) & (F.col("s") > 0), 1 / F.col("s")).otherwise(0.0)).drop("s"))
        sums.append(chosen[m].adjoint(part.where("w <> 0").select(*D, F.lit(1.0).alias("v"))).select(*X, F.col("v").alias("c")))
    nothing = lambda df: df.select(*X, F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"))
    if state is None:
        steps = reduce(DataFrame.unionByName, sums).groupBy(*X).agg(F.max("c").alias("c"))
        prim = materialise(cells.join(steps, X, "left").select(*place, F.when(F.col("c") > 0, share / F.col("c")).otherwise(0.0).alias("t"), F.lit(1.0).alias("x"), F.lit(0.0).alias("z")))
        dual = {m: materialise(rows[m].select(*D, F.lit(0.0).alias("v"))) for m in range(subsets)}
    else:
        prim, dual = state["primal"], {m: state[f"dual{m}"] for m in range(subsets)}
    # the leaves and the nodes of every level, each with its own edges' duals and with primal steps that don't change
    nodes = [materialise(prim.select(*X, "t").join(level, "k").groupBy("node", "p").agg(F.sum("t").alias("t")).withColumnRenamed("node", "k")) for level, _ in levels]
    edges = [state[f"edges{i}"] if state else materialise(nothing(df)) for i, df in enumerate([prim, *nodes])]
    for m in order:
        if m == "tv":
            before, (edges[0], dz) = [edges[0]], tv_step(prim, edges[0], nx, ny, tv * leaf_edge, own)
            for i, (level, edge) in enumerate(levels, 1):
                total = prim.join(level, "k").groupBy("node", "p").agg(F.sum("x").alias("x")).withColumnRenamed("node", "k")
                before.append(edges[i])
                edges[i], of_nodes = tv_step(nodes[i - 1].join(total, X), edges[i], nx, ny, tv * edge, own)
                back = of_nodes.withColumnRenamed("k", "node").join(level, "node").select(*X, "v")
                dz = dz.select(*X, "v").unionByName(back)
            if levels:
                dz = dz.groupBy(*X).agg(F.sum("v").alias("v"))
            factor = 1 / p_tv
        else:
            ax = chosen[m].forward(prim.select(*X, F.col("x").alias("v")))
            before, moved = [dual[m]], materialise(_on(rows[m], yd=dual[m], ax=ax).select(*D, "yd", _dual(F.col("yd"), F.col("sig"), F.col("ax")).alias("v")))
            dz = chosen[m].adjoint(moved.select(*D, (F.col("v") - F.col("yd")).alias("v")))
            dual[m] = moved
            factor = 1 / share
        both = prim.join(dz.select(*X, F.col("v").alias("dz")), X, "left").withColumn("dz", F.coalesce("dz", F.lit(0.0)))
        z = F.col("z") + F.col("dz")
        new = F.when(F.col("t") > 0, F.greatest(F.lit(0.0), F.col("x") - F.col("t") * (z + factor * F.col("dz") + lam))).otherwise(0.0)
        old, prim = prim, materialise(both.select(*place, "t", new.alias("x"), z.alias("z")))
        discard(old, *before)
    x = prim.select(*X, F.col("x").alias("v"))
    if not resumable:
        return x
    return x, {"primal": prim} | {f"dual{m}": df for m, df in dual.items()} | {f"edges{i}": df for i, df in enumerate(edges)}
