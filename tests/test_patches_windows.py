"""Bin means of pole figures, patches, total variation over trees, windows with lattice slopes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from polefold.functions import rotations as rot
from polefold.operators import derivs, fields, graphs, linop, patches, polefigure, projector, quadrature, windows
from polefold.plans import solvers
from polefold.plans.state import materialise
from polefold.sources import bindings as B


def one_axis(spark):
    return spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0)], "r int, nx double, ny double, nz double, cnt double")


def figure_inputs(spark, data, condition="k < 5"):
    axes = polefigure.pole_axes(spark.createDataFrame([(0, 3**-0.5, 3**-0.5, 3**-0.5, 1.0)], "r int, hx double, hy double, hz double, share double"), rot.symops(spark, "O"))
    poles = polefigure.poles(B.orientations(spark, data).where(condition), axes)
    return poles, projector.angles(spark, 5), polefigure.ring_table(spark, [0.15])


@pytest.mark.parametrize("rule", [((2, 1), (3, 1)), ((1, 2), (1, 1)), ((1, 1), (4, 1))])
@pytest.mark.parametrize("width", [1.0, 6.0])
def test_bin_means_are_sums_over_nodes(spark, data, rule, width):
    poles, angle, ring = figure_inputs(spark, data)
    poles = poles.withColumn("sigma", F.col("sigma") * width)
    made, step = quadrature.Rule(*rule), math.pi / 5
    got = polefigure.pf_table(poles, angle, ring, 24, made, step)
    probe = polefigure.probes(angle, 24, ring, made, step)
    assert probe.groupBy("a", "c", "r").agg(F.sum("wq").alias("w")).where("abs(w - 1) > 1e-12").count() == 0
    d = F.col("px") * F.col("vx") + F.col("py") * F.col("vy") + F.col("pz") * F.col("vz")
    value = F.col("wq") * F.col("cnt") * polefigure.density(d, F.col("sigma")) / (8 * math.pi * F.col("sigma") * F.col("sigma"))
    brute = poles.join(probe, "r").groupBy("a", "k", "c", "r").agg(F.sum(value).alias("b")).where("b > 0")
    both = got.join(brute, ["a", "k", "c", "r"], "full").agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.count("*")).first()
    assert both[0] < 1e-9 and both[1] == brute.count()


def test_one_node_is_the_table_of_middles(spark, data):
    inputs = figure_inputs(spark, data)
    plain = {(r.a, r.k, r.c): r.v for r in polefigure.pf_table(*inputs, 24).collect()}
    nodes = {(r.a, r.k, r.c): r.v for r in polefigure.pf_table(*inputs, 24, quadrature.Rule((1, 1), (1, 1)), 0.3).collect()}
    assert plain.keys() == nodes.keys() and all(abs(nodes[k] - v) < 1e-9 * v for k, v in plain.items())


@pytest.mark.parametrize("tol", [0.1, 0.02, 0.005])
def test_error_of_bin_means_stays_under_the_bound(spark, tol):
    """Along a great circle, where the bound is reached: a pole in the plane of the azimuths of a ring at 0."""
    sigma, n_eta = 0.1, 36
    o = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, sigma)], "k int, qx double, qy double, qz double, qw double, sigma double")
    inputs = polefigure.poles(o, one_axis(spark)), projector.angles(spark, 1), polefigure.ring_table(spark, [0.0])
    d_eta, share = 2 * math.pi / n_eta, math.exp(-polefigure.CUT)
    rule = quadrature.choose(1e-6, d_eta, sigma, tol, share)
    fine = quadrature.Rule((1, 1), (8, 8))
    peak = 1 / (8 * math.pi * sigma * sigma)
    values = [{r.c: r.v for r in polefigure.pf_table(*inputs, n_eta, x, 1e-6).collect()} for x in (rule, fine)]
    limit = quadrature.bound(*rule.eta, d_eta, sigma) + share
    worst = max(abs(values[0].get(c, 0.0) - values[1].get(c, 0.0)) for c in range(n_eta)) / peak
    assert worst <= limit <= tol * 1.01 and values[1]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_links_and_chains(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(400)] + [(2000, 2000)] + [(3000, 3001 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in pair and pair[0] != pair[1] for pair in links)}


def test_regions_of_a_serpentine_are_one(spark):
    n = 33
    rows = [(0, x + n * y) for y in range(n) for x in range(n) if y % 2 == 0 or x == (n - 1 if y % 4 == 1 else 0)]
    assert {r.region for r in fields.regions(spark.createDataFrame(rows, "k int, p int"), n, n).collect()} == {0}


def brute_patches(rows, nx, gap, fill):
    out = []
    for k in sorted({k for k, _ in rows}):
        points = sorted({(p // nx, p % nx) for c, p in rows if c == k})
        box = lambda s: [min(y for y, _ in s), max(y for y, _ in s), min(x for _, x in s), max(x for _, x in s)]
        y0, y1, x0, x1 = box(points)
        boxes = [box(points)]
        if len(points) < fill * (y1 - y0 + 1) * (x1 - x0 + 1):
            left, boxes = set(points), []
            while left:
                group, todo = set(), [left.pop()]
                while todo:
                    y, x = todo.pop()
                    group.add((y, x))
                    near = {q for q in left if max(abs(q[0] - y), abs(q[1] - x)) <= 2 * gap + 1}
                    left -= near
                    todo += near
                boxes.append(box(group))
            again = True
            while again:
                again = False
                for i, a in enumerate(boxes):
                    for b in boxes[i + 1 :]:
                        if a[0] <= b[1] and b[0] <= a[1] and a[2] <= b[3] and b[2] <= a[3]:
                            boxes = [c for c in boxes if c is not a and c is not b] + [[min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]]
                            again = True
                            break
                    if again:
                        break
        out += [(k, b[2], b[0], b[3] - b[2] + 1, b[1] - b[0] + 1) for b in sorted(boxes)]
    return out


@pytest.mark.parametrize(("gap", "fill", "share"), [(0, 0.5, 0.04), (1, 0.5, 0.02), (2, 0.9, 0.03), (2, 0.0, 0.3)])
def test_patches(spark, gap, fill, share):
    rng, nx = random.Random(7), 70
    rows = [(k, p) for k in (0, 3, 5000) for p in range(nx * nx) if rng.random() < share]
    rows += [(9, 5 + nx * y + x) for y in range(6) for x in range(5)] + [(10, 0)]
    support = spark.createDataFrame(rows, "k int, p int").repartition(3)
    patch, pair = (materialise(x) for x in patches.patches(support, nx, gap=gap, fill=fill))
    got = sorted(patch.collect(), key=lambda r: r.patch)
    assert [(r.k, r.x0, r.y0, r.w, r.h) for r in got] == brute_patches(rows, nx, gap, fill)
    assert [r.patch for r in got] == list(range(len(got))) and [r.coff for r in got] == [sum(x.w * x.h for x in got[:i]) for i in range(len(got))]
    placed = pair.collect()
    assert sorted((r.k, r.p) for r in placed) == sorted(rows) and len({r.i for r in placed}) == len(rows)
    for r in placed:
        own = got[r.patch]
        assert own.k == r.k and r.i == own.coff + (r.p // nx - own.y0) * own.w + r.p % nx - own.x0 and 0 <= r.p % nx - own.x0 < own.w
    flat = patches.flat_mask(patch, pair).agg(F.count("*"), F.sum("inside"), F.max("i")).first()
    assert tuple(flat) == (sum(x.w * x.h for x in got), len(rows), sum(x.w * x.h for x in got) - 1)


def test_patches_of_nothing(spark):
    patch, pair = patches.patches(spark.createDataFrame([], "k int, p int"), 8)
    assert patch.count() == 0 and pair.count() == 0


def tv_problem(spark, data):
    geo = projector.geometry(projector.angles(spark, B.R), B.NX, B.NY, B.NS)
    op = linop.tomographic(materialise(projector.radon_weights(geo, B.NX, B.NY, B.NS)), materialise(B.pf_surrogate(spark)))
    return op, materialise(B.with_noise(B.data(spark, data)))


def test_a_level_of_single_orientations_is_the_leaves_again(spark, data):
    """Two blocks alike, each with half of the step and of the weight, move as one."""
    op, rows = tv_problem(spark, data)
    cells = materialise(spark.range(3 * 256).selectExpr("cast(id div 256 as int) k", "cast(id % 256 as int) p"))
    order = [0, "tv", 1, "tv"]
    alone = {(r.k, r.p): r.v for r in solvers.spdhg_tv(op, rows, order, cells, 2, B.NX, B.NY, 0.5).collect()}
    same = [(spark.range(3).selectExpr("cast(id as int) k", "cast(id as int) node"), 0.5)]
    twice = {(r.k, r.p): r.v for r in solvers.spdhg_tv(op, rows, order, cells, 2, B.NX, B.NY, 0.5, levels=same, leaf_edge=0.5).collect()}
    assert alone.keys() == twice.keys() and max(abs(twice[k] - v) for k, v in alone.items()) < 1e-9
    one_patch = {(r.k, r.p): r.v for r in solvers.spdhg_tv(op, rows, order, cells.withColumn("patch", F.col("k")), 2, B.NX, B.NY, 0.5).collect()}
    assert max(abs(one_patch[k] - v) for k, v in alone.items()) < 1e-12
    first, state = solvers.spdhg_tv(op, rows, order[:2], cells, 2, B.NX, B.NY, 0.5, resumable=True)
    rest = {(r.k, r.p): r.v for r in solvers.spdhg_tv(op, rows, order[2:], cells, 2, B.NX, B.NY, 0.5, state=state).collect()}
    assert max(abs(rest[k] - v) for k, v in alone.items()) < 1e-12


def test_no_difference_crosses_a_patch(spark):
    state = spark.createDataFrame([(0, p, p % 4 // 2, 1.0, float(p)) for p in range(16)], "k int, p int, patch int, t double, x double")
    dual = state.select("k", "p", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"))
    new, _ = solvers.tv_step(state, dual, 4, 4, 10.0, 0.5)
    assert {r.p % 4 for r in new.collect() if r.qx} == {0, 2} and {r.p // 4 for r in new.collect() if r.qy} == {0, 1, 2}


CELL = (4.0, 4.1, 4.3, 88.0, 93.0, 95.0)


def window_inputs(spark, cell, rel, data=None, amplitude=None):
    hkl = [(0, 1, 1, 1, 8), (1, 0, 0, 2, 6), (2, 0, 2, 2, 12), (3, 1, 1, 3, 24)]
    families = spark.createDataFrame([(*x, 0.5 + x[0]) for x in hkl], "f int, h int, k int, l int, mult int, amp double")
    edges = spark.createDataFrame([(0, 2.5, 3.0), (1, 4.0, 5.2)], "win int, lo double, hi double")
    return windows.channels(families, edges, cell, rel, 0.35, 1e-6, amplitude), families


@pytest.mark.parametrize("amplitude", [None, "amp"])
def test_slopes_of_channels_are_differences(spark, amplitude):
    made = {r.r: r for r in window_inputs(spark, CELL, 0.03, amplitude=amplitude)[0].collect()}
    for i, x in enumerate(windows.PARAMETERS):
        h = 1e-4 if x != "rel" else 1e-6
        ends = []
        for sign in (1, -1):
            cell = [c + sign * h * (i == j) for j, c in enumerate(CELL)]
            ends.append({r.r: r for r in window_inputs(spark, tuple(cell), 0.03 + sign * h * (x == "rel"), amplitude=amplitude)[0].collect()})
        for r, row in made.items():
            for name, value in (("s", "share"), ("t", "two_theta")):
                slope = (ends[0][r][value] - ends[1][r][value]) / (2 * h)
                assert row[f"d{name}_{x}"] == pytest.approx(slope, abs=2e-3 * max(1.0, abs(slope)))
    if amplitude is None:
        assert {w: pytest.approx(1.0) for w in (0, 1)} == {w: sum(r.share for r in made.values() if r.win == w) for w in (0, 1)}


def windowed_model(spark, data, cell, rel):
    channel, families = window_inputs(spark, cell, rel)
    channel = materialise(channel)
    n = F.sqrt(F.col("h") * F.col("h") + F.col("k") * F.col("k") + F.col("l") * F.col("l"))
    normals = families.select(F.col("f").alias("r"), *[(F.col(c) / n).alias(f"h{x}") for c, x in zip("hkl", "xyz")], F.lit(1.0).alias("share"))
    axes = windows.channel_axes(polefigure.pole_axes(normals, rot.symops(spark, "O")), channel)
    poles = polefigure.poles(B.orientations(spark, data).where("k < 3").withColumn("sigma", F.lit(0.3)), axes)
    slopes = materialise(polefigure.pf_slopes(poles, projector.angles(spark, 4), channel.select("r", "two_theta"), 5))
    radon = materialise(projector.radon_weights(projector.geometry(projector.angles(spark, 4), 4, 4, 6), 4, 4, 6))
    return channel, slopes, radon


def test_windowed_operator_and_lattice_gradient(spark, data):
    channel, slopes, radon = windowed_model(spark, data, CELL, 0.03)
    op = windows.windowed(radon, slopes, channel)
    coef = materialise(spark.range(48).selectExpr("cast(id div 16 as int) k", "cast(id % 16 as int) p", "1.0D + id % 5 v"))
    res = materialise(spark.range(4 * 6 * 5 * 2).selectExpr("cast(id div 60 as int) a", "cast(id div 10 % 6 as int) y", "cast(id div 2 % 5 as int) c", "cast(id % 2 as int) win", "cast(id % 7 as double) - 3 v"))
    forward, back = op.forward(coef), op.adjoint(res)
    dot = lambda a, b, on: a.withColumnRenamed("v", "u").join(b, on).agg(F.sum(F.col("u") * F.col("v"))).first()[0]
    total = dot(forward, res, ["a", "y", "c", "win"])
    assert total == pytest.approx(dot(coef, back, ["k", "p"]), rel=1e-10)
    part = op.restrict("a % 2 = 0").forward(coef)
    assert {r.a for r in part.select("a").distinct().collect()} == {0, 2}
    got = {r.parameter: r.g for r in windows.lattice_gradient(res, coef, radon, slopes, channel).collect()}
    for i, x in enumerate(windows.PARAMETERS):
        if x not in ("a", "gamma", "rel"):
            continue
        h = 1e-3 if x != "rel" else 1e-5
        ends = []
        for sign in (1, -1):
            model = windowed_model(spark, data, tuple(c + sign * h * (i == j) for j, c in enumerate(CELL)), 0.03 + sign * h * (x == "rel"))
            ends.append(dot(windows.windowed(model[2], model[1], model[0]).forward(coef), res, ["a", "y", "c", "win"]))
        slope = (ends[0] - ends[1]) / (2 * h)
        assert got[x] == pytest.approx(slope, rel=5e-3, abs=5e-3 * abs(total)), x
