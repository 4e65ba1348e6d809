"""Operators of the engine: identities, symmetry, brute force, and every query against its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from polefold.functions import rotations as rot
from polefold.functions import scalar
from polefold.operators import blocks, crystal, derivs, fields, interp, linop, polefigure, projector, search, terms, tree
from polefold.plans import catalog, odf, solvers
from polefold.plans.state import load_state, materialise, save_state
from polefold.schemas import assert_schema
from polefold.sources import bindings as B
from polefold.sources import cif

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def comparable(frame):
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())), columns


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, data, name):
    got, columns = comparable(catalog.QUERIES[name](spark, data).toPandas())
    want, other = comparable(duck.execute(catalog.ORACLE[name]).df())
    assert columns == other
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_adjoint_identity_of_random_vectors(spark):
    geo = projector.geometry(projector.angles(spark, 7, 0, 2 * math.pi), 9, 8, 13, 1.3, 0.7)
    op = linop.tomographic(projector.radon_weights(geo, 9, 8, 13), B.pf_surrogate(spark).where("a < 7"))
    x = spark.range(7 * 72).selectExpr("cast(id div 72 as int) k", "cast(id % 72 as int) p", "rand(3) v")
    y = spark.range(7 * 13 * 24).selectExpr("cast(id div 312 as int) a", "cast((id div 24) % 13 as int) y", "cast(id % 24 as int) j", "rand(4) v")
    x, y = materialise(x), materialise(y)
    left = op.forward(x).withColumnRenamed("v", "f").join(y, ["a", "y", "j"]).agg(F.sum(F.col("f") * F.col("v"))).first()[0]
    right = op.adjoint(y).withColumnRenamed("v", "f").join(x, ["k", "p"]).agg(F.sum(F.col("f") * F.col("v"))).first()[0]
    assert abs(left - right) < 1e-10 * abs(left)
    parts = [op.restrict(f"a % 2 = {m}").forward(x).agg(F.sum("v")).first()[0] for m in (0, 1)]
    assert abs(sum(parts) - op.forward(x).agg(F.sum("v")).first()[0]) < 1e-8


def test_restriction_reaches_the_scan(spark):
    stored = materialise(B.pf_surrogate(spark))
    plan = linop.bulk(stored).restrict("a = 3").forward(spark.range(7).selectExpr("cast(id as int) k", "1.0D v"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,3)" in plan


def test_trapezoid_sums_are_alike(spark):
    geo = projector.geometry(projector.angles(spark, 5), 16, 16, 41, 0.6, 0.3)
    sums = projector.radon_weights(geo, 16, 16, 41).groupBy("a", "p").agg(F.sum("w").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(sums[0] - sums[1]) < 1e-9


@pytest.mark.parametrize(("name", "order"), [("C1", 1), ("C6", 6), ("D3", 6), ("D4", 8), ("T", 12), ("O", 24)])
def test_groups_are_closed(name, order):
    ops = np.array(rot.group(name))
    assert len(ops) == order
    for a in ops:
        images = np.array([rot._times(tuple(a), tuple(b)) for b in ops])
        assert (np.abs(images @ ops.T).max(1) > 1 - 1e-9).all()


def test_zone_is_invariant(spark, data):
    o, ops = B.orientations(spark, data), rot.symops(spark, "O")
    zone = rot.fundamental_zone(o, ops).select("k", "qw")
    moved = rot.fundamental_zone(rot.equivalents(o, ops), ops).select("k", F.col("qw").alias("q2"))
    gap = moved.join(zone, "k").agg(F.max(F.abs(F.col("qw") - F.col("q2"))), F.count("*")).first()
    assert gap[0] < 1e-8 and gap[1] == 24 * zone.count()
    assert zone.where("qw < 0").count() == 0


def test_greedy_thinning_equals_the_sequential_rule(spark, data):
    o, ops = B.orientations(spark, data), np.array(rot.group("O"))
    got = {r.k for r in rot.thin_greedy(o, rot.symops(spark, "O"), 30.0).collect()}
    rows = sorted((r.k, r.qx, r.qy, r.qz, r.qw) for r in o.collect())
    kept = []
    for k, *q in rows:
        if all(max(abs(np.dot(q, rot._times(tuple(p), tuple(s)))) for s in ops) <= math.cos(math.radians(15)) for _, p in kept):
            kept.append((k, q))
    assert got == {k for k, _ in kept}


def _texture(spark, rows):
    axes = polefigure.pole_axes(spark.createDataFrame([(0, 3**-0.5, 3**-0.5, 3**-0.5, 1.0)], "r int, hx double, hy double, hz double, share double"), rot.symops(spark, "O"))
    angle, ring = projector.angles(spark, 3), polefigure.ring_table(spark, [0.15])
    o = spark.createDataFrame(rows, "k int, qx double, qy double, qz double, qw double, sigma double")
    return o, lambda o, make: make(polefigure.poles(o, axes), angle, ring, 24).withColumn("j", F.col("c"))


def test_pole_figure_slopes_against_differences(spark):
    o, table = _texture(spark, [(0, 0.0, 0.0, 0.0, 1.0, 0.3), (1, 0.2, -0.4, 0.1, math.sqrt(1 - 0.21), 0.25)])
    slopes = {(r.a, r.k, r.j): r for r in table(o, polefigure.pf_slopes).collect()}
    plain = {(r.a, r.k, r.j): r.v for r in table(o, polefigure.pf_table).collect()}
    assert slopes.keys() == plain.keys() and all(abs(slopes[i].v - v) < 1e-12 for i, v in plain.items())
    h = 1e-5
    for name in derivs.PARAMETERS:
        step = spark.createDataFrame([(k, *[h * (n == name) for n in derivs.PARAMETERS]) for k in (0, 1)], "k int, s_rx double, s_ry double, s_rz double, s_sigma double")
        up, down = ({(r.a, r.k, r.j): r.v for r in table(derivs.updated_orientations(o, step, s, (1e-4, 1.0)), polefigure.pf_table).collect()} for s in (1.0, -1.0))
        bad = 0
        for i, r in slopes.items():
            gap = abs((up.get(i, 0.0) - down.get(i, 0.0)) / (2 * h) - r[f"d_{name}"])
            bad += gap > 1e-4
        assert bad <= 0.02 * len(slopes)  # a pole that crosses the cut jumps


def test_pole_figure_slopes_by_geometry(spark):
    o, _ = _texture(spark, [(0, 0.0, 0.0, 0.0, 1.0, 0.3), (1, 0.2, -0.4, 0.1, math.sqrt(1 - 0.21), 0.25)])
    axes = polefigure.pole_axes(spark.createDataFrame([(0, 3**-0.5, 3**-0.5, 3**-0.5, 1.0)], "r int, hx double, hy double, hz double, share double"), rot.symops(spark, "O"))
    angle, poles = projector.angles(spark, 3), polefigure.poles(o, axes)
    made = lambda shift, ring: {(r.a, r.k, r.c): r for r in polefigure.pf_slopes(poles, angle.withColumn("theta", F.col("theta") + shift), polefigure.ring_table(spark, [0.15 + ring]), 24).collect()}
    h, slopes = 1e-5, made(0.0, 0.0)
    for name, up, down in (("d_omega", made(h, 0.0), made(-h, 0.0)), ("d_two_theta", made(0.0, h), made(0.0, -h))):
        gaps = [abs((up[i].v - down[i].v) / (2 * h) - r[name]) for i, r in slopes.items() if i in up and i in down]
        assert len(gaps) >= 0.98 * len(slopes) and sum(g > 1e-4 for g in gaps) <= 0.02 * len(gaps)


def test_refine_moves_orientations(spark):
    truth, table = _texture(spark, [(0, 0.2, -0.4, 0.1, math.sqrt(1 - 0.21), 0.09)])
    b = materialise(table(truth, polefigure.pf_table).select("a", "j", F.col("v").alias("b")))
    away = spark.createDataFrame([(0, 0.02, -0.01, 0.015, 0.003)], "k int, s_rx double, s_ry double, s_rz double, s_sigma double")
    start = materialise(derivs.updated_orientations(truth, away))
    x = spark.createDataFrame([(a, 0, 0, 1.0) for a in range(3)], "a int, y int, k int, v double")

    def residual(o):
        mu = table(o, polefigure.pf_table).select("a", "j", "v")
        return mu.join(b, ["a", "j"], "full").select("a", F.lit(0).alias("y"), "j", (F.coalesce("v", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("r"), F.lit(1.0).alias("c"))

    evaluate = lambda x, o: residual(o).agg(F.sum(F.col("r") ** 2) / 2).first()[0]
    newton = lambda x, o: derivs.newton_steps(derivs.normal_blocks(derivs.model_entries(residual(o), x, table(o, polefigure.pf_slopes))), max_rot=0.05)
    _, moved, history = derivs.refine(lambda x, o: x, evaluate, newton, x, start, 3)
    assert history[0]["alpha"] > 0 and history[1]["f0"] == pytest.approx(history[0]["f"])
    assert history[-1]["f"] < 1e-3 * history[0]["f0"]
    (want,), (got,) = truth.collect(), moved.collect()
    assert abs(sum(want[c] * got[c] for c in ("qx", "qy", "qz", "qw"))) > 1 - 1e-7 and abs(got.sigma - want.sigma) < 1e-3


@pytest.mark.parametrize("width", [1.0, 6.0])
def test_generated_pole_figure_loses_no_entry(spark, data, width):
    axes = polefigure.pole_axes(spark.createDataFrame([(0, 3**-0.5, 3**-0.5, 3**-0.5, 1.0)], "r int, hx double, hy double, hz double, share double"), rot.symops(spark, "O"))
    poles = polefigure.poles(B.orientations(spark, data).where("k < 6").withColumn("sigma", F.col("sigma") * width), axes)
    angle, ring = projector.angles(spark, 5), polefigure.ring_table(spark, [0.15])
    got = polefigure.pf_table(poles, angle, ring, 24)
    probe = polefigure.probes(angle, 24, ring)
    d = F.col("px") * F.col("vx") + F.col("py") * F.col("vy") + F.col("pz") * F.col("vz")
    value = F.col("cnt") * polefigure.density(d, F.col("sigma")) / (8 * math.pi * F.col("sigma") * F.col("sigma"))
    brute = poles.join(probe, "r").groupBy("a", "k", "c", "r").agg(F.sum(value).alias("b")).where("b > 0")
    both = got.join(brute, ["a", "k", "c", "r"], "full").agg(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))), F.count("*")).first()
    assert both[0] < 1e-9 and both[1] == brute.count()


def test_fcc_families(spark):
    b = crystal.reciprocal(crystal.lattice_matrix(4.05, 4.05, 4.05, 90, 90, 90))
    hkl = crystal.enumerate_hkl(spark, b, 0.0, 5.2).where(crystal.centering("F"))
    got = {tuple(sorted((abs(r.h), abs(r.k), abs(r.l)))): r.mult for r in crystal.families(hkl, crystal.integer_ops("cubic")).collect()}
    assert got == {(1, 1, 1): 8, (0, 0, 2): 6, (0, 2, 2): 12, (1, 1, 3): 24}


def test_lattices():
    rows = crystal.lattice_matrix(3.0, 4.0, 5.0, 80, 95, 110)
    assert np.allclose(crystal.cell_of(rows), (3, 4, 5, 80, 95, 110))
    assert np.allclose(crystal.reciprocal(rows).T @ rows.T / (2 * math.pi), np.eye(3))
    b = crystal.reciprocal(rows)
    assert abs(b[1, 0]) < 1e-9 and abs(b[2, 0]) < 1e-9 and abs(rows[2, 0]) + abs(rows[2, 1]) < 1e-9
    assert crystal.crystal_system(3, 3, 3, 90, 90, 90) == "cubic"
    assert crystal.crystal_system(3, 3, 5, 90, 90, 120) == "hexagonal"
    assert crystal.crystal_system(3, 4, 5, 90, 100, 90) == "monoclinic"


CIF = """data_one
_cell_length_a 4.05(2)
_cell_angle_alpha   90
_symmetry_space_group_name_H-M 'F m -3 m'
_symmetry_Int_Tables_number 225
loop_
_symmetry_equiv_pos_as_xyz
 'x, y, z'
 '-x,-y,z'
 'x+1/2, y+1/2, z'
loop_
_atom_site_label
_atom_site_type_symbol
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
_atom_site_occupancy
_atom_site_B_iso_or_equiv
Al1 Al3+ 0.0 0.0 0.0 1.0 0.8(1)
O1 O 0.25 0.1 0.5 0.5 ?
_note
;
text block _cell_length_b 9
;
data_two
_cell_length_a 1
"""


def test_cif(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    got = cif.parse(CIF)
    assert got["cell"] == {"a": 4.05, "b": 4.05, "c": 4.05, "alpha": 90.0, "beta": 90.0, "gamma": 90.0}
    assert got["group"] == 225 and got["symbol"] == "F m -3 m" and len(got["operations"]) == 3
    assert "_cell_length_b" in got["warnings"]
    basis = cif.read_basis(spark, str(tmp_path)).collect()
    assert len(basis) == 2 + 3
    assert abs(basis[0].u - 0.8 / (8 * math.pi**2)) < 1e-12 and basis[-1].u is None and basis[-1].occ == 0.5
    cell = cif.read_cells(spark, str(tmp_path)).first()
    assert (cell.a, cell.sg) == (4.05, 225)
    assert cif.operation("-x+y, 2z-1/4, .5") == [[-1, 1, 0, 0], [0, 0, 2, -0.25], [0, 0, 0, 0.5]]


def small_problem(spark):
    radon = materialise(projector.radon_weights(projector.geometry(projector.angles(spark, 6), 6, 6, 9, 1.0, 0.5), 6, 6, 9))
    pf = materialise(B.pf_surrogate(spark).where("a < 6 and k < 3 and j < 6"))
    op = linop.tomographic(radon, pf)
    truth = materialise(spark.range(3 * 36).selectExpr("cast(id div 36 as int) k", "cast(id % 36 as int) p", "cast(1 + id % 5 as double) v"))
    data = materialise(op.forward(truth).select("a", "y", "j", F.col("v").alias("b"), F.lit(1.0).alias("w"), F.lit(0.5).alias("g"), F.lit(0.1).alias("bg")))
    return op, truth, data


def deviance(op, data, x):
    mu = op.forward(x).withColumnRenamed("v", "mu")
    rows = data.join(mu, ["a", "y", "j"], "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))
    return terms.poisson_deviance(rows).first()["deviance"]


def test_solvers_reduce_their_objective(spark, tmp_path):
    op, truth, data = small_problem(spark)
    cells = truth.select("k", "p")
    ones = truth.select("k", "p", F.lit(1.0).alias("v"))
    start = deviance(op, data, ones)
    x, state = solvers.pdhg(op, data, 4, cells)
    assert deviance(op, data, x) < start
    save_state(state, str(tmp_path / "s"))
    again, _ = solvers.pdhg(op, data, 1, cells, state=load_state(spark, str(tmp_path / "s"), ["primal", "dual"]))
    direct, _ = solvers.pdhg(op, data, 5, cells)
    gap = again.withColumnRenamed("v", "u").join(direct, ["k", "p"]).agg(F.max(F.abs(F.col("u") - F.col("v")))).first()[0]
    assert gap < 1e-9
    assert deviance(op, data, solvers.osem(op, data, [0, 1], ones, 2)) < start
    x, stats = solvers.fista_poisson(op, data, ones, 2)
    assert stats[-1]["f"] < start
    assert solvers.random_order(4, 3, 1) == solvers.random_order(4, 3, 1)


def test_callback_stops(spark):
    op, truth, data = small_problem(spark)
    seen = []
    solvers.fista(op, data, 1e-4, 5, callback=lambda it, x, s: seen.append(it) or it == 2)
    assert seen == [1, 2]


def test_stream_updates_state(spark, data, tmp_path):
    from polefold.streaming import incremental

    rows = B.data(spark, data).select("a", "y", "j", "b")
    for i in range(2):
        rows.where(f"a % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = spark.createDataFrame([], "a int, b double")
    step = lambda x, batch: x.unionByName(batch.groupBy("a").agg(F.sum("b").alias("b")))
    q = incremental.fit_stream(incremental.data_stream(spark, str(tmp_path / "in")), step, start, str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "state/gen=2")).agg(F.sum("b")).first()[0]
    assert got == rows.agg(F.sum("b")).first()[0]


def test_components_and_schema(spark):
    square = spark.createDataFrame([(0, p) for p in (0, 1, 5, 15, 14)], "k int, p int")
    got = {r.p: r.region for r in fields.regions(square, 4, 4).collect()}
    assert got == {0: 0, 1: 0, 5: 0, 14: 14, 15: 14}
    with pytest.raises(ValueError):
        assert_schema(square, "coef")
    assert assert_schema(square.withColumn("v", F.lit(1.0)), "coef") is not None


def test_symmetric_point_interpolates_alike(spark, data):
    o, ops = B.orientations(spark, data).where("k < 40"), rot.symops(spark, "O")
    values = o.select("k", (F.col("k") + 1.0).alias("v"))
    target = o.where("k = 3")
    other = rot.equivalents(target, ops).where("g = 7").drop("g")
    got = [interp.apply(interp.so3_kernel(t, o, ops, 0.3, 40.0), values).first()["v"] for t in (target, other)]
    assert abs(got[0] - got[1]) < 1e-9


def test_bulk_fit_recovers_weights(spark):
    pf = B.pf_surrogate(spark)
    truth = spark.createDataFrame([(k, float(k % 3)) for k in range(7)], "k int, w double")
    data = pf.join(truth, "k").groupBy("a", "j").agg(F.sum(F.col("v") * F.col("w")).alias("b"))
    got = odf.fit_bulk(pf, data, 12)
    gap = got.withColumnRenamed("w", "u").join(truth, "k").agg(F.sqrt(F.sum((F.col("u") - F.col("w")) ** 2))).first()[0]
    assert gap < 1.0


def test_candidates_link_neighbouring_tiles(spark):
    ops = rot.symops(spark, "O")
    s = math.sin(math.radians(1))
    o = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, s, math.sqrt(1 - s * s)), (2, 0.38, 0.0, 0.0, math.sqrt(1 - 0.38**2))], "k int, qx double, qy double, qz double, qw double")
    kept = search.apart(spark.createDataFrame([(0, 0, 5.0), (0, 1, 4.0), (1, 1, 3.0), (15, 2, 9.0)], "p int, k int, z0 double"), o, ops, 8.0, 3)
    assert kept.count() == 3
    got = [(r.k, r.score, r.tiles) for r in search.linked(kept, o, ops, 4, 4, 5.0, 2).collect()]
    assert got == [(0, 8.0, [0, 1])]


def about_z(spark, n, step_deg):
    halves = [math.radians(i * step_deg) / 2 for i in range(n)]
    return spark.createDataFrame([(i, 0.0, 0.0, math.sin(h), math.cos(h)) for i, h in enumerate(halves)], "k int, qx double, qy double, qz double, qw double")


def test_greedy_thinning_of_ordered_chains(spark):
    ops = rot.symops(spark, "C1")
    kept = lambda o, d, **kw: sorted(r.k for r in rot.thin_greedy(o, ops, d, **kw).collect())
    # more rows kept than the sixty rounds of before could decide
    assert kept(about_z(spark, 900, 0.1), 1.0 - 1e-6) == list(range(0, 900, 10))
    # by rounds alone
    assert kept(about_z(spark, 66, 0.1), 0.2 - 1e-6, local=0) == list(range(0, 66, 2))


def test_long_chain_of_tiles_is_one_candidate(spark):
    n = 130
    kept = spark.createDataFrame([(p, p, 1.0) for p in range(n)], "p int, k int, z0 double")
    o = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 1.0) for k in range(n)], "k int, qx double, qy double, qz double, qw double")
    got = search.linked(kept, o, rot.symops(spark, "C1"), n, 1, 5.0, 2).collect()
    assert [(r.score, len(r.tiles)) for r in got] == [(float(n), n)]


def test_dense_round_trip(spark, tmp_path):
    from polefold.sources import tables

    array = np.arange(24.0).reshape(2, 3, 4)
    long = tables.from_dense(spark, array, ("a", "y", "j"))
    assert long.count() == 23
    assert (tables.to_dense(long, array.shape, ("a", "y", "j")) == array).all()
    assert tables.completed(long, {"a": 2, "y": 3, "j": 4}).count() == 24
    np.save(tmp_path / "x.npy", array)
    assert tables.read_npy(spark, str(tmp_path / "x.npy"), ("a", "y", "j")).count() == 23
    tables.append_json(tables.iteration_stats(spark, [{"iter": 1, "f": 2.0}, {"iter": 2}]), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError):
        tables.to_dense(long, (10_000, 10_000), ("a", "y"))


def test_phases_are_fitted_together(spark):
    pf = B.pf_surrogate(spark)
    other = pf.select("a", "k", ((F.col("j") + 7) % 24).cast("int").alias("j"), "v")
    weights = spark.createDataFrame([(k, 1.0 + k) for k in range(7)], "k int, w double")
    model = lambda t: t.join(weights, "k").groupBy("a", "j").agg(F.sum(F.col("v") * F.col("w")).alias("b"))
    data = model(pf).unionByName(model(other)).groupBy("a", "j").agg(F.sum("b").alias("b"))
    got = odf.fit_bulk_phases({"one": pf, "two": other}, data, 4)
    assert {n: d.count() for n, d in got.items()} == {"one": 7, "two": 7}


def test_nested_cells_cover_everything(spark, data):
    from polefold.operators import tree

    o = B.orientations(spark, data).where("label = 0")
    got = tree.nested_cells(o, rot.symops(spark, "O"), (20.0, 40.0))
    assert got.where("level = 0").count() == got.where("level = 1").count() == o.count()
    counts = [got.where(f"level = {i}").select("node").distinct().count() for i in (0, 1)]
    assert counts[0] <= counts[1]


def test_total_variation_step_flattens(spark):
    state = materialise(spark.range(16).selectExpr("0 as k", "cast(id as int) p", "1.0D t", "case when id % 4 < 2 then 0.0D else 10.0D end x"))
    dual = state.select("k", "p", F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"))
    new, dz = solvers.tv_step(state, dual, 4, 4, 0.5, 0.25)
    rows = {r.p: r for r in new.collect()}
    assert rows[1].qx > 0 and rows[0].qx == 0 and all(r.qy == 0 for r in rows.values())
    moved = {r.p: r.v for r in dz.collect()}
    assert moved[1] < 0 < moved[2] and abs(sum(moved.values())) < 1e-12


def _random_quats(n, seed):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def _quat_table(spark, q, key="k"):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], f"{key} int, qx double, qy double, qz double, qw double")


@pytest.mark.parametrize(("group", "limit"), [("O", 12.0), ("D3", 40.0), ("C1", 100.0)])
def test_near_pairs_loses_nothing(spark, group, limit):
    left, right = _random_quats(60, 1), _random_quats(40, 2)
    turns = np.array(rot.group(group))
    want = {}
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            x, y, z, w = b
            images = np.array([[w * s[0] + x * s[3] + y * s[2] - z * s[1], w * s[1] - x * s[2] + y * s[3] + z * s[0], w * s[2] + x * s[1] - y * s[0] + z * s[3], w * s[3] - x * s[0] - y * s[1] - z * s[2]] for s in turns])
            c = np.abs(images @ a).max()
            if c >= math.cos(math.radians(limit) / 2):
                want[i, j] = c
    got = rot.near_pairs(_quat_table(spark, left), _quat_table(spark, right, "t"), rot.symops(spark, group), limit).collect()
    assert {(r.k, r.t) for r in got} == set(want)
    assert all(abs(want[r.k, r.t] - r.c) < 1e-9 for r in got)


def test_angular_joins_have_no_cross_join_of_orientations(spark):
    o = _quat_table(spark, _random_quats(10, 3))
    plan = rot.near_pairs(o, o.withColumnRenamed("k", "t"), rot.symops(spark, "O"), 10.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") + plan.count("Join Inner\n") <= 1  # with the symmetry operations only
    assert "_cell" in plan


def test_nested_cells_are_nested(spark):
    o = _quat_table(spark, _random_quats(80, 4))
    rows = tree.nested_cells(o, rot.symops(spark, "C1"), (90.0, 45.0, 20.0)).collect()
    node = {(r.level, r.k): r.node for r in rows}
    assert len(node) == 3 * 80
    for level in (1, 2):
        parents = {}
        for k in range(80):
            parents.setdefault(node[level, k], set()).add(node[level - 1, k])
        assert all(len(p) == 1 for p in parents.values())
    assert len({node[2, k] for k in range(80)}) > len({node[0, k] for k in range(80)})


def test_families_of_all_systems():
    orders = {"cubic": 48, "hexagonal": 24, "trigonal": 12, "tetragonal": 16, "orthorhombic": 8, "monoclinic": 4, "triclinic": 2}
    assert {s: len(crystal.integer_ops(s)) for s in orders} == orders
    assert crystal.crystal_system(3, 4, 4, 90, 90, 90) == "orthorhombic"
    assert crystal.crystal_system(3, 4, 5, 90, 90, 100) == "triclinic"
    assert [crystal.system_of_group(n) for n in (1, 2, 3, 15, 16, 75, 142, 143, 168, 195, 230)] == ["triclinic", "triclinic", "monoclinic", "monoclinic", "orthorhombic", "tetragonal", "tetragonal", "trigonal", "hexagonal", "cubic", "cubic"]
    with pytest.raises(ValueError):
        crystal.system_of_group(231)
    with pytest.raises(ValueError):
        crystal.scattering_window(0.5)
    with pytest.raises(ValueError):
        crystal.laue_rotations([np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]])], crystal.lattice_matrix(3.0, 4.0, 5.0, 90, 90, 90))


def test_unknown_elements_are_an_error(spark):
    sites = spark.createDataFrame([("Xx", 0.0, 0.0, 0.0, 1.0, None)], "element string, x double, y double, z double, occ double, u double")
    with pytest.raises(Exception, match="no form factor for element Xx"):
        crystal.with_elements(sites, crystal.form_factor_table(spark)).collect()
    named = crystal.with_elements(sites.withColumn("element", F.lit("d ")), crystal.form_factor_table(spark)).first()
    assert named.element == "H"
    assert all(abs(sum(a) + c - z) < 0.1 for (a, _, c), z in ((crystal.FORM_FACTORS[e], z) for e, z in (("H", 1), ("C", 6), ("Fe", 26), ("Au", 79), ("U", 92))))


def test_error_function_tails(spark):
    xs = [-3.0, -0.5, 0.0, 0.3, 2.0, 5.0, 8.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.erfc(F.col("x")).alias("c"), scalar.erfcx(F.abs("x")).alias("s")).collect()
    for r in got:
        assert abs(r.c - math.erfc(r.x)) <= 2e-7 * max(math.erfc(r.x), 1e-300)
        if abs(r.x) < 20:
            assert abs(r.s - math.exp(r.x**2) * math.erfc(abs(r.x))) < 2e-7 * r.s
    assert abs(got[-1].s - 1 / (20 * math.sqrt(math.pi))) < 1e-4


def test_renumbered_orientations(spark):
    far = spark.range(100).select((F.col("id") * 10**11).alias("k"), F.col("id").alias("was")).repartition(4)
    got = sorted((r.was, r.k) for r in odf.renumbered(far).collect())
    assert got == [(i, i) for i in range(100)]


def test_backtracking_ends_with_an_error(spark, monkeypatch):
    monkeypatch.setattr(solvers, "MAX_BACKTRACKS", 0)
    cells = spark.createDataFrame([(0, 0)], "k int, p int")
    data = spark.createDataFrame([(0, 0, 0, 4.0, 1.0, 1.0, 0.0)], "a int, y int, j int, b double, w double, g double, bg double")
    radon = spark.createDataFrame([(0, 0, 0, 1.0)], "a int, y int, p int, w double")
    pf = spark.createDataFrame([(0, 0, 0, 1.0)], "a int, k int, j int, v double")
    with pytest.raises(ArithmeticError):
        solvers.fista_poisson(linop.tomographic(radon, pf), data, cells.withColumn("v", F.lit(1.0)), 1)
    assert abs(solvers.poisson_start(linop.tomographic(radon, pf), data, cells, "uniform").first().v - 4.0) < 1e-9


def test_block_projection_is_the_table_of_weights(spark):
    geo = projector.geometry(projector.angles(spark, 5), 9, 7, 13, 1.0, 0.25)
    radon = projector.radon_weights(geo, 9, 7, 13)
    want = {(r.a, r.y, r.p): r.w for r in radon.collect()}
    made = {}
    for r in geo.collect():
        w = blocks.footprint(r.gx, r.gy, r.t0, 9, 7, 13)
        made |= {(r.a, int(y), int(p)): w[y, p] for y, p in zip(*np.nonzero(w))}
    assert made.keys() == want.keys() and all(abs(made[i] - w) < 1e-12 for i, w in want.items())
    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(int(k), int(p), float(v)) for k, p, v in zip(rng.integers(0, 11, 60), rng.integers(0, 63, 60), rng.normal(size=60))], "k int, p int, v double").groupBy("k", "p").agg(F.sum("v").alias("v"))
    op = blocks.BlockProjection(geo, 9, 7, 13, block=4)
    flat = lambda df, *keys: {tuple(r[c] for c in keys): r.v for r in df.collect() if abs(r.v) > 1e-12}
    one, other = flat(op.forward(x), "a", "y", "k"), flat(projector.forward(x, radon), "a", "y", "k")
    assert one.keys() == other.keys() and all(abs(one[i] - v) < 1e-9 for i, v in other.items())
    sino = op.forward(x)
    one, other = flat(op.adjoint(sino), "k", "p"), flat(projector.adjoint(sino, radon), "k", "p")
    assert one.keys() == other.keys() and all(abs(one[i] - v) < 1e-9 for i, v in other.items())
    part = flat(op.restricted("a % 2 = 1").forward(x), "a", "y", "k")
    assert {a for a, *_ in part} == {1, 3}
    assert op.forward(x.where("k > 99")).count() == 0
