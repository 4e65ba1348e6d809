"""Cells, reflections and structure factors of many materials, against the one-material functions and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polefold.functions import rotations as rot
from polefold.operators import crystal, materials, polefigure

SCHEMA = "id long, system string, a double, b double, c double, alpha double, beta double, gamma double"
CELLS = [
    (1, "cubic", 4.0, 4.0, 4.0, 90.0, 90.0, 90.0), (2, "hexagonal", 3.0, 3.0, 5.0, 90.0, 90.0, 120.0), (3, "trigonal", 4.0, 4.0, 6.0, 90.0, 90.0, 120.0), (4, "tetragonal", 3.0, 3.0, 5.0, 90.0, 90.0, 90.0),
    (5, "orthorhombic", 3.0, 4.0, 5.0, 90.0, 90.0, 90.0), (6, "monoclinic", 3.0, 4.0, 5.0, 90.0, 90.0, 100.0), (7, "triclinic", 3.0, 4.0, 5.0, 80.0, 95.0, 100.0),
]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS, SCHEMA)


def test_families_equal_those_of_one_material(spark, cells):
    """Counting by stabilisers gives the families that grouping all members gives, for every system at once."""
    got = {(r.id, r.h, r.k, r.l): (r.mult, round(r.q, 9)) for r in materials.families(materials.reflections(cells, 0.1, 5.0)).collect()}
    want = {}
    for id_, system, *cell in CELLS:
        b = crystal.reciprocal(crystal.lattice_matrix(*cell))
        for r in crystal.families(crystal.enumerate_hkl(spark, b, 0.1, 5.0), crystal.integer_ops(system)).collect():
            want[(id_, r.h, r.k, r.l)] = (r.mult, round(r.q, 9))
    assert got == want


def test_lattice_and_its_inverse(cells):
    for r in materials.lattice(cells).collect():
        rows = np.array([[r.m00, r.m01, r.m02], [0, r.m11, r.m12], [0, 0, r.m22]])
        inverse = np.array([[r.r00, r.r01, r.r02], [0, r.r11, r.r12], [0, 0, r.r22]])
        assert np.allclose(rows, crystal.lattice_matrix(r.a, r.b, r.c, r.alpha, r.beta, r.gamma), atol=1e-12)
        assert np.allclose(rows @ inverse, 2 * math.pi * np.eye(3)) and abs(r.volume - crystal.cell_volume(rows)) < 1e-9


def test_slopes_of_q_by_differences(spark, cells):
    rows = cells.crossJoin(spark.createDataFrame([(1, -2, 3), (2, 1, 0)], "h int, k int, l int"))
    for name in ("a", "b", "c", "alpha", "beta", "gamma"):
        step = 1e-4
        ends = [{(r.id, r.h): r.q for r in materials.q_slopes(rows.withColumn(name, F.col(name) + s)).collect()} for s in (step, -step)]
        for r in materials.q_slopes(rows).collect():
            key = (r.id, r.h)
            assert abs((ends[0][key] - ends[1][key]) / (2 * step) - r[f"dq_{name}"]) < 1e-6


def test_nulls_empty_tables_and_materials_without_sites(spark, cells):
    """A null in a cell gives no reflections; a cell without sites has f2 = 0; empty tables stay empty."""
    broken = spark.createDataFrame([(9, "cubic", None, 4.0, 4.0, 90.0, 90.0, 90.0)], SCHEMA)
    assert materials.families(materials.reflections(broken, 0.1, 5.0)).count() == 0
    assert materials.lattice(broken).first().m00 is None
    assert materials.families(materials.reflections(cells.limit(0), 0.1, 5.0)).count() == 0
    sites = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 5.0, 0.0), (1, 0.5, 0.5, 0.5, 5.0, 0.0)], "id long, x double, y double, z double, b_coh double, u2 double")
    rows = materials.reflections(materials.with_basis(cells, sites), 0.1, 3.5)
    got = materials.neutron(rows, -1.0).select("id", "h", "k", "l", "f2").collect()
    assert {r.id for r in got} == set(range(1, 8)) and all(r.f2 == 0 for r in got if r.id != 1)
    assert all(abs(r.f2 - (1.0 if (r.h + r.k + r.l) % 2 == 0 else 0.0)) < 1e-12 for r in got if r.id == 1)
    unnamed = cells.withColumn("system", F.lit(None).cast("string")).where("id = 1")
    assert {r.mult for r in materials.families(materials.reflections(unnamed, 0.1, 3.5)).collect()} == {2}


def test_cells_windows_and_letters_that_lack_something(spark, cells):
    lone = spark.createDataFrame([(1, "hexagonal", 3.0, None, None, None, None, None)], SCHEMA)
    with pytest.raises(Exception, match="needs more lengths"):
        materials.completed(lone).collect()
    scan = "wavelength double, energy double, q_low double, q_high double, tt_low double, tt_high double"
    with pytest.raises(Exception, match="window in q"):
        materials.windows(spark.createDataFrame([(None, None, None, None, 0.1, 0.2)], scan)).collect()
    with pytest.raises(Exception, match="no lattice letter"):
        materials.reflections(cells, 0.1, 3.0).where(materials.lattice_rule(F.lit("Q"))).collect()


def test_anomalous_terms_and_rings(spark, cells):
    """Structure factors, ring numbers and scales equal those of the one-material functions."""
    one = cells.where("id = 5")
    sites = spark.createDataFrame([(5, "Al", 0.0, 0.0, 0.0, 1.0, 0.01, -0.4, 0.3), (5, "Fe", 0.3, 0.5, 0.2, 0.5, None, 0.1, 0.2)], "id long, element string, x double, y double, z double, occ double, u double, f1 double, f2a double")
    table = crystal.form_factor_table(spark)
    made = materials.with_angles(materials.x_ray(materials.families(materials.reflections(materials.with_basis(one, crystal.with_elements(sites, table).drop("element")), 0.1, 5.0))), 0.35)
    b = crystal.reciprocal(crystal.lattice_matrix(*CELLS[4][2:]))
    plain = crystal.structure_factors(crystal.with_angles(crystal.families(crystal.enumerate_hkl(spark, b, 0.1, 5.0), crystal.integer_ops("orthorhombic")), 0.35), sites.drop("id"), table)
    got = {(r.h, r.k, r.l): r.f2 for r in made.collect()}
    want = {(r.h, r.k, r.l): r.f2 for r in plain.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    mine = {r.r: (r.intensity, r.scale) for r in materials.ring_scales(materials.rings(materials.present(made)), 0.35).collect()}
    theirs = {r.r: (r.intensity, r.scale) for r in crystal.ring_scales(crystal.rings(crystal.present(plain)), 0.35, 60.0).collect()}
    assert mine.keys() == theirs.keys() and all(np.allclose(mine[k], theirs[k], rtol=1e-9) for k in mine)


def test_reflections_by_material_need_no_shuffle_after_the_cells(spark, cells):
    rows = materials.rings(materials.with_angles(materials.families(materials.reflections(cells, 0.1, 5.0)), 0.35))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan


def test_axes_are_not_split_by_rounded_operations(spark):
    """4 / sqrt(17) lies 1e-10 beside a limit of rounding: its twelve axes stay twelve."""
    n = math.sqrt(17)
    normals = spark.createDataFrame([(0, 0.0, -1 / n, 4 / n, 1.0)], "r int, hx double, hy double, hz double, share double")
    assert polefigure.pole_axes(normals, rot.symops(spark, "O")).count() == 12
