"""Work and disk that grow with the table, not with its pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polefold.functions import rotations as rot
from polefold.operators import cells, interp


def orientations(spark, n, seed=5, columns="k int, qx double, qy double, qz double, qw double"):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return q, spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], columns).repartition(3)


@pytest.mark.parametrize("group", ["C1", "D2"])
def test_cells_keep_the_walls_of_neighbours_alone(spark, group):
    n = 400 if group == "C1" else 120
    q, centres = orientations(spark, n)
    walls = {r.k: np.array(r.walls) for r in cells.half_spaces(centres, rot.symops(spark, group), math.pi).collect()}
    assert set(walls) == set(range(n))
    images = np.concatenate([np.array([[float(x) for x in rot._times(tuple(p), s)] for p in q]) for s in rot.group(group)])
    assert max(map(len, walls.values())) < len(images)  # two walls an image before: 2 * (len(images) - 1)
    directions = np.random.default_rng(2).normal(size=(300, 3))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    g = np.array([0.6, 0.0, 0.8])
    for k in range(0, n, 17):
        near = images * np.sign(images @ q[k])[:, None]
        near = near[near @ q[k] < 1 - 1e-12]
        sides = np.concatenate([q[k] - near, q[k] + near])
        sides /= np.linalg.norm(sides, axis=1, keepdims=True)
        assert np.allclose(cells.fibre(directions, q[k], g, walls[k]), cells.fibre(directions, q[k], g, sides), atol=1e-9)


def test_a_lone_cell_is_all_space(spark):
    _, centres = orientations(spark, 1)
    walls = cells.half_spaces(centres, rot.symops(spark, "C1"), math.pi)
    beams = spark.createDataFrame([(0, 0.0, 1.0, 0.0)], "a int, bx double, by double, bz double")
    table = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 2.0)], "r int, gx double, gy double, gz double, d double")
    lam = spark.createDataFrame([(0, 1.0), (1, 5.0)], "l int, lam double")
    assert [(r.l, round(r.v, 9)) for r in cells.spectra(walls, beams, table, lam).collect()] == [(0, 0.125)]


def test_thinning_in_stretches_equals_the_sequential_rule(spark):
    q, rows = orientations(spark, 300)
    images = [np.array([[float(x) for x in rot._times(tuple(p), s)] for p in q]) for s in rot.group("D2")]
    like = np.max([np.abs(q @ i.T) for i in images], axis=0)
    near = like > math.cos(math.radians(30.0) / 2)
    for within in (None, "cell"):
        kept = []
        for k in range(300):
            if not any(near[k, t] and (within is None or k % 2 == t % 2) for t in kept):
                kept.append(k)
        parts = rows.withColumn("cell", F.col("k") % 2)
        got = rot.thin_greedy(parts, rot.symops(spark, "D2"), 30.0, within=within, first=40)
        assert sorted(r.k for r in got.collect()) == kept


def test_thinning_lists_no_pairs_between_all_rows(spark, monkeypatch):
    _, rows = orientations(spark, 600)
    whole, seen = rot.near_pairs, []

    def counted(*args):
        out = whole(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(rot, "near_pairs", counted)
    ops = rot.symops(spark, "C1")
    rot.thin_greedy(rows, ops, 60.0, first=40).collect()
    assert sum(seen) < whole(rows, rows.withColumnRenamed("k", "t"), ops, 60.0).count() / 10


def test_neutron_tables_group_by_what_they_use(spark, data):
    from polefold.plans import catalog

    for name in ("neutron_table", "steel_table"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        keys = [x.split("]")[0] for x in plan.split("Aggregate [")[1:]]
        assert not any("gx#" in x or "m00#" in x for x in keys), name


@pytest.mark.parametrize(("group", "cut"), [("C1", 180.0), ("O", 30.0), ("O", 65.0), ("D6", 100.0)])
def test_sums_over_a_kernel_need_no_pairs(spark, monkeypatch, group, cut):
    _, targets = orientations(spark, 300, seed=7)
    _, grid = orientations(spark, 90, seed=8)
    ops, values = rot.symops(spark, group), grid.select("k", (F.col("k") % 7 + 0.5).alias("v"))
    want = {r.m: r.v for r in interp.apply(interp.so3_kernel(targets, grid, ops, 0.3, cut), values).collect()}
    monkeypatch.setattr(interp, "TARGET_ROWS", 100)
    monkeypatch.setattr(interp, "GRID_ROWS", 40)
    monkeypatch.setattr(rot, "near_images", None)
    lost = spark.createDataFrame([(-1, None, 0.0, 0.0, 1.0)], targets.schema)
    got = {r.m: r.v for r in interp.so3_gather(targets.union(lost), grid.join(values, "k"), ops, 0.3, cut).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[m], want[m], rel_tol=1e-9) for m in want)


def test_so3_interp_lists_no_pairs(spark, data, monkeypatch):
    from polefold.plans import catalog

    monkeypatch.setattr(rot, "near_images", None)
    assert catalog.QUERIES["so3_interp"](spark, data).count() == 500


@pytest.mark.parametrize("cut", [20.0, 90.0])
def test_sums_over_axes_need_no_pairs(spark, data, monkeypatch, cut):
    from polefold.plans import catalog

    _, rows = orientations(spark, 300)
    n = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2)
    axes = rows.select("k", *[(F.col(f"q{c}") / n).alias(f"u{c}") for c in "xyz"], (F.col("k") % 7 + 0.5).alias("v"))
    want = {r.m: r.v for r in interp.apply(interp.s2_kernel(axes, axes.where("k % 3 = 0"), 0.3, cut), axes.select("k", "v")).collect()}
    monkeypatch.setattr(interp, "TARGET_ROWS", 100)
    monkeypatch.setattr(interp, "GRID_ROWS", 40)
    monkeypatch.setattr(interp, "s2_kernel", None)
    got = {r.m: r.v for r in interp.s2_gather(axes, axes.where("k % 3 = 0"), 0.3, cut).collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[m], want[m], rel_tol=1e-9) for m in want)
    assert catalog.QUERIES["s2_interp"](spark, data).count() > 0


@pytest.mark.parametrize(("group", "limit", "grouped"), [("O", 40.0, False), ("O", 60.0, True), ("D3", 20.0, False), ("C1", 100.0, False)])
def test_pairs_are_grouped_where_two_images_can_be_near(spark, group, limit, grouped):
    a, left = orientations(spark, 60, seed=1)
    b, right = orientations(spark, 40, seed=2)
    turns = [np.array([[float(x) for x in rot._times(tuple(q), s)] for q in b]) for s in rot.group(group)]
    like = np.max([np.abs(a @ t.T) for t in turns], axis=0)
    pairs = rot.near_pairs(left, right.withColumnRenamed("k", "t"), rot.symops(spark, group), limit)
    assert ("Aggregate" in pairs._jdf.queryExecution().optimizedPlan().toString()) == grouped
    got = [((r.k, r.t), r.c) for r in pairs.collect()]
    want = {(int(i), int(j)): like[i, j] for i, j in np.argwhere(like >= math.cos(math.radians(limit) / 2))}
    assert len(got) == len(want) and set(dict(got)) == set(want)
    assert all(abs(want[p] - c) < 1e-9 for p, c in got)


def test_rows_are_not_repeated_around_few_targets(spark):
    a, rows = orientations(spark, 200, seed=3)
    b, targets = orientations(spark, 5, seed=4)
    ops = rot.symops(spark, "O")
    turns = [np.array([[float(x) for x in rot._times(tuple(q), s)] for q in b]) for s in rot.group("O")]
    like = np.max([np.abs(a @ t.T) for t in turns], axis=0)
    got = {r.k: (r.t, r.angle) for r in rot.nearest_misorientation(rows, targets, ops, first_deg=30.0, few=True).collect()}
    assert {k: t for k, (t, _) in got.items()} == dict(enumerate(like.argmax(1)))
    assert all(abs(angle - math.degrees(2 * math.acos(like[k].max()))) < 1e-6 for k, (_, angle) in got.items())


def test_nested_cells_hold_every_row_of_the_table(spark, tmp_path):
    import duckdb

    from polefold.plans import catalog

    values = np.random.default_rng(6).normal(size=(40, 64))
    rows = [(i, list(map(float, v)), None if i % 11 == 10 else i % 11) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.level, r.node, r.k) for r in catalog.QUERIES["nested_cells"](spark, str(tmp_path)).collect())
    assert sorted((level, k) for level, _, k in got) == [(level, k) for level in (0, 1) for k in range(40)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.ORACLE["nested_cells"]).fetchall())
