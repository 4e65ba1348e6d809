"""Many materials at once: cells, reflections and structure factors as rows of tables.

cell(id, system, a, b, c, alpha, beta, gamma), in Angstrom and degrees, is one material a row. What
follows from a cell alone is an expression of its row; reflections are generated from the row's own
limits, a family keeps the row that is its smallest member, and a cell's basis travels as one array.
So materials may be as many as the table holds: only joins of sites to cells and ring numbers shuffle,
both by ``id``. A null in a cell gives null results and no reflections.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import crystal

SYSTEMS = ("cubic", "hexagonal", "trigonal", "tetragonal", "orthorhombic", "monoclinic", "triclinic")


def _turns() -> tuple[Column, Column, Column]:
    return tuple(F.radians(F.col(n)) for n in ("alpha", "beta", "gamma"))


def lattice(cells: DataFrame) -> DataFrame:
    """m00 ... m22: rows of the upper triangular lattice matrix (c along z, a* along x), r00 ... r22: 2 pi times its inverse, volume."""
    al, be, ga = _turns()
    a, b, c = (F.col(n) for n in "abc")
    cgs = (F.cos(al) * F.cos(be) - F.cos(ga)) / (F.sin(al) * F.sin(be))  # cosine of the reciprocal gamma
    rows = cells.withColumns({
        "m00": a * F.sin(be) * F.sqrt(1 - cgs * cgs), "m01": -a * F.sin(be) * cgs, "m02": a * F.cos(be),
        "m11": b * F.sin(al), "m12": b * F.cos(al), "m22": c.cast("double"),
    })
    m = {n: F.col(f"m{n}") for n in ("00", "01", "02", "11", "12", "22")}
    turn = F.lit(2 * math.pi)
    return rows.withColumns({
        "volume": m["00"] * m["11"] * m["22"], "r00": turn / m["00"], "r11": turn / m["11"], "r22": turn / m["22"],
        "r01": -turn * m["01"] / (m["00"] * m["11"]), "r12": -turn * m["12"] / (m["11"] * m["22"]),
        "r02": turn * (m["01"] * m["12"] - m["02"] * m["11"]) / (m["00"] * m["11"] * m["22"]),
    })


def completed(cells: DataFrame) -> DataFrame:
    """Cells with the lengths and angles that their system fixes filled in; one that lacks a needed length is an error."""
    s, a = F.col("system"), F.col("a")
    lone = s.isin("cubic", "trigonal")
    b = F.when(lone | s.isin("tetragonal", "hexagonal"), a).otherwise(F.col("b"))
    c = F.when(lone, a).otherwise(F.col("c"))
    right = s.isin("cubic", "tetragonal", "orthorhombic")
    alpha = F.when(right, 90.0).otherwise(F.coalesce("alpha", F.lit(90.0)))
    beta = F.when(s == "trigonal", alpha).when(right, 90.0).otherwise(F.coalesce("beta", F.lit(90.0)))
    gamma = F.when(s == "hexagonal", 120.0).when(s == "trigonal", alpha).when(right, 90.0).otherwise(F.coalesce("gamma", F.lit(90.0)))
    lacking = s.isNotNull() & (a.isNull() | b.isNull() | c.isNull())
    c = F.when(lacking, F.raise_error(F.concat(s, F.lit(" needs more lengths"))).cast("double")).otherwise(c)
    kept = [n for n in cells.columns if n not in ("a", "b", "c", "alpha", "beta", "gamma")]
    return cells.select(*kept, a.alias("a"), b.alias("b"), c.alias("c"), alpha.alias("alpha"), beta.alias("beta"), gamma.alias("gamma"))


def metric(cells: DataFrame) -> DataFrame:
    """Dot products aa, ab, ac, bb, bc, cc of the lattice vectors."""
    al, be, ga = _turns()
    a, b, c = (F.col(n) for n in "abc")
    return cells.withColumns({"aa": a * a, "ab": a * b * F.cos(ga), "ac": a * c * F.cos(be), "bb": b * b, "bc": b * c * F.cos(al), "cc": c * c})


def named_system(tol: float = 0.05) -> Column:
    """System of a cell's lengths and angles; the unique axis of a tetragonal cell is c, of a monoclinic one b."""
    same = lambda *v: F.greatest(*v) - F.least(*v) < tol
    a, b, c, al, be, ga = (F.col(n).cast("double") for n in ("a", "b", "c", "alpha", "beta", "gamma"))
    at = lambda x, value: F.abs(x - value) < tol
    right = at(al, 90) & at(be, 90) & at(ga, 90)
    return (
        F.when(right & same(a, b, c), "cubic").when(right & same(a, b), "tetragonal").when(right, "orthorhombic")
        .when(same(a, b) & at(al, 90) & at(be, 90) & at(ga, 120), "hexagonal").when(same(a, b, c) & same(al, be, ga), "trigonal")
        .when(at(al, 90) & at(ga, 90), "monoclinic").otherwise("triclinic")
    )


def windows(scans: DataFrame) -> DataFrame:
    """q_min, q_max, wavelength of scans(wavelength, energy, q_low, q_high, tt_low, tt_high), nulls where not given.

    A wavelength goes before an energy, a window in q before one in two-theta; too little is an error.
    """
    lam = F.coalesce(F.col("wavelength"), crystal.KEV_A / F.col("energy"))
    by_q = F.col("q_low").isNotNull() & F.col("q_high").isNotNull()
    by_angle = lam.isNotNull() & F.col("tt_low").isNotNull() & F.col("tt_high").isNotNull()
    at = lambda n: 4 * math.pi / lam * F.sin(F.col(n) / 2)
    none = F.raise_error(F.lit("a window in q, or a wavelength or energy with a window in two-theta")).cast("double")
    low = F.when(by_q, F.col("q_low")).when(by_angle, F.greatest(at("tt_low"), F.lit(0.0))).otherwise(none)
    high = F.when(by_q, F.col("q_high")).when(by_angle, at("tt_high")).otherwise(none)
    return scans.withColumns({"q_min": low, "q_max": high, "wavelength": lam})


def reflections(cells: DataFrame, q_min: float | Column, q_max: float | Column, most: int | None = None) -> DataFrame:
    """One row a reflection h, k, l with gx, gy, gz (no 2 pi), q of every cell, its columns kept, the origin left out.

    An index is at most a q / 2 pi for its edge a, so the ranges are those of the cell; ``most`` bounds them further.
    Cells are dealt out by ``id`` first: a row becomes hundreds, and what follows by material needs no other shuffle.
    """
    cells = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    q_min, q_max = (F.lit(x) if not isinstance(x, Column) else x for x in (q_min, q_max))
    rows = lattice(cells).withColumns({"_q0": q_min, "_q1": q_max})
    for name, edge in zip("hkl", "abc"):
        top = F.floor(F.col(edge) * F.col("_q1") / (2 * math.pi) + 1e-9).cast("int")
        top = F.least(top, F.lit(most)) if most is not None else top
        rows = rows.withColumn(name, F.explode(F.sequence(-top, top)))
    rows = rows.where("h <> 0 or k <> 0 or l <> 0")
    h, k, l = (F.col(n) for n in "hkl")
    per = {"gx": F.col("r00") * h + F.col("r01") * k + F.col("r02") * l, "gy": F.col("r11") * k + F.col("r12") * l, "gz": F.col("r22") * l}
    rows = rows.withColumns({n: x / (2 * math.pi) for n, x in per.items()})
    g = [F.col(n) for n in ("gx", "gy", "gz")]
    rows = rows.withColumn("q", 2 * math.pi * F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2]))
    return rows.where(F.col("q").between(F.col("_q0"), F.col("_q1"))).drop("_q0", "_q1")


def _images(ops: list[np.ndarray]) -> Column:
    turned = [[sum((int(m[i, j]) * F.col(c) for j, c in enumerate("hkl") if m[i, j]), F.lit(0)).cast("int") for i in range(3)] for m in ops]
    return F.array_distinct(F.array(*[F.struct(*[x.alias(n) for x, n in zip(t, "hkl")]) for t in turned]))


def equivalents(key: Column, groups: dict[str, list[np.ndarray]]) -> Column:
    """Distinct images of (h, k, l) under the group that ``key`` names; null where it names none of them."""
    found = None
    for name, ops in groups.items():
        found = F.when(key == name, _images(ops)) if found is None else found.when(key == name, _images(ops))
    return found


def _forms(system: str) -> list[Column]:
    """Each image of (h, k, l) under the rotations of a system as one whole number in the order of (h, k, l), without its sign."""
    halves: dict[bytes, np.ndarray] = {}
    for m in crystal.integer_ops(system):
        if (-m).tobytes() not in halves:
            halves[m.tobytes()] = m
    digits = np.array([1 << 42, 1 << 21, 1])
    h, k, l = (F.col(c).cast("long") for c in "hkl")
    return [F.abs(sum(int(f) * x for f, x in zip(digits @ m, (h, k, l)))) for m in halves.values()]


def families(rows: DataFrame) -> DataFrame:
    """Smallest member of every family, with mult. All members have one q, so a family is whole or absent and nothing is grouped.

    Images are compared as whole numbers (indices below 2^20); mult is the group's order by the number of
    operations that keep the member. Reflections of a cell whose ``system`` is unknown pair with their inverse alone.
    """
    system = F.when(F.col("system").isin(*SYSTEMS), F.col("system")).otherwise("triclinic")
    own = F.col("h").cast("long") * (1 << 42) + F.col("k").cast("long") * (1 << 21) + F.col("l").cast("long")
    kept, order = None, None
    for name in SYSTEMS:
        forms = _forms(name)
        top = F.greatest(*forms) if len(forms) > 1 else forms[0]
        kept = F.when(system == name, own == -top) if kept is None else kept.when(system == name, own == -top)
        fixed = sum(F.when(x == -own, 1).otherwise(0) for x in forms)
        order = F.when(system == name, (2 * len(forms) / fixed).cast("int")) if order is None else order.when(system == name, (2 * len(forms) / fixed).cast("int"))
    return rows.where(kept).withColumn("mult", order)


def lattice_rule(letter: Column) -> Column:
    """Selection rule of the lattice letter of each row; an unknown letter is an error."""
    rule = None
    for name in "PIABCFR":
        rule = F.when(letter == name, crystal.centering(name)) if rule is None else rule.when(letter == name, crystal.centering(name))
    return rule.otherwise(F.raise_error(F.concat(F.lit("no lattice letter "), F.coalesce(letter, F.lit("null")))).cast("boolean"))


def with_basis(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """Cells with ``basis``, the array of their sites(id, ...), in a fixed order; a cell without sites has an empty one.

    One row holds one cell's basis, which the cell bounds.
    """
    fields = [c for c in sites.columns if c != "id"]
    basis = sites.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("basis"))
    return cells.join(basis, "id", "left").withColumn("basis", F.coalesce("basis", F.array().cast(basis.schema["basis"].dataType)))


def _amplitude(rows: DataFrame, part) -> DataFrame:
    """Each row's reflection with f2 = |F|^2 in place of ``basis``: ``part(site)`` gives real and imaginary scattering, with the site's weight.

    Sites are summed by all columns, ``id`` among them, so rows that are dealt out by ``id`` stay where they are. Without sites f2 is 0.
    """
    keys = [c for c in rows.columns if c != "basis"]
    each = rows.select(*keys, F.explode_outer("basis").alias("_s"))
    site = F.col("_s")
    real, imaginary = part(site)
    each = each.select(*keys, real.alias("_a"), imaginary.alias("_b"), (2 * math.pi * (F.col("h") * site["x"] + F.col("k") * site["y"] + F.col("l") * site["z"])).alias("_p"))
    a, b, cosine, sine = F.col("_a"), F.col("_b"), F.cos("_p"), F.sin("_p")
    total = each.groupBy(*keys).agg(F.coalesce(F.sum(a * cosine - b * sine), F.lit(0.0)).alias("_a"), F.coalesce(F.sum(a * sine + b * cosine), F.lit(0.0)).alias("_b"))
    return total.select(*keys, (a * a + b * b).alias("f2"))


def x_ray(rows: DataFrame) -> DataFrame:
    """f2 of reflections whose ``basis`` has x, y, z, occ, u, fa, fb, fc and, where there, f1, f2a (anomalous terms)."""
    names = set(rows.schema["basis"].dataType.elementType.names)
    q2 = F.col("q") * F.col("q")
    s2 = q2 / (16 * math.pi * math.pi)

    def part(site):
        weight = site["occ"] * F.exp(-q2 * F.coalesce(site["u"], F.lit(0.0)) / 2)
        real = sum((site["fa"][i] * F.exp(-site["fb"][i] * s2) for i in range(4)), site["fc"])
        extra = [F.coalesce(site[n], F.lit(0.0)) if n in names else F.lit(0.0) for n in ("f1", "f2a")]
        return weight * (real + extra[0]), weight * extra[1]

    return _amplitude(rows, part)


def neutron(rows: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """f2 (barn) of reflections whose ``basis`` has x, y, z, b_coh (fm), u2; at most the threshold goes."""
    weight = lambda site: site["b_coh"] * F.exp(-F.col("q") * F.col("q") * site["u2"] / 2)
    return _amplitude(rows, lambda s: (weight(s), F.lit(0.0))).withColumn("f2", 0.01 * F.col("f2")).where(F.col("f2") > threshold)


def present(rows: DataFrame, share: float = 1e-8, cutoff: float = 0.0) -> DataFrame:
    """Without systematic absences; ``intensity`` is mult f2 in percent of the material's largest, at least ``cutoff`` of it."""
    own = Window.partitionBy("id")
    rows = rows.withColumns({"_f": F.max("f2").over(own), "_i": F.max(F.col("mult") * F.col("f2")).over(own)}).where(F.col("f2") > share * F.col("_f"))
    return rows.withColumn("intensity", 100 * F.col("mult") * F.col("f2") / F.col("_i")).where(F.col("intensity") >= 100 * cutoff).drop("_f", "_i")


def with_angles(rows: DataFrame, wavelength: float | Column) -> DataFrame:
    """d and two_theta; reflections that the wavelength cannot reach go."""
    s = F.col("q") * wavelength / (4 * math.pi)
    return rows.where(s <= 1.0).withColumns({"d": 2 * math.pi / F.col("q"), "two_theta": 2 * F.asin(s)})


def rings(rows: DataFrame, rtol: float = 1e-6) -> DataFrame:
    """Ring number within the material: a gap in its sorted two-theta begins a new one."""
    order = Window.partitionBy("id").orderBy("two_theta", "h", "k", "l")
    before = F.lag("two_theta").over(order)
    gap = F.when(before.isNull() | (F.abs(F.col("two_theta") - before) > rtol * before), 1).otherwise(0)
    return rows.withColumn("_gap", gap).withColumn("r", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1).drop("_gap")


def ring_scales(ringed: DataFrame, wavelength: float | Column, **model: str) -> DataFrame:
    """Per material and ring: intensity with all factors, and 1 / intensity with geometric mean 1 over the material."""
    wavelength = F.lit(wavelength) if not isinstance(wavelength, Column) else wavelength
    i = F.col("mult") * F.col("f2") * crystal.intensity_factor(F.col("two_theta"), **model) * F.pow(wavelength, F.lit(3.0)) / (F.col("volume") * F.col("volume"))
    total = ringed.groupBy("id", "r").agg(F.sum(i).alias("intensity"))
    mean = F.avg(F.log(1 / F.col("intensity"))).over(Window.partitionBy("id"))
    return total.withColumn("scale", 1 / F.col("intensity") / F.exp(mean))


def q_slopes(rows: DataFrame) -> DataFrame:
    """q of h, k, l in each row's own cell and dq_a ... dq_gamma, its slopes by lengths (Angstrom) and angles (degrees).

    With G the metric tensor and v = G^-1 h, q = 2 pi sqrt(h v) and dq = -(2 pi)^2 (v dG v) / (2 q).
    """
    rows = metric(rows)
    g = {n: F.col(n) for n in ("aa", "ab", "ac", "bb", "bc", "cc")}
    h, k, l = (F.col(n) for n in "hkl")
    adj = [[g["bb"] * g["cc"] - g["bc"] * g["bc"], g["ac"] * g["bc"] - g["ab"] * g["cc"], g["ab"] * g["bc"] - g["ac"] * g["bb"]]]
    adj.append([adj[0][1], g["aa"] * g["cc"] - g["ac"] * g["ac"], g["ab"] * g["ac"] - g["aa"] * g["bc"]])
    adj.append([adj[0][2], adj[1][2], g["aa"] * g["bb"] - g["ab"] * g["ab"]])
    det = g["aa"] * adj[0][0] + g["ab"] * adj[0][1] + g["ac"] * adj[0][2]
    rows = rows.withColumns({f"_v{i}": (adj[i][0] * h + adj[i][1] * k + adj[i][2] * l) / det for i in range(3)})
    v = [F.col(f"_v{i}") for i in range(3)]
    rows = rows.withColumn("q", 2 * math.pi * F.sqrt(h * v[0] + k * v[1] + l * v[2]))
    a, b, c = (F.col(n) for n in "abc")
    al, be, ga = _turns()
    degree = math.pi / 180
    forms = {
        "a": 2 * v[0] * (a * v[0] + b * F.cos(ga) * v[1] + c * F.cos(be) * v[2]), "b": 2 * v[1] * (b * v[1] + a * F.cos(ga) * v[0] + c * F.cos(al) * v[2]),
        "c": 2 * v[2] * (c * v[2] + a * F.cos(be) * v[0] + b * F.cos(al) * v[1]), "alpha": -2 * degree * b * c * F.sin(al) * v[1] * v[2],
        "beta": -2 * degree * a * c * F.sin(be) * v[0] * v[2], "gamma": -2 * degree * a * b * F.sin(ga) * v[0] * v[1],
    }
    made = rows.withColumns({f"dq_{n}": -2 * math.pi**2 * x / F.col("q") for n, x in forms.items()})
    return made.drop("aa", "ab", "ac", "bb", "bc", "cc", "_v0", "_v1", "_v2")


def images(sites: DataFrame, operations: list[list[list[float]]]) -> DataFrame:
    """Every site under every operation (rows of x, y, z factors and an offset), op its number, in the cell from 0 to 1."""
    own = [F.col(n) for n in "xyz"]
    each = []
    for number, rows in enumerate(operations):
        moved = [sum((float(f) * x for f, x in zip(row, own) if f), F.lit(float(row[3]))) for row in rows]
        each.append(F.struct(F.lit(number).alias("op"), *[(m - F.floor(m)).alias(n) for m, n in zip(moved, "xyz")]))
    kept = [c for c in sites.columns if c not in "xyz"]
    return sites.select(*kept, F.explode(F.array(*each)).alias("_i")).select(*kept, "_i.*")
