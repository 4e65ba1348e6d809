"""Unit quaternions (x, y, z, w) as four columns: products, symmetry, zones, distances."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def quat(prefix: str = "") -> Quat:
    return tuple(F.col(f"{prefix}q{c}") for c in "xyzw")


def product(a: Quat, b: Quat) -> Quat:
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def inverse(q: Quat) -> Quat:
    return (-q[0], -q[1], -q[2], q[3])


def dot(a: Quat, b: Quat) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]


def rotate(q: Quat, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """R(q) v, written out so that it stays inside generated code."""
    x, y, z, w = q
    a, b, c = v
    return (
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - z * w) * b + 2 * (x * z + y * w) * c,
        2 * (x * y + z * w) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - x * w) * c,
        2 * (x * z - y * w) * a + 2 * (y * z + x * w) * b + (1 - 2 * (x * x + y * y)) * c,
    )


def from_rotvec(x: Column, y: Column, z: Column) -> Quat:
    angle = F.sqrt(x * x + y * y + z * z)
    scale = F.when(angle < 1e-12, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return (x * scale, y * scale, z * scale, F.cos(angle / 2))


def to_rotvec(q: Quat) -> tuple[Column, Column, Column]:
    sign = F.when(q[3] < 0, -1.0).otherwise(1.0)
    half = F.acos(F.least(F.abs(q[3]), F.lit(1.0)))
    scale = F.when(half < 1e-12, F.lit(2.0)).otherwise(2 * half / F.sin(half)) * sign
    return (q[0] * scale, q[1] * scale, q[2] * scale)


def normalised(x: Column, y: Column, z: Column, w: Column) -> Quat:
    n = F.sqrt(x * x + y * y + z * z + w * w)
    return (x / n, y / n, z / n, w / n)


def cyclic(n: int) -> list[tuple[float, float, float, float]]:
    return [(0.0, 0.0, math.sin(math.pi * i / n), math.cos(math.pi * i / n)) for i in range(n)]


def _times(a: tuple, b: tuple) -> tuple:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def _closure(generators: list[tuple]) -> list[tuple]:
    """All products, at full precision; nine decimals only tell elements apart and give their order."""

    def signed(q: tuple) -> tuple:
        sign = next((math.copysign(1.0, c) for c in (q[3], q[0], q[1], q[2]) if abs(c) > 1e-9), 1.0)
        return tuple(sign * c if abs(c) > 1e-12 else 0.0 for c in q)

    def key(q: tuple) -> tuple:
        return tuple(round(c, 9) + 0.0 for c in q)

    one = (0.0, 0.0, 0.0, 1.0)
    found, fresh = {key(one): one}, [one]
    while fresh:
        made = {key(q): q for q in (signed(_times(a, b)) for a, b in itertools.product(fresh, generators))}
        fresh = [q for k, q in made.items() if k not in found]
        found = made | found
    return [found[k] for k in sorted(found, key=lambda q: (-q[3], q))]


_X2, _Y2 = (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)
_DIAGONAL = (0.5, 0.5, 0.5, 0.5)


def group(name: str) -> list[tuple[float, float, float, float]]:
    """Proper rotations of a point group (C1 C2 C3 C4 C6, D2 D3 D4 D6, T, O), generated from two turns."""
    kind, order = name[0], int(name[1:] or 0)
    if name == "T":
        generators = [(0.0, 0.0, 1.0, 0.0), _DIAGONAL]
    elif name == "O":
        generators = [cyclic(4)[1], _DIAGONAL]
    elif kind in "CD" and order in (1, 2, 3, 4, 6):
        generators = [cyclic(order)[1]] if order > 1 else []
        generators += [_Y2 if order == 3 else _X2] if kind == "D" else []  # D3: turns about the a axes, with a* along x
    else:
        raise ValueError(f"unknown point group {name}")
    return _closure(generators) if generators else [(0.0, 0.0, 0.0, 1.0)]


#: fixed value: undecided pairs that the driver may hold while thinning
OPEN_PAIRS = 200_000
#: rows of the first stretch of keys while thinning
FIRST_ROWS = 4_000
#: crystal system -> rotations (fixed convention: the monoclinic turn is about z)
SYSTEMS = {"cubic": "O", "hexagonal": "D6", "trigonal": "D3", "tetragonal": "D4", "orthorhombic": "D2", "monoclinic": "C2", "triclinic": "C1"}


def symops(spark: SparkSession, name: str) -> DataFrame:
    """symop(g, qx, qy, qz, qw): at most 24 rows."""
    rows = [(i, *map(float, q)) for i, q in enumerate(group(name))]
    return spark.createDataFrame(rows, "g int, qx double, qy double, qz double, qw double")


def equivalents(orientations: DataFrame, ops: DataFrame) -> DataFrame:
    """One row per orientation and symmetry operation (at most 24), the product from the right."""
    s = ops.select("g", *[F.col(f"q{c}").alias(f"sq{c}") for c in "xyzw"])
    both = orientations.crossJoin(F.broadcast(s))
    turned = product(quat(), quat("s"))
    others = [c for c in orientations.columns if c not in ("qx", "qy", "qz", "qw")]
    return both.select(*others, "g", *[t.alias(f"q{c}") for t, c in zip(turned, "xyzw")])


def fundamental_zone(orientations: DataFrame, ops: DataFrame, key: str = "k") -> DataFrame:
    """The equivalent with the largest |w| (first operation on ties), with w >= 0.

    The symmetry operations are an array literal, so nothing is exploded and nothing shuffles.
    """
    rows = ops.orderBy("g").collect()  # at most 24
    turns = F.array(*[F.struct(F.lit(-r["g"]).alias("g"), *[F.lit(r[f"q{c}"]).alias(c) for c in "xyzw"]) for r in rows])

    def image(turn: Column) -> Column:
        x, y, z, w = product(quat(), tuple(turn[c] for c in "xyzw"))
        return F.struct(F.round(F.abs(w), 9).alias("m"), turn["g"].alias("g"), x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))

    best = F.array_max(F.transform(turns, image))
    sign = F.when(F.col("_best.w") < 0, -1.0).otherwise(1.0)
    others = [c for c in orientations.columns if c not in ("qx", "qy", "qz", "qw")]
    return orientations.withColumn("_best", best).select(*others, *[(F.col(f"_best.{c}") * sign).alias(f"q{c}") for c in "xyzw"])


def grid_cells(values: list[Column], size: float, reach: float) -> Column:
    """Cells (arrays of whole numbers) of a grid that a ball of radius ``reach`` <= size / 2 around a point meets."""

    def grown(ends: Column):
        return lambda have: F.transform(ends, lambda x: F.concat(have, F.array(x)))

    found = F.array(F.array().cast("array<int>"))
    for v in values:
        ends = F.array_distinct(F.array(*[F.floor((v + e) / size).cast("int") for e in ((-reach, reach) if reach else (0.0,))]))
        found = F.flatten(F.transform(found, grown(ends)))
    return found


def near_images(left: DataFrame, right: DataFrame, ops: DataFrame, limit_deg: float, within: str | None = None, few: bool = False) -> DataFrame:
    """(k, q, t, tq, c): each image of ``right`` (t, q) within ``limit_deg`` of ``left`` (k, q), with the sign at which c = cos(angle / 2) >= 0.

    Unit quaternions at that angle are a known chord apart. Space is cut into cells of twice the
    chord: an image of the right side lies in one, the ball around a quaternion of the left side
    meets 16 at most. The join is on cells (and on the column ``within``, where given), then verified.
    Where the right side is ``few``, the balls are those around its images, and no row of the left side is repeated.
    """
    limit = math.radians(min(limit_deg, 180.0))
    chord = 2 * math.sin(limit / 4) + 1e-9
    keys = ["_cell"] + ([within] if within else [])
    rest = [within] if within else []
    images = equivalents(right.select("t", *rest, "qx", "qy", "qz", "qw"), ops)
    signs = F.explode(F.array(F.lit(-1.0), F.lit(1.0)))
    both = images.select("t", *rest, "qx", "qy", "qz", "qw", signs.alias("_s")).select("t", *rest, *[(F.col("_s") * F.col(f"q{c}")).alias(f"tq{c}") for c in "xyzw"])
    placed = both.withColumn("_cell", F.explode(grid_cells([F.col(f"tq{c}") for c in "xyzw"], 2 * chord, chord if few else 0.0)))
    asked = left.select("k", *rest, "qx", "qy", "qz", "qw").withColumn("_cell", F.explode(grid_cells(list(quat()), 2 * chord, 0.0 if few else chord)))
    c = F.least(dot(quat(), quat("t")), F.lit(1.0))
    return asked.join(placed, keys).where(c >= math.cos(limit / 2) - 1e-12).withColumn("c", c)


def near_pairs(left: DataFrame, right: DataFrame, ops: DataFrame, limit_deg: float, within: str | None = None) -> DataFrame:
    """(k, t, c): pairs of ``left`` (k, q) and ``right`` (t, q) within ``limit_deg`` under symmetry, c = cos(angle / 2)."""
    turns = [2 * math.acos(min(abs(r.qw), 1.0)) for r in ops.select("qw").collect()]  # at most 24
    if 2 * math.radians(limit_deg) < min((t for t in turns if t > 1e-6), default=2 * math.pi) - 1e-6:  # images are too far apart for two to be near
        return near_images(left, right, ops, limit_deg, within).select("k", "t", "c")
    return near_images(left, right, ops, limit_deg, within).groupBy("k", "t").agg(F.max("c").alias("c"))


def nearest_misorientation(orientations: DataFrame, targets: DataFrame, ops: DataFrame, key: str = "k", first_deg: float | None = None, within: str | None = None, few: bool = False) -> DataFrame:
    """key, t and angle in degrees: the nearest target (smallest id on ties).

    Pairs are searched by cells, first within an angle that holds a few of the targets' images on average
    (or ``first_deg``); what has found nothing goes on at twice the limit, so that wide searches are
    left to the few rows that need them. Images go straight into the best of a row, which is one a task
    and row where targets are ``few`` (see :func:`near_images`).
    """
    from ..plans.state import materialise

    rest = [within] if within else []
    left = orientations.select(F.col(key).alias("k"), *rest, "qx", "qy", "qz", "qw")
    right = targets.select(F.col("k").alias("t"), *rest, "qx", "qy", "qz", "qw")
    found, limit = None, first_deg
    if limit is None:  # a ball of angle t holds (t - sin t) / pi of all rotations
        images = max(right.count() * ops.count(), 1)
        limit = math.degrees(min((48 * math.pi / images) ** (1 / 3), math.pi))
    while True:
        pairs = near_images(left, right, ops, limit, within, few).select("k", "t", F.round("c", 12).alias("c"))
        best = pairs.groupBy("k").agg(F.max(F.struct("c", (-F.col("t")).alias("t"))).alias("m"))
        best = materialise(best.select("k", (-F.col("m.t")).alias("t"), F.degrees(2 * F.acos(F.col("m.c"))).alias("angle")))
        found = best if found is None else found.union(best)
        left = materialise(left.join(best.select("k"), "k", "left_anti"))
        if limit >= 180 or left.isEmpty():
            return found.select(F.col("k").alias(key), "t", "angle")
        limit = min(2 * limit, 180.0)


def children(orientations: DataFrame, step: float, stencil: int = 6) -> DataFrame:
    """Orientations moved by rotation vectors of length step: 6 axis, 12 edge or 26 cube directions."""
    points = [p for p in itertools.product((-1, 0, 1), repeat=3) if any(p)]
    wanted = {6: 1, 12: 2}.get(stencil)
    points = [p for p in points if wanted is None or sum(map(abs, p)) == wanted]
    arms = F.array(*[F.struct(F.lit(i).alias("child"), *[F.lit(step * c / math.dist(p, (0, 0, 0))).alias(n) for c, n in zip(p, "abc")]) for i, p in enumerate(points)])
    turned = orientations.select("*", F.explode(arms).alias("_arm"))
    made = product(quat(), from_rotvec(F.col("_arm.a"), F.col("_arm.b"), F.col("_arm.c")))
    return turned.select(F.col("k").alias("parent"), F.col("_arm.child").alias("child"), *[m.alias(f"q{c}") for m, c in zip(made, "xyzw")])


def thin_cells(orientations: DataFrame, cell: float, key: str = "k") -> DataFrame:
    """First orientation (by key) of every cell of rotation-vector space."""
    x, y, z = to_rotvec(quat())
    cells = [F.floor(c / cell).alias(n) for c, n in ((x, "cx"), (y, "cy"), (z, "cz"))]
    return orientations.select(key, *cells).groupBy("cx", "cy", "cz").agg(F.min(key).alias(key), F.count("*").alias("members"))


def _clear_of(rows: DataFrame, kept: DataFrame, ops: DataFrame, min_deg: float, within: str | None) -> DataFrame:
    """Rows (k, q) that no row of ``kept`` (t, q) is nearer to than ``min_deg``.

    The images of ``kept`` are placed in all cells that their balls meet, a row lies in one: no row is repeated.
    """
    limit = math.radians(min(min_deg, 180.0))
    chord = 2 * math.sin(limit / 4) + 1e-9
    keys = ["_cell"] + ([within] if within else [])
    rest = [within] if within else []
    images = equivalents(kept.select(*rest, "qx", "qy", "qz", "qw"), ops).withColumn("_s", F.explode(F.array(F.lit(-1.0), F.lit(1.0))))
    placed = images.select(*rest, *[(F.col("_s") * F.col(f"q{c}")).alias(f"tq{c}") for c in "xyzw"])
    placed = placed.withColumn("_cell", F.explode(grid_cells([F.col(f"tq{c}") for c in "xyzw"], 2 * chord, chord)))
    one = rows.withColumn("_cell", grid_cells(list(quat()), 2 * chord, 0.0)[0])
    near = dot(tuple(one[f"q{c}"] for c in "xyzw"), tuple(placed[f"tq{c}"] for c in "xyzw")) > math.cos(limit / 2)
    same = [one[n].eqNullSafe(placed[n]) if n != "_cell" else one[n] == placed[n] for n in keys]
    for s in same:
        near = near & s
    return one.join(placed, near, "left_anti").drop("_cell")


def thin_greedy(orientations: DataFrame, ops: DataFrame, min_deg: float, key: str = "k", local: int = OPEN_PAIRS, within: str | None = None, first: int = FIRST_ROWS) -> DataFrame:
    """Drop an orientation if one already kept (in order of key) is nearer than ``min_deg``; only rows alike in ``within`` are compared.

    Same set as the sequential rule. Rows are decided in stretches of keys, the first of about ``first`` rows and
    each at most twice as long as the one before it; after a stretch its kept rows drop what is near them among all
    later rows. So conflicts are listed within a stretch only, where what earlier ones left is thin, and not
    between all rows.
    """
    from ..plans.state import discard, materialise

    rest = [within] if within else []
    names = ["k", *rest, "qx", "qy", "qz", "qw"]
    rows = materialise(orientations.select(F.col(key).alias("k"), *names[1:]))
    size, out = first, None
    while n := rows.count():
        now, later = rows, None
        if n > size:
            top = rows.agg(F.percentile_approx("k", size / n, 10_000).alias("k")).first()["k"]
            now, later = rows.where(F.col("k") <= top), rows.where(F.col("k") > top)
        kept = materialise(now.join(_thinned(now, ops, min_deg, local, within), "k", "left_semi"))
        out = kept if out is None else out.union(kept)
        if later is None:
            break
        old, rows = rows, materialise(_clear_of(later, kept, ops, min_deg, within))
        discard(old)
        size *= 2
    return (rows if out is None else out).select(F.col("k").alias(key))


def _thinned(base: DataFrame, ops: DataFrame, min_deg: float, local: int, within: str | None) -> DataFrame:
    """Keys kept of a stretch.

    An undecided row is kept once no undecided or kept row before it is near, and dropped once a kept
    row before it is near. Only conflict pairs are iterated. A round decides the first undecided row at
    least, so the rounds end; once at most ``local`` pairs are undecided, the driver goes through them in order instead.
    """
    from ..plans.state import materialise

    near = near_pairs(base, base.withColumnRenamed("k", "t"), ops, min_deg, within).where((F.col("t") < F.col("k")) & (F.col("c") > math.cos(math.radians(min_deg) / 2)))
    pairs = near.select("k", "t")
    pairs = materialise(pairs)
    state = materialise(base.select("k", F.lit(0).alias("s")))  # 0 open, 1 kept, -1 dropped
    while True:
        before = pairs.join(state.withColumnRenamed("k", "t"), "t").groupBy("k").agg(F.max("s").alias("hi"), F.min(F.when(F.col("s") == 0, 0).otherwise(1)).alias("settled"))
        state = materialise(
            state.join(before, "k", "left").select(
                "k", F.when(F.col("s") != 0, F.col("s")).when(F.col("hi") == 1, -1).when(F.coalesce("settled", F.lit(1)) == 1, 1).otherwise(0).alias("s")
            )
        )
        if not state.where("s = 0").limit(1).count():
            break
        undecided = pairs.join(state.where("s = 0").select("k"), "k").join(state.where("s >= 0").select(F.col("k").alias("t"), "s"), "t")
        rows = undecided.select("k", "t", "s").limit(local + 1).collect()
        if len(rows) <= local:
            decided = _sequential(rows, [r.k for r in state.where("s = 0").join(undecided.select("k"), "k", "left_anti").collect()])
            return state.where("s = 1").select("k").union(state.sparkSession.createDataFrame([(k,) for k in decided], state.select("k").schema))
    return state.where("s = 1")


def _sequential(rows: list, free: list) -> list:
    """Keys kept among undecided ones: ``rows`` (k, t, s) are their conflicts with earlier undecided or kept ones."""
    conflicts: dict = {}
    for k, t, s in rows:
        conflicts.setdefault(k, []).append((t, s))
    kept = set(free)  # nothing before them is near any more
    for k in sorted(conflicts):
        if not any(s == 1 or t in kept for t, s in conflicts[k]):
            kept.add(k)
    return sorted(kept)
