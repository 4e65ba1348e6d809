"""Residual search: scores, top lists, peaks, linked candidates, pruning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rotations as rot


def score(op, inputs: DataFrame) -> DataFrame:
    """z(input, k, p): A^T e / sqrt(A^T d), both adjoints in one pass over the tables.

    ``inputs``: input (name), a, y, j, e, d. The pair is carried as two rows of one vector.
    """
    rows = inputs.select("input", "a", "y", "j", F.explode(F.array(F.struct(F.lit("e").alias("part"), F.col("e").alias("v")), F.struct(F.lit("d").alias("part"), F.col("d").alias("v")))).alias("s"))
    back = op.adjoint(rows.select("input", "a", "y", "j", "s.part", "s.v"), ("input", "part"))
    pair = back.groupBy("input", "k", "p").agg(F.sum(F.when(F.col("part") == "e", F.col("v"))).alias("num"), F.sum(F.when(F.col("part") == "d", F.col("v"))).alias("den"))
    return pair.select("input", "k", "p", F.when(F.col("den") > 0, F.col("num") / F.sqrt("den")).otherwise(0.0).alias("z"))


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("p",), value: str = "z0", tie: str = "k") -> DataFrame:
    """The k best of each group; the rank limit runs before and after the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def peaks(real: DataFrame, null: DataFrame, ratio: float) -> DataFrame:
    """Entries (p, k, z0, z1) whose z0 is ``ratio`` times the null's best of the pixel and whose z1 reaches the null's best."""
    best = null.groupBy("p").agg(F.max("z0").alias("n0"), F.max("z1").alias("n1"))
    return real.join(best, "p").where((F.col("z0") >= ratio * F.col("n0")) & (F.col("z1") >= F.col("n1"))).select("p", "k", "z0", "z1")


def apart(found: DataFrame, orientations: DataFrame, ops: DataFrame, sep_deg: float, limit: int) -> DataFrame:
    """Per tile: peaks in order of rank, dropped if near one already kept; at most ``limit``.

    A tile holds at most the length of its top list, so its rows meet in one group of bounded size.
    """
    import numpy as np
    import pandas as pd

    turns = np.array([[r.qx, r.qy, r.qz, r.qw] for r in ops.collect()])  # at most 24
    close = math.cos(math.radians(sep_deg) / 2)
    rows = found.join(orientations.select("k", "qx", "qy", "qz", "qw"), "k")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["z0", "k"], ascending=[False, True])
        q = group[["qx", "qy", "qz", "qw"]].to_numpy()
        x, y, z, w = q.T[:, :, None]
        a, b, c, d = turns.T[:, None, :]
        images = np.stack([w * a + x * d + y * c - z * b, w * b - x * c + y * d + z * a, w * c + x * b - y * a + z * d, w * d - x * a - y * b - z * c], -1)
        got: list[int] = []
        for i in range(len(q)):
            if all(np.abs(images[j] @ q[i]).max() <= close for j in got):
                got.append(i)
                if len(got) == limit:
                    break
        return group.iloc[got][["p", "k", "z0"]]

    return rows.groupBy("p").applyInPandas(pick, "p int, k int, z0 double")


def linked(kept: DataFrame, orientations: DataFrame, ops: DataFrame, nx: int, ny: int, link_deg: float, min_tiles: int) -> DataFrame:
    """candidate(id, k, score, tiles): peaks of neighbouring tiles within ``link_deg``, joined to components.

    A label is the least of the node's own, its neighbours' and its label's label (a hop), until none changes.
    """
    from ..plans.state import materialise

    nodes = materialise(kept.join(orientations.select("k", "qx", "qy", "qz", "qw"), "k").withColumn("node", F.shiftleft(F.col("p").cast("long"), 32) + F.col("k")))
    arms = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    x, y = F.col("p") % nx + F.col("o.dx"), F.floor(F.col("p") / nx).cast("int") + F.col("o.dy")
    moved = nodes.select("node", "p", "qx", "qy", "qz", "qw", F.explode(arms).alias("o")).where((x >= 0) & (x < nx) & (y >= 0) & (y < ny))
    moved = moved.select("node", (x + nx * y).cast("int").alias("p"), "qx", "qy", "qz", "qw")
    images = rot.equivalents(nodes.select(F.col("node").alias("other"), "p", "qx", "qy", "qz", "qw"), ops).select("other", "p", *[F.col(f"q{c}").alias(f"tq{c}") for c in "xyzw"])
    close = math.cos(math.radians(link_deg) / 2)
    links = materialise(moved.join(images, "p").where((F.col("node") != F.col("other")) & (F.abs(rot.dot(rot.quat(), rot.quat("t"))) > close)).select("node", "other").distinct())
    state = materialise(nodes.select("node", F.col("node").alias("root")))
    while True:
        low = links.join(state.select(F.col("node").alias("other"), F.col("root").alias("far")), "other").groupBy("node").agg(F.min("far").alias("far"))
        hop = state.select(F.col("node").alias("root"), F.col("root").alias("hop"))
        new = materialise(state.join(low, "node", "left").join(hop, "root").select("node", F.least("root", "hop", F.coalesce("far", "root")).alias("root"), F.col("root").alias("was")))
        state = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            break
    grouped = nodes.join(state, "node").groupBy("root").agg(
        F.max(F.struct("z0", (-F.col("k")).alias("nk"))).alias("best"), F.sum("z0").alias("score"), F.array_sort(F.collect_set("p")).alias("tiles")
    )
    return grouped.where(F.size("tiles") >= min_tiles).select(F.col("root").alias("id"), (-F.col("best.nk")).cast("int").alias("k"), "score", "tiles")


def candidate_support(candidates: DataFrame, tile: int, tiles_x: int, nx: int, ny: int, steps: int = 0) -> DataFrame:
    """support(id, p): voxels of every candidate's tiles, grown by a diamond."""
    from .fields import diamond, dilate

    cells = candidates.select(F.col("id").alias("k"), F.explode("tiles").alias("t"))
    grid = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(tile) for dy in range(tile)])
    x, y = (F.col("t") % tiles_x) * tile + F.col("o.dx"), F.floor(F.col("t") / tiles_x) * tile + F.col("o.dy")
    voxels = cells.select("k", "t", F.explode(grid).alias("o")).where((x < nx) & (y < ny)).select("k", (x + nx * y).cast("int").alias("p"))
    return dilate(voxels, diamond(steps), nx, ny).withColumnRenamed("k", "id") if steps else voxels.distinct().withColumnRenamed("k", "id")


def prune_added(weights: DataFrame, n_old: int, rel: float = 0.1) -> DataFrame:
    """keep flag per orientation: old ones, and added ones of at least ``rel`` times the median of the positive added ones."""
    median = weights.where((F.col("k") >= n_old) & (F.col("w") > 0)).agg(F.expr("percentile(w, 0.5)").alias("m"))
    both = weights.crossJoin(F.broadcast(median))
    return both.select("k", "w", ((F.col("k") < n_old) | F.coalesce(F.col("w") >= rel * F.col("m"), F.lit(False))).alias("keep"))


def best_per(scores: DataFrame, key: str, value: str = "z", tie: str = "k") -> DataFrame:
    return scores.groupBy(key).agg(F.max(F.struct(value, (-F.col(tie)).alias("t"))).alias("m")).select(key, (-F.col("m.t")).alias(tie), F.col(f"m.{value}").alias(value))


def lattice(spacing_deg: float, radius_deg: float) -> list[tuple[float, float, float]]:
    """Rotation vectors of a cubic lattice within a radius, in radians, nearest first."""
    m = math.ceil(radius_deg / spacing_deg)
    cells = [(x, y, z) for x in range(-m, m + 1) for y in range(-m, m + 1) for z in range(-m, m + 1)]
    inside = [c for c in cells if math.hypot(*c) * spacing_deg <= radius_deg + 1e-9]
    return [tuple(math.radians(spacing_deg * v) for v in c) for c in sorted(inside, key=lambda c: (math.hypot(*c), c))]


def refine_candidates(candidates: DataFrame, score_of, levels: tuple[tuple[float, float, float], ...] = ((1.25, 6.0, 1.0), (0.4, 1.6, 0.4))) -> DataFrame:
    """candidate(id, q) moved to the best orientation of finer and finer lattices around it.

    ``score_of(trials, sigma)``: trials(id, k, q) -> (k, z); trials are exploded from a literal lattice,
    so a level is one plan whatever the number of candidates.
    """
    from ..plans.state import materialise

    for spacing, radius, sigma in levels:
        points = lattice(spacing, radius)
        arms = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for n, v in zip("abc", p)]) for i, p in enumerate(points)])
        wide = candidates.select("id", "qx", "qy", "qz", "qw", F.explode(arms).alias("o"))
        made = rot.product(rot.quat(), rot.from_rotvec(F.col("o.a"), F.col("o.b"), F.col("o.c")))
        trials = materialise(wide.select("id", (F.col("id") * len(points) + F.col("o.i")).alias("k"), *[m.alias(f"q{c}") for m, c in zip(made, "xyzw")]))
        best = best_per(trials.select("id", "k").join(score_of(trials, math.radians(sigma)), "k"), "id")
        candidates = materialise(trials.join(best.select("id", "k"), ["id", "k"]).select("id", "qx", "qy", "qz", "qw"))
    return candidates


def support_from_candidates(orientations: DataFrame, candidates: DataFrame, ops: DataFrame, tol_deg: float) -> DataFrame:
    """support(k, p): an orientation may be used at the voxels p of every candidate(id, q, p) within ``tol_deg`` of it.

    The angular join is on the candidates' distinct orientations; voxels come back by an equi-join on id.
    """
    distinct = candidates.select(F.col("id").alias("t"), "qx", "qy", "qz", "qw").distinct()
    near = rot.near_pairs(orientations, distinct, ops, tol_deg).select("k", F.col("t").alias("id"))
    return near.join(candidates.select("id", "p"), "id").select("k", "p").distinct()
