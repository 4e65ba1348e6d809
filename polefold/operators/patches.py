"""Patches: the support of every orientation as few disjoint boxes, and its coefficients as one flat vector.

An orientation whose voxels fill enough of their bounding box is one patch. Otherwise its voxels are
clustered (connected after growing by ``gap``), every cluster has its box, and boxes that overlap are
merged until none do. Boxes meet only within tiles that both touch, so no pair of boxes is formed
that is far apart, and all steps are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components

TILE, RUN = 32, 4096


def _xy(nx: int) -> tuple[Column, Column]:
    return (F.col("p") % nx).cast("int"), F.floor(F.col("p") / nx).cast("int")


def clusters(support: DataFrame, nx: int, reach: int = 1) -> DataFrame:
    """support(k, p) with ``cluster``: the smallest pixel of those that chains of steps of at most ``reach`` (in both directions) join.

    Pixels of a cell of ``reach`` by ``reach`` are always joined, and a step ends in a neighbouring cell, so
    links are between cells.
    """
    x, y = _xy(nx)
    wide = nx // reach + 3
    cell = lambda cx, cy: F.col("k").cast("long") * F.lit(1 << 32) + (cy + 1) * wide + cx + 1
    pixels = support.select("k", "p", x.alias("x"), y.alias("y")).withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    pixels = pixels.withColumn("cell", cell(F.col("cx"), F.col("cy")))
    arms = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    ahead = pixels.select("x", "y", "k", "cx", "cy", F.col("cell").alias("a"), F.explode(arms).alias("o"))
    ahead = ahead.select("a", F.col("x").alias("ax"), F.col("y").alias("ay"), cell(F.col("cx") + F.col("o.dx"), F.col("cy") + F.col("o.dy")).alias("cell"))
    links = ahead.join(pixels, "cell").where(f"abs(ax - x) <= {reach} and abs(ay - y) <= {reach}").select("a", F.col("cell").alias("b")).distinct()
    named = pixels.select("k", "p", "cell").join(components(links).withColumnRenamed("node", "cell"), "cell", "left")
    return named.select("k", "p", F.min("p").over(Window.partitionBy(F.coalesce("root", "cell"))).alias("cluster"))


def _tiles(x: str, y: str) -> tuple[Column, Column]:
    return F.floor(F.col(x) / TILE).cast("int").alias("tx"), F.floor(F.col(y) / TILE).cast("int").alias("ty")


def _over_tiles(boxes: DataFrame) -> DataFrame:
    """Every box once for each tile that it touches."""
    across, down = (F.sequence(F.floor(F.col(f"{c}0") / TILE).cast("int"), F.floor(F.col(f"{c}1") / TILE).cast("int")) for c in "xy")
    return boxes.withColumn("tx", F.explode(across)).withColumn("ty", F.explode(down))


def merged(boxes: DataFrame) -> DataFrame:
    """box(k, x0, x1, y0, y1), inclusive: overlapping boxes of an orientation are merged until none overlap."""
    from ..plans.state import discard, materialise

    sides = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    # a box is named by its corner: its orientation's boxes of one corner are merged first
    corner = F.xxhash64("k", "x0", "y0").alias("id")
    now = materialise(boxes.groupBy("k", "x0", "y0").agg(F.max("x1").alias("x1"), F.max("y1").alias("y1")).select("k", "x0", "x1", "y0", "y1", corner))
    while True:
        tiled = _over_tiles(now)
        other = tiled.select("k", "tx", "ty", *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1", "id")])
        meets = "x0 <= _x1 and _x0 <= x1 and y0 <= _y1 and _y0 <= y1 and id < _id"
        links = materialise(tiled.join(other, ["k", "tx", "ty"]).where(meets).select(F.col("id").alias("a"), F.col("_id").alias("b")).distinct())
        if not links.limit(1).count():
            return now.drop("id")
        named = now.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("id", F.coalesce("root", "id"))
        old, now = now, materialise(named.groupBy("k", "id").agg(*sides).select("k", "x0", "x1", "y0", "y1", corner))
        discard(old, links)


def patches(support: DataFrame, nx: int, split: bool = True, gap: int = 2, fill: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """patch(patch, k, x0, y0, w, h, coff) and pair(k, p, patch, i).

    ``coff``: first coefficient of the patch in the flat vector, which holds the boxes row by row in order of
    k, y0, y1, x0, x1; ``i``: a voxel's coefficient. Every pair is in exactly one patch.
    """
    x, y = _xy(nx)
    pairs = support.select("k", "p", x.alias("x"), y.alias("y"))
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    whole = pairs.groupBy("k").agg(*box, F.count("*").alias("n"))
    sparse = (F.col("n") < fill * (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)) & F.lit(split)
    loose = clusters(support.join(whole.where(sparse).select("k"), "k", "left_semi"), nx, 2 * gap + 1)
    parts = loose.select("k", "cluster", x.alias("x"), y.alias("y")).groupBy("k", "cluster").agg(*box).drop("cluster")
    boxes = merged(parts).unionByName(whole.where(~sparse).drop("n"))
    boxes = boxes.select("k", "x0", "y0", "x1", "y1", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))

    # numbers and offsets: within an orientation, within a run of orientations, then over the runs
    size, run = F.col("w").cast("long") * F.col("h"), F.floor(F.col("k") / RUN)
    by_k = boxes.groupBy("k").agg(F.count("*").alias("m"), F.sum(size).alias("c")).withColumn("run", run)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    runs = by_k.groupBy("run").agg(F.sum("m").alias("m"), F.sum("c").alias("c"))
    runs = runs.select("run", upto("m", Window.orderBy("run")).alias("m1"), upto("c", Window.orderBy("run")).alias("c1"))
    inner = Window.partitionBy("run").orderBy("k")
    firsts = by_k.select("k", "run", upto("m", inner).alias("m0"), upto("c", inner).alias("c0")).join(runs, "run").select("k", (F.col("m0") + F.col("m1")).alias("m0"), (F.col("c0") + F.col("c1")).alias("c0"))
    own = Window.partitionBy("k").orderBy("y0", "y1", "x0", "x1")
    numbered = boxes.withColumns({"at": F.row_number().over(own) - 1, "c": upto(size, own)}).join(firsts, "k")
    numbered = numbered.select((F.col("m0") + F.col("at")).alias("patch"), "k", "x0", "y0", "x1", "y1", "w", "h", (F.col("c0") + F.col("c")).alias("coff"))

    tiled = _over_tiles(numbered)
    placed = pairs.select("k", "p", "x", "y", *_tiles("x", "y")).join(tiled, ["k", "tx", "ty"]).where("x between x0 and x1 and y between y0 and y1")
    index = F.col("coff") + (F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")
    return numbered.drop("x1", "y1"), placed.select("k", "p", "patch", index.alias("i"))


def flat_mask(patch: DataFrame, pair: DataFrame) -> DataFrame:
    """flat(i, patch, k, inside): every coefficient of the flat vector, and whether a pair stands there."""
    cells = patch.select("patch", "k", F.explode(F.sequence("coff", F.col("coff") + F.col("w").cast("long") * F.col("h") - 1)).alias("i"))
    return cells.join(pair.select("i", F.lit(1).alias("inside")), "i", "left").select("i", "patch", "k", F.coalesce("inside", F.lit(0)).alias("inside"))
