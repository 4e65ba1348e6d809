"""Images of coefficients: stencils, supports, morphology, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense(coef: DataFrame, channels: DataFrame, npix: int) -> DataFrame:
    """coef with every pixel of every listed channel k; absent values are zero."""
    pixels = coef.sparkSession.range(npix).select(F.col("id").cast("int").alias("p"))
    cells = channels.select("k").distinct().crossJoin(F.broadcast(pixels))
    return cells.join(coef.select("k", "p", "v"), ["k", "p"], "left").select("k", "p", F.coalesce("v", F.lit(0.0)).alias("v"))


def tv_gradient(full: DataFrame, nx: int, ny: int) -> DataFrame:
    """Forward differences gx, gy of a dense field, zero at the far edges. One shuffle per direction."""
    x, y = F.col("p") % nx, F.floor(F.col("p") / nx)
    row, column = Window.partitionBy("k", y).orderBy("p"), Window.partitionBy("k", x).orderBy("p")
    return full.select("k", "p", "v", F.coalesce(F.lead("v").over(row) - F.col("v"), F.lit(0.0)).alias("gx"), F.coalesce(F.lead("v").over(column) - F.col("v"), F.lit(0.0)).alias("gy"))


def tv_divergence(field: DataFrame, nx: int, ny: int) -> DataFrame:
    """The transpose of ``tv_gradient`` on a dense field(k, p, px, py): div."""
    x, y = F.col("p") % nx, F.floor(F.col("p") / nx)
    row, column = Window.partitionBy("k", y).orderBy("p"), Window.partitionBy("k", x).orderBy("p")
    own = F.when(x < nx - 1, -F.col("px")).otherwise(0.0) + F.when(y < ny - 1, -F.col("py")).otherwise(0.0)
    before = F.coalesce(F.lag("px").over(row), F.lit(0.0)) + F.coalesce(F.lag("py").over(column), F.lit(0.0))
    return field.select("k", "p", (own + before).alias("div"))


def tv_value(gradient: DataFrame) -> DataFrame:
    return gradient.groupBy("k").agg(F.sum(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("tv"))


def tv_prox(full: DataFrame, nx: int, ny: int, weight: float, rounds: int, tau: float = 0.25) -> DataFrame:
    """Dual iterations of the total-variation prox, then clipped at zero."""
    from ..plans.state import materialise

    zero = F.lit(0.0)
    state = materialise(full.select("k", "p", "v", zero.alias("px"), zero.alias("py"), F.col("v").alias("u")))
    for _ in range(rounds):
        grad = tv_gradient(state.select("k", "p", F.col("u").alias("v")), nx, ny).select("k", "p", "gx", "gy")
        moved = state.join(grad, ["k", "p"]).select("k", "p", "v", (F.col("px") + tau * F.col("gx")).alias("px"), (F.col("py") + tau * F.col("gy")).alias("py"))
        size = F.greatest(F.lit(1.0), F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")) / weight)
        moved = materialise(moved.select("k", "p", "v", (F.col("px") / size).alias("px"), (F.col("py") / size).alias("py")))
        div = tv_divergence(moved, nx, ny)
        state = materialise(moved.join(div, ["k", "p"]).select("k", "p", "v", "px", "py", (F.col("v") - F.col("div")).alias("u")))
    return state.select("k", "p", F.greatest("u", zero).alias("v"))


def disk(radius: float) -> list[tuple[int, int]]:
    n = int(radius)
    return [(dx, dy) for dx in range(-n, n + 1) for dy in range(-n, n + 1) if dx * dx + dy * dy <= radius * radius]


def diamond(steps: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx in range(-steps, steps + 1) for dy in range(-steps, steps + 1) if abs(dx) + abs(dy) <= steps]


def dilate(support: DataFrame, offsets: list[tuple[int, int]], nx: int, ny: int) -> DataFrame:
    """support(k, p) grown by the offsets, clipped to the grid."""
    arms = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    x, y = F.col("p") % nx + F.col("o.dx"), F.floor(F.col("p") / nx).cast("int") + F.col("o.dy")
    grown = support.select("k", "p", F.explode(arms).alias("o")).where((x >= 0) & (x < nx) & (y >= 0) & (y < ny))
    return grown.select("k", (x + nx * y).cast("int").alias("p")).distinct()


def restrict(support: DataFrame, mask: DataFrame) -> DataFrame:
    return support.join(mask.select("p"), "p", "left_semi").select("k", "p")


def project_support(coef: DataFrame, support: DataFrame) -> DataFrame:
    """Coefficients on the support (all channels, or per channel if the support has k)."""
    keys = [c for c in ("k", "p") if c in support.columns]
    return coef.join(support.select(*keys), keys, "left_semi")


def local_support(coef: DataFrame, top: int | None = None, rel: float = 0.0, min_voxel: float = 0.0) -> DataFrame:
    """Pairs (k, p) with v > 0, among the ``top`` of the voxel, at least ``rel`` of its maximum, in voxels whose maximum is at least ``min_voxel`` of all."""
    voxel = Window.partitionBy("p")
    ranked = coef.where("v > 0").withColumn("rank", F.row_number().over(voxel.orderBy(F.desc("v"), "k")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    ranked = ranked.withColumn("best", F.max("v").over(voxel))
    kept = ranked.where(F.col("v") >= rel * F.col("best"))
    if min_voxel > 0:
        kept = kept.crossJoin(F.broadcast(coef.agg(F.max("v").alias("peak")))).where(F.col("best") >= min_voxel * F.col("peak"))
    return kept.select("k", "p")


def bounding_boxes(support: DataFrame, nx: int) -> DataFrame:
    x, y = F.col("p") % nx, F.floor(F.col("p") / nx).cast("int")
    return support.groupBy("k").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))


def tiles(support: DataFrame, nx: int, size: int) -> DataFrame:
    x, y = F.col("p") % nx, F.floor(F.col("p") / nx).cast("int")
    return support.select("k", "p", F.floor(x / size).cast("int").alias("tx"), F.floor(y / size).cast("int").alias("ty"))


def regions(support: DataFrame, nx: int, ny: int) -> DataFrame:
    """support with ``region``: the smallest pixel of its 8-connected component."""
    from .patches import clusters

    return clusters(support, nx).withColumnRenamed("cluster", "region")


def spatial_moments(coef: DataFrame, nx: int) -> DataFrame:
    """Weight, mean and population covariance of the voxel positions of every orientation."""
    x, y, v = F.col("p") % nx, F.floor(F.col("p") / nx), F.greatest("v", F.lit(0.0))
    s = coef.groupBy("k").agg(F.sum(v).alias("w"), F.sum(v * x).alias("sx"), F.sum(v * y).alias("sy"), F.sum(v * x * x).alias("sxx"), F.sum(v * y * y).alias("syy"), F.sum(v * x * y).alias("sxy"))
    mx, my = F.col("sx") / F.col("w"), F.col("sy") / F.col("w")
    return s.select("k", "w", mx.alias("mx"), my.alias("my"), (F.col("sxx") / F.col("w") - mx * mx).alias("cxx"), (F.col("syy") / F.col("w") - my * my).alias("cyy"), (F.col("sxy") / F.col("w") - mx * my).alias("cxy"))


def density(coef: DataFrame) -> DataFrame:
    """Total per voxel and the orientation with most of it (smallest k on ties)."""
    return coef.groupBy("p").agg(F.sum("v").alias("density"), F.max(F.struct("v", (-F.col("k")).alias("nk"))).alias("m")).select("p", "density", (-F.col("m.nk")).alias("dominant"))


def line_integrals(values: DataFrame) -> DataFrame:
    """Per channel and row: sum up to and including the pixel, less half of its own value."""
    row = Window.partitionBy("k", "iy").orderBy("ix").rowsBetween(Window.unboundedPreceding, 0)
    return values.select("k", "ix", "iy", (F.sum("v").over(row) - F.col("v") / 2).alias("s"))


def scramble(data: DataFrame, shifts: DataFrame, n_eta: int, channels: int, block: int = 5) -> DataFrame:
    """Azimuth null: every (block of angles, channel) rolled by the shift given as data."""
    c, ch = F.floor(F.col("j") / channels).cast("int"), F.col("j") % channels
    keyed = data.withColumns({"c": c, "ch": ch, "block": F.floor(F.col("a") / block).cast("int")})
    rolled = keyed.join(F.broadcast(shifts), ["block", "ch"])
    return rolled.select("a", "y", (F.pmod(F.col("c") + F.col("shift"), F.lit(n_eta)) * channels + F.col("ch")).cast("int").alias("j"), "b")
