"""Data terms, evaluation splits and counting statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-3


def broadcast_onto(data: DataFrame, values: DataFrame, name: str, default: float) -> DataFrame:
    """Column ``name`` from a dimension table on whichever of the data's axes it has (none: one value)."""
    keys = [c for c in values.columns if c in ("a", "y", "j")]
    one = values.select(*keys, F.col(name).alias("_v"))
    joined = data.join(one, keys, "left") if keys else data.crossJoin(F.broadcast(one.limit(1)))
    return joined.withColumn(name, F.coalesce("_v", F.lit(default))).drop("_v")


def expected(mu: Column, bg: Column, g: Column, eps: float = EPS) -> Column:
    return F.greatest(mu, F.lit(0.0)) + bg + eps * g


def deviance_term(b: Column, mu: Column, w: Column, g: Column, bg: Column, eps: float = EPS) -> Column:
    m = expected(mu, bg, g, eps)
    return w / g * (m - b + F.when(b > 0, b * F.log(F.when(b > 0, b).otherwise(1.0) / m)).otherwise(0.0))


def _c(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def poisson_deviance(data: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """deviance, points and deviance per point of data(b, mu, w, g, bg); zero weights count nowhere."""
    used = data.where("w <> 0").withColumn("_t", deviance_term(*_c("b", "mu", "w", "g", "bg")))
    out = used.groupBy(*by).agg(F.sum("_t").alias("deviance"), F.count("*").alias("points"))
    return out.withColumn("per_point", F.col("deviance") / F.greatest("points", F.lit(1)))


def wls_objective(data: DataFrame, floor: float = 1.0) -> DataFrame:
    b, mu, w, g, bg = _c("b", "mu", "w", "g", "bg")
    r = mu + bg - b
    return data.where("w <> 0").agg(F.sum(0.5 * w / g / F.greatest(b, floor * g) * r * r).alias("wls"))


def curvature(data: DataFrame, floor: float = 1.0) -> Column:
    b, mu, w, g, bg = _c("b", "mu", "w", "g", "bg")
    m = F.greatest(F.greatest(mu, F.lit(0.0)) + bg, floor * g)
    return F.when(w != 0, w / g * F.greatest(b, m) / (m * m)).otherwise(0.0)


def huber_value(r: Column, delta: float) -> Column:
    a = F.abs(r)
    return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


def residual_norms(data: DataFrame, delta: float) -> DataFrame:
    r = F.col("w") * (F.col("mu") - F.col("b"))
    return data.agg(F.sum(r * r).alias("sumsq"), F.sum(huber_value(r, delta)).alias("huber"), F.sum(F.when(F.abs(r) > delta, 1).otherwise(0)).alias("clipped"))


def asinh_misfit(data: DataFrame, c: float, over_weight: float = 1.0) -> DataFrame:
    b, mu, w = _c("b", "mu", "w")
    r = c * F.asinh(mu / c) - c * F.asinh(b / c)
    return data.agg(F.sum(0.5 * w * F.when(r > 0, over_weight).otherwise(1.0) * r * r).alias("misfit"))


def score_inputs(data: DataFrame, floor: float = 0.25) -> DataFrame:
    """e and d of the score test: weighted relative residual, and its variance; predictions at least ``floor`` counts."""
    b, mu, w, g = _c("b", "mu", "w", "g")
    m = F.greatest(F.greatest(mu, F.lit(0.0)), floor * g)
    used = w > 0
    return data.select("a", "y", "j", F.when(used, w / g * (b / m - 1)).otherwise(0.0).alias("e"), F.when(used, w / (g * m)).otherwise(0.0).alias("d"))


def block_split(angle: DataFrame, block: int = 5, period: int = 5, held: int = 2) -> DataFrame:
    return angle.withColumn("fitted", F.floor(F.col("a") / block) % period != held)


def interleaved(angle: DataFrame, subsets: int) -> DataFrame:
    """subset of every fitted angle: its rank among the fitted, modulo ``subsets`` (angles are a small dimension)."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("a")) - 1
    return angle.where("fitted").withColumn("subset", rank % subsets)


def gain_from_pairs(pairs: DataFrame, by: tuple[str, ...] = (), cap: float | None = None) -> DataFrame:
    """gain = sum((x - y)^2 / 2) / sum((x + y) / 2) over repeated measurements x, y."""
    x, y = _c("x", "y")
    used = pairs if cap is None else pairs.where((x + y) / 2 <= cap)
    return used.groupBy(*by).agg((F.sum((x - y) * (x - y) / 2) / F.sum((x + y) / 2)).alias("gain"), F.count("*").alias("pairs"))


def integration_gain(pixels: DataFrame) -> DataFrame:
    """gain(win): mean over bins of 1 / sum(norm) of the bin's pixels; null where no bin has any."""
    per_bin = pixels.groupBy("win", "bin").agg(F.sum("norm").alias("s"))
    return per_bin.groupBy("win").agg(F.avg(F.when(F.col("s") > 0, 1 / F.col("s"))).alias("gain"))


def coverage(pixels: DataFrame, n_eta: int, windows: list[tuple[float, float]]) -> DataFrame:
    """Share of each (eta bin, window) solid angle that valid pixels(two_theta, eta, omega, valid) cover."""
    import math

    d_eta = 2 * math.pi / n_eta
    spans = F.array(*[F.struct(F.lit(i).alias("win"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(windows)])
    cut = pixels.where("valid").select(F.floor(F.col("eta") / (360.0 / n_eta)).cast("int").alias("c"), "two_theta", "omega", F.explode(spans).alias("s"))
    cut = cut.where("two_theta >= s.lo and two_theta < s.hi").groupBy("c", "s").agg(F.sum("omega").alias("o"))
    return cut.select("c", F.col("s.win").alias("win"), (F.col("o") / (d_eta * (F.cos("s.lo") - F.cos("s.hi")))).alias("ratio"))


def em_scales(comp: DataFrame, data: DataFrame, channel: Column, rounds: int, ties: dict[str, str] | None = None, eps: float = EPS) -> DataFrame:
    """scale(c, ch) of fixed components by EM. ``comp``: c, a, y, j, v; ``data``: a, y, j, b, w, g, bg."""
    from ..plans.state import materialise

    spark = comp.sparkSession
    d = data.withColumn("ch", channel).where("w <> 0").select("a", "y", "j", "ch", "b", "w", "g", "bg")
    full = materialise(comp.join(d, ["a", "y", "j"]))
    labels = comp.select("c").distinct()
    tie = F.col("c")
    for name, label in (ties or {}).items():
        tie = F.when(F.col("c") == name, label).otherwise(tie)
    scale = materialise(labels.crossJoin(d.select("ch").distinct()).withColumn("s", F.lit(1.0)))
    for _ in range(rounds):
        scaled = full.join(F.broadcast(scale), ["c", "ch"])  # components x channels: a dimension table
        mu = scaled.groupBy("a", "y", "j").agg(F.sum(F.col("s") * F.col("v")).alias("mu"))
        ratio = scaled.join(mu, ["a", "y", "j"]).withColumn("q", F.col("w") / F.col("g") * F.col("v"))
        m = expected(F.col("mu"), F.col("bg"), F.col("g"), eps)
        sums = ratio.groupBy("c", "ch").agg(F.sum(F.col("q") * F.col("b") / m).alias("num"), F.sum("q").alias("den"))
        both = scale.join(sums, ["c", "ch"], "left").withColumn("tie", tie)
        factor = both.groupBy("tie", "ch").agg((F.sum(F.col("s") * F.col("num")) / F.sum(F.col("s") * F.col("den"))).alias("f"))
        scale = materialise(both.join(factor, ["tie", "ch"]).select("c", "ch", (F.col("s") * F.coalesce("f", F.lit(1.0))).alias("s")))
    del spark
    return scale


def intensity_vjp(grad: DataFrame) -> DataFrame:
    """Sums of a gradient over all but one axis: every row is expanded to its four axes, partial sums come before the shuffle."""
    axes = {"a": F.col("a"), "y": F.col("y"), "r": F.pmod("j", F.lit(3)), "j": F.col("j")}
    parts = F.array(*[F.struct(F.lit(n).alias("axis"), c.cast("int").alias("i")) for n, c in axes.items()])
    return grad.select(F.explode(parts).alias("x"), "v").groupBy("x.axis", "x.i").agg(F.sum("v").alias("v")).select("axis", "i", "v")


def fit_linear(data: DataFrame, rounds: int, background: bool = False) -> DataFrame:
    """Alternating closed-form fit of scales per angle, translation and ring, and of a background per segment.

    Columns axis (a, y, r; bg), i, s. Angle and translation scales keep a mean of 1, the rings take the
    level. The tables of scales are dimensions of a scan, so each block is one aggregate of the data.
    """
    from ..plans.state import materialise

    base = data.withColumn("r", F.pmod("j", F.lit(3)).cast("int")).select("a", "y", "j", "r", "b", "w", "mu")
    start = lambda key, value: materialise(base.select(F.col(key).alias("i")).distinct().withColumn("s", F.lit(value)))
    scale = {n: start(n, 1.0) for n in ("a", "y", "r")}
    level = start("j", 0.0) if background else None

    def filled(names: list[str]) -> tuple[DataFrame, Column]:
        """The data with the factor of the named scales, and what is left of it above the background."""
        rows, factor, above = base, F.col("mu"), F.col("b")
        for n in names:
            rows = rows.join(F.broadcast(scale[n].select(F.col("i").alias(n), F.col("s").alias(f"s_{n}"))), n)
            factor = factor * F.col(f"s_{n}")
        if background:
            rows = rows.join(F.broadcast(level.select(F.col("i").alias("j"), F.col("s").alias("s_bg"))), "j")
            above = above - F.col("s_bg")
        return rows.withColumns({"g": factor, "above": above}), F.col("w") * F.col("g")

    for _ in range(rounds):
        for n in scale:
            rows, weight = filled([m for m in scale if m != n])
            sums = rows.groupBy(F.col(n).alias("i")).agg(F.sum(weight * F.col("above")).alias("num"), F.sum(weight * F.col("g")).alias("den"))
            kept = sums.join(scale[n], "i")
            scale[n] = materialise(kept.select("i", F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("s")).alias("s")))
        if background:
            rows, _ = filled(list(scale))
            fit = rows.groupBy(F.col("j").alias("i")).agg((F.sum(F.col("w") * (F.col("b") - F.col("g"))) / F.greatest(F.sum("w"), F.lit(1e-300))).alias("s"))
            level = materialise(fit)
        for n in ("a", "y"):
            mean = scale[n].agg(F.avg("s")).first()[0]
            scale[n] = materialise(scale[n].select("i", (F.col("s") / mean).alias("s")))
            scale["r"] = materialise(scale["r"].select("i", (F.col("s") * mean).alias("s")))
    out = None
    for n, df in (scale | ({"bg": level} if background else {})).items():
        part = df.select(F.lit(n).alias("axis"), "i", "s")
        out = part if out is None else out.union(part)
    return out
