"""Radial windows as data channels: reflections mixed by their overlap with a window, and the lattice's derivatives.

A channel is a reflection family inside a window. It has the share of the window that the family holds
(its overlap times its multiplicity, or times a given amplitude) and is evaluated at the window's two-theta, the
overlap's mean. The lattice and the profile's relative width move overlaps, shares and two-thetas; the poles'
directions in the crystal are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import derivs
from .linop import LinearOp, Link

CELL = ("a", "b", "c", "alpha", "beta", "gamma")
PARAMETERS = (*CELL, "rel")
STRIDE = 1 << 16  # families in a window's range of channel numbers


def channels(families: DataFrame, windows: DataFrame, cell: tuple[float, ...], rel: float, wavelength: float, least: float = 1e-3, amplitude: str | None = None) -> DataFrame:
    """channel(r, win, f, w, share, two_theta) with ds_x and dt_x, the slopes of share and two-theta by each of ``PARAMETERS``.

    families(f, h, k, l, mult) and windows(win, lo, hi) are dimension tables; angles of the cell are in
    degrees. Without ``amplitude`` (a column of families) the shares of a window add up to 1.
    """
    known = derivs.q_and_derivatives(families, cell)
    q, s = F.col("q"), math.sqrt(2.0) * rel
    both = known.crossJoin(F.broadcast(windows)).withColumn("w", derivs.overlap(q, F.col("lo"), F.col("hi"), rel)).where(F.col("w") > least)

    def slope(by_edge) -> Column:
        # of the overlap, from the slope of the scaled distance u = (edge - q) / (s q) of each edge
        def part(edge: str) -> Column:
            u = (F.col(edge) - q) / (s * q)
            return F.exp(-u * u) / math.sqrt(math.pi) * by_edge(F.col(edge), u)

        return part("hi") - part("lo")

    sine = q * (wavelength / (4 * math.pi))
    by_q = slope(lambda edge, u: -edge / (s * q * q))
    both = both.withColumns({"tf": 2 * F.asin(sine), **{f"dw_{x}": by_q * F.col(f"dq_{x}") for x in CELL}, "dw_rel": slope(lambda edge, u: -u / rel)})
    turn = 2 * wavelength / (4 * math.pi) / F.sqrt(1 - sine * sine)
    both = both.withColumns({**{f"df_{x}": turn * F.col(f"dq_{x}") for x in CELL}, "df_rel": F.lit(0.0)})

    over = Window.partitionBy("win")
    total = lambda c: F.sum(c).over(over)
    if amplitude:
        m = F.col(amplitude)
        shares = {"share": m * F.col("w")} | {f"ds_{x}": m * F.col(f"dw_{x}") for x in PARAMETERS}
    else:
        m = F.col("mult")
        held = total(m * F.col("w"))
        shares = {"share": m * F.col("w") / held} | {f"ds_{x}": (m * F.col(f"dw_{x}") - m * F.col("w") / held * total(m * F.col(f"dw_{x}"))) / held for x in PARAMETERS}
    both = both.withColumns(shares | {"two_theta": total(F.col("w") * F.col("tf")) / total("w")})
    moved = {f"dt_{x}": total(F.col(f"dw_{x}") * (F.col("tf") - F.col("two_theta")) + F.col("w") * F.col(f"df_{x}")) / total("w") for x in PARAMETERS}
    number = (F.col("win") * STRIDE + F.col("f")).cast("int").alias("r")
    return both.withColumns(moved).select(number, "win", "f", "w", "share", "two_theta", *[f"d{c}_{x}" for c in "st" for x in PARAMETERS])


def channel_axes(axes: DataFrame, channel: DataFrame) -> DataFrame:
    """axes(r: family, nx, ny, nz, cnt) of every channel."""
    return axes.withColumnRenamed("r", "f").join(F.broadcast(channel.select("r", "f")), "f").drop("f")


@dataclass(frozen=True)
class Mix(Link):
    """A link without angles: all angles share it."""

    def restricted(self, condition: str) -> Mix:
        return self


def windowed(radon: DataFrame, pf: DataFrame, channel: DataFrame) -> LinearOp:
    """coef(k, p) -> data(a, y, c, win): projection, pole figures pf(a, k, c, r, v) of every channel, windows."""
    project = Link(radon, (), ("p",), ("a", "y"), "w", ("k",))
    figures = Link(pf.select("a", "k", "c", "r", F.col("v").alias("w")), ("a",), ("k",), ("c", "r"), "w", ("y",))
    return LinearOp([project, figures, Mix(channel.select("r", "win", F.col("share").alias("w")), (), ("r",), ("win",), "w", ("a", "y", "c"))])


def lattice_gradient(residual: DataFrame, coef: DataFrame, radon: DataFrame, slopes: DataFrame, channel: DataFrame) -> DataFrame:
    """parameter, g: slopes of the sum of residual(a, y, c, win, v) times the windowed data, by each of ``PARAMETERS``.

    ``slopes`` are the channels' pole figures with d_two_theta. Rows of data meet projections once, summed over the
    detector before they meet pole figures, so two numbers a channel are left.
    """
    sino = coef.join(radon, "p").groupBy("a", "y", "k").agg(F.sum(F.col("v") * F.col("w")).alias("s"))
    seen = residual.join(sino, ["a", "y"]).groupBy("a", "k", "c", "win").agg(F.sum(F.col("v") * F.col("s")).alias("g"))
    own = slopes.join(F.broadcast(channel.select("r", "win")), "r").join(seen, ["a", "k", "c", "win"])
    told = own.groupBy("r").agg(F.sum(F.col("g") * F.col("v")).alias("t"), F.sum(F.col("g") * F.col("d_two_theta")).alias("dt"))
    both = channel.join(told, "r")
    totals = both.agg(*[F.sum(F.col(f"ds_{x}") * F.col("t") + F.col("share") * F.col("dt") * F.col(f"dt_{x}")).alias(x) for x in PARAMETERS])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(x).alias("parameter"), F.coalesce(x, F.lit(0.0)).alias("g")) for x in PARAMETERS])).alias("s")).select("s.*")
