"""Projection of many orientations at once: channels in dense blocks, one matrix product an angle.

The long-table projection (:mod:`projector`) forms a row for every pixel, angle, bin and channel. Where
most pixels hold most channels, a block of channels is a dense array of bounded size (pixels x
``block``), and the footprint weights of an angle, made where they are used, act on it as one matrix.
Only coefficients and projections are shuffled, each once, by block. As a link of an operator chain
(:mod:`linop`) it gives what the table of weights gives.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def footprint(gx: float, gy: float, t0: float, nx: int, ny: int, ns: int) -> np.ndarray:
    """Weights [bin, pixel] of one angle (distance driven)."""
    p = np.arange(nx * ny)
    t = gx * (p % nx) + gy * (p // nx) + t0
    big = max(abs(gx), abs(gy))
    out = np.zeros((ns, nx * ny))
    first = np.ceil(t - (1 + big) / 2).astype(int)
    for step in range(3):  # a pixel's shadow is at most two bins wide
        y = first + step
        w = np.minimum(np.maximum((1 + big) / 2 - np.abs(t - y), 0.0), min(1.0, big)) / big
        ok = (y >= 0) & (y < ns) & (w > 1e-9)
        out[y[ok], p[ok]] = w[ok]
    return out


@dataclass(frozen=True)
class BlockProjection:
    """coef(k, p, v) -> sino(a, y, k, v) and back. ``geo`` (angles with gx, gy, t0) is a dimension of the scan."""

    geo: DataFrame
    nx: int
    ny: int
    ns: int
    block: int = 64

    def restricted(self, condition: str) -> BlockProjection:
        return replace(self, geo=self.geo.where(condition))

    def _dealt(self, vector: DataFrame, columns: list[str]) -> DataFrame:
        parts = int(vector.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # a given number, so that adaptive execution does not join the few but heavy blocks
        return vector.select(F.floor(F.col("k") / self.block).cast("int").alias("_b"), *columns).repartition(parts, "_b")

    def forward(self, x: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        if extra:
            raise ValueError("blocks have no further keys")
        angles = [(r["a"], r["gx"], r["gy"], r["t0"]) for r in self.geo.select("a", "gx", "gy", "t0").orderBy("a").collect()]
        nx, ny, ns, block = self.nx, self.ny, self.ns, self.block

        def work(rows: pa.Table) -> pa.Table:
            k, p, v = (rows.column(c).to_numpy() for c in ("k", "p", "v"))
            first = int(k.min()) // block * block
            images = np.zeros((nx * ny, block))
            np.add.at(images, (p, k - first), v)
            made = np.stack([footprint(gx, gy, t0, nx, ny, ns) @ images for _, gx, gy, t0 in angles]) if angles else np.zeros((0, ns, block))
            at = np.nonzero(made)
            numbers = np.array([a for a, *_ in angles], np.int32)
            columns = [numbers[at[0]] if len(numbers) else np.zeros(0, np.int32), at[1].astype(np.int32), (at[2] + first).astype(np.int32), made[at]]
            return pa.table(columns, names=["a", "y", "k", "v"])

        return self._dealt(x, ["k", "p", "v"]).groupBy("_b").applyInArrow(work, "a int, y int, k int, v double")

    def adjoint(self, y: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        if extra:
            raise ValueError("blocks have no further keys")
        angles = {r["a"]: (r["gx"], r["gy"], r["t0"]) for r in self.geo.select("a", "gx", "gy", "t0").collect()}
        nx, ny, ns, block = self.nx, self.ny, self.ns, self.block

        def work(rows: pa.Table) -> pa.Table:
            a, at, k, v = (rows.column(c).to_numpy() for c in ("a", "y", "k", "v"))
            first = int(k.min()) // block * block
            images, touched = np.zeros((nx * ny, block)), np.zeros((nx * ny, block), bool)
            for number in np.unique(a).tolist():
                if number in angles:
                    own = a == number
                    lines = np.zeros((ns, block))
                    np.add.at(lines, (at[own], k[own] - first), v[own])
                    weights = footprint(*angles[number], nx, ny, ns)
                    images += weights.T @ lines
                    present = np.zeros((ns, block), np.float32)  # which cells a row of the vector reaches, whatever its value
                    present[at[own], k[own] - first] = 1
                    touched |= (weights > 0).astype(np.float32).T @ present > 0
            spots = np.nonzero(touched)
            columns = [(spots[1] + first).astype(np.int32), spots[0].astype(np.int32), images[spots]]
            return pa.table(columns, names=["k", "p", "v"])

        return self._dealt(y, ["a", "y", "k", "v"]).groupBy("_b").applyInArrow(work, "k int, p int, v double")
