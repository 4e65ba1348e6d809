"""One linear operator for all forward models: a chain of sparse weight tables.

Every link is a table with columns (shared keys, input key, output key, weight). ``forward`` joins
and sums link by link; ``adjoint`` takes the same links in the opposite direction with the keys
exchanged. Single-phase, multi-phase, bulk, matrix and wavelength operators differ only in their links.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    table: DataFrame
    shared: tuple[str, ...]
    source: tuple[str, ...]
    target: tuple[str, ...]
    weight: str = "w"
    carried: tuple[str, ...] = ()  # keys of the vector that the table doesn't have

    def _apply(self, vector: DataFrame, on: tuple[str, ...], to: tuple[str, ...], extra: tuple[str, ...]) -> DataFrame:
        table = self.table.withColumnRenamed(self.weight, "_w")
        keys = [k for k in (*self.carried, *extra) if k in vector.columns]
        joined = vector.join(table, [*on])
        return joined.groupBy(*dict.fromkeys([*to, *keys])).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))

    def restricted(self, condition: str) -> Link:
        return replace(self, table=self.table.where(condition))

    def forward(self, vector: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        on = tuple(k for k in (*self.shared, *self.source) if k in vector.columns)
        return self._apply(vector, on, (*self.shared, *self.target), extra)

    def adjoint(self, vector: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        on = tuple(k for k in (*self.shared, *self.target) if k in vector.columns)
        return self._apply(vector, on, (*self.shared, *self.source), extra)


@dataclass(frozen=True)
class LinearOp:
    """A = link_n ... link_1. Vectors have the column ``v``; ``extra`` key columns (input, row set, phase) pass through."""

    links: Sequence[Link]

    def forward(self, x: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        for link in self.links:
            x = link.forward(x, extra)
        return x

    def adjoint(self, y: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        for link in reversed(self.links):
            y = link.adjoint(y, extra)
        return y

    def restrict(self, condition: str) -> LinearOp:
        """The rows for which a condition on the links' shared columns holds; it reaches their scans."""
        return replace(self, links=[k.restricted(condition) for k in self.links])

    def row_sums(self) -> DataFrame:
        """A 1 on all coefficients that any link touches, from the tables alone."""
        first = self.links[0]
        ones = first.table.groupBy(*first.shared, *first.target).agg(F.sum(first.weight).alias("v"))
        for link in self.links[1:]:
            sums = link.table
            on = [k for k in (*link.shared, *link.source) if k in ones.columns]
            keys = [*dict.fromkeys([*link.shared, *link.target, *[c for c in ones.columns if c != "v" and c not in link.source]])]
            ones = ones.join(sums.withColumnRenamed(link.weight, "_w"), on).groupBy(*keys).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
        return ones


def tomographic(radon: DataFrame, pf: DataFrame, scale: float = 1.0) -> LinearOp:
    """coef(k, p) -> data(a, y, j): projection of every orientation's image, then its pole figures."""
    project = Link(radon, (), ("p",), ("a", "y"), "w", ("k",))
    figures = Link(pf.select("a", "k", "j", (F.col("v") * scale).alias("w")), ("a",), ("k",), ("j",), "w", ("y",))
    return LinearOp([project, figures])


def tomographic_blocks(projection, pf: DataFrame, scale: float = 1.0) -> LinearOp:
    """As :func:`tomographic`, with a :class:`blocks.BlockProjection` in place of the table of weights."""
    return LinearOp([projection, tomographic(pf.select("a", F.lit(0).alias("y"), F.lit(0).alias("p"), F.lit(0.0).alias("w")), pf, scale).links[1]])


def bulk(pf: DataFrame) -> LinearOp:
    """coef(k) -> data(a, j): pole figures of a whole sample, no projection."""
    return LinearOp([Link(pf.select("a", "k", "j", F.col("v").alias("w")), (), ("k",), ("a", "j"), "w")])


def matrix(radon: DataFrame, b: DataFrame) -> LinearOp:
    """coef(k, p) -> data(a, y, l) with a user's matrix b(a, k, l, v)."""
    project = Link(radon, (), ("p",), ("a", "y"), "w", ("k",))
    return LinearOp([project, Link(b.select("a", "k", "l", F.col("v").alias("w")), ("a",), ("k",), ("l",), "w", ("y",))])


def with_powder(b: DataFrame, spectrum: DataFrame, k: int) -> DataFrame:
    """b(a, k, l, v) and one more column ``k``: a spectrum(l, v) that is the same at every angle."""
    angles = b.select("a").distinct()
    return b.select("a", "k", "l", "v").unionByName(angles.crossJoin(F.broadcast(spectrum)).select("a", F.lit(k).alias("k"), "l", "v"))


def phases_forward(parts: dict[str, tuple[LinearOp, DataFrame]], keys: tuple[str, ...] = ("a", "y", "j")) -> DataFrame:
    """Contributions of several phases, each with its own operator, added."""
    total = None
    for op, x in parts.values():
        made = op.forward(x).select(*keys, "v")
        total = made if total is None else total.unionByName(made)
    return total.groupBy(*keys).agg(F.sum("v").alias("v"))


def broaden(pf: DataFrame, bins: DataFrame) -> DataFrame:
    """pf(a, k, c, r) onto two-theta bins: bins(r, t, w) is the small ring x bin table."""
    return pf.join(F.broadcast(bins), "r").groupBy("a", "k", "c", "t").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def power_iteration(op: LinearOp, x0: DataFrame, keys: tuple[str, ...], rounds: int, weights: DataFrame | None = None, data_keys: tuple[str, ...] = ("a", "y", "j")) -> list[float]:
    """Estimates of the largest eigenvalue of A^T W A; one scalar a round reaches the driver."""
    from ..plans.state import materialise

    x, found = x0, []
    for _ in range(rounds):
        norm = x.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0]
        x = materialise(x.select(*keys, (F.col("v") / norm).alias("v")))
        y = op.forward(x)
        if weights is not None:
            y = y.join(weights, list(data_keys)).select(*data_keys, (F.col("v") * F.col("w")).alias("v"))
        z = materialise(op.adjoint(y).select(*keys, "v"))
        found.append(x.withColumnRenamed("v", "x").join(z, list(keys)).agg(F.sum(F.col("x") * F.col("v"))).first()[0])
        x = z
    return found
