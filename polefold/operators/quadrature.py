"""Nodes inside a bin: Gauss-Legendre panels with a bound on the error of a bin's mean."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def error_constant(points: int) -> float:
    """Constant of the error term of Gauss-Legendre with that many points (1/24 for the midpoint)."""
    return math.factorial(points) ** 4 / ((2 * points + 1) * math.factorial(2 * points) ** 3)


def peak_moment(order: int, a: float) -> float:
    """Largest derivative of even order of exp(a (cos t - 1)): a moment of a symmetric Skellam variable.

    Its even cumulants are all ``a`` and its odd ones 0, which gives the moments one from another.
    """
    if order % 2:
        raise ValueError("the order must be even")
    moments = {0: 1.0}
    for n in range(2, order + 1, 2):
        moments[n] = a * sum(math.comb(n - 1, n - 1 - m) * moments[m] for m in range(0, n - 1, 2))
    return moments[order]


def bound(points: int, panels: int, width: float, sigma: float) -> float:
    step = abs(width) / panels
    return error_constant(points) * step ** (2 * points) * peak_moment(2 * points, sigma**-2)


def nodes(points: int, panels: int) -> list[tuple[float, float]]:
    """Offsets in (0, 1) of a bin with weights that sum to 1."""
    at, weight = np.polynomial.legendre.leggauss(points)
    return [(float((panel + (x + 1) / 2) / panels), float(w / (2 * panels))) for panel in range(panels) for x, w in zip(at, weight)]


@dataclass(frozen=True)
class Rule:
    omega: tuple[int, int]  # points, panels
    eta: tuple[int, int]

    @property
    def size(self) -> int:
        return math.prod(self.omega) * math.prod(self.eta)


def choose(d_omega: float, d_eta: float, sigma: float, tol: float = 1e-3, cut_share: float = 0.0, most_points: int = 8, most_nodes: int = 64) -> Rule:
    """The rule of fewest nodes whose bound is within the tolerance; the smallest bound among those."""
    budget = tol - cut_share
    if budget <= 0:
        raise ValueError("the tolerance is not above the share that the cut takes")

    def options(width: float) -> list[tuple[int, float, tuple[int, int]]]:
        best: dict[int, tuple[float, tuple[int, int]]] = {}
        for points, panels in itertools.product(range(1, most_points + 1), range(1, most_nodes + 1)):
            if points * panels <= most_nodes:
                value = (bound(points, panels, width, sigma), (points, panels))
                best[points * panels] = min(best.get(points * panels, value), value)
        return [(n, b, r) for n, (b, r) in best.items()]

    fitting = [(n * m, b + c, r, s) for (n, b, r), (m, c, s) in itertools.product(options(d_omega), options(d_eta)) if b + c <= budget]
    if not fitting:
        raise ValueError("no rule meets the tolerance")
    _, _, omega, eta = min(fitting)
    return Rule(omega, eta)


def node_table(spark: SparkSession, rule: tuple[int, int]) -> DataFrame:
    """node(s, x, wq): a dimension table to cross with the bins."""
    return spark.createDataFrame([(i, float(x), float(w)) for i, (x, w) in enumerate(nodes(*rule))], "s int, x double, wq double")
