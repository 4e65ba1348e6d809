"""Scalar column helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(value: Column, places: int = 4) -> Column:
    """Rounded, and never a negative zero, so that results compare by value."""
    return F.round(value, places) + F.lit(0.0)


def soft(v: Column, lam: float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - F.lit(lam), F.lit(0.0))


def nonneg_soft(v: Column, lam: float = 0.0) -> Column:
    return F.greatest(v - F.lit(lam), F.lit(0.0))


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


#: fixed values: rational approximation of erf, Abramowitz and Stegun 7.1.26
_P, _A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf_text(x: str) -> str:
    """erf of an SQL expression, absolute error below 1.5e-7; reads alike in Spark and other SQL."""
    t = f"(1.0D/(1.0D+{_P}D*abs({x})))"
    poly = f"({_A[4]}D)"
    for c in reversed(_A[:4]):
        poly = f"(({c}D)+{t}*{poly})"
    return f"(sign({x})*(1.0D-{t}*{poly}*exp(-({x})*({x}))))"


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + _P * F.abs(x))
    poly = F.lit(_A[4])
    for c in reversed(_A[:4]):
        poly = c + t * poly
    return F.signum(x) * (1.0 - t * poly * F.exp(-x * x))


#: fixed values: fit of ln(erfc(x) exp(x^2) / t) in t = 2 / (2 + x), Numerical Recipes' erfcc
_C = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfcx_text(x: str) -> str:
    """exp(x^2) erfc(x) of an SQL expression at x >= 0, relative error below 1.2e-7."""
    t = f"(1.0/(1.0+0.5*({x})))"
    poly = f"({_C[-1]})"
    for c in reversed(_C[:-1]):
        poly = f"(({c})+{t}*{poly})"
    return f"({t}*exp({poly}))"


def erfcx(x: Column) -> Column:
    """exp(x^2) erfc(x) for x >= 0, relative error below 1.2e-7 however small erfc becomes."""
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(_C[-1])
    for c in reversed(_C[:-1]):
        poly = c + t * poly
    return t * F.exp(poly)


def erfc(x: Column) -> Column:
    """1 - erf(x) without cancellation, relative error below 1.2e-7."""
    tail = erfcx(F.abs(x)) * F.exp(-x * x)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def gauss_peak(x: Column, sigma: Column) -> Column:
    return F.exp(-x * x / (2 * sigma * sigma)) / (sigma * (2 * math.pi) ** 0.5)


def tail_peak(x: Column, sigma: Column, alpha: Column, exact: bool = False) -> Column:
    """Gaussian with an exponential tail, unit area; the exact form, or the older approximate one."""
    root2 = 2.0**0.5
    u = (sigma / alpha - x / sigma) / root2 if exact else sigma / alpha - x / (root2 * sigma)
    power = sigma * sigma / (2 * alpha * alpha) - x / alpha
    # far out both factors leave the range of numbers, their product does not
    far = erfcx(F.greatest(u, F.lit(0.0))) * F.exp(clip(power - u * u, -800.0, 700.0))
    near = erfc(F.least(u, F.lit(0.0))) * F.exp(clip(power, -800.0, 700.0))
    return F.when(u >= 0, far).otherwise(near) / (2 * alpha)


def edge_profile(x: Column, sigma: Column, alpha: Column, kind: str = "legacy") -> Column:
    """"legacy": a plain Gaussian where sigma >= 0.2 alpha, else the approximate tail; "emg": exact."""
    if kind == "emg":
        return tail_peak(x, sigma, alpha, exact=True)
    return F.when(sigma >= 0.2 * alpha, gauss_peak(x, sigma)).otherwise(tail_peak(x, sigma, alpha))


#: fixed values of the empirical pulse-tail fit
_TAIL = (1.39341, 0.18492, 18.94806, -10.82914, 16.6964)


def pulse_tail(lam: Column) -> Column:
    p1, p2, p3, p4, p5 = _TAIL
    return erf((lam - p1) / p2) * (p3 + p4 * lam) + p5 * lam
