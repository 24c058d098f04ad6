"""Tails of the chi-squared, F and t distributions, for the few statistics of a table that need a p-value."""

from __future__ import annotations

import math


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: its series below a + 1, its continued fraction beyond."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    return front * _fraction(lambda n: (-n * (n - a), x + 2 * n + 1 - a), x + 1 - a)


def _fraction(step, first: float) -> float:
    """1 / (first + a1 / (b1 + a2 / (b2 + ...))) for (a, b) = step(n), n from 1 on, by Lentz's method."""
    tiny = 1e-300
    c, d = 1 / tiny, 1 / (first or tiny)
    h = d
    for n in range(1, 10_000):
        a, b = step(n)
        d = 1 / ((b + a * d) or tiny)
        c = (b + a / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a

    def step(n: int) -> tuple[float, float]:
        m = n // 2
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if n % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    return front * _fraction(step, 1.0)


def chi2_sf(x: float, df: float) -> float:
    """The share of a chi-squared distribution beyond x."""
    return gamma_q(df / 2, x / 2)


def f_sf(x: float, df1: float, df2: float) -> float:
    """The share of an F distribution beyond x."""
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * x)) if x > 0 else 1.0


def t_sf(x: float, df: float) -> float:
    """The share of a t distribution beyond x."""
    half = beta_i(df / 2, 0.5, df / (df + x * x)) / 2
    return half if x > 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    """Where a share p of a t distribution lies below."""
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2
