"""Tails of distributions: by numeric methods on the driver for single statistics, and as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26 (error below 1.5e-7).
ERFC_P, ERFC_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERFC_P * x)
    total = F.lit(0.0)
    for a in reversed(ERFC_A):
        total = (total + a) * t
    return total * F.exp(-x * x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_quantile(p: float, df: float) -> float:
    """Two-sided quantile: P(|T| > t) = p."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        if beta_cdf(df / (df + mid * mid), df / 2, 0.5) > p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def chi2_tail(x: float, df: float) -> float:
    """P(X > x), by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_tail(z: float) -> float:
    """Two-sided P(|Z| > z)."""
    return math.erfc(abs(z) / math.sqrt(2))


def studentized_range_tail(q: float, groups: int, df: float) -> float:
    """P(Q > q) by Gauss-Legendre quadrature over the range's and the scale's densities."""
    if q <= 0:
        return 1.0
    nodes, weights = np.polynomial.legendre.leggauss(96)
    z = 8.0 * nodes
    pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))

    def range_cdf(w: float) -> float:
        inner = cdf(z) - cdf(z - w)
        return float(groups * np.sum(8.0 * weights * pdf * inner ** (groups - 1)))

    if df > 5000:
        return max(0.0, 1 - range_cdf(q))
    # Scale s with s^2 * df chi-square distributed; integrate where its density isn't negligible.
    low, high = max(1e-6, 1 - 9 / math.sqrt(2 * df)), 1 + 9 / math.sqrt(2 * df)
    s = (high - low) / 2 * nodes + (high + low) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    values = np.array([range_cdf(q * v) for v in s])
    return max(0.0, min(1.0, 1 - float(np.sum((high - low) / 2 * weights * np.exp(log_density) * values))))
