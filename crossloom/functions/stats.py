"""Distributions without SciPy: gamma and beta integrals, normal quantiles, a normality test."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_sf2(x: float, df: float) -> float:
    """Two-sided."""
    return beta_i(df / 2, 0.5, df / (df + x * x))


def inverse(fn, target: float, low: float, high: float) -> float:
    """Where a decreasing function reaches a value, by bisection."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if fn(mid) > target else (low, mid)
    return (low + high) / 2


def f_quantile(p: float, d1: float, d2: float) -> float:
    return inverse(lambda x: f_sf(x, d1, d2), 1 - p, 0, 1e6)


def norm_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def norm_quantile_udf(p):
    """Column of normal quantiles, null outside (0, 1)."""

    @F.pandas_udf("double")
    def quantile(x: pd.Series) -> pd.Series:
        inv = NormalDist().inv_cdf
        return x.map(lambda v: inv(v) if 0 < v < 1 else None)

    return quantile(p)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk's test by Royston's approximation: (W, p) for 3 to 5000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([norm_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)])
    c, u = m / math.sqrt(m @ m), 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[[0, 2]] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        # Royston's (1995) polynomial coefficients.
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, c[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
            phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[[1, -2]] = -second, second
        else:
            phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[[0, -1]] = -last, last
    w = (a @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(1, w))) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1e-300, 1 - w))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return w, 1e-19
        y = -math.log(g - y)
        mu, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - NormalDist().cdf((y - mu) / sd)
