"""Genetic map functions: distance in cM to recombination fraction and back, as Columns and as numpy functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MOST = 0.5 - 1e-14


def mf_h(d: Column) -> Column:
    """Haldane."""
    return 0.5 * (1 - F.exp(-d / 50))


def imf_h(r: Column) -> Column:
    return -50 * F.log(1 - 2 * F.least(r, F.lit(_MOST)))


def mf_k(d: Column) -> Column:
    """Kosambi."""
    return 0.5 * F.tanh(d / 50)


def imf_k(r: Column) -> Column:
    return 50 * F.atanh(2 * F.least(r, F.lit(_MOST)))


def mf_m(d: Column) -> Column:
    """Morgan."""
    return F.least(d / 100, F.lit(0.5))


def imf_m(r: Column) -> Column:
    return F.least(r * 100, F.lit(50.0))


def imf_cf(r: Column) -> Column:
    """Carter-Falconer, inverse."""
    r = F.least(r, F.lit(_MOST))
    return 12.5 * (F.log(1 + 2 * r) - F.log(1 - 2 * r)) + 25 * F.atan(2 * r)


def mf_cf(d: Column) -> Column:
    """Carter-Falconer: no closed form; bisection on whole batches."""

    @F.pandas_udf("double")
    def solve(x: pd.Series) -> pd.Series:
        return pd.Series(np_mf(x.to_numpy(float), "c-f"))

    return solve(d)


def np_imf(r: np.ndarray, kind: str) -> np.ndarray:
    """Distance in cM; kind: haldane, kosambi, c-f, morgan."""
    r = np.minimum(np.asarray(r, float), _MOST)
    if kind == "haldane":
        return -50 * np.log(1 - 2 * r)
    if kind == "kosambi":
        return 50 * np.arctanh(2 * r)
    if kind == "c-f":
        return 12.5 * (np.log(1 + 2 * r) - np.log(1 - 2 * r)) + 25 * np.arctan(2 * r)
    return np.minimum(100 * r, 50)


def np_mf(d: np.ndarray, kind: str) -> np.ndarray:
    d = np.asarray(d, float)
    if kind == "haldane":
        return 0.5 * (1 - np.exp(-d / 50))
    if kind == "kosambi":
        return 0.5 * np.tanh(d / 50)
    if kind == "c-f":
        low, high = np.zeros(d.shape), np.full(d.shape, _MOST)
        d = np.minimum(d, 300)
        for _ in range(60):
            mid = (low + high) / 2
            under = np_imf(mid, "c-f") < d
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        return (low + high) / 2
    return np.minimum(d / 100, 0.5)


def mf_stahl(d: Column, m: int = 0, p: float = 0.0) -> Column:
    """The chi-square model with a share ``p`` of points without interference; ``d`` in cM."""
    x = d / 100
    lam = 2 * (m + 1) * x * (1 - p)
    total = F.lit(0.0)
    for i in range(m + 1):
        total = total + (1 - i / (m + 1)) * F.exp(-lam) * F.pow(lam, F.lit(float(i))) / math.factorial(i)
    return 0.5 * (1 - F.exp(-2 * x * p) * total)


def np_mf_stahl(d: np.ndarray, m: int = 0, p: float = 0.0) -> np.ndarray:
    x = np.asarray(d, float) / 100
    lam = 2 * (m + 1) * x * (1 - p)
    total = sum((1 - i / (m + 1)) * np.exp(-lam) * lam**i / math.factorial(i) for i in range(m + 1))
    return 0.5 * (1 - np.exp(-2 * x * p) * total)


def np_imf_stahl(r: np.ndarray, m: int = 0, p: float = 0.0) -> np.ndarray:
    """Between Morgan's distance (total interference) and Haldane's (none), by bisection; in cM."""
    r = np.minimum(np.asarray(r, float), _MOST)
    low, high = 100 * r, np_imf(r, "haldane")
    for _ in range(100):
        mid = (low + high) / 2
        under = np_mf_stahl(mid, m, p) < r
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def imf_stahl(r: Column, m: int = 0, p: float = 0.0) -> Column:
    @F.pandas_udf("double")
    def solve(x: pd.Series) -> pd.Series:
        return pd.Series(np_imf_stahl(x.to_numpy(float), m, p))

    return solve(r)


MAP_FUNCTIONS = {"haldane": (mf_h, imf_h), "kosambi": (mf_k, imf_k), "c-f": (mf_cf, imf_cf), "morgan": (mf_m, imf_m)}


def adjust_rf_ri(r: Column, kind: str = "self", chrtype: str = "A", expand: bool = True) -> Column:
    """Recombination fraction of one meiosis to that of inbred lines, and back."""
    a, b = {("self", "A"): (2.0, 2.0), ("sib", "A"): (4.0, 6.0), ("sib", "X"): (8 / 3, 4.0), ("self", "X"): (2.0, 2.0)}[(kind, chrtype)]
    return a * r / (1 + b * r) if expand else r / (a - b * r)


def grid(positions: np.ndarray, step: float, off_end: float = 0.0, stepwidth: str = "fixed") -> list[tuple[float, int]]:
    """(position, index of the marker there or -1) in order: markers and pseudomarkers.

    fixed: every ``step`` cM from the first position; variable: the fewest points needed, the step of the whole chromosome bent to
    end at its end; max: equal parts of each interval, none wider than ``step``."""
    positions = np.asarray(positions, float)
    out = [(float(x), k) for k, x in enumerate(positions)]
    low, high = positions.min() - off_end, positions.max() + off_end
    if step > 0:
        if stepwidth == "fixed":
            extra = np.arange(low, high + 1e-9, step)
        elif stepwidth == "variable":
            n = max(1, math.ceil((high - low) / step)) if high > low else 1
            extra = np.linspace(low, high, n + 1)
        else:
            parts = [np.linspace(a, b, math.ceil((b - a) / step) + 1)[1:-1] for a, b in zip(positions, positions[1:], strict=False) if b - a > step]
            extra = np.concatenate([*parts, [low, high] if off_end else []]) if parts or off_end else np.zeros(0)
        out += [(float(x), -1) for x in extra if np.abs(positions - x).min() > 1e-6]
    elif off_end:
        out += [(float(low), -1), (float(high), -1)]
    return sorted(out)


def locus_name(chr_: str, pos: float) -> str:
    """Name of a pseudomarker."""
    return f"c{chr_}.loc{round(pos, 1):g}"
