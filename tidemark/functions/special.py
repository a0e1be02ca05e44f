"""Special functions in NumPy: what the parametric families need beyond the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)
_inv = np.frompyfunc(NormalDist().inv_cdf, 1, 1)


def lgamma(x):
    return np.asarray(_lgamma(x), float)


def normal_cdf(x):
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def normal_ppf(p):
    return np.asarray(_inv(np.asarray(p, float)), float)


def chi2_sf(x: float, dof: int) -> float:
    """Upper tail of chi-square, by the regularized incomplete gamma function."""
    return 1.0 if x <= 0 else float(1 - gamma_p(dof / 2, np.array([x / 2]))[0])


def gamma_p(a: float, x: np.ndarray) -> np.ndarray:
    """Regularized lower incomplete gamma P(a, x): series below a + 1, continued fraction above."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    low = (x > 0) & (x < a + 1)
    if low.any():
        y, term = x[low], np.full(low.sum(), 1 / a)
        total, k = term.copy(), a
        for _ in range(1000):
            k += 1
            term = term * y / k
            total += term
            if (term < 1e-17 * total).all():
                break
        out[low] = total * np.exp(-y + a * np.log(y) - math.lgamma(a))
    high = x >= a + 1
    if high.any():
        y = x[high]
        b, tiny = y + 1 - a, 1e-300
        c, d = np.full_like(y, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
            c = np.where(np.abs(b + an / c) < tiny, tiny, b + an / c)
            step = c * d
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - np.exp(-y + a * np.log(y) - math.lgamma(a)) * h
    return out


def beta_i(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b) by its continued fraction."""
    x = np.clip(np.asarray(x, float), 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    y = np.where(flip, 1 - x, x)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < tiny, tiny, 1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + num * d) < tiny, tiny, 1 + num * d)
            c = np.where(np.abs(1 + num / c) < tiny, tiny, 1 + num / c)
            h = h * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    part = np.where(y == 0, 0.0, front * h)
    return np.where(flip, 1 - part, part)


def log_bessel_k(v: float, x: np.ndarray, nodes: int = 96) -> np.ndarray:
    """ln K_v(x) for x > 0, by the trapezoid rule on the integral of exp(-x cosh t) cosh(v t)."""
    x = np.atleast_1d(np.asarray(x, float))
    top = np.arccosh(1 + (50 + abs(v) * 8) / x)
    t = np.linspace(0, 1, nodes)[:, None] * top
    e = -x * (np.cosh(t) - 1) + abs(v) * t + np.log1p(np.exp(-2 * abs(v) * t)) - math.log(2)
    peak = e.max(axis=0)
    w = np.exp(e - peak)
    w[0] /= 2
    return peak - x + np.log(w.sum(axis=0) * top / (nodes - 1))
