"""Special functions over arrays: gamma family, normal, Student-t and F tails."""

from __future__ import annotations

import math

import numpy as np

_ERFC = np.vectorize(math.erfc, otypes=[float])


def _shifted(x: np.ndarray, least: float, term) -> tuple[np.ndarray, np.ndarray]:
    """x raised by whole steps to ``least`` or more, and the sum of ``term`` at each value passed."""
    x = np.array(x, float)
    total = np.zeros_like(x)
    while (low := x < least).any():
        total = total + np.where(low, term(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return x, total


def gammaln(x) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series above 10."""
    z, s = _shifted(x, 10.0, np.log)
    r = 1 / (z * z)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - s


def digamma(x) -> np.ndarray:
    z, s = _shifted(x, 10.0, lambda v: 1 / v)
    r = 1 / (z * z)
    return np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - s


def trigamma(x) -> np.ndarray:
    z, s = _shifted(x, 10.0, lambda v: 1 / (v * v))
    r = 1 / (z * z)
    return 1 / z + 0.5 * r + (r / z) * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66)))) + s


def norm_sf(x) -> np.ndarray:
    return 0.5 * _ERFC(np.asarray(x, float) / math.sqrt(2))


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inner = (y > 0) & (y < 1)
    safe = np.where(inner, y, 0.5)
    front = np.exp(gammaln(p + q) - gammaln(p) - gammaln(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(y)
    d = 1 / guard(1 - (p + q) * safe / (p + 1))
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / guard(1 + num * d)
            c = guard(1 + num / c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = np.where(inner, front * f, y)
    return np.where(flip, 1 - out, out)


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) with ``df`` degrees of freedom; NaN stays NaN."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    s = np.where(ok, t, 0.0)
    d = np.where(ok, df, 1.0)
    return np.where(ok, betainc(d / 2, 0.5, d / (d + s * s)), np.where(np.isinf(t), 0.0, np.nan))


def f_cdf(x, a, b) -> np.ndarray:
    x = np.asarray(x, float)
    return betainc(np.asarray(a) / 2, np.asarray(b) / 2, a * x / (a * x + b))


def f_ppf(p: float, a: float, b: float) -> float:
    """Quantile of the F distribution, by bisection."""
    low, high = 0.0, 1.0
    while float(f_cdf(high, a, b)) < p and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if float(f_cdf(mid, a, b)) < p else (low, mid)
    return (low + high) / 2
