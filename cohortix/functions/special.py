"""Special functions in NumPy: incomplete beta, Student's t, normal quantiles."""

from __future__ import annotations

import math

import numpy as np


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    g = np.vectorize(math.lgamma, otypes=[float])
    return g(a) + g(b) - g(a + b)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, turns: int = 500) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, turns):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out = out * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    if ok.any():
        p, q, y = a[ok], b[ok], x[ok]
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta(p, q))
        low = y < (p + 1) / (p + q + 2)
        r = np.empty_like(y)
        if low.any():
            r[low] = front[low] * beta_fraction(p[low], q[low], y[low]) / p[low]
        if (~low).any():
            r[~low] = 1 - front[~low] * beta_fraction(q[~low], p[~low], 1 - y[~low]) / q[~low]
        out[ok] = r
    return out


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) of Student's t with df degrees of freedom; NaN stays."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isnan(t), np.nan, incomplete_beta(df / 2, 0.5, df / (df + t * t)))


def normal_quantile(p) -> np.ndarray:
    """Inverse of the standard normal distribution, by Newton's method on an initial guess of its tails."""
    p = np.asarray(p, dtype=float)
    out = np.full(p.shape, np.nan)
    out[p == 0], out[p == 1] = -np.inf, np.inf
    ok = (p > 0) & (p < 1)
    if ok.any():
        q = np.minimum(p[ok], 1 - p[ok])
        s = np.sqrt(-2 * np.log(q))
        z = s - (2.30753 + 0.27061 * s) / (1 + 0.99229 * s + 0.04481 * s * s)  # the guess of Hastings, of the upper tail
        erfc = np.vectorize(math.erfc, otypes=[float])
        for _ in range(6):
            tail = 0.5 * erfc(z / math.sqrt(2))
            step = (tail - q) / np.maximum(np.exp(-z * z / 2) / math.sqrt(2 * math.pi), 1e-300)
            z = z + step / (1 - np.clip(z * step / 2, -0.5, 0.5))
        out[ok] = np.where(p[ok] < 0.5, -z, z)
    return out


def g_to_z(g, df) -> np.ndarray:
    """Normal score with the same tail as a t-like statistic of df degrees of freedom; df above 1e7 counts as normal."""
    g, df = np.broadcast_arrays(np.asarray(g, dtype=float), np.asarray(df, dtype=float))
    normal = df > 1e7
    with np.errstate(invalid="ignore", divide="ignore"):
        tail = np.where(df == 1, np.arctan2(1.0, np.abs(g)) / math.pi, incomplete_beta(df / 2, 0.5, 1 / (1 + g * g / df)) / 2)
    z = -normal_quantile(np.where(np.isnan(tail), 0.5, tail))
    return np.where(normal, g, np.sign(g) * z)


def pearson_p(r, n) -> np.ndarray:
    """Two-sided p of a Pearson correlation of n pairs."""
    r, n = np.asarray(r, dtype=float), np.asarray(n, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return t_two_sided(r * np.sqrt((n - 2) / np.maximum(1 - r * r, 1e-300)), n - 2)
