"""Vectorised NumPy helpers for gamma mixtures, used inside Arrow batches and on binned data."""

from __future__ import annotations

import numpy as np

_LOG_2PI = float(np.log(2 * np.pi))
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x: Stirling's series ten units to the right, shifted back."""
    x = np.asarray(x, dtype=float)
    z = x + 10.0
    inv = 1.0 / z
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    # Two products of five keep the intermediate far from overflow.
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4)
    high = (x + 5) * (x + 6) * (x + 7) * (x + 8) * (x + 9)
    back = np.log(low) + np.log(high)
    return (z - 0.5) * np.log(z) - z + 0.5 * _LOG_2PI + series - back


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log Gamma for positive x: asymptotic series ten units to the right, stepped back."""
    x = np.asarray(x, dtype=float)
    z = x + 10.0
    inv2 = 1.0 / (z * z)
    back = sum(1.0 / (x + i) for i in range(10))
    return np.log(z) - 0.5 / z - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 / 240))) - back


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log Gamma for positive x, in the same way."""
    x = np.asarray(x, dtype=float)
    inv = 1.0 / (x + 10.0)
    inv2 = inv * inv
    back = sum(1.0 / (x + i) ** 2 for i in range(10))
    return inv + 0.5 * inv2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 / 30))) + back


def _series(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1.0 / s
    total = term.copy()
    for k in range(1, 500):
        term = term * x / (s + k)
        total += term
        if np.all(term <= total * 1e-15):
            break
    return total * np.exp(-x + s * np.log(x) - lgamma(s))


def _fraction(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper tail by a continued fraction (modified Lentz)."""
    tiny = 1e-300
    b = x + 1.0 - s
    c = np.full_like(x, 1 / tiny)
    d = 1.0 / b
    h = d.copy()
    for i in range(1, 500):
        an = -i * (i - s)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = d * c
        h *= step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h * np.exp(-x + s * np.log(x) - lgamma(s))


def _quadrature(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Large shapes: Gauss-Legendre over the near tail, at constant cost."""
    m = s - 1.0
    root = np.sqrt(m)
    above = x > m
    far = np.where(above, np.maximum(m + 11.5 * root, x + 6.0 * root), np.maximum(0.0, np.minimum(m - 7.5 * root, x - 5.0 * root)))
    half = 0.5 * (far - x)
    t = 0.5 * (far + x)[:, None] + half[:, None] * _NODES[None, :]
    t = np.maximum(t, 1e-300)
    f = np.exp(-(t - m[:, None]) + m[:, None] * (np.log(t) - np.log(m)[:, None]))
    area = (f * _WEIGHTS[None, :]).sum(axis=1) * half * np.exp(m * (np.log(m) - 1.0) - lgamma(s))
    return np.where(above, 1.0 - area, -area)


def cdf(x: np.ndarray, shape: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma P(shape, rate * x)."""
    s = np.asarray(shape, dtype=float)
    y = np.asarray(rate, dtype=float) * np.asarray(x, dtype=float)
    out = np.zeros_like(y)
    live = y > 0
    big = live & (s > 200)
    low = live & ~big & (y < s + 1)
    high = live & ~big & ~low
    for mask, function, upper in ((big, _quadrature, False), (low, _series, False), (high, _fraction, True)):
        if mask.any():
            value = function(s[mask], y[mask])
            out[mask] = 1.0 - value if upper else value
    return np.clip(out, 0.0, 1.0)


def _density(x: np.ndarray, shape: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Derivative of the cdf with respect to log x."""
    return np.exp(shape * np.log(rate * x) - rate * x - lgamma(shape))


def mixture_quantile(p: float, q, s1, r1, s2, r2, steps: int = 100) -> np.ndarray:
    """Quantile of q*Gamma(s1, r1) + (1-q)*Gamma(s2, r2), searched on log x.

    Newton steps inside a shrinking bracket; a step that leaves the bracket is
    replaced by bisection, so it always converges.
    """
    lo = np.full(q.shape, -20.0)
    hi = np.full(q.shape, 20.0)
    t = np.log(np.clip(q * s1 / r1 + (1 - q) * s2 / r2, 1e-8, 1e8))
    active = np.ones(q.shape, dtype=bool)
    for _ in range(steps):
        i = np.flatnonzero(active)
        if i.size == 0:
            break
        x = np.exp(t[i])
        gap = q[i] * cdf(x, s1[i], r1[i]) + (1 - q[i]) * cdf(x, s2[i], r2[i]) - p
        slope = q[i] * _density(x, s1[i], r1[i]) + (1 - q[i]) * _density(x, s2[i], r2[i])
        hi[i] = np.where(gap > 0, t[i], hi[i])
        lo[i] = np.where(gap > 0, lo[i], t[i])
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            proposal = t[i] - gap / slope
        inside = np.isfinite(proposal) & (proposal > lo[i]) & (proposal < hi[i])
        fresh = np.where(inside, proposal, 0.5 * (lo[i] + hi[i]))
        active[i] = np.abs(fresh - t[i]) > 1e-12
        t[i] = fresh
    return np.exp(t)
