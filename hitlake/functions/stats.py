"""Phases, bins and binomial intervals as column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BCID_PERIOD_NS, Z_68


def phase(t: Column) -> Column:
    """Time within the BCID period, in ns."""
    return F.pmod(t, F.lit(BCID_PERIOD_NS))


def wrap_phase(d: Column, period: float = BCID_PERIOD_NS) -> Column:
    """A phase difference in [-period/2, period/2)."""
    return F.pmod(d + period / 2, F.lit(period)) - period / 2


def bin_index(x: Column, lo: Column, hi: Column, bins: int | Column) -> Column:
    """Bin of x in [lo, hi] of equal bins, the last closed on the right; null outside."""
    n = bins if isinstance(bins, Column) else F.lit(bins)
    at = F.floor((x - lo) * n / (hi - lo)).cast("long")
    return F.when((x >= lo) & (x <= hi), F.least(at, n.cast("long") - 1))


def bin_center(i: Column, lo: float, hi: float, bins: int) -> Column:
    """Middle of bin i."""
    return F.lit(lo) + (i + 0.5) * ((hi - lo) / bins)


def wilson(k: Column, n: Column, z: float = Z_68) -> Column:
    """struct(lo, hi): the Wilson interval of k of n; (0, 1) for n = 0."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    square = F.try_divide(F.lit(z * z), n.cast("double"))
    centre = (p + square / 2) / (1 + square)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.try_divide(square, 4 * n.cast("double"))) / (1 + square)
    lo = F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0))
    hi = F.coalesce(F.least(F.lit(1.0), centre + half), F.lit(1.0))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


CL_68 = 0.6827  # fixed value: the interval's level


def _beta_ratio(a: np.ndarray, b: np.ndarray, x: np.ndarray, log_beta: np.ndarray) -> np.ndarray:
    """Regularized incomplete beta function: its continued fraction, on the side of the mean where that converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16)) - log_beta) / a
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 50 + 8 * int(np.sqrt(max(a.max(initial=1), b.max(initial=1))))):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + term * d), away(1 + term / c)
            value = value * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return np.where(swap, 1 - front * value, front * value)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x at which the beta distribution of a and b has reached p, by bisection."""
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    low, high, log_beta = np.zeros_like(a), np.ones_like(a), lgamma(a) + lgamma(b) - lgamma(a + b)
    for _ in range(60):
        x = (low + high) / 2
        under = _beta_ratio(a, b, x, log_beta) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


def clopper_pearson(k: Column, n: Column, level: float = CL_68) -> Column:
    """struct(lo, hi): the exact binomial interval of k of n; (0, 1) for n = 0. A row is a capture and station, so numpy serves."""

    @F.pandas_udf("lo double, hi double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        k, n = k.to_numpy(np.float64, na_value=0), n.to_numpy(np.float64, na_value=0)
        low, high = (n > 0) & (k > 0), (n > 0) & (k < n)
        lo, hi = np.zeros(len(k)), np.ones(len(k))
        if low.any():
            lo[low] = beta_quantile((1 - level) / 2, k[low], n[low] - k[low] + 1)
        if high.any():
            hi[high] = beta_quantile(1 - (1 - level) / 2, k[high] + 1, n[high] - k[high])
        return pd.DataFrame({"lo": lo, "hi": hi})

    return interval(k, n)


def gaussian(x: Column, amplitude: Column, mu: Column, sigma: Column, bg: Column) -> Column:
    """A * exp(-((x - mu) / sigma)^2 / 2) + bg."""
    u = (x - mu) / sigma
    return amplitude * F.exp(-0.5 * u * u) + bg


def fit_gaussians(x: np.ndarray, y: np.ndarray, start: np.ndarray, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares amplitude, mu, sigma and bg of curves (one a row), and which of them converged; start has the first values.

    Bins within six sigma of the start's mu count. Bounds: amplitude and bg from 0, mu within six sigma of the start,
    sigma from 1 to six times the start's. Damped Gauss-Newton steps (Levenberg and Marquardt) are cut at the bounds;
    what stands at a bound and is pushed beyond it rests. The start stays where it is outside the bounds, has under four
    bins or does not converge.
    """
    mu, sigma = start[:, 1], start[:, 2]
    low = np.column_stack([np.zeros_like(mu), mu - 6 * sigma, np.ones_like(mu), np.zeros_like(mu)])
    high = np.column_stack([np.full_like(mu, np.inf), mu + 6 * sigma, 6 * sigma, np.full_like(mu, np.inf)])
    with np.errstate(all="ignore"):
        use = (np.abs(x - mu[:, None]) <= 6 * sigma[:, None]).astype(float)
        ok = np.isfinite(start).all(1) & (start >= low).all(1) & (start <= high).all(1) & (use.sum(1) >= 4)
    p, damping, done = np.where(ok[:, None], start, 1.0), np.full(len(start), 1e-3), ~ok

    def residual(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u = (x - p[:, 1:2]) / p[:, 2:3]
        bell = np.exp(-0.5 * u * u)
        return use * (p[:, :1] * bell + p[:, 3:] - y), u, bell

    r, u, bell = residual(p)
    cost = (r * r).sum(1)
    for _ in range(steps):
        if done.all():
            break
        slope = use[:, :, None] * np.stack([bell, p[:, :1] * bell * u / p[:, 2:3], p[:, :1] * bell * u * u / p[:, 2:3], np.ones_like(x)], 2)
        down = -np.einsum("gmi,gm->gi", slope, r)
        free = ~((p <= low) & (down < 0) | (p >= high) & (down > 0))
        normal = np.einsum("gmi,gmj->gij", slope, slope) * (free[:, :, None] & free[:, None, :])
        at = np.arange(4)
        normal[:, at, at] = np.where(free, normal[:, at, at] * (1 + damping[:, None]) + 1e-12, 1.0)
        tried = np.clip(p + np.linalg.solve(normal, (down * free)[:, :, None])[:, :, 0], low, high)
        tried = np.where(done[:, None], p, tried)
        r2, u2, bell2 = residual(tried)
        cost2 = (r2 * r2).sum(1)
        better = cost2 <= cost
        small_step = (np.abs(tried - p) <= 1e-11 * (1 + np.abs(p))).all(1)
        done |= small_step | (damping > 1e12)
        damping = np.where(better, np.maximum(damping / 5, 1e-14), damping * 4)
        p, cost = np.where(better[:, None], tried, p), np.where(better, cost2, cost)
        r, u, bell = np.where(better[:, None], r2, r), np.where(better[:, None], u2, u), np.where(better[:, None], bell2, bell)
    ok &= done
    return np.where(ok[:, None], p, start), ok


def percent_text(k: Column, n: Column, digits: int = 2) -> Column:
    """k of n as text in percent."""
    return F.format_string(f"%.{digits}f%%", F.round(100.0 * F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0)), digits))


def dedup_triggers(phases: Column, dead_ns: float) -> Column:
    """Of an array of phases, those more than dead_ns after the last one kept; all distinct ones for dead_ns <= 0."""
    ordered = F.array_sort(F.array_distinct(phases))
    if dead_ns <= 0:
        return ordered
    empty = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, empty, lambda kept, p: F.when((F.size(kept) == 0) | (p - F.try_element_at(kept, F.lit(-1)) > dead_ns), F.concat(kept, F.array(p))).otherwise(kept))
