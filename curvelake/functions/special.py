"""Scalar functions that Spark has no expression for."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def digamma_column(n: Column) -> Column:
    """psi(n) of a positive integer column: -gamma + sum of 1 / q for q < n."""
    terms = F.when(n >= 2, F.sequence(F.lit(1), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(terms, F.lit(-EULER), lambda s, q: s + 1.0 / q)


def digamma(n: int) -> float:
    return -EULER + sum(1.0 / q for q in range(1, n))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _t_density_scale(df: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the scaled chi distribution sqrt(X / df) by Simpson's rule."""
    spread = 1 / math.sqrt(2 * df)
    s = np.linspace(max(1e-9, 1 - 12 * spread), 1 + 12 * spread, 4001)
    log = (df - 1) * np.log(s) - df * s * s / 2
    d = np.exp(log - log.max())
    w = np.ones(len(s))
    w[1:-1:2], w[2:-1:2] = 4, 2
    d = d * w
    return s, d / d.sum()


def noncentral_t_cdf(x: float, df: float, shift: float) -> float:
    """P(T <= x) as the mean over the scale s of Phi(x s - shift)."""
    s, w = _t_density_scale(df)
    z = x * s - shift
    return float(sum(a * normal_cdf(b) for a, b in zip(w.tolist(), z.tolist())))


def t_quantile(p: float, df: float) -> float:
    low, high = -200.0, 200.0
    s, w = _t_density_scale(df)
    for _ in range(100):
        mid = (low + high) / 2
        value = float(sum(a * normal_cdf(mid * b) for a, b in zip(w.tolist(), s.tolist())))
        low, high = (mid, high) if value < p else (low, mid)
    return (low + high) / 2
