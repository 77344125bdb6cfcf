"""Special functions (plain Python, vectorised over Arrow batches where rows need them)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def gamma_upper(a: float, x: float, tol: float = 1e-12) -> float:
    """Regularised upper incomplete gamma function: by the series below a + 1, by a continued fraction above."""
    if a <= 0 or x < 0:
        return float("nan")
    if x == 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > tol * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        t = -i * (i - a)
        b += 2
        d = 1 / ((t * d + b) or 1e-300)
        c = (b + t / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < tol:
            break
    return h * scale


def gamma_p(observed: float, alpha: float, beta: float) -> int:
    """Two-sided p-value, in thousandths, of a gamma law with shape alpha and scale beta."""
    if not (observed > 0 and alpha > 0 and beta > 0) or observed > 120:
        return 0
    m = gamma_upper(alpha, observed / beta)
    return int(2000 * min(m, 1 - m))


@F.pandas_udf(IntegerType())
def gamma_p_udf(observed: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.Series:
    ok = observed.notna() & alpha.notna() & beta.notna()
    return pd.Series([gamma_p(o, a, b) if k else 0 for o, a, b, k in zip(observed, alpha, beta, ok, strict=True)], dtype="int32")


_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(10)


def normal_upper(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def least_probability(k: int, mean: list[float], sd: list[float]) -> float:
    """Chance that the k-th of independent normal variables is the least, by ten-point Gauss-Hermite integration."""
    if sd[k] <= 0:
        others = [(m, s) for i, (m, s) in enumerate(zip(mean, sd, strict=True)) if i != k]
        return math.prod(normal_upper((mean[k] - m) / s) if s > 0 else float(m > mean[k]) for m, s in others)
    total = 0.0
    for x, w in zip(_NODES, _WEIGHTS, strict=True):
        at = mean[k] + math.sqrt(2) * sd[k] * x
        p = 1.0
        for i, (m, s) in enumerate(zip(mean, sd, strict=True)):
            if i != k:
                p *= normal_upper((at - m) / s) if s > 0 else float(m > at)
        total += w * p
    return total / math.sqrt(math.pi)


def unambiguity(mean: list[float], sd: list[float]) -> int:
    """Percentage, rounded up, by which the least mean's chance of being least exceeds one half, doubled."""
    p = [least_probability(k, mean, sd) for k in range(len(mean))]
    total = sum(p)
    if total <= 0:
        return 100
    return math.ceil(round(100 * max(0.0, 2 * p[min(range(len(mean)), key=mean.__getitem__)] / total - 1), 9))


@F.pandas_udf(IntegerType())
def unambiguity_udf(x: pd.Series) -> pd.Series:
    return pd.Series([unambiguity([float(e["mean"]) for e in v], [float(e["sd"]) for e in v]) for v in x], dtype="int32")
