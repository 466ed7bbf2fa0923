"""Tail probabilities of the normal, Student t and chi-square distributions.

Spark has none built in. These run on aggregated rows only (one row per test),
as Arrow-batched pandas UDFs; a batch is a handful of array operations, so a
test per segment may have millions of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-15
_STEPS = 10_000
# Beyond so many degrees of freedom Student's t is the normal distribution.
_NORMAL_DOF = 1e8


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: raised to at least 10, then Stirling's series."""
    x = np.array(x, dtype=float)
    raised = np.zeros_like(x)
    while (small := x < 10).any():
        raised[small] += np.log(x[small])
        x[small] += 1
    i = 1 / (x * x)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - raised


def _continued_fraction(first: np.ndarray, term: Callable[[int], tuple]) -> np.ndarray:
    """Value of first + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method, until every value stands still."""
    solid = lambda v: np.where(v == 0, _TINY, v)
    value = solid(first)
    upper, lower = value, np.zeros_like(value)
    for step in range(1, _STEPS):
        a, b = term(step)
        lower = 1.0 / solid(b + a * lower)
        upper = solid(b + a / upper)
        change = upper * lower
        value = value * change
        if (np.abs(change - 1.0) < _EPS).all():
            break
    return value


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x, a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    # The fraction converges fast on one side of the mean; the other side is what is left.
    turned = x > (a + 1.0) / (a + b + 2.0)
    x, a, b = np.where(turned, 1.0 - x, x), np.where(turned, b, a), np.where(turned, a, b)

    def term(step: int) -> tuple:
        m = step // 2
        if step % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    log_front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(safe) + b * np.log1p(-safe) - np.log(a)
    found = np.where(inside, np.exp(log_front) / _continued_fraction(np.ones_like(x), term), np.where(x <= 0, 0.0, 1.0))
    return np.where(turned, 1.0 - found, found)


def chi_square_upper(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(X > x): series below the mean, continued fraction above it."""
    x, dof = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, dof))
    found = np.ones_like(x)
    s, h = dof / 2.0, x / 2.0
    found[np.isinf(x) & (x > 0)] = 0.0
    usable = (x > 0) & np.isfinite(x)
    low, high = usable & (h < s + 1.0), usable & (h >= s + 1.0)
    if low.any():
        total = term = 1.0 / s[low]
        n, half = s[low], h[low]
        for _ in range(_STEPS * 100):
            n = n + 1.0
            term = term * half / n
            total = total + term
            if (term < total * _EPS).all():
                break
        found[low] = 1.0 - np.exp(s[low] * np.log(half) - half - log_gamma(s[low]) + np.log(total))
    if high.any():
        shape, half = s[high], h[high]
        front = _continued_fraction(half + 1.0 - shape, lambda i: (-i * (i - shape), half + 2 * i + 1.0 - shape))
        found[high] = np.exp(shape * np.log(half) - half - log_gamma(shape)) / front
    return found


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """The square of a normal value is chi-square with one degree of freedom."""
    return chi_square_upper(np.square(np.asarray(z, dtype=float)), 1.0)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    t, dof = (np.array(v, dtype=float) for v in np.broadcast_arrays(t, dof))
    found = np.zeros_like(t)
    normal = np.isfinite(t) & (dof > _NORMAL_DOF)
    student = np.isfinite(t) & ~normal
    found[normal] = normal_two_sided(t[normal])
    t, dof = t[student], dof[student]
    found[student] = incomplete_beta(dof / (dof + t * t), dof / 2.0, 0.5)
    return found


def _udf(function) -> Callable[..., Column]:
    """A vectorised column function that answers null where an argument is null."""

    def batch(*series: pd.Series) -> pd.Series:
        values = np.array([s.to_numpy(dtype=float, na_value=np.nan) for s in series])
        found = np.full(values.shape[1], np.nan)
        there = ~np.isnan(values).any(axis=0)
        found[there] = function(*values[:, there])
        return pd.Series(found)

    def one(a: pd.Series) -> pd.Series:
        return batch(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(a, b)

    # Built on use: a worker that loads this module has no session to build it with.
    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, "double")(*columns)


t_two_sided_p = _udf(t_two_sided)
chi_square_p = _udf(chi_square_upper)
normal_p = _udf(normal_two_sided)

# Sent to the workers by value, so that the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
