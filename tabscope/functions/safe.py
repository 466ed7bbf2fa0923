"""Arithmetic that answers null, never an error, when there is nothing to divide by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-12


def tidy(c: Column | str, digits: int) -> Column:
    """Half-up rounding that first drops the noise of floating-point sums.

    A mean of prices often lies exactly between two rounded values; without a
    relative guard, far below the last digit, the order of summation would
    decide which one it becomes.
    """
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(1 + GUARD), digits)


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return tidy(100 * F.try_divide(part.cast("double"), whole.cast("double")), digits)


def pct_change(before: Column, after: Column) -> Column:
    """Signed change in percent of ``before``: null from zero to zero, infinite from zero."""
    return F.when(before == 0, F.when(after != 0, F.lit(float("inf")))).otherwise(
        tidy(100 * F.try_divide(after - before, before), 2)
    )


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; null without variance."""
    spread_x = F.stddev_pop(F.when(y.isNotNull(), x))
    spread_y = F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread_x * spread_y)
