"""Missing-value rules in one place.

A missing number is NULL, never NaN; division by zero is NULL; a NULL condition counts as false
before it is negated; sums over nothing are 0 unless NULL is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL where den is 0 or either is NULL."""
    return F.try_divide(col(num), F.nullif(col(den), F.lit(0.0)))


def clean(x: str | Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(col(x)), col(x))


def is_true(cond: Column) -> Column:
    """A condition in which NULL is false."""
    return F.coalesce(cond, F.lit(False))


def total(x: str | Column) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(col(x)), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson r as an aggregate; NULL for a constant input or fewer than two rows."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return safe_div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
