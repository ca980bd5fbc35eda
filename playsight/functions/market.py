"""Market arithmetic as Column expressions: odds, devig, Student t with 7 degrees, blends, totals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from playsight.functions.nulls import safe_div


def profit(price: Column) -> Column:
    """Profit of a winning unit stake at an American price; NULL within (-100, 100)."""
    return F.when(price >= 100, price / 100.0).when(price <= -100, safe_div(F.lit(100.0), F.abs(price)))


def implied(price: Column) -> Column:
    """Break-even probability of a price."""
    return safe_div(F.lit(1.0), profit(price) + 1.0)


def fair_price(p: Column) -> Column:
    """American price at which p breaks even; NULL outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.when(p >= 0.5, -100.0 * p / (1.0 - p)).otherwise(100.0 * (1.0 - p) / p))


def devig(mine: Column, theirs: Column, backed: Column) -> Column:
    """Fair probability from two implied ones: the lower of proportional and equal split for the backed side, else the higher."""
    proportional, split = safe_div(mine, mine + theirs), mine - (mine + theirs - 1.0) / 2.0
    return F.when(backed, F.least(proportional, split)).otherwise(F.greatest(proportional, split))


def expected_value(win: Column, loss: Column, price: Column) -> Column:
    return win * profit(price) - loss


def edge(win: Column, loss: Column, price: Column) -> Column:
    return safe_div(win, win + loss) - implied(price)


def t_cdf7(value: Column, sd: Column, scale: bool = True) -> Column:
    """Student t distribution function with 7 degrees of freedom, in closed form.

    With scale, sd is a standard deviation and is turned into the scale sd * sqrt(5 / 7).
    """
    x = safe_div(value, sd * math.sqrt(5.0 / 7.0)) if scale else safe_div(value, sd)
    theta = F.atan(x / math.sqrt(7.0))
    cos = F.cos(theta)
    return 0.5 + (theta + F.sin(theta) * (cos + (2.0 / 3.0) * F.pow(cos, F.lit(3.0)) + (8.0 / 15.0) * F.pow(cos, F.lit(5.0)))) / math.pi


def blend(pure: Column, market: Column, weight: float) -> Column:
    """(1 - w) pure + w market with w at most one half; pure where there is no market."""
    w = min(weight, 0.5)
    return F.coalesce((1 - w) * pure + w * market, pure)


#: Fixed values of the published total calibration: centre, shift, slope.
TOTAL_CENTRE, TOTAL_SHIFT, TOTAL_SLOPE = 45.0, -0.19748, 0.71639


def calibrated_total(total: Column) -> Column:
    return TOTAL_CENTRE + TOTAL_SHIFT + TOTAL_SLOPE * (total - TOTAL_CENTRE)


def total_probabilities(mean: Column, line: Column, sd: Column) -> tuple[Column, Column, Column]:
    """(over, push, under) for a total: a push only at a whole line."""
    over = t_cdf7(mean - F.floor(line) - 0.5, sd)
    under = t_cdf7(F.ceil(line) - 0.5 - mean, sd)
    return over, 1.0 - over - under, under


def integer_pmf(mean: Column, sd: Column, low: int, high: int) -> Column:
    """Array of probabilities of the whole numbers low..high, the tails folded into the ends; NULLs without a mean or a deviation.

    The distribution function is taken once at each edge between two numbers, over Arrow batches.
    """
    if high <= low:
        return F.array(F.lit(1.0))
    edges = np.arange(low, high) + 0.5

    @F.arrow_udf("array<double>")
    def masses(mean: pa.Array, sd: pa.Array) -> pa.Array:
        m, s = (x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in (mean, sd))
        with np.errstate(all="ignore"):
            theta = np.arctan((edges - m[:, None]) / (s[:, None] * math.sqrt(5.0)))
            cos = np.cos(theta)
            square = cos * cos
            below = 0.5 + (theta + np.sin(theta) * cos * (1.0 + square * (2.0 / 3.0 + square * (8.0 / 15.0)))) / math.pi
        flat = np.diff(below, axis=1, prepend=0.0, append=1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))

    known = mean.isNotNull() & sd.isNotNull() & (sd != 0)
    return F.when(known, masses(mean, sd)).otherwise(F.array_repeat(F.lit(None).cast("double"), high - low + 1))
