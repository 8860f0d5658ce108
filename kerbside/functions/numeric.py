"""Exact integer rounding of ratios, so that percentages agree across engines
(a double computation followed by decimal rounding can land either side of a
tie)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_half_even(num: Column, den: Column, scale: int) -> Column:
    """``num/den`` rounded half-to-even to 1/``scale`` (scale=1000 → 0.001),
    computed on the exact rational with long arithmetic; result double."""
    n = num.cast("long") * F.lit(scale)
    d = den.cast("long")
    q = (n - F.pmod(n, d)) / d
    q = q.cast("long")
    r = n - q * d
    up = (r * 2 > d) | ((r * 2 == d) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(scale))


def ratio_half_up(num: Column, den: Column) -> Column:
    """``round(num/den)`` half-up on the exact rational, long result."""
    n = num.cast("long")
    d = den.cast("long")
    return F.floor((n * 2 + d) / (d * 2)).cast("long")


COORD_SCALE = 1e7      # coordinate means are exact at 1e-7 degree (about 1 cm)
MICROS_PER_MINUTE = 6e7  # minute means are exact at one microsecond


def exact_mean(c: Column, scale: float) -> Column:
    """Mean of ``c`` that does not depend on summation order: values are
    quantised to ``1/scale``, summed as exact decimals (no overflow at any row
    count), and divided once.  A floating ``avg`` changes in its last bits
    with partitioning; this gives the same double on every run and engine.
    Null when there are no non-null values."""
    return mean_of_parts(exact_sum(c, scale), F.count(c), scale)


def exact_sum(c: Column, scale: float) -> Column:
    """The sum part of ``exact_mean``; parts of several groups may be added up."""
    return F.sum(F.round(c * F.lit(scale)).cast("decimal(38,0)"))


def mean_of_parts(total: Column, count: Column, scale: float) -> Column:
    return total.cast("double") / count.cast("double") / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """``num/den`` as one double division of exact counts."""
    return num.cast("double") / den.cast("double")
