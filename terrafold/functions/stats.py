"""Quantile conventions and robust spread, as aggregate expressions.

Five conventions are kept apart: `median` and `quantile` interpolate (type 7), `upper_median`
is element n // 2 of the ascending list, `quantile_nearest` rounds the rank and `quantile_rank`
floors q * n. Nulls are left out by all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def median(x: Column | str) -> Column:
    return F.percentile(_c(x), 0.5)


def quantile(x: Column | str, q: float) -> Column:
    return F.percentile(_c(x), q)


def upper_median(x: Column | str) -> Column:
    """Element floor(n / 2), from 0, of the ascending values."""
    x = _c(x)
    return F.get(F.sort_array(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int"))


def quantile_nearest(x: Column | str, q: float) -> Column:
    """The value at the rank nearest to q (n - 1)."""
    x = _c(x)
    return F.get(F.sort_array(F.collect_list(x)), F.floor((F.count(x) - 1) * q + 0.5).cast("int"))


def quantile_rank(x: Column | str, q: float) -> Column:
    """The value at rank floor(q n), the last at most."""
    x = _c(x)
    return F.get(F.sort_array(F.collect_list(x)), F.least(F.floor(F.count(x) * q), F.count(x) - 1).cast("int"))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    """x between low and high; null stays null."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(as_col(low), F.least(x, as_col(high))))


def rounded(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def nice_spacing(target: Column) -> Column:
    """The smallest 1, 2 or 5 times a power of ten that is at least target."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(target)))
    m = target / base
    return F.when(target > 0, base * F.when(m <= 1, 1).when(m <= 2, 2).when(m <= 5, 5).otherwise(10))
