"""Aggregate expressions with the null and tie rules of a flat order table.

Sums of nothing are 0, means skip nulls, rates keep nulls in the denominator, modes prefer the smallest
value and first/last follow a stated sequence, since rows of a DataFrame have no order of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


_LOW_BITS = 20


def whole_sum(x: Column | str) -> Column:
    """Sum of whole numbers as decimal, null of nothing.

    The high and the low bits are added up apart, as longs.  That is as fast as a plain sum, which could
    overflow on trillions of amounts in hundredths, and several times faster than a decimal sum.
    """
    x = F.col(x) if isinstance(x, str) else x
    high = F.sum(F.shiftright(x, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(x.bitwiseAND((1 << _LOW_BITS) - 1)).cast("decimal(20,0)")
    return high * (1 << _LOW_BITS) + low


def money_sum(x: Column | str) -> Column:
    """Sum of hundredths, in units, exact; 0 when there is nothing to add."""
    units = whole_sum(x) * F.lit(Decimal("0.01"))
    return F.coalesce(units, F.lit(0)).cast("decimal(30,2)")


def total(x: Column | str) -> Column:
    """Sum of hundredths, in units, as double; 0 when there is nothing to add."""
    return money_sum(x).cast("double")


def mean(x: Column | str, scale: int = 1) -> Column:
    """Mean of the known values, as double and in units if ``scale`` whole numbers make one; null of none."""
    added = (whole_sum(x) if scale == 100 else F.sum(x)).cast("double")
    return F.try_divide(added / scale if scale != 1 else added, F.count(x))


def rate(predicate: Column) -> Column:
    """Share of rows, in percent, for which the predicate holds; an unknown predicate counts as no."""
    return F.try_divide(F.count_if(predicate) * F.lit(100.0), F.count("*"))


def distinct(x: Column | str, approximate: bool = False) -> Column:
    """Number of distinct non-null values; ``approximate`` trades exactness for a fixed-size sketch."""
    return F.approx_count_distinct(x) if approximate else F.count_distinct(x)


def mode_min(x: Column | str) -> Column:
    """Most frequent value, the smallest one on ties.  State grows with the distinct values of a group."""
    return F.mode(x, True)


def median(x: Column | str, approximate: bool = False) -> Column:
    """Interpolated median.

    The exact form holds one counter per distinct value of a group: meant for short domains such as hours
    of the day.  Use ``operators.distributions.exact_quantiles`` for values without such a bound.
    """
    return F.percentile_approx(x, 0.5).cast("double") if approximate else F.median(x)


def first_by(x: Column | str, sequence: Sequence[str]) -> Column:
    """Value on the row that comes first in the sequence."""
    return F.min_by(x, F.struct(*sequence))


def last_by(x: Column | str, sequence: Sequence[str]) -> Column:
    """Value on the row that comes last in the sequence."""
    return F.max_by(x, F.struct(*sequence))
