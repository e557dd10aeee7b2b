"""Column expressions: rounding, clipping, bands, calendar parts and display labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Round half to even, by the shortest decimal form of a double."""
    return F.bround(x, digits)


def whole_half_even(x: str, divisor: int) -> Column:
    """x / divisor of whole numbers, rounded half to even in whole numbers; ``x`` is SQL text."""
    rest = f"pmod({x}, {divisor})"
    down = f"(({x}) - {rest}) div {divisor}"
    up = f"2 * {rest} > {divisor} OR (2 * {rest} = {divisor} AND pmod({down}, 2) = 1)"
    return F.expr(f"{down} + CASE WHEN {up} THEN 1 ELSE 0 END")


def clip(x: Column, low: Any, high: Any) -> Column:
    """Limit ``x`` to [low, high].  A null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is 0."""
    return F.try_divide(numerator, denominator)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def lookup(key: Column | str, values: Mapping[str, Any], strict: bool = True) -> Column:
    """Value of ``key`` in a fixed map.  With ``strict`` a missing key fails the query."""
    key = F.col(key) if isinstance(key, str) else key
    found = F.create_map(*[F.lit(part) for pair in values.items() for part in pair])[key]
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(key, F.lit("null")))))


def band(x: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the band ``x`` is in.

    ``cuts`` descend and are strict lower limits: ``band(p, [0.6, 0.35], ["High", "Medium", "Low"])`` is
    Medium at 0.6 and Low at 0.35.  A null has no band.
    """
    x = F.col(x) if isinstance(x, str) else x
    if len(labels) != len(cuts) + 1:
        raise ValueError("band needs one more label than cuts")
    chosen = F.when(x.isNull(), None)
    for cut, label in zip(cuts, labels):
        chosen = chosen.when(x > F.lit(cut), F.lit(label))
    return chosen.otherwise(F.lit(labels[-1]))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Complete 24-hour days between two timestamps (47 h 59 min is 1)."""
    return F.timestamp_diff("DAY", start, end)


# Day names in the order of ``weekday``.
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def calendar(ts: Column | str) -> dict[str, Column]:
    """Calendar parts of a timestamp; ``weekday`` counts from Monday = 0."""
    day = F.to_date(ts)
    return {
        "year": F.year(day),
        "month_number": F.month(day),
        "month_name": F.date_format(day, "MMM yyyy"),
        "weekday": F.weekday(day),
        "day_of_week": F.date_format(day, "EEEE"),
        "hour": F.hour(ts),
    }


def month_start(ts: Column | str) -> Column:
    """First day of the month: the key to group and sort months by."""
    return F.trunc(F.to_date(ts), "month")


def month_labels(start: Column | str) -> dict[str, Column]:
    """``2023-01`` and ``Jan 2023``, for the few rows of a report rather than for every order."""
    return {"month": F.date_format(start, "yyyy-MM"), "month_name": F.date_format(start, "MMM yyyy")}


def day_name(weekday: Column | str) -> Column:
    """Name of a weekday number."""
    weekday = F.col(weekday) if isinstance(weekday, str) else weekday
    return F.element_at(F.array(*map(F.lit, DAYS)), weekday + 1)


def percent_text(p: Column) -> Column:
    """``0.8734`` as ``87.3%``."""
    return F.concat(half_even(p * 100, 1).cast("string"), F.lit("%"))


def money_text(x: Column) -> Column:
    """``1234.5`` as ``₹1,234``."""
    return F.concat(F.lit("₹"), F.format_number(half_even(x, 0), 0))


def short_money_text(x: Column) -> Column:
    """``₹12.3K`` below a million, ``₹1.23M`` from there on."""
    return F.when(
        x < 1e6, F.concat(F.lit("₹"), F.format_number(half_even(x / 1e3, 1), 1), F.lit("K"))
    ).otherwise(F.concat(F.lit("₹"), F.format_number(half_even(x / 1e6, 2), 2), F.lit("M")))


def stars(x: Column) -> Column:
    """A rating as a row of stars."""
    return F.repeat(F.lit("⭐"), half_even(x, 0).cast("int"))


def discount_text(pct: Column) -> Column:
    """``~5% off``; empty without a discount."""
    return F.when(
        pct > 0, F.concat(F.lit("~"), half_even(pct, 0).cast("bigint").cast("string"), F.lit("% off"))
    ).otherwise(F.lit(""))
