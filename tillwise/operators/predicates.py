"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.schema import CANCELLED


def is_cancelled(status: str = "order_status") -> Column:
    """True for cancelled orders; an unknown status is not cancelled."""
    return F.col(status).eqNullSafe(CANCELLED)


def active(df: DataFrame, status: str = "order_status") -> DataFrame:
    """Orders that were not cancelled; a row without status is kept."""
    return df.where(~is_cancelled(status))


def eq_or_all(df: DataFrame, column: str, value: Any = None) -> DataFrame:
    """Rows with the chosen value, or all rows when none (or ``"All"``) is chosen."""
    return df if value is None or value == "All" else df.where(F.col(column) == F.lit(value))


def text_search(df: DataFrame, column: str, pattern: str = "", regex: bool = False) -> DataFrame:
    """Case-insensitive search for a piece of text, or for a regular expression."""
    if not pattern:
        return df
    text = F.col(column)
    return df.where(text.rlike(f"(?i){pattern}") if regex else F.lower(text).contains(pattern.lower()))


def in_list(df: DataFrame, column: str, values: Sequence[Any] | None = None) -> DataFrame:
    """Rows whose value is in the list; all rows when no list is given."""
    return df if values is None else df.where(F.col(column).isin(list(values)))


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows on which every key is known: a row without a key belongs to no group."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df
