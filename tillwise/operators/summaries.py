"""Grouped summaries, counts, shares and matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.scalars import guarded_ratio
from tillwise.operators.predicates import with_keys
from tillwise.session import store


def summarise(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Aggregates by key.  Rows without a key are left out; no keys gives the one-row total."""
    columns = [x.alias(name) for name, x in measures.items()]
    return with_keys(df, *keys).groupBy(*keys).agg(*columns) if keys else df.agg(*columns)


def value_counts(df: DataFrame, column: str, count: str = "orders") -> DataFrame:
    """Rows per known value, most frequent first."""
    return summarise(df, [column], {count: F.count("*")}).orderBy(F.desc(count), column)


def share(
    df: DataFrame, measure: str, name: str = "share", by: Sequence[str] = (), many: bool = False
) -> DataFrame:
    """Each row's part of the total of ``measure``, over all rows or over the rows with equal ``by``.

    ``df`` is a summary.  If it has a row per city or segment, its few rows meet in one task for the total,
    which spares a second pass over the facts.  For a summary with ``many`` rows it is stored first and the
    total is a scalar subquery over the stored rows.  ``by`` is for totals of few rows each, such as the
    categories of a customer.
    """
    if many:
        df = store(df)
        whole = df.agg(F.sum(measure)).scalar()
    else:
        whole = F.sum(measure).over(Window.partitionBy(*by))
    return df.withColumn(name, guarded_ratio(F.col(measure).cast("double"), whole.cast("double")))


def band_counts(df: DataFrame, column: str, labels: Sequence[str], count: str = "customers") -> DataFrame:
    """Count and share of every listed label, those without rows included; one pass, no join."""
    counts = df.agg(*[F.count_if(F.col(column) == label).alias(f"n{i}") for i, label in enumerate(labels)])
    rows = F.array(
        *[
            F.struct(F.lit(label).alias(column), F.col(f"n{i}").alias(count))
            for i, label in enumerate(labels)
        ]
    )
    return share(counts.select(F.inline(rows)), count)


def matrix(
    df: DataFrame, rows: str | Sequence[str], column: str, values: Sequence[Any], cell: Column, fill: Any = 0
) -> DataFrame:
    """A cell per row key and listed column value, ``fill`` where there is none.

    The values are given, so Spark need not look for them first.
    """
    rows = [rows] if isinstance(rows, str) else list(rows)
    wide = with_keys(df, *rows).groupBy(*rows).pivot(column, list(values)).agg(cell)
    return wide.fillna(fill, [str(v) for v in values])
