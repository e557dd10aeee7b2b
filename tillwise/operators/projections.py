"""Derived columns: lookups, order economics, calendar parts, labels, display shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.scalars import calendar, clip, half_even, whole_half_even
from tillwise.schema import SCALES


def with_lookup(df: DataFrame, dim: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Attach the attributes of ``dim`` by ``key``; with ``strict`` a fact without a match fails.

    ``dim`` has one row per key.  It carries no broadcast hint: Spark broadcasts it if its size is below
    the threshold and otherwise joins by shuffle, where adaptive execution splits a hot key.
    """
    attributes = [c for c in dim.columns if c != key]
    found = F.lit(True).alias("_found")
    joined = df.join(dim.select(key, *attributes, found), key, "left")
    if strict:
        miss = F.concat(F.lit(f"no {key} entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        checked = F.when(F.col("_found"), F.col(attributes[0])).otherwise(F.raise_error(miss))
        joined = joined.withColumn(attributes[0], checked)
    return joined.drop("_found")


_UNIT = 10_000  # rates are whole ten-thousandths


def order_economics(
    df: DataFrame,
    cost_ratio: str | None = "cost_ratio",
    discount_rate: str = "discount_rate",
    cost_rate: str = "cost_rate",
    charge_rate: str = "charge_rate",
    cost_clip: tuple[int, int] = (30, 400),
    charge_clip: tuple[int, int] = (40, 500),
) -> DataFrame:
    """Cost, delivery, discount, payment and profit of each order from its ``price`` and four rate columns.

    Price and results are whole hundredths, rates whole ten-thousandths.  Cost of goods is rounded to
    hundredths, all else to units, half to even and without leaving whole numbers.  Without a cost ratio
    there are no cost of goods and no profit.
    """

    def units(rate: str) -> Column:
        return whole_half_even(f"price * {rate}", 100 * _UNIT)

    df = df.withColumns(
        {
            "discount_pct": whole_half_even(discount_rate, 10),
            "discount_amount": units(discount_rate) * 100,
            "delivery_cost": units(cost_rate),
            "delivery_charge": units(charge_rate),
        }
    ).withColumns(
        {
            "delivery_cost": clip(F.col("delivery_cost"), *cost_clip) * 100,
            "delivery_charge": clip(F.col("delivery_charge"), *charge_clip) * 100,
        }
    )
    paid = whole_half_even("price - discount_amount + delivery_charge", 100) * 100
    df = df.withColumn("payment_amount", paid)
    if cost_ratio is None:
        return df
    df = df.withColumn("cogs", whole_half_even(f"price * {cost_ratio}", _UNIT))
    df = df.withColumn("gross_profit", F.expr("payment_amount - cogs - delivery_cost"))
    margin = half_even(F.expr("gross_profit / payment_amount * 100"), 1)
    return df.withColumn("gross_margin_pct", F.when(F.col("payment_amount") > 0, margin).otherwise(0.0))


def in_units(df: DataFrame) -> DataFrame:
    """A fact table for display: money and percentages in units."""
    return df.withColumns({c: F.col(c) / scale for c, scale in SCALES.items() if c in df.columns})


def with_calendar(df: DataFrame, ts: str = "order_date") -> DataFrame:
    """Add ``year month_number month_name weekday day_of_week hour`` of a timestamp."""
    return df.withColumns(calendar(ts))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of the given columns as 0."""
    return df.fillna(0, list(columns))


def round_numbers(df: DataFrame, digits: int) -> DataFrame:
    """Every fractional column rounded to ``digits``, half to even; whole numbers and text stay."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.withColumns(
        {f.name: half_even(f.name, digits) for f in df.schema if isinstance(f.dataType, fractional)}
    )


def display(df: DataFrame, titles: Mapping[str, str]) -> DataFrame:
    """The columns of a result table, in the given order, under their titles."""
    return df.select(*[F.col(name).alias(title) for name, title in titles.items()])
