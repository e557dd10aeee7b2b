"""Columns of the order fact table.

All operators and reports use the canonical names below.  A table with other names is brought in with
``FactSchema(customer_id="buyer", ...).conform(df)``.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANCELLED = "cancelled"

# Fixed type of every fact column.  Money is in whole hundredths and the discount in whole tenths of a
# percent: rounding is exact, sums do not depend on the order in which partitions are merged, and both stay
# primitive arithmetic inside generated code.  Reports turn them into units last.
FACT_TYPES: dict[str, T.DataType] = {
    "customer_id": T.LongType(),
    "order_date": T.TimestampNTZType(),
    "category": T.StringType(),
    "price": T.LongType(),
    "cogs": T.LongType(),
    "delivery_cost": T.LongType(),
    "delivery_charge": T.LongType(),
    "discount_pct": T.LongType(),
    "discount_amount": T.LongType(),
    "payment_amount": T.LongType(),
    "gross_profit": T.LongType(),
    "gross_margin_pct": T.DoubleType(),
    "review_score": T.IntegerType(),
    "order_status": T.StringType(),
    "gender": T.StringType(),
    "age_group": T.StringType(),
    "device": T.StringType(),
    "city": T.StringType(),
}

# How many of a column's whole numbers make one unit.
SCALES = {
    "price": 100,
    "cogs": 100,
    "delivery_cost": 100,
    "delivery_charge": 100,
    "discount_pct": 10,
    "discount_amount": 100,
    "payment_amount": 100,
    "gross_profit": 100,
}

# Together these name one order line; they stand for "row order" wherever a result depends on it.
SEQUENCE = ("order_key", "line_number", "part_key", "supplier_key", "price")


@dataclass(frozen=True)
class FactSchema:
    """The caller's name for each canonical fact column."""

    customer_id: str = "customer_id"
    order_date: str = "order_date"
    category: str = "category"
    price: str = "price"
    cogs: str = "cogs"
    delivery_cost: str = "delivery_cost"
    delivery_charge: str = "delivery_charge"
    discount_pct: str = "discount_pct"
    discount_amount: str = "discount_amount"
    payment_amount: str = "payment_amount"
    gross_profit: str = "gross_profit"
    gross_margin_pct: str = "gross_margin_pct"
    review_score: str = "review_score"
    order_status: str = "order_status"
    gender: str = "gender"
    age_group: str = "age_group"
    device: str = "device"
    city: str = "city"

    def conform(self, df: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
        """Rename a table in plain units to the canonical columns, scale its money, check its types.

        Money must be whole hundredths, discounts whole tenths of a percent; more digits are an error.
        ``DataFrame.to`` fails on a column that cannot be cast without loss.  Columns that are not facts
        (sequence keys and the like) pass through as they are.  ``id_type`` is for string customer ids.
        """
        renamed = df.withColumnsRenamed({getattr(self, f.name): f.name for f in fields(self)})
        scaled = renamed.withColumns(
            {c: whole_exactly(F.col(c), scale) for c, scale in SCALES.items() if c in renamed.columns}
        )
        types = {**FACT_TYPES, **({"customer_id": id_type} if id_type else {})}
        return scaled.to(
            T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in scaled.schema])
        )


def whole_exactly(x: Column, scale: int) -> Column:
    """An amount in units as a whole number of 1/scale units, in decimals; an error if digits would be cut."""
    scaled = F.try_multiply(x.try_cast("decimal(28,12)"), F.lit(scale))
    rounded = F.round(scaled, 0)
    fits = x.isNull() | F.coalesce(scaled == rounded, F.lit(False))
    message = F.concat(F.lit(f"not a whole number of 1/{scale}: "), x.cast("string"))
    return F.when(fits, rounded.cast("bigint")).otherwise(F.raise_error(message))


def whole(x: Column, scale: int) -> Column:
    """An amount in units as a whole number of 1/scale units."""
    return F.rint(x.cast("double") * scale).cast("bigint")
