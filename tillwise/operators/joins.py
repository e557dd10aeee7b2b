"""Joins the reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.session import store

# Fixed value: the segment shown for a customer without one.
DEFAULT_SEGMENT = "Regular Customers"


def scalar_of(df: DataFrame, value: Column) -> Column:
    """A one-row aggregate of ``df`` as a value for every row of another table, without a join."""
    return df.agg(value).scalar()


def with_profile(
    ids: DataFrame, rfm: DataFrame, behaviour: DataFrame, default_segment: str = DEFAULT_SEGMENT
) -> DataFrame:
    """Segment and behaviour of each customer.

    A customer all of whose orders were cancelled has behaviour but no segment, and gets the default.
    """
    segments = rfm.select("customer_id", "segment")
    joined = ids.join(segments, "customer_id", "left").join(behaviour, "customer_id", "left")
    return joined.withColumn("segment", F.coalesce("segment", F.lit(default_segment)))


def with_first_period(
    df: DataFrame, entity: str = "customer_id", ts: str = "order_date", grain: str = "month"
) -> DataFrame:
    """Every row with the start of its entity's first period.

    The minimum combines before its shuffle.  As the entities are stored first, the join shuffles both sides for itself
    alone, and adaptive execution can split the rows of a hot entity at any size.
    """
    first = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("_entity")).agg(
        F.date_trunc(grain, F.min(ts)).cast("date").alias(f"first_{grain}")
    )
    return df.join(store(first), F.col(entity) == F.col("_entity")).drop("_entity")
