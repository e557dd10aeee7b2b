"""Order cells: the additive form of the fact table that the reports sum up.

A raw order is a cell of one order; ``order_cells`` only projects.  ``roll_up`` adds the raw cells of equal
dimensions into few, so that one scan of the facts can serve every additive report.  Reports do not care
which of the two they read, except those that count distinct customers, which need the raw cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.aggregates import distinct, whole_sum
from tillwise.functions.scalars import day_name, month_labels, month_start
from tillwise.operators.predicates import is_cancelled
from tillwise.schema import CANCELLED, SCALES

_MEASURES = (
    "payment_amount",
    "cogs",
    "delivery_cost",
    "discount_amount",
    "gross_profit",
    "price",
    "discount_pct",
    "review_score",
)
_AVERAGED = ("payment_amount", "price", "discount_pct", "review_score")

DIMENSIONS = (
    "month_start",
    "weekday",
    "hour",
    "category",
    "city",
    "device",
    "gender",
    "age_group",
    "order_status",
    "rating",
    "discounted",
)


def order_cells(facts: DataFrame) -> DataFrame:
    """One cell per order: calendar keys, the measures and how many orders have each of them.

    The keys are dates and numbers; reports turn them into text after they have summed up.
    """
    have = set(facts.columns)
    cells = {"size": F.lit(1)}
    if "order_date" in have:
        day = F.to_date("order_date")
        cells |= {"month_start": month_start(day), "weekday": F.weekday(day), "hour": F.hour("order_date")}
        cells["orders"] = F.col("order_date").isNotNull().cast("int")
    if "order_status" in have:
        cells["cancelled"] = is_cancelled().cast("int")
    if "review_score" in have:
        cells["rating"] = F.col("review_score")
    if "discount_pct" in have:
        cells["discounted"] = F.col("discount_pct") > 0
    cells |= {f"{m}_n": F.col(m).isNotNull().cast("int") for m in _AVERAGED if m in have}
    return facts.withColumns(cells)


def roll_up(cells: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Cells of equal dimensions added up.  Combines before the shuffle.

    The sum of one cell is a long; were it to overflow, the query would fail and not wrap around.
    """
    dimensions = [d for d in dimensions if d in cells.columns]
    measures = [*_MEASURES, *[f"{m}_n" for m in _AVERAGED], "size", "orders", "cancelled"]
    sums = [F.sum(m).alias(m) for m in measures if m in cells.columns]
    return cells.groupBy(*dimensions).agg(*sums)


SKETCHED_BY = ("month_start", "category", "city", "order_status")


def sketch_up(cells: DataFrame, dimensions: Sequence[str] = SKETCHED_BY) -> DataFrame:
    """Raw cells added up by few dimensions, with a sketch of the customers and one of the order values.

    Unlike counts and quantiles, sketches of parts can be merged: reports by any of the dimensions need no raw cells.
    The sketch of customers errs by 1.6 % (one standard deviation), that of values by 1.3 % of the rank.
    """
    measures = [*_MEASURES, *[f"{m}_n" for m in _AVERAGED], "size", "orders", "cancelled"]
    sums = [F.sum(m).alias(m) for m in measures if m in cells.columns]
    return cells.groupBy(*dimensions).agg(
        *sums,
        F.hll_sketch_agg("customer_id").alias("customers_sketch"),
        F.kll_sketch_agg_bigint(F.col("payment_amount")).alias("payment_sketch"),
    )


def customers_of(cells: DataFrame) -> Column:
    """Distinct customers of cells: from their sketches where cells have them, else exact."""
    if "customers_sketch" in cells.columns:
        return F.hll_sketch_estimate(F.hll_union_agg("customers_sketch"))
    return distinct("customer_id")


def order_value_quantile(q: float) -> Column:
    """A value of about rank q among the payments of sketched cells, in units."""
    return F.kll_sketch_get_quantile_bigint(F.kll_merge_agg_bigint("payment_sketch"), F.lit(q)) / 100.0


def active_cells(cells: DataFrame) -> DataFrame:
    """Cells of orders that were not cancelled."""
    return cells.where(~F.col("order_status").eqNullSafe(CANCELLED))


def size() -> Column:
    """Order rows."""
    return F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")


def orders() -> Column:
    """Orders with a date."""
    return F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint")


def average(measure: str) -> Column:
    """Mean of a measure, in units, over the orders that have it."""
    scale = SCALES.get(measure, 1)
    added = (whole_sum(measure) if scale == 100 else F.sum(measure)).cast("double")
    return F.try_divide(added / scale, F.sum(f"{measure}_n"))


def cancel_rate() -> Column:
    """Cancelled orders, percent of all."""
    return F.try_divide(F.sum("cancelled") * F.lit(100.0), F.sum("size"))


def by_month(df: DataFrame) -> DataFrame:
    """A summary by ``month_start`` with its labels ``month`` and ``month_name``."""
    return df.withColumns(month_labels("month_start")).drop("month_start")


def by_weekday(df: DataFrame) -> DataFrame:
    """A summary by ``weekday`` with ``day_of_week``."""
    return df.withColumn("day_of_week", day_name("weekday"))
