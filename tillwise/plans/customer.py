"""Customer reports.

Each works for all customers at once; ``customer_id`` narrows it to one, and the filter reaches the scan.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.aggregates import money_sum, first_by, total
from tillwise.operators.joins import with_profile
from tillwise.operators.predicates import eq_or_all
from tillwise.operators.projections import display, in_units
from tillwise.operators.summaries import share, summarise
from tillwise.plans.cells import average, by_month, by_weekday, size
from tillwise.schema import SEQUENCE

# Titles of the order list.
ORDER_TITLES = {
    "order_date": "Date",
    "category": "Category",
    "price": "Price (₹)",
    "discount_amount": "Discount (₹)",
    "payment_amount": "Paid (₹)",
    "review_score": "Rating",
    "order_status": "Status",
    "city": "City",
}


def default_customer(facts: DataFrame, sequence: tuple[str, ...] = SEQUENCE) -> DataFrame:
    """The customer of the first order in sequence, whom a portal shows unless another is chosen."""
    return facts.agg(first_by("customer_id", sequence).alias("customer_id"))


def home_kpis(cells: DataFrame, customer_id: Any = None) -> DataFrame:
    measures = {
        "total_orders": size(),
        "total_spent": total("payment_amount"),
        "avg_rating": average("review_score"),
        "savings": total("discount_amount"),
    }
    return summarise(eq_or_all(cells, "customer_id", customer_id), ["customer_id"], measures)


def home_with_segment(
    cells: DataFrame, rfm: DataFrame, behaviour: DataFrame, customer_id: Any = None
) -> DataFrame:
    """Key figures with the customer's segment and favourites."""
    profile = behaviour.select("customer_id", "fav_category", "pref_device")
    return with_profile(home_kpis(cells, customer_id), rfm, profile)


def monthly_spend(cells: DataFrame, customer_id: Any = None) -> DataFrame:
    chosen = eq_or_all(cells, "customer_id", customer_id)
    spend = by_month(summarise(chosen, ["customer_id", "month_start"], {"spent": total("payment_amount")}))
    return spend if customer_id is None else spend.orderBy("month")


def category_shares(cells: DataFrame, customer_id: Any = None) -> DataFrame:
    """Spend per category and its share of the customer's spend."""
    chosen = eq_or_all(cells, "customer_id", customer_id)
    spend = summarise(chosen, ["customer_id", "category"], {"spent": money_sum("payment_amount")})
    return share(spend, "spent", by=["customer_id"]).withColumn("spent", F.col("spent").cast("double"))


def status_counts(cells: DataFrame, customer_id: Any = None) -> DataFrame:
    chosen = eq_or_all(cells, "customer_id", customer_id)
    return summarise(chosen, ["customer_id", "order_status"], {"orders": size()})


def order_totals(cells: DataFrame, customer_id: Any = None, status: str | None = None) -> DataFrame:
    """Number, value and mean value (0 without orders) of the orders with a status.

    For one customer this is always one row; for all, one row per customer with such an order.
    """
    measures = {
        "orders": size(),
        "total_value": total("payment_amount"),
        "avg_order_value": F.coalesce(average("payment_amount"), F.lit(0.0)),
    }
    chosen = eq_or_all(eq_or_all(cells, "customer_id", customer_id), "order_status", status)
    return summarise(chosen, [] if customer_id is not None else ["customer_id"], measures)


def order_list(facts: DataFrame, customer_id: Any = None, status: str | None = None) -> DataFrame:
    """Orders for display: newest first for one customer; for all customers rows with their owner, unsorted."""
    chosen = in_units(eq_or_all(eq_or_all(facts, "customer_id", customer_id), "order_status", status))
    if customer_id is None:
        return chosen.select("customer_id", *ORDER_TITLES)
    ties = [c for c in SEQUENCE if c in facts.columns]
    return display(chosen.orderBy(F.desc("order_date"), *ties), ORDER_TITLES)


def profile(behaviour: DataFrame, customer_id: Any = None) -> DataFrame:
    """The profile page's part of the behaviour features."""
    return eq_or_all(behaviour, "customer_id", customer_id).select(
        "customer_id",
        "total_orders",
        "total_spend",
        "avg_order_value",
        "cancel_rate",
        "fav_category",
        "pref_device",
        "avg_discount",
        "avg_rating",
    )


def weekday_spend(cells: DataFrame, customer_id: Any = None) -> DataFrame:
    """Spend by weekday, Monday first."""
    chosen = eq_or_all(cells, "customer_id", customer_id)
    spend = by_weekday(summarise(chosen, ["customer_id", "weekday"], {"spent": total("payment_amount")}))
    return spend if customer_id is None else spend.orderBy("weekday")
