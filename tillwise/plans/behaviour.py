"""Behaviour reports; cancelled orders count in all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.aggregates import mean, median, mode_min, rate, total
from tillwise.functions.scalars import half_even
from tillwise.operators.predicates import is_cancelled, with_keys
from tillwise.operators.summaries import share, summarise
from tillwise.plans.cells import average, by_month, by_weekday, cancel_rate, orders, size


def orders_by_hour(cells: DataFrame) -> DataFrame:
    return summarise(cells, ["hour"], {"orders": size()}).orderBy("hour")


def orders_by_weekday(cells: DataFrame) -> DataFrame:
    return by_weekday(summarise(cells, ["weekday"], {"orders": size()})).orderBy("weekday")


def orders_by_month(cells: DataFrame) -> DataFrame:
    return by_month(summarise(cells, ["month_start"], {"orders": size()})).orderBy("month")


def device_orders(cells: DataFrame) -> DataFrame:
    measures = {"orders": orders(), "revenue": total("payment_amount")}
    return summarise(cells, ["device"], measures).orderBy("device")


def gender_orders(cells: DataFrame) -> DataFrame:
    measures = {"orders": orders(), "revenue": total("payment_amount")}
    return share(summarise(cells, ["gender"], measures), "orders").orderBy("gender")


def age_group_orders(cells: DataFrame) -> DataFrame:
    measures = {
        "orders": orders(),
        "revenue": total("payment_amount"),
        "avg_spend": average("payment_amount"),
    }
    return summarise(cells, ["age_group"], measures).orderBy("age_group")


def order_value_matrix(cells: DataFrame) -> DataFrame:
    """Mean order value by gender and age group, in long form."""
    measures = {"avg_order_value": average("payment_amount")}
    return summarise(cells, ["gender", "age_group"], measures).orderBy("gender", "age_group")


def category_behaviour(cells: DataFrame) -> DataFrame:
    measures = {
        "orders": orders(),
        "revenue": total("payment_amount"),
        "avg_spend": average("payment_amount"),
        "avg_rating": average("review_score"),
        "avg_discount": average("discount_pct"),
        "cancel_rate": cancel_rate(),
    }
    return summarise(cells, ["category"], measures).orderBy(F.desc("revenue"), "category")


def spend_rating_bubbles(cells: DataFrame) -> DataFrame:
    return category_behaviour(cells).select("category", "avg_spend", "avg_rating", "orders", "revenue")


def cancel_ranking(cells: DataFrame) -> DataFrame:
    return summarise(cells, ["category"], {"cancel_rate": cancel_rate()}).orderBy(
        F.desc("cancel_rate"), "category"
    )


def rating_distribution(cells: DataFrame) -> DataFrame:
    return summarise(cells, ["rating"], {"orders": size()}).orderBy("rating")


def discount_by_age(cells: DataFrame) -> DataFrame:
    """Mean discount of the discounted orders."""
    measures = {"avg_discount": average("discount_pct")}
    return summarise(cells.where("discounted"), ["age_group"], measures).orderBy("age_group")


def rating_by_category(cells: DataFrame) -> DataFrame:
    return summarise(cells, ["category"], {"avg_rating": average("review_score")}).orderBy(
        F.desc("avg_rating"), "category"
    )


def behaviour_features(facts: DataFrame) -> DataFrame:
    """Nine metrics per customer.

    The modes and the median hold a counter per distinct category, device and hour of a customer, and
    combine before the shuffle, so a customer with very many orders costs no more than these counters.
    """
    return (
        with_keys(facts, "customer_id")
        .groupBy("customer_id")
        .agg(
            F.count("order_date").alias("total_orders"),
            total("payment_amount").alias("total_spend"),
            half_even(mean("payment_amount", 100), 0).alias("avg_order_value"),
            half_even(mean("discount_pct", 10), 1).alias("avg_discount"),
            mode_min("category").alias("fav_category"),
            half_even(mean("review_score"), 2).alias("avg_rating"),
            half_even(rate(is_cancelled()), 1).alias("cancel_rate"),
            mode_min("device").alias("pref_device"),
            median(F.hour("order_date")).alias("pref_hour"),
        )
    )


def user_habits(events: DataFrame) -> DataFrame:
    """Most frequent event and median hour of each user, on the table that has a time of day."""
    return summarise(
        events,
        ["customer_id"],
        {
            "events": F.count("*"),
            "fav_category": mode_min("category"),
            "pref_hour": median(F.hour("order_date")),
        },
    )
