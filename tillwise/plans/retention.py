"""Retention, new-versus-returning and geographic reports; cancelled orders count in all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.aggregates import money_sum, rate, total
from tillwise.operators.distributions import histogram
from tillwise.operators.ranking import top_k
from tillwise.operators.summaries import share, summarise
from tillwise.plans.cells import average, by_month, customers_of, orders


def orders_per_customer(facts: DataFrame) -> DataFrame:
    return summarise(facts, ["customer_id"], {"orders": F.count("*")})


def retention_rates(facts: DataFrame) -> DataFrame:
    """Percent of customers with more than one order, with five or more, and with one."""
    n = F.col("orders")
    return orders_per_customer(facts).agg(
        F.count("*").alias("customers"),
        rate(n > 1).alias("repeat_rate"),
        rate(n >= 5).alias("heavy_rate"),
        rate(n == 1).alias("one_time_rate"),
    )


def orders_histogram(facts: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(orders_per_customer(facts), "orders", bins)


def top_customers(facts: DataFrame, k: int = 10) -> DataFrame:
    spend = summarise(facts, ["customer_id"], {"total_spend": total("payment_amount")})
    return top_k(spend, "total_spend", k, ["customer_id"])


def new_vs_returning(cells: DataFrame) -> DataFrame:
    """Orders, customers and revenue per month, by whether the month is the customer's first.

    Orders are summed per customer and month first.  A customer then has one row per month at most, which
    bounds the window that finds the first month; and each of those rows is one customer of its month.
    """
    monthly = summarise(
        cells,
        ["customer_id", "month_start"],
        {"orders": F.sum("size"), "payment_amount": F.sum("payment_amount")},
    )
    first = F.min("month_start").over(Window.partitionBy("customer_id"))
    kind = F.when(F.col("month_start") == first, "New").otherwise("Returning")
    typed = summarise(
        monthly.withColumn("customer_type", kind),
        ["month_start", "customer_type"],
        {
            "orders": F.sum("orders"),
            "customers": F.count("*"),
            "revenue": total("payment_amount"),
        },
    )
    return by_month(typed).orderBy("month", "customer_type")


def new_vs_returning_orders(cells: DataFrame) -> DataFrame:
    return new_vs_returning(cells).select("month", "customer_type", "orders", "customers")


def new_vs_returning_revenue(cells: DataFrame) -> DataFrame:
    return new_vs_returning(cells).select("month", "customer_type", "revenue")


def geo_table(cells: DataFrame) -> DataFrame:
    """Revenue, orders, unique customers and order value by city.  Needs raw cells."""
    measures = {
        "revenue": total("payment_amount"),
        "orders": orders(),
        "customers": customers_of(cells),
        "avg_order_value": average("payment_amount"),
    }
    return summarise(cells, ["city"], measures).orderBy(F.desc("revenue"), "city")


def geo_treemap(cells: DataFrame) -> DataFrame:
    """Area (share of revenue) and colour (order value) of each city."""
    measures = {"revenue": money_sum("payment_amount"), "avg_order_value": average("payment_amount")}
    tiles = share(summarise(cells, ["city"], measures), "revenue", many=True)
    return tiles.withColumn("revenue", F.col("revenue").cast("double"))
