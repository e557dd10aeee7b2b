"""Manager dashboard reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.aggregates import mean, total
from tillwise.functions.scalars import guarded_ratio
from tillwise.operators.predicates import with_keys
from tillwise.operators.ranking import top_k
from tillwise.operators.summaries import matrix, share, summarise
from tillwise.plans.cells import active_cells, average, by_month, by_weekday, customers_of, size
from tillwise.plans.profit import MARKETING, OVERHEAD
from tillwise.schema import CANCELLED


def executive_kpis(cells: DataFrame) -> DataFrame:
    """Revenue, orders, order value and net profit without cancelled orders; customers and rating with.

    One pass: the cancelled orders are left out inside the aggregates.  Needs raw cells, one per order.
    """
    kept = ~F.col("order_status").eqNullSafe(CANCELLED)

    def only(measure: str) -> Column:
        return F.when(kept, F.col(measure))

    revenue, profit = F.col("revenue"), F.col("_profit")
    net = profit - revenue * MARKETING - revenue * OVERHEAD
    sums = cells.agg(
        total(only("payment_amount")).alias("revenue"),
        F.coalesce(F.sum(only("size")), F.lit(0)).cast("bigint").alias("orders"),
        mean(only("payment_amount"), 100).alias("avg_order_value"),
        customers_of(cells).alias("customers"),
        average("review_score").alias("avg_rating"),
        total(only("gross_profit")).alias("_profit"),
    )
    return sums.withColumns(
        {"net_profit": net, "net_margin": guarded_ratio(net, revenue) * 100}
    ).drop("_profit")


def monthly_revenue(cells: DataFrame) -> DataFrame:
    revenue = summarise(active_cells(cells), ["month_start"], {"revenue": total("payment_amount")})
    return by_month(revenue).orderBy("month")


def orders_by_status(cells: DataFrame) -> DataFrame:
    """Orders and share of each status, title-cased."""
    titled = cells.withColumn("status", F.initcap("order_status"))
    return share(summarise(titled, ["status"], {"orders": size()}), "orders").orderBy(
        F.desc("orders"), "status"
    )


def revenue_by_city(cells: DataFrame) -> DataFrame:
    return summarise(active_cells(cells), ["city"], {"revenue": total("payment_amount")}).orderBy(
        F.desc("revenue"), "city"
    )


def top_categories(cells: DataFrame, k: int = 5) -> DataFrame:
    revenue = summarise(active_cells(cells), ["category"], {"revenue": total("payment_amount")})
    return top_k(revenue, "revenue", k, ["category"])


def weekday_hour_heatmap(cells: DataFrame) -> DataFrame:
    """Orders per weekday (rows, Monday first) and hour (columns ``0`` to ``23``)."""
    known = with_keys(cells, "hour")
    return by_weekday(matrix(known, "weekday", "hour", list(range(24)), size())).orderBy("weekday")
