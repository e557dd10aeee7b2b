"""Product reports, and the shop catalogue built on the same categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.aggregates import total
from tillwise.functions.scalars import discount_text, stars
from tillwise.operators.predicates import eq_or_all, text_search
from tillwise.operators.summaries import summarise
from tillwise.plans.cells import average, by_month, cancel_rate, customers_of, orders, size


def category_stats(cells: DataFrame) -> DataFrame:
    """All measures of a category.  Needs raw cells."""
    measures = {
        "orders": orders(),
        "revenue": total("payment_amount"),
        "avg_price": average("price"),
        "avg_discount": average("discount_pct"),
        "avg_rating": average("review_score"),
        "cancel_rate": cancel_rate(),
        "unique_customers": customers_of(cells),
    }
    return summarise(cells, ["category"], measures).orderBy(F.desc("revenue"), "category")


def category_matrix(cells: DataFrame) -> DataFrame:
    """Discount against rating, sized by revenue."""
    return summarise(
        cells,
        ["category"],
        {
            "avg_discount": average("discount_pct"),
            "avg_rating": average("review_score"),
            "revenue": total("payment_amount"),
        },
    )


def category_drill_kpis(cells: DataFrame, category: str | None = None) -> DataFrame:
    """Key figures of one category, or of each."""
    measures = {
        "orders": size(),
        "revenue": total("payment_amount"),
        "avg_price": average("price"),
        "avg_rating": average("review_score"),
    }
    return summarise(eq_or_all(cells, "category", category), ["category"], measures)


def category_drill_months(cells: DataFrame, category: str | None = None) -> DataFrame:
    chosen = eq_or_all(cells, "category", category)
    revenue = summarise(chosen, ["category", "month_start"], {"revenue": total("payment_amount")})
    return by_month(revenue).orderBy("category", "month")


def category_drill_cities(cells: DataFrame, category: str | None = None) -> DataFrame:
    chosen = eq_or_all(cells, "category", category)
    revenue = summarise(chosen, ["category", "city"], {"revenue": total("payment_amount")})
    return revenue.orderBy("category", F.desc("revenue"), "city")


# The sort orders a shopper can choose, as (column, descending).
SORT_ORDERS = {
    "Popularity": ("orders", True),
    "Price ↑": ("avg_price", False),
    "Price ↓": ("avg_price", True),
    "Rating": ("avg_rating", True),
}


def shop_catalogue(
    cells: DataFrame,
    category: str | None = None,
    search: str = "",
    sort_by: str = "Popularity",
    regex: bool = False,
) -> DataFrame:
    """What a category costs, how it is rated, how often it is ordered; filtered, searched and sorted.

    The filters are on the grouping key, so Spark applies them before the aggregation.
    """
    products = summarise(
        cells,
        ["category"],
        {
            "avg_price": average("price"),
            "avg_rating": average("review_score"),
            "orders": orders(),
            "avg_discount": average("discount_pct"),
        },
    )
    products = text_search(eq_or_all(products, "category", category), "category", search, regex)
    column, descending = SORT_ORDERS[sort_by]
    return products.withColumns(
        {"stars": stars(F.col("avg_rating")), "discount_label": discount_text(F.col("avg_discount"))}
    ).orderBy(F.desc(column) if descending else F.asc(column), "category")
