"""Profit-and-loss statement of the orders that were not cancelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.aggregates import total
from tillwise.functions.scalars import guarded_ratio, ratio
from tillwise.operators.summaries import summarise
from tillwise.plans.cells import active_cells, by_month, orders

# Operating expenses as a share of revenue; for a month or category in one sum.
MARKETING = 0.08
OVERHEAD = 0.05
OPERATING = 0.13


def pnl_summary(cells: DataFrame) -> DataFrame:
    """The statement in one row.  Margins are 0 without revenue."""
    sums = active_cells(cells).agg(
        total("payment_amount").alias("revenue"),
        total("cogs").alias("cogs"),
        total("delivery_cost").alias("delivery_cost"),
        total("discount_amount").alias("discount_cost"),
        total("gross_profit").alias("gross_profit"),
    )
    revenue, profit = F.col("revenue"), F.col("gross_profit")
    net = profit - F.col("marketing") - F.col("ops_overhead")
    return (
        sums.withColumns({"marketing": revenue * MARKETING, "ops_overhead": revenue * OVERHEAD})
        .withColumn("net_profit", net)
        .withColumns(
            {
                "gross_margin": guarded_ratio(profit, revenue) * 100,
                "net_margin": guarded_ratio(F.col("net_profit"), revenue) * 100,
            }
        )
    )


def waterfall(summary: DataFrame) -> DataFrame:
    """The statement in eight steps.

    Payments are net of discounts already, and the steps subtract the discounts once more.  So
    ``running_total``, which adds up the steps shown, is below ``reported_total``, the statement's value.
    """
    steps = [
        ("Revenue", "relative", F.col("revenue")),
        ("COGS", "relative", -F.col("cogs")),
        ("Delivery Cost", "relative", -F.col("delivery_cost")),
        ("Discount Cost", "relative", -F.col("discount_cost")),
        ("Gross Profit", "total", F.col("gross_profit")),
        ("Marketing", "relative", -F.col("marketing")),
        ("Ops Overhead", "relative", -F.col("ops_overhead")),
        ("Net Profit", "total", F.col("net_profit")),
    ]

    def step(number: int, label: str, measure: str, amount: Column) -> Column:
        empty = F.lit(None).cast("double")
        return F.struct(
            F.lit(number).alias("step"),
            F.lit(label).alias("label"),
            F.lit(measure).alias("measure"),
            (amount if measure == "relative" else empty).alias("delta"),
            (amount if measure == "total" else empty).alias("reported_total"),
        )

    rows = summary.select(F.inline(F.array(*[step(i, *s) for i, s in enumerate(steps, start=1)])))
    # Eight rows, so one task is enough for the running total.
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running_total", F.sum("delta").over(upto))


def pnl_monthly(cells: DataFrame) -> DataFrame:
    net = F.col("gross_profit") - F.col("revenue") * OPERATING
    months = summarise(active_cells(cells), ["month_start"], _statement())
    return by_month(months.withColumn("net_profit", net)).orderBy("month")


def pnl_by_category(cells: DataFrame) -> DataFrame:
    margin = ratio(F.col("gross_profit"), F.col("revenue")) * 100
    return (
        summarise(active_cells(cells), ["category"], _statement())
        .withColumn("margin_pct", margin)
        .orderBy(F.desc("gross_profit"), "category")
    )


def cost_breakdown(summary: DataFrame) -> DataFrame:
    """The five cost components and their share of all cost."""
    parts = {
        "COGS": "cogs",
        "Delivery Cost": "delivery_cost",
        "Discount Losses": "discount_cost",
        "Marketing": "marketing",
        "Ops Overhead": "ops_overhead",
    }
    rows = F.array(
        *[F.struct(F.lit(k).alias("component"), F.col(c).alias("amount")) for k, c in parts.items()]
    )
    whole = sum((F.col(c) for c in list(parts.values())[1:]), F.col("cogs"))
    return summary.select(F.inline(rows), whole.alias("_whole")).select(
        "component", "amount", guarded_ratio(F.col("amount"), F.col("_whole")).alias("share")
    )


def _statement() -> dict[str, Column]:
    return {
        "revenue": total("payment_amount"),
        "cogs": total("cogs"),
        "gross_profit": total("gross_profit"),
        "orders": orders(),
    }
