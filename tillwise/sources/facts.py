"""The order fact table, assembled from the star schema tables.

Grain: one row per order line.  ``columns`` names what a report reads; a dimension none of whose columns
is wanted is not joined at all.  That is safe because dimensions are attached by left joins on their
unique keys, so they neither drop nor repeat facts; a line without its order stays, without customer and date.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.scalars import band, lookup
from tillwise.operators.projections import order_economics
from tillwise.schema import CANCELLED, FACT_TYPES, SEQUENCE, whole

# Cost of a product in ten-thousandths of its price, by product type.
COST_RATIOS = {
    "ECONOMY": 6800,
    "LARGE": 5500,
    "MEDIUM": 5700,
    "PROMO": 4300,
    "SMALL": 3500,
    "STANDARD": 6000,
}

# Age groups, and the account balances above which all but the first start (five equal bands).
AGE_GROUPS = ["18-24", "25-34", "35-44", "45-54", "55+"]
AGE_CUTS = [1200, 3400, 5600, 7800]

# Delivery rates in ten-thousandths of the price; the tax rate is added to the charge.
DELIVERY_COST_RATE = 600
DELIVERY_CHARGE_RATE = 500

_CUSTOMER = {"gender", "age_group", "device", "city"}
_HEADER = _CUSTOMER | {"customer_id", "order_date", "order_status"}
_COSTED = {"cogs", "gross_profit", "gross_margin_pct"}
_PART = {"category"} | _COSTED
_ECONOMICS = _COSTED | {
    "discount_pct", "discount_amount", "delivery_cost", "delivery_charge", "payment_amount",
}
_STATUS = f"""
    CASE WHEN header_status = 'P' AND return_flag = 'R' THEN '{CANCELLED}'
         WHEN header_status = 'F' THEN 'delivered'
         WHEN header_status = 'O' THEN 'shipped'
         WHEN header_status = 'P' THEN 'processing' END"""


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def load_facts(
    spark: SparkSession,
    directory: str,
    columns: Iterable[str] | None = None,
    lines: DataFrame | None = None,
    orders: DataFrame | None = None,
) -> DataFrame:
    """Order lines with economics and customer attributes; all fact columns unless some are named.

    ``lines`` and ``orders`` are rows of the line and order tables to take in their place.  Orders are joined last: the
    texts of a customer are then on no line that is still to be shuffled.
    """
    wanted = list(dict.fromkeys(columns or [*SEQUENCE, *FACT_TYPES]))
    facts = _lines(table(spark, directory, "lineitem") if lines is None else lines)
    if _PART & set(wanted):
        facts = facts.join(part_categories(spark, directory), "part_key", "left")
    if _HEADER & set(wanted):
        headers = order_headers(spark, directory, [c for c in wanted if c in _CUSTOMER], orders)
        facts = facts.join(headers, "order_key", "left")
    if _ECONOMICS & set(wanted):
        rates = {
            "cost_rate": F.lit(DELIVERY_COST_RATE),
            "charge_rate": F.col("tax_rate") + DELIVERY_CHARGE_RATE,
        }
        costed = bool(_COSTED & set(wanted))
        if costed:
            rates["cost_ratio"] = lookup("category", COST_RATIOS)
        facts = order_economics(facts.withColumns(rates), "cost_ratio" if costed else None)
    if "order_status" in wanted:
        facts = facts.withColumn("order_status", F.expr(_STATUS))
    return facts.select(*wanted)


def order_headers(
    spark: SparkSession, directory: str, attributes: Iterable[str] = (), orders: DataFrame | None = None
) -> DataFrame:
    """One row per order with its customer, date and the wanted customer attributes.

    Attributes are joined here, before the lines: a customer holding much of the traffic is then joined on
    its orders, and the line join by ``order_key`` that follows spreads its rows again.
    """
    attributes = list(attributes)
    orders = (table(spark, directory, "orders") if orders is None else orders).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("header_status"),
    )
    if not attributes:
        return orders
    return orders.join(customer_attributes(spark, directory, attributes), "customer_id", "left")


def part_categories(spark: SparkSession, directory: str) -> DataFrame:
    """Category of every product."""
    return table(spark, directory, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_type").alias("category"))


def customer_attributes(spark: SparkSession, directory: str, attributes: Iterable[str]) -> DataFrame:
    """Customer dimension: the wanted ones of gender, age group, device and city, fixed per customer."""
    wanted = set(attributes)
    customers = table(spark, directory, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("device"),
        band("c_acctbal", AGE_CUTS[::-1], AGE_GROUPS[::-1]).alias("age_group"),
        "c_nationkey",
    )
    if wanted & {"city", "gender"}:
        nations = table(spark, directory, "nation").select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"), "n_regionkey"
        )
        customers = customers.join(nations, "c_nationkey", "left")
    if "gender" in wanted:
        regions = table(spark, directory, "region").select(
            F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("gender")
        )
        customers = customers.join(regions, "n_regionkey", "left")
    return customers.select("customer_id", *sorted(wanted))


def load_events(spark: SparkSession, directory: str) -> DataFrame:
    """Events as facts: the table with a time of day, for the hour-of-day reports."""
    return table(spark, directory, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("order_date"),
        F.col("event_type").alias("category"),
        whole(F.col("value"), 100).alias("payment_amount"),
    )


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supplier_key"),
        whole(F.col("l_extendedprice"), 100).alias("price"),
        whole(F.col("l_discount"), 10_000).alias("discount_rate"),
        whole(F.col("l_tax"), 10_000).alias("tax_rate"),
        F.col("l_returnflag").alias("return_flag"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
    )
