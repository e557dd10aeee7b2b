"""Segment reports, over the table of scored and segmented customers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.aggregates import mean
from tillwise.functions.scalars import half_even
from tillwise.operators.distributions import box_stats, histogram
from tillwise.operators.predicates import in_list
from tillwise.operators.ranking import hash_sample
from tillwise.operators.summaries import share, summarise

AVERAGED = ("recency", "frequency", "monetary", "avg_rating", "rfm_score")


def segment_sizes(customers: DataFrame) -> DataFrame:
    sizes = summarise(customers, ["segment"], {"customers": F.count("*")})
    return share(sizes, "customers").orderBy(F.desc("customers"), "segment")


def scatter_sample(customers: DataFrame, n: int = 500, seed: int = 7) -> DataFrame:
    """Up to n customers, drawn at random but the same ones each time."""
    drawn = hash_sample(customers, "customer_id", n, seed)
    return drawn.select(
        "customer_id", "recency", F.col("monetary").cast("double"), "frequency", "segment"
    )


def segment_averages(customers: DataFrame) -> DataFrame:
    measures = {f"avg_{c.removeprefix('avg_')}": half_even(mean(c), 1) for c in AVERAGED}
    return summarise(customers, ["segment"], measures).orderBy("segment")


def segment_box(customers: DataFrame, metric: str = "monetary") -> DataFrame:
    return box_stats(customers, metric, "segment")


def recency_histogram(customers: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(customers, "recency", bins, ["segment"])


def spend_histogram(customers: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(customers, "monetary", bins, ["segment"])


def customer_table(customers: DataFrame, segments: Sequence[str] | None = None) -> DataFrame:
    """Customers of the chosen segments, best score first."""
    return (
        in_list(customers, "segment", segments)
        .select(
            "customer_id",
            "segment",
            "recency",
            "frequency",
            F.col("monetary").cast("double"),
            "avg_rating",
            "rfm_score",
            "city",
            "gender",
            "age_group",
        )
        .orderBy(F.desc("rfm_score"), "customer_id")
    )


def segment_profile(customers: DataFrame) -> DataFrame:
    measures = {
        "customers": F.count("*"),
        "avg_spend": mean("monetary"),
        "avg_orders": mean("frequency"),
        "avg_recency": mean("recency"),
    }
    return summarise(customers, ["segment"], measures).orderBy("segment")


def segment_gender(customers: DataFrame) -> DataFrame:
    counts = summarise(customers, ["segment", "gender"], {"customers": F.count("*")})
    return share(counts, "customers", by=["segment"]).orderBy("segment", F.desc("customers"), "gender")


def segment_age(customers: DataFrame) -> DataFrame:
    counts = summarise(customers, ["segment", "age_group"], {"customers": F.count("*")})
    return counts.orderBy("segment", F.desc("customers"), "age_group")
