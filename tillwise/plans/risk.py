"""Churn risk reports, over scored customers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.scalars import percent_text
from tillwise.models.churn import CHURN_DAYS, FEATURES, HIGH, HOLDOUT, RISK_LEVELS, at_risk, held_out, score_churn
from tillwise.operators.distributions import histogram
from tillwise.operators.evaluation import confusion, ranking_quality, score_counts
from tillwise.operators.summaries import band_counts, summarise


def churn_scores(scored: DataFrame) -> DataFrame:
    return scored.select(
        "customer_id",
        "segment",
        "recency",
        "frequency",
        F.col("monetary").cast("double"),
        "avg_rating",
        "churn_prob",
        "risk_level",
    )


def risk_mix(scored: DataFrame) -> DataFrame:
    """Customers and share of each risk level, also of an empty one."""
    return band_counts(scored, "risk_level", RISK_LEVELS)


def probability_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(scored, "churn_prob", bins)


def what_if(model: PipelineModel, scenarios: DataFrame) -> DataFrame:
    """Risk of supposed customers, with the percent and level a gauge shows."""
    return score_churn(model, scenarios).withColumn("percent", F.col("churn_prob") * 100)


def idle_scenarios(rfm: DataFrame, days: int = 90) -> DataFrame:
    """Every customer as they would stand after some more days without an order."""
    return rfm.select(
        "customer_id",
        (F.col("recency") + days).alias("recency"),
        "frequency",
        F.col("monetary").cast("double"),
        "avg_rating",
    )


def scenario_grid(rfm: DataFrame, steps: int = 4) -> DataFrame:
    """Supposed customers: every combination of some values of the inputs, spread evenly over what customers show.

    The inputs of one row each are what a form would ask for; the grid has ``steps + 1`` values of each, whatever the
    number of customers.
    """
    limits = rfm.agg(*[f(c).cast("double").alias(f"{name}_{c}") for c in FEATURES for name, f in (("lo", F.min), ("hi", F.max))])
    grid = limits
    for c in FEATURES:
        low, high = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        values = F.array(*[low + (high - low) * F.lit(k / steps) for k in range(steps + 1)])
        grid = grid.withColumn(c, F.explode(F.array_distinct(values)))
    return grid.select(*FEATURES)


def high_risk_list(scored: DataFrame) -> DataFrame:
    """Customers at high risk, the most likely to leave first."""
    return (
        scored.where(F.col("risk_level") == RISK_LEVELS[0])
        .orderBy(F.desc("churn_prob"), "customer_id")
        .select(
            "customer_id",
            "segment",
            F.col("recency").alias("days_inactive"),
            F.col("frequency").alias("orders"),
            F.col("monetary").cast("double").alias("total_spend"),
            "avg_rating",
            percent_text(F.col("churn_prob")).alias("churn_risk"),
            "city",
        )
    )


def with_later_label(orders: DataFrame, rated: Callable[[DataFrame], DataFrame], days: int = CHURN_DAYS) -> DataFrame:
    """Customers as they stood ``days`` before the newest order, with ``label``: 1.0 if they have not ordered since.

    Features come from orders up to then only, so unlike a threshold on recency the label is not among them.  ``orders`` are stored
    ``order_sums``, and ``rated`` makes customers of some of them.
    """
    newest = orders.agg(F.max("order_date").alias("newest")).first().newest
    if newest is None:
        return rated(orders).withColumn("label", F.lit(None).cast("double"))
    cut = F.lit(newest) - F.expr(f"INTERVAL {days} DAYS")
    came = orders.where((F.col("kept") > 0) & (F.col("order_date") > cut)).select("customer_id").distinct()
    came = came.withColumn("_came", F.lit(True))
    before = rated(orders.where(F.col("order_date") <= cut))
    return before.join(came, "customer_id", "left").withColumn("label", F.col("_came").isNull().cast("double")).drop("_came")


def holdout_scores(model: PipelineModel, later: DataFrame, part: float = HOLDOUT) -> DataFrame:
    """``(customer_id, score, label)`` of the customers that took no part in training."""
    scored = score_churn(model, later.where(held_out(part)))
    return scored.select("customer_id", F.col("churn_prob").alias("score"), "label")


def holdout_summary(scores: DataFrame, threshold: float = HIGH) -> DataFrame:
    """One row: how many were held out and left, ranking quality, and the confusion table at ``threshold``."""
    counts = score_counts(scores, "score", "label")
    ranked, told = ranking_quality(counts), confusion(counts, threshold)
    return told.withColumns({c: ranked.select(c).scalar() for c in ranked.columns})


def churn_labels(rfm: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """Customers per training label."""
    labelled = rfm.withColumn("at_risk", at_risk(days=days).cast("int"))
    return summarise(labelled, ["at_risk"], {"customers": F.count("*")}).orderBy("at_risk")
