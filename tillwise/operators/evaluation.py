"""How well scores tell two classes apart, from counts per score: no table of rows is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.operators.ranking import running_sums
from tillwise.session import store


def score_counts(scored: DataFrame, score: str, label: str) -> DataFrame:
    """``(score, positives, negatives)`` per distinct score, stored; rows without score or label take no part."""
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return store(
        known.groupBy(F.col(score).cast("double").alias("score")).agg(
            F.count_if(F.col(label) > 0).alias("positives"), F.count_if(~(F.col(label) > 0)).alias("negatives")
        )
    )


def ranking_quality(counts: DataFrame) -> DataFrame:
    """One row: ``rows``, ``positives``, and ``auc``, the share of (positive, negative) pairs in the right order, ties half.

    Null without both classes.  Positives above and beside negatives are counted as whole numbers.
    """
    placed = running_sums(counts, "score", ["negatives"])
    won = (2 * F.col("before_negatives") + F.col("negatives")).cast("decimal(20,0)") * F.col("positives")
    totals = placed.agg(
        F.coalesce(F.sum(F.col("positives") + F.col("negatives")), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"),
        F.sum("negatives").alias("_negatives"),
        F.sum(won).alias("_won"),
    )
    pairs = 2.0 * F.col("positives").cast("double") * F.col("_negatives").cast("double")
    return totals.select("rows", "positives", F.try_divide(F.col("_won").cast("double"), pairs).alias("auc"))


def calibration(counts: DataFrame, bands: int = 10) -> DataFrame:
    """Per band of equal width of the score (0 to 1): rows, mean score (six digits) and share of positives; bands without rows do not appear."""
    band = F.least(F.floor(F.col("score") * bands), F.lit(bands - 1)).cast("int")
    n = F.col("positives") + F.col("negatives")
    return (
        counts.groupBy(band.alias("band"))
        .agg(F.sum(n).alias("rows"), F.sum(F.col("score") * n).alias("_score"), F.sum("positives").alias("_positives"))
        .select(
            "band", "rows", F.round(F.col("_score") / F.col("rows"), 6).alias("mean_score"),
            (F.col("_positives") / F.col("rows")).alias("observed"),
        )
        .orderBy("band")
    )


def confusion(counts: DataFrame, threshold: float) -> DataFrame:
    """One row: how often a score above ``threshold`` and the label agree and differ, with precision and recall."""
    above = F.col("score") > threshold
    cells = {
        "true_positives": (above, "positives"), "false_positives": (above, "negatives"),
        "false_negatives": (~above, "positives"), "true_negatives": (~above, "negatives"),
    }
    summed = counts.agg(*[F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).alias(name) for name, (test, c) in cells.items()])
    hits = F.col("true_positives")
    return summed.withColumns(
        {
            "precision": F.try_divide(hits, hits + F.col("false_positives")),
            "recall": F.try_divide(hits, hits + F.col("false_negatives")),
        }
    )
