"""Churn risk: a random forest on recency, frequency, monetary value and rating.

The label is a threshold on recency, which is also a feature, so the forest learns that threshold.  Its
accuracy says nothing about predicting behaviour.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.scalars import band
from tillwise.models.layout import in_fixed_order, partitions_for
from tillwise.operators.projections import fill_zero

# Model inputs and their titles; risk levels from high to low and their strict lower limits.
FEATURES = ("recency", "frequency", "monetary", "avg_rating")
FEATURE_TITLES = {
    "recency": "Days Since Last Order",
    "frequency": "Number of Orders",
    "monetary": "Total Spend (₹)",
    "avg_rating": "Average Rating Given",
}
RISK_LEVELS = ("High Risk", "Medium Risk", "Low Risk")
HIGH, MEDIUM = 0.6, 0.35
CHURN_DAYS = 180
MIN_ROWS = 20
#: Share of the customers that an evaluation keeps out of training.
HOLDOUT = 0.25


def at_risk(recency: str = "recency", days: int = CHURN_DAYS) -> Column:
    """1.0 when the last order is more than ``days`` ago."""
    return (F.col(recency) > days).cast("double")


def training_size(rfm: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """One row: training rows and classes among them."""
    label = F.col("label") if "label" in rfm.columns else at_risk(days=days)
    return rfm.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("classes"))


def can_train(rows, classes, min_rows: int = MIN_ROWS):
    """Whether so many rows of so many classes can train a model; numbers or columns."""
    return (rows >= min_rows) & (classes >= 2)


def train_churn(
    rfm: DataFrame,
    days: int = CHURN_DAYS,
    min_rows: int = MIN_ROWS,
    trees: int = 100,
    seed: int = 42,
    holdout: float = 0.0,
    max_depth: int = 12,
    max_bins: int = 256,
    partitions: int | None = None,
) -> PipelineModel | None:
    """The fitted pipeline, or None with fewer than ``min_rows`` customers or one class.

    ``holdout`` keeps that share of the customers (by hash of their id) out of training.  A column ``label`` (1.0 for
    customers who left) is used where ``rfm`` has one, else a threshold on recency.  Partitions follow from the number
    of rows unless they are given.  The node that a row has come to in each tree is kept from level to level, so no level
    sends the rows through the trees from their roots; the forest is the same.
    """
    known = F.col("label").cast("double") if "label" in rfm.columns else at_risk(days=days)
    table = _features(rfm, known.alias("label"))
    if holdout:
        table = table.where(~held_out(holdout))
    size = training_size(table).first()
    if not can_train(size.rows, size.classes, min_rows):
        return None
    table = in_fixed_order(table, partitions or partitions_for(size.rows)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(
            numTrees=trees, seed=seed, maxDepth=max_depth, maxBins=max_bins, probabilityCol="probability",
            maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=-1,
        )
        return Pipeline(stages=[assembler, forest]).fit(table)
    finally:
        table.unpersist()


def held_out(part: float) -> Column:
    """Whether a customer is in the hold-out set: by the first 32 bits of the MD5 of the id."""
    draw = F.conv(F.substring(F.md5(F.col("customer_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return draw % 1_000_000 < int(part * 1_000_000)


def score_churn(model: PipelineModel, df: DataFrame, high: float = HIGH, medium: float = MEDIUM) -> DataFrame:
    """``df`` with ``churn_prob`` and ``risk_level``: one pass of the model over all rows.

    ``df`` has the four features; they are customers, or supposed customers for a what-if question.
    """
    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    named = df.withColumn("_row", F.struct(*df.columns)).select("_row", *inputs)
    p = vector_to_array("probability")[1]
    scored = model.transform(named).select("_row.*", p.alias("churn_prob"))
    return scored.withColumn("risk_level", band("churn_prob", [high, medium], RISK_LEVELS))


def importances(model: PipelineModel, like: DataFrame) -> DataFrame:
    """Weight of each feature, ascending."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(name, FEATURE_TITLES[name], weight) for name, weight in zip(FEATURES, weights)]
    made = like.sparkSession.createDataFrame(rows, "feature string, factor string, importance double")
    return made.orderBy("importance", "feature")


def _features(rfm: DataFrame, *more: Column) -> DataFrame:
    table = rfm.select("customer_id", *[F.col(c).cast("double") for c in FEATURES], *more)
    return fill_zero(table, FEATURES)
