"""Placement of training rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

#: Training rows a task should hold about, and the least number of partitions.
ROWS, LEAST = 200_000, 8


def partitions_for(rows: int) -> int:
    """Partitions for so many training rows: they follow from the table, not from the cluster."""
    return max(LEAST, ceil(rows / ROWS))


def in_fixed_order(df: DataFrame, partitions: int, key: str = "customer_id") -> DataFrame:
    """Rows hashed by key into ``partitions`` partitions and sorted there.

    Bagging draws by partition and position, so a seed then gives the same model on any cluster, and again after an
    executor is lost.
    """
    return df.repartition(partitions, key).sortWithinPartitions(key)
