"""Stored tables: checked reads, compute-once frames, result sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.operators.projections import display
from tillwise.schema import FactSchema


def read_facts(spark: SparkSession, path: str, schema: FactSchema = FactSchema()) -> DataFrame:
    """A flat order table in parquet, renamed to the canonical columns and type-checked."""
    return schema.conform(spark.read.parquet(path))


def materialise(df: DataFrame, path: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Compute once for all later reports: as a parquet table at ``path``, else persisted.

    A report that filters on a partition column reads only the files of its values.  ``path`` must be new.
    """
    if path is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(df: DataFrame, path: str, titles: Mapping[str, str]) -> None:
    """Write a result table under its display titles."""
    display(df, titles).write.parquet(path)


def extent(facts: DataFrame) -> DataFrame:
    """Row count, first and last date."""
    return facts.agg(
        F.count("*").alias("orders"),
        F.to_date(F.min("order_date")).alias("first_date"),
        F.to_date(F.max("order_date")).alias("last_date"),
    )
