"""Streams of order files: where they come from, how they are run, and where their results lie.

A run takes all files that came since the last one and ends (``availableNow``).  Progress and state lie in the checkpoint folder,
results in folders by batch number.  A batch that is repeated after a failure overwrites its own folder, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillwise.schema import whole

BATCH = "batch"


def stream_files(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files at ``path`` (a folder or a pattern) as a stream, oldest first; later runs see later files."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_orders(events: DataFrame) -> DataFrame:
    """Events, streamed or not, with the columns of orders.  A time without a zone is taken in the session's, which is to be UTC."""
    return events.select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("order_date"),
        F.col("event_type").alias("category"),
        whole(F.col("value"), 100).alias("payment_amount"),
    )


def run_available(stream: DataFrame, results: str, checkpoint: str) -> None:
    """Run the stream (an updating one) over all files not yet seen; batch n writes ``results/batch=n``.

    After a failure or a stop, the same call with the same ``checkpoint`` goes on where the last finished batch ended.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{results}/{BATCH}={batch}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def batches(spark: SparkSession, results: str, schema: StructType) -> DataFrame:
    """All rows that runs have written, with their ``batch``."""
    stated = StructType.fromJson(schema.jsonValue()).add(BATCH, "long")
    return spark.read.schema(stated).parquet(results)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key: the present result of a stream that updates whole results."""
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_new"))
    return newest.select(*keys, "_new.*")
