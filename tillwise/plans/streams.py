"""Reports kept up to date from a stream of event files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import shared_folder
from tillwise.sources.facts import table
from tillwise.streaming.runs import batches, event_orders, latest, run_available, stream_files
from tillwise.streaming.summaries import stream_new_vs_returning, stream_summarise, sum_changes

DAY_KEYS = ("window_start", "window_end", "category")


def daily_categories(events: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Orders and amount (in hundredths) of each day and category, of a table or a stream."""
    measures = {"orders": F.count("*"), "amount": F.coalesce(F.sum("payment_amount"), F.lit(0))}
    return stream_summarise(event_orders(events), "1 day", watermark, ["category"], measures)


class EventReports:
    """Reports over the files at ``path``; ``folder`` keeps their progress, state and results between runs.

    ``files_per_batch`` bounds what a batch reads.  ``refresh`` takes in the files that came since the last time; reports read results.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str, files_per_batch: int | None = None):
        self.spark, self.path, self.folder, self.files_per_batch = spark, path, folder, files_per_batch
        events = stream_files(spark, path, spark.read.parquet(path).schema, files_per_batch)
        self.streams = {"days": daily_categories(events), "retention": stream_new_vs_returning(event_orders(events), "week")}

    def refresh(self, *names: str) -> None:
        for name in names or self.streams:
            run_available(self.streams[name], f"{self.folder}/{name}", f"{self.folder}/progress/{name}")

    def _rows(self, name: str) -> DataFrame:
        return batches(self.spark, f"{self.folder}/{name}", self.streams[name].schema)

    def days(self) -> DataFrame:
        newest = latest(self._rows("days"), DAY_KEYS)
        return _shown(newest)

    def retention(self) -> DataFrame:
        return sum_changes(self._rows("retention"))


def event_reports(spark: SparkSession, directory: str) -> EventReports:
    """Reports over the events of a data directory, begun anew in the shared folder; a stream takes a pattern, not one file."""
    return EventReports(spark, f"{directory}/events.parque[t]", f"{shared_folder(spark)}/{uuid4()}")


def streamed_days(spark: SparkSession, directory: str) -> DataFrame:
    reports = event_reports(spark, directory)
    reports.refresh("days")
    return reports.days()


def streamed_retention(spark: SparkSession, directory: str) -> DataFrame:
    reports = event_reports(spark, directory)
    reports.refresh("retention")
    return reports.retention()


def batch_days(spark: SparkSession, directory: str) -> DataFrame:
    """``streamed_days`` computed at once from the table."""
    return _shown(daily_categories(table(spark, directory, "events")))


def _shown(days: DataFrame) -> DataFrame:
    bounds = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return days.select(*bounds, "category", "orders", (F.col("amount") / 100.0).alias("revenue"))
