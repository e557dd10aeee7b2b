"""Session settings and lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans here count on.

    Adaptive execution sizes the shuffle partitions, splits a join partition that one hot key has swollen
    and turns a join into a broadcast only once the measured side is below the threshold.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as their query has ended, not when the driver happens to collect its garbage.

    For chains of queries that each store their result and are computed once.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder, and return the stored rows in the same partitions.

    Used where a second evaluation could give other rows (range partition bounds are sampled) or where the
    order of partitions counts.  The files outlive any executor.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and return a scan of it.

    Later plans read only the columns they use and push their filters down.  Partitions and their order are
    not kept.  The files outlive any executor and stay in the application's folder.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The application's folder for stored tables, which the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``; where that is unset, in the warehouse, which is shared as well.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored")
    return context.getCheckpointDir()
