"""Small helpers the operators of this package share."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import settle, shared_folder, store

__all__ = ["arrow_rows", "connected_components", "per_batch", "read", "settle", "ship", "store", "words_column"]

#: Separators of words: space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this library's Python files to the executors, once per application, as ``--py-files`` would.

    The archive lies in the shared folder.
    """
    context = spark.sparkContext
    if getattr(context, "_tillwise_shipped", False):
        return
    package, archive = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(package.rglob("*.py")):
            file.write(path, path.relative_to(package.parent))
    target = f"{shared_folder(spark)}/tillwise.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(archive.getvalue()))
    out.close()
    context.addPyFile(target)
    context._tillwise_shipped = True


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Arrow batches hold at most so many rows, in a worker and in its executor; for queries computed within it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words_column(text: Column) -> Column:
    """Number of words of ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def per_batch(function, schema: pa.Schema, rows: int = 2_000):
    """A function for ``mapInArrow`` that gives ``function(columns as lists)`` in batches of ``rows``.

    ``function`` gets one list per input column and returns one list or array per output column.  Batches are
    cut to ``rows`` rows so that what a worker holds does not depend on the batch size Spark sends.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = function(*[column.to_pylist() for column in part.columns])
                arrays = [
                    column if isinstance(column, pa.Array) else pa.array(column, field.type)
                    for column, field in zip(made, schema, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def connected_components(edges: DataFrame, max_rounds: int = 60, rounds: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the smallest node that can be reached.

    Alternates two rewirings until nothing changes: every node sends its larger neighbours to its smallest
    one, then every node hooks itself and its smaller neighbours to the smallest of them.  Each round is
    aggregations that combine before their shuffle and joins that adaptive execution can split at a hot node;
    rounds grow with the logarithm of the longest path.  Each round is stored as Parquet, so that few tasks read many small
    files, and no table is read twice to have both directions of an edge.

    After ``rounds``, if given, what was found is returned: nodes of one root are then connected for certain, but connected
    nodes may still have several roots.

    Null nodes take no part.  Loops (a = b) make a component of their own if nothing else reaches the node.
    """
    pairs = edges.where("a is not null and b is not null").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    loops = pairs.where("a = b").select("a").distinct()
    current, before = store(pairs.where("a <> b").distinct()), None  # a > b, here and after every round
    for _ in range(max_rounds if rounds is None else rounds):
        if rounds is None:
            state = current.select(
                F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
            ).first()
            if state == before or state[0] == 0:
                break
            before = state
        least = current.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = current.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = [F.struct(F.col(c).alias("a"), F.col("m").alias("b")) for c in "ab"]
        small = large.join(smallest, "a").select(F.explode(F.array(*hooked)).alias("edge")).select("edge.*")
        current = store(small.where("a <> b").distinct())
    else:
        if rounds is None:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
