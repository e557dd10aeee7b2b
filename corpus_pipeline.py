"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage is ``(name, function)``; the function takes the session, the documents and the folder of the tables.  Its
result is written as Parquet to the shared folder and read again as the next one's documents, so a lost executor costs at most
the stage that runs.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import cotrain, linededup, mixing, pieces, setjoin
from tillwise.llm.frames import read, ship
from tillwise.llm.queries import vocabulary
from tillwise.session import short_shuffles, store

#: Parts whose ids a worker keeps: fewer than the operator's, as the workers serve the other stages as well.
KEPT = 100_000
#: Rows of an Arrow batch of whole texts, which a worker and its executor hold beside each other.
ROWS = "1024"


def prepare(spark: SparkSession) -> None:
    """Python files for the executors, and smaller batches than Spark's 10,000 rows; no result depends on them."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers do not reject."""
    prepare(spark)
    return cotrain.keep_good(docs, cotrain.fit(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their source repeats on over 2 % of its different documents; see ``linededup``."""
    prepare(spark)
    kept = linededup.drop_boilerplate(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document with the smallest id.

    SimHash finds the first links, a join of shingle sets those that it misses.
    """
    prepare(spark)
    with short_shuffles(spark):
        kept = setjoin.drop_near_duplicates(docs)
    return kept.select("*")  # planned after the setting, so it may be computed again


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's share of the token budget."""
    prepare(spark)
    return mixing.mix_documents(docs, mixing.PIPELINE)


def piece_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their digest and that of the decoded text."""
    prepare(spark)
    made = pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"), with_ids=True, kept=KEPT)
    return made.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("piece_coding", piece_coding),
]

#: SQL cannot state a trained classifier, a join of shingle sets or merges; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
