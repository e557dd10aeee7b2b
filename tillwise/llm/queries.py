"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import (
    cotrain,
    deobfuscate,
    langid,
    linededup,
    merkle,
    mixing,
    pieces,
    prefixforest,
    pseudolm,
    simhash,
    tokencount,
    variants,
    wand,
)
from tillwise.llm.frames import read, ship


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the files are installed with Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.encode_decode(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return made.withColumnRenamed("id", "doc_id")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pseudolm.score(docs, pseudolm.fit(docs)).withColumnRenamed("id", "doc_id")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(read(spark, sf_dir, "documents"), F.col("id") % 20 == 0)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    made = langid.predict(docs, langid.fit(docs))
    return made.select(
        F.col("id").alias("doc_id"), langid.held_out(F.col("id")).alias("held_out"), "lang_pred", "score"
    )


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tokencount.count_tokens(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return made.withColumnRenamed("id", "doc_id")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return cotrain.score(docs, cotrain.fit(docs, read(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        simhash.hex_digits(F.col("fp")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.choose(read(spark, sf_dir, "documents"), mixing.PRODUCTION).withColumnRenamed("id", "doc_id")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(
        "page_id",
        linededup.host_of(F.col("url")).alias("host"),
        linededup.html_text(F.col("html")).alias("page_text"),
    )
    return linededup.mark_lines(pages, "host", "page_text").select(
        "page_id", "host", "n_lines", "n_dropped", F.md5("kept_text").alias("kept_md5")
    )


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixforest.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.document_manifest(read(spark, sf_dir, "documents"), tampered)
    return made.withColumn("proof_sha256", F.sha2("proof", 256)).drop("proof")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(read(spark, sf_dir, "documents"), every=31)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deobfuscate.find_personal_data(read(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s.plain)
    of = lambda kind: F.size(F.filter(plain, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[of(kind) for kind in deobfuscate.KINDS],
        F.sha2(deobfuscate.listed(plain), 256).alias("base_sha256"),
        deobfuscate.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s.plain)).cast("long").alias("n_disguised"),
    )


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run after the executors have this library's files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op10_nearest_vectors": shipped(nearest_vectors),
    "op11_merkle_manifest": shipped(merkle_manifest),
    "op12_personal_data": shipped(personal_data),
    "op13_spelling_variants": shipped(spelling_variants),
    "op1_piece_coding": shipped(piece_coding),
    "op2_lm_scores": shipped(lm_scores),
    "op3_simhash_near_dedup": shipped(simhash_near_dedup),
    "op4_exact_top_k": shipped(exact_top_k),
    "op5_language_id": shipped(language_id),
    "op6_source_mixing": shipped(source_mixing),
    "op7_line_dedup": shipped(line_dedup),
    "op8_token_counts": shipped(token_counts),
    "op9_quality": shipped(quality),
}
