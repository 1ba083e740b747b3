"""The queries of the training-data operators over their whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, langid, licenses, mixing, neardup, quality, secretscan, tokenout, toxicity, vectors
from quern.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with all kinds of evidence, and every document, whose source stands for a host."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("text"), F.lit(True).alias("is_markup"), "url", none.alias("site"))
    rows = rows.unionByName(docs.select(F.col("doc_id").cast("long").alias("id"), F.lit("document").alias("kind"), "text", F.lit(False).alias("is_markup"), none.alias("url"), F.col("source").alias("site")))
    x = langid.identify(rows, docs.select("doc_id", "text", "lang"))
    mine = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return x.select("kind", mine("document").alias("doc_id"), mine("page").alias("page_id"), "lang", "confidence", "text_lang", "declared", "host", "n_words")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return x.select("doc_id", "nth", F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"), "score", "is_secret")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenout.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_quality_classifier, op3_toxicity, op4_minhash_dedup, op5_decontaminate, op6_language_id, op7_secret_scan, op8_token_output, op9_embedding_dedup, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.oracle(), "op5_decontaminate": decontam.oracle(), "op10_license_scan": licenses.oracle()}
