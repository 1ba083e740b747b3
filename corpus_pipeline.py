"""The training-data pipeline: five operators, one after another, over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, mixing, neardup, quality, tokenout
from quern.llm.common import discard, keep, materialize, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts.

    Null and empty texts are scored as such; repeated rows stay or go together; without labels every
    document has the prior's score.  An empty table stays empty; other columns pass through.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), that of the smallest doc_id.

    Texts without words are no copies of each other and stay, as do rows without a doc_id; rows that share a
    doc_id are one document.  An empty table stays empty; other columns pass through.
    """
    return neardup.unique(docs, size=5, percent=80)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item nor half of one.

    Null and empty texts stay; rows that share a doc_id, or have none, go together.  An empty table stays
    empty; other columns pass through.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, none more than three times.

    Texts without words weigh nothing and go once; a null source is a source.  An empty table stays empty;
    other columns pass through.
    """
    return mixing.repeated(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from the compressed shards.

    Null and empty texts hold the end id alone; rows without a doc_id come first, repeated rows each have
    theirs.  An empty table gives none; other columns are left out.
    """
    import public_tokenizers

    return tokenout.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", neardup_stage),
    ("benchmark decontamination", decontam_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]

#: SQL can't express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = keep(materialize(stage(spark, docs, sf_dir)))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
