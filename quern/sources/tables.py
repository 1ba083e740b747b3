"""Indexes as Parquet tables: saved, loaded, or built where nothing is saved."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import bm25, word_vectors
from quern.sources.jsonl import exists


#: Postings that a task sorts, about.
ROWS = 1_000_000


def save_bm25(index: bm25.Index, path: str, buckets: int = 64) -> None:
    """Postings are laid out by a hash of their term; a search over some terms loads their buckets only."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    # a bucket's postings are dealt to several tasks, so that none sorts more than about ROWS
    total = index.terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    part = F.pmod(F.xxhash64("ord"), F.lit(total // (16 * ROWS) + 1))
    index.postings.withColumn("bucket", bucket).repartition(max(buckets, total // ROWS), "bucket", part).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    index.terms.write.parquet(f"{path}/terms")
    index.chunks.write.parquet(f"{path}/chunks")
    spark = index.terms.sparkSession
    row = (index.n, float(index.avgdl), float(index.k1), float(index.b), float(index.epsilon), buckets)
    spark.createDataFrame([row], "n long, avgdl double, k1 double, b double, epsilon double, buckets int").coalesce(1).write.parquet(f"{path}/corpus")


def load_bm25(spark: SparkSession, path: str, terms: list[str] | None = None) -> bm25.Index:
    """The saved index; its parameters are those it was saved with.  With `terms`, only the postings in their buckets are read."""
    c = spark.read.parquet(f"{path}/corpus").first()
    if c is None:
        raise ValueError(f"no index at {path}")
    postings = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        wanted = spark.createDataFrame([(w,) for w in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(c["buckets"])).cast("int").alias("b")).distinct()
        postings = postings.where(F.col("bucket").isin(*[r["b"] for r in wanted.collect()]))
    return bm25.Index(postings.drop("bucket"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/chunks"), c["n"], c["avgdl"], c["k1"], c["b"], c["epsilon"])


def save_vectors(index: word_vectors.Index, path: str) -> None:
    index.vectors.write.parquet(f"{path}/vectors")
    index.idf.write.parquet(f"{path}/idf")
    spark = index.vectors.sparkSession
    spark.createDataFrame([(index.width, index.weighted, index.preprocess)], "width int, weighted boolean, preprocess boolean").coalesce(1).write.parquet(f"{path}/settings")


def load_vectors(spark: SparkSession, path: str, words: DataFrame) -> word_vectors.Index:
    """The saved vectors; a missing part is an error."""
    s = spark.read.parquet(f"{path}/settings").first()
    return word_vectors.Index(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/idf"), words, s["width"], s["weighted"], s["preprocess"])


def load_or_build(spark: SparkSession, path: str, load: Callable[[], Any], build: Callable[[], Any], save: Callable[[Any], None]) -> Any:
    """What is saved at the path, or else what is built, saved there and loaded."""
    if not exists(spark, path):
        save(build())
    return load()


def read_word_vectors(spark: SparkSession, path: str, empty_if_missing: bool = False) -> DataFrame:
    """(term, vec) of lines of a word and its components; a count line at the top is skipped.

    A missing file is an error unless an empty vocabulary is asked for.
    """
    if not exists(spark, path):
        if not empty_if_missing:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], "term string, vec array<float>")
    parts = F.split(F.trim("value"), " ")
    x = spark.read.text(path).select(parts[0].alias("term"), F.transform(F.slice(parts, 2, 1_000_000), lambda v: v.try_cast("float")).alias("vec"))
    return x.where((F.size("vec") > 1) & ~F.exists("vec", lambda v: v.isNull()))
