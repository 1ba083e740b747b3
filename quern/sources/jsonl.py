"""JSON-lines tables, read with a schema, and JSON written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "document_id bigint, document_text string"
CHUNKED = "document_id bigint, title string, chunks array<struct<chunk_id:int,title:string,content:string>>"
GOLD = "question string, answer string, document_id bigint"
PREDICTED = "question string, answer string, document_id array<bigint>, scores array<double>"
#: What becomes of a malformed line; blank lines are skipped in every mode.
MODES = {"strict": "FAILFAST", "skip": "DROPMALFORMED"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, schema: str, mode: str = "strict", fallback: str | None = None) -> DataFrame:
    """The rows of the lines; of `fallback` where nothing is at the path, and an error where neither is there."""
    if not exists(spark, path):
        if fallback is None or not exists(spark, fallback):
            raise FileNotFoundError(path)
        path = fallback
    return spark.read.schema(schema).option("mode", MODES[mode]).json(path)


def malformed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that don't fit the schema, as `line`."""
    parsed = F.from_json("value", f"{schema}, line string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "line"})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("p")).where("p.line is not null").select("p.line")


def numbered(docs: DataFrame, ord_: str = "doc_ord") -> DataFrame:
    """docs with their place in the files' order, and it as document_id where that is missing; rows without text go after that.

    Counts rows by partition first, then numbers within them; no row moves.
    """
    x = docs.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = {r["_part"]: r["n"] for r in x.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, starts = 0, {}
    for part in sorted(counts):
        starts[part], start = start, start + counts[part]
    base = F.create_map(*(F.lit(v) for kv in starts.items() for v in kv)) if starts else F.create_map(F.lit(0), F.lit(0))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    x = x.withColumn(ord_, (base[F.col("_part")] + inside).cast("bigint")).drop("_part", "_at")
    return x.withColumn("document_id", F.coalesce("document_id", ord_)).where("document_text is not null")


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_document(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one indented JSON list; more than `most` rows are an error."""
    spark = df.sparkSession
    rows = [r[0] for r in df.select(F.to_json(F.struct(*df.columns))).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
