"""Documents that keep arriving, turned into chunks file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.plans.retrieval import ingest
from quern.sources.jsonl import RAW


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(RAW).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(path)


def write_chunks(docs: DataFrame, out: str, checkpoint: str, most: int | None = None, once: bool = True) -> StreamingQuery:
    """Appends the chunks of each micro-batch to the Parquet table at `out`, each batch in a folder of its own.

    A batch that is run again after a failure overwrites its own folder, so no chunk comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        ingest(batch, most).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
