"""What the training-data operators share: table access, work tables in the shared folder, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship, work_dir

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name under sf_dir, which may be any path that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is (lower() would also fold other letters)."""
    return F.translate(col, UPPER, LOWER)


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Work tables written inside are removed at the end, but for those given to keep()."""
    _open.append([])
    try:
        yield
    finally:
        discard(*_open.pop())


def keep(df: DataFrame) -> DataFrame:
    """df, a work table, outlives the innermost scratch() and belongs to the one around it."""
    if _open and any(df is held for held in _open[-1]):
        _open[-1] = [held for held in _open[-1] if held is not df]
        if len(_open) > 1:
            _open[-2].append(df)
    return df


def materialize(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the tasks it ran.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    if _open:
        _open[-1].append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Removes work tables of materialize() that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df._quern_path)


def release(spark: SparkSession) -> None:
    """Removes all work tables of this application; results that still read them become unusable."""
    _remove(spark, work_dir(spark))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
