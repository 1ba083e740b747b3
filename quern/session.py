"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once an application, as spark-submit --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quern", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._quern_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores dealt to all of them; a larger one as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def work_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder of spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quern-{spark.sparkContext.applicationId}"
