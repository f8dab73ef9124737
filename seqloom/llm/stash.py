"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import materialize as stash
from ..sources.staging import shared_folder

__all__ = ["drop_stash", "modest_batches", "release", "shared_folder", "stash"]


#: Bytes of one Arrow batch handed to Python: texts differ in length a thousandfold, so rows bound nothing.
BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Have the session hand Python small batches; every operator with Python kernels asks for it."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(size).rstrip("bB"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def drop_stash(df: DataFrame) -> None:
    """Delete a stash that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of finished jobs before the next job adds its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
