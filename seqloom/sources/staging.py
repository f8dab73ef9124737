"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of this machine only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="seqloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and return the written table: its lineage ends
    there, so a lost executor costs no recomputation of what came before.  Columns in
    `by` become folders, of which a filter on them reads only its own."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def collect(spark: SparkSession) -> None:
    """Collect the driver's garbage.  Planning a long query makes several times what it holds, and
    the heap grows to its limit for that; a full collection also gives the memory back."""
    spark.sparkContext._jvm.System.gc()


def materialize_tidily(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """As materialize, for work of many plans one after the other: none leaves its garbage to the next."""
    out = materialize(df, label, by)
    collect(df.sparkSession)
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, label: str, keys: tuple[str, ...]) -> DataFrame:
    """As materialize, but in as many buckets of the keys as a shuffle has partitions: a join on all
    of the keys then shuffles the other side only.  The table's name ends with the session."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path, n = f"{shared_folder(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *keys)  # one file a bucket
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(name)
