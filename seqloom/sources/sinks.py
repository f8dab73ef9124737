"""Sinks: Parquet with an overwrite guard, JSON and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """Snappy Parquet; an existing path raises unless overwrite is asked for."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str, overwrite: bool = False) -> None:
    """A table bucketed and sorted by its key: later joins on the key need no shuffle."""
    df.write.mode("overwrite" if overwrite else "errorifexists").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as reports can't hold them."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[F.when(~bad(F.col(f.name)), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    finite(df).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    finite(df).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("encoding", "UTF-8").csv(path)


def describe_files(df: DataFrame) -> DataFrame:
    """path and length of the files a DataFrame reads."""
    return df.sparkSession.read.format("binaryFile").load(df.inputFiles()).select("path", "length")
