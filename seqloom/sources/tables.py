"""Parquet table sources: plain Spark reads, so any file system Spark knows will do."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, root: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The named table under root; with columns only those, checked to exist."""
    df = spark.read.parquet(table_path(root, name))
    return df if columns is None else require_columns(df, columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns (a pruned scan); a missing one raises ValueError."""
    wanted = list(columns)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*wanted)
