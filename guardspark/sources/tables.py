"""Readers for the parquet tables the jobs consume."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One parquet table; column pruning and filters push into the scan.

    ``spread`` is for CPU-heavy text work: see :func:`spread`.
    """
    from ..session import ship_package
    ship_package(spark)          # Python steps downstream import this package
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_rows(df) if spread else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all task slots when the scan is narrower.

    A table stored as one file with one row group scans as one partition,
    so regex work on it would run in a single task. Large inputs already
    arrive in at least as many splits as there are slots; for them this is
    a no-op and adds no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df
