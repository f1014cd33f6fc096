"""Readers of the Parquet tables that a data folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """``<data_dir>/<name>.parquet``, by Spark's reader alone (any file system)."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
