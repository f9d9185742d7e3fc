"""Loading of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one parquet table below ``root``; projections and filters reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
