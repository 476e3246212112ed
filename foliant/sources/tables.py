"""Access to the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.session import ship

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a corpus folder; column pruning and filters reach its scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
