"""The row-local operators on streams; a watermark instead of a retention sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.segments import sentences


def page_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sentence_stream(pages: DataFrame) -> DataFrame:
    """Sentences of arriving pages; the same expressions as in a batch."""
    return sentences(pages, "normalized_text", "document_id", "page", "ingested_at")


def recent_counts(rows: DataFrame, by: str, retention: str = "6 hours", window: str = "1 hour") -> DataFrame:
    """Rows by window of time; what comes later than ``retention`` is dropped and its state freed."""
    return rows.withWatermark("ingested_at", retention).groupBy(F.window("ingested_at", window), by).agg(F.count(F.lit(1)).alias("n"))


def first_deliveries(rows: DataFrame, keys: list[str], retention: str = "6 hours") -> DataFrame:
    """Each key once within the retention; state is kept no longer."""
    return rows.withWatermark("ingested_at", retention).dropDuplicatesWithinWatermark(keys)
