"""Keywords of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import KEYWORD_STOP, lower_each, title_case
from foliant.operators.segments import first_per


def keyword_counts(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """Words of at least six UTF-8 bytes, without common ones, title-cased and counted: by, word, n."""
    split = F.explode(F.split(lower_each(F.col(text)), r"[^\p{IsAlphabetic}\p{N}]+"))
    each = rows.select(*by, split.alias("w")).filter((F.octet_length("w") >= 6) & ~F.col("w").isin(*KEYWORD_STOP))
    return each.select(*by, title_case(F.col("w")).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def top_keywords(rows: DataFrame, text: str, *by: str, most: int = 12) -> DataFrame:
    """The most frequent keywords, ties in the order of the words: by, rank, word, n."""
    return first_per(keyword_counts(rows, text, *by), most, list(by), F.col("n").desc(), "word")
