"""Keyed tables: lookup, upsert, retention, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return rows.filter(F.col(key) == value)


def upsert(rows: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Updated keys replaced as a whole, new ones added."""
    return rows.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def unexpired(rows: DataFrame, column: str, now: Column, hours: int = 6) -> DataFrame:
    """Rows not older than ``hours`` before ``now``."""
    return rows.filter(F.col(column) >= now - F.make_dt_interval(hours=F.lit(hours)))


def unexpired_at_last(rows: DataFrame, column: str, hours: int = 6) -> DataFrame:
    """Rows not older than ``hours`` before the last one; the maximum is one row of the plan, not looked up while it is built."""
    last = F.broadcast(rows.agg(F.max(column).alias("_now")))
    return unexpired(rows.join(last, F.col(column).isNotNull()), column, F.col("_now"), hours).drop("_now")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def same_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Contents that occur more than once: hash, n, first key. Texts are reduced to their hash before the shuffle."""
    hashed = rows.filter(F.col(content).isNotNull()).select(key, content_hash(F.col(content)).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).filter("n > 1")
