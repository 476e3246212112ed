"""Files in and out: PDF bytes, JSON captures and models, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.store import content_hash

#: Fixed value: uploads above this are refused.
MAX_BYTES = 50 * 1024 * 1024

ITEM = "str string, transform array<double>, width double, height double, hasEOL boolean, bbox struct<x double, y double, width double, height double>"
ITEM_TYPE = "struct<str:string,transform:array<double>,width:double,height:double,hasEOL:boolean,bbox:struct<x:double,y:double,width:double,height:double>>"
CAPTURE = f"extractor_version string, pages array<array<{ITEM_TYPE}>>"


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with their bytes and SHA-256, larger ones left out by the length column before their bytes are read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.filter(F.col("length") <= MAX_BYTES).select("path", "length", content_hash(F.col("content")).alias("pdf_hash"), "content")


def typed_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """JSON of a given schema; a file that is no JSON becomes a row with _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def captured_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of captured pages: path, page and item_no from 1; entries without a string are no items."""
    rows = typed_json(spark, path, CAPTURE).select(F.input_file_name().alias("path"), F.posexplode("pages").alias("p", "items"))
    kept = rows.select("path", (F.col("p") + 1).alias("page"), F.posexplode(F.filter("items", lambda i: i["str"].isNotNull())).alias("i", "x"))
    return kept.select("path", "page", (F.col("i") + 1).alias("item_no"), "x.str", "x.transform", "x.width", "x.height", F.coalesce("x.hasEOL", F.lit(False)).alias("has_eol"), "x.bbox")


def split_valid(models: DataFrame, versions: tuple[str, ...] = ("1.0",)) -> tuple[DataFrame, DataFrame]:
    """Model headers that are sound, and the others with their reason: known version, UUID, 64 hex digits of hash."""
    reason = (
        F.when(~F.coalesce(F.col("schema_version").isin(*versions), F.lit(False)), "schema_version")
        .when(~F.coalesce(F.col("document_id").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False)), "document_id")
        .when(~F.coalesce(F.col("pdf_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "pdf_hash")
    )
    judged = models.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def complete_captures(pages: DataFrame, models: DataFrame) -> DataFrame:
    """For each document the pages there are and those there should be."""
    have = pages.groupBy("document_id").agg(F.countDistinct("page").alias("n_pages"))
    return models.join(have, "document_id", "left").select("document_id", "page_count", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), (F.coalesce("n_pages", F.lit(0)) == F.col("page_count")).alias("complete"))


def first_available(preferred: DataFrame, template: DataFrame, key: str, needed: str) -> DataFrame:
    """Rows of ``preferred``, or of ``template`` for keys it lacks; rows whose ``needed`` is blank are left out."""
    both = preferred.unionByName(template.join(preferred.select(key), key, "left_anti"))
    return both.filter(F.trim(F.col(needed)) != "")


def json_rows(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias(name))


def write_json(rows: DataFrame, path: str, keep_existing: bool = False) -> None:
    """JSON lines; ``keep_existing`` leaves a path alone that exists already."""
    rows.write.mode("ignore" if keep_existing else "error").json(path)


def sheet(rows: DataFrame, line: Column, order: list[str], *by: str) -> DataFrame:
    """Rows as lines of text in order, one sheet per group."""
    gathered = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(gathered, lambda x: x["line"]), "\n").alias("sheet"), F.count(F.lit(1)).alias("n_lines"))


def counts_text(counts: Column) -> Column:
    """A map of counts as "a=1 b=2", by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("error").text(path)
