"""Pages from text items, and items back from page offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.kinds import kind, begins_references
from foliant.functions.measure import round_half_up, utf16_length, utf16_slice
from foliant.functions.text import trim
from foliant.operators.segments import latest, sentences

ITEM = ["document_id", "page"]


def delivered_items(items: DataFrame) -> DataFrame:
    """Each item position once: the latest delivery. Items come together by page, as all that follows needs them: one shuffle."""
    return latest(items.repartition(*ITEM), [*ITEM, "item_no"], F.col("ingested_at").desc_nulls_last(), F.col("item_key").desc())


def delivered_pages(pages: DataFrame, whole_documents: bool = False) -> DataFrame:
    """Each page once: the latest delivery. ``whole_documents`` brings a document's pages together, for steps that run over them."""
    return latest(pages.repartition("document_id") if whole_documents else pages, ITEM, F.col("ingested_at").desc_nulls_last(), F.col("page_key").desc())


def placed_items(items: DataFrame) -> DataFrame:
    """Items with their stretch of the page's raw and normalized text, in UTF-16 units.

    Raw text is every string and a line break where has_eol. Normalized strings are joined by a space,
    but a line ending in a hyphen loses it and takes the next item directly; empty strings add nothing.
    The joint depends on the neighbours alone, so both offsets are window sums over one sort per page.
    """
    w = Window.partitionBy(*ITEM).orderBy("item_no")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    norm, eol = F.col("norm"), F.coalesce("has_eol", F.lit(False))
    rows = items.filter("str is not null").select(*ITEM, "item_no", "str", F.coalesce("normalized_str", F.lit("")).alias("norm"), eol.alias("eol"))
    joins = F.coalesce(F.lag(F.col("eol") & norm.endswith("-"), 1).over(w), F.lit(False)) & (norm != "")
    rows = rows.withColumn("joins", joins)
    rows = rows.withColumns({
        "cut": F.coalesce(F.lead("joins", 1).over(w), F.lit(False)),
        "some": F.coalesce(F.max((norm != "").cast("int")).over(before), F.lit(0)) == 1,
    })
    rows = rows.withColumns({
        "gap": ((norm != "") & F.col("some") & ~F.col("joins")).cast("int"),
        "own": F.when(F.col("cut"), F.left(norm, F.char_length(norm) - 1)).otherwise(norm),
    })
    end = F.sum(F.col("gap") + utf16_length(F.col("own"))).over(so_far)
    raw_end = F.sum(utf16_length(F.col("str"))).over(so_far) + F.coalesce(F.sum(F.col("eol").cast("int")).over(before), F.lit(0))
    return rows.select(
        *ITEM, "item_no", "str", "own", "gap", "eol",
        (raw_end - utf16_length(F.col("str"))).cast("int").alias("raw_start"), raw_end.cast("int").alias("raw_end"),
        (end - utf16_length(F.col("own"))).cast("int").alias("start"), end.cast("int").alias("end"),
    )


def page_texts(placed: DataFrame) -> DataFrame:
    """The pages' raw and normalized text from placed items; one page's items come together, no more."""
    rows = F.sort_array(F.collect_list(F.struct("item_no", "str", "eol", "gap", "own")))
    grouped = placed.groupBy(*ITEM).agg(rows.alias("rows"), F.count(F.lit(1)).alias("n_items"))
    raw = F.array_join(F.transform("rows", lambda x: F.concat(x["str"], F.when(x["eol"], F.lit("\n")).otherwise(F.lit("")))), "")
    norm = F.array_join(F.transform("rows", lambda x: F.concat(F.when(x["gap"] == 1, F.lit(" ")).otherwise(F.lit("")), x["own"])), "")
    return grouped.select(*ITEM, "n_items", raw.alias("raw_text"), norm.alias("normalized_text"))


def span_index(items: DataFrame) -> DataFrame:
    """Items with their place among the non-empty items of the page, from 0; null for empty ones."""
    w = Window.partitionBy(*ITEM).orderBy("item_no").rowsBetween(Window.unboundedPreceding, 0)
    full = F.char_length(F.coalesce("str", F.lit(""))) > 0
    return items.select(*ITEM, "item_no", F.when(full, F.sum(full.cast("int")).over(w) - 1).cast("int").alias("span"))


def item_overlaps(units: DataFrame, placed: DataFrame) -> DataFrame:
    """Which stretch of which item each sentence covers: an equi-join on the page with the overlap as residual condition."""
    u, i = units.select(*ITEM, "sent_no", F.col("start").alias("us"), F.col("end").alias("ue")), placed.select(*ITEM, "item_no", "start", "end")
    low, high = F.greatest("us", "start"), F.least("ue", "end")
    return u.join(i, ITEM).filter(low < high).select(*ITEM, "sent_no", "item_no", (low - F.col("start")).alias("item_start"), (high - F.col("start")).alias("item_end"))


def reading_units(pages: DataFrame) -> DataFrame:
    """The sentences of the pages with quote context and kind.

    A reference section once begun holds to the end of the document, over page breaks.
    """
    rows = sentences(pages.withColumn("page_text", F.col("normalized_text")), "normalized_text", *ITEM, "page_text")
    total = utf16_length(F.col("page_text"))
    prefix = trim(utf16_slice(F.col("page_text"), F.greatest(F.col("start") - 32, F.lit(0)), F.col("start")))
    suffix = trim(utf16_slice(F.col("page_text"), F.col("end"), F.least(F.col("end") + 32, total)))
    rows = rows.select(*ITEM, "sent_no", "text", "start", "end", prefix.alias("prefix"), suffix.alias("suffix"))
    return with_kinds(rows)


def with_kinds(units: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("page", "sent_no").rowsBetween(Window.unboundedPreceding, 0)
    in_references = F.max(begins_references(F.col("text")).cast("int")).over(w) == 1
    return units.withColumn("kind", kind(F.col("text"), F.col("page"), F.col("start"), in_references))


def line_groups(items: DataFrame, top) -> DataFrame:
    """Items of a page by line: ``top`` rounded to the nearest multiple of 4."""
    line = (round_half_up(top / 4) * 4).cast("int")
    return items.withColumn("line", line).groupBy(*ITEM, "line").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_no").alias("first_item"), F.max("item_no").alias("last_item"))


def whole_lines(items: DataFrame, chosen: DataFrame, top) -> DataFrame:
    """The items on the lines of the chosen items."""
    lined = items.withColumn("line", (round_half_up(top / 4) * 4).cast("int"))
    lines = lined.join(chosen.select(*ITEM, "item_no").distinct(), [*ITEM, "item_no"], "left_semi").select(*ITEM, "line").distinct()
    return lined.join(lines, [*ITEM, "line"], "left_semi").select(*ITEM, "item_no", "line")


def page_stats(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Every page with the number of its items, also 0, its lengths and a preview."""
    n = items.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_items"))
    text = F.coalesce("normalized_text", F.lit(""))
    return pages.join(n, ITEM, "left").select(
        *ITEM, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.char_length(F.coalesce("raw_text", F.lit(""))).alias("raw_chars"), F.char_length(text).alias("normalized_chars"),
        (text != "").alias("has_text"), F.left(text, F.lit(120)).alias("preview"),
    )
