"""What became of annotations on their pages: match ranges, shares, counts and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import match_form

ITEM = ["document_id", "page"]


def match_ranges(items: DataFrame) -> DataFrame:
    """Each item's stretch of the page in match form.

    Items are joined by a space, also behind an empty one, but for a word cut by a hyphen between two.
    """
    w = Window.partitionBy(*ITEM).orderBy("item_no")
    left = F.lag("str").over(w)
    cut = F.coalesce(left.rlike(r"(?i)[a-z]-\s*$") & F.col("str").rlike(r"(?i)^\s*[a-z]"), F.lit(False))
    rows = items.select(*ITEM, "item_no", F.coalesce("str", F.lit("")).alias("str"))
    rows = rows.select(*ITEM, "item_no", match_form(F.col("str")).alias("form"), F.when(left.isNull() | cut, 0).otherwise(1).alias("gap"))
    end = F.sum(F.col("gap") + F.char_length("form")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*ITEM, "item_no", "form", "gap", (end - F.char_length("form")).cast("int").alias("start"), end.cast("int").alias("end"))


def match_text(ranges: DataFrame) -> DataFrame:
    """The pages in match form from their items."""
    rows = F.sort_array(F.collect_list(F.struct("item_no", "gap", "form")))
    joined = F.array_join(F.transform(rows, lambda x: F.concat(F.when(x["gap"] == 1, F.lit(" ")).otherwise(F.lit("")), x["form"])), "")
    return ranges.groupBy(*ITEM).agg(joined.alias("whole"))


def items_of_matches(matches: DataFrame, ranges: DataFrame) -> DataFrame:
    """The items each match (unit, document_id, page, start, end) touches."""
    m = matches.select("unit", *ITEM, F.col("start").alias("ms"), F.col("end").alias("me"))
    return m.join(ranges.select(*ITEM, "item_no", "start", "end"), ITEM).filter((F.col("end") > F.col("ms")) & (F.col("start") < F.col("me"))).select("unit", *ITEM, "item_no")


def matched_share(matches: DataFrame, units: DataFrame) -> DataFrame:
    """How much of each unit (unit, part) its matches cover, at most all of it; and whether that is enough to use."""
    total = matches.groupBy("unit").agg(F.sum(F.col("end") - F.col("start")).alias("matched"), F.count(F.lit(1)).alias("n_matches"))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.coalesce("matched", F.lit(0)).cast("double"), F.char_length("part").cast("double")), F.lit(0.0)))
    rows = units.join(total, "unit", "left").select("unit", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), share.alias("share"))
    return rows.withColumn("usable", (F.col("n_matches") >= 1) & (F.col("share") >= 0.5))


def page_counts(rows: DataFrame, status: str, conditions: dict[str, Column], *by: str) -> DataFrame:
    """Conditional counts and a map of counts by status; pre-aggregated by status, so the map gathers a few rows per group."""
    part = rows.groupBy(*by, status).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])
    entry = F.when(F.col(status).isNotNull(), F.struct(status, "_n"))
    return part.groupBy(*by).agg(F.sum("_n").alias("n"), *[F.sum(name).alias(name) for name in conditions], F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_status"))


def merged_counts(counts: DataFrame, column: str, *by: str) -> DataFrame:
    """Maps of counts added up by key."""
    added = counts.select(*by, F.explode(column)).groupBy(*by, "key").agg(F.sum("value").alias("value"))
    return added.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias(column))


def top_or_first(rows: DataFrame, preferred: Column, by: str, most: int, fallback: int, *order: str) -> DataFrame:
    """The first ``most`` preferred rows of each group; for a group without any, its first ``fallback`` rows."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = rows.withColumns({"_any": F.max(preferred.cast("int")).over(Window.partitionBy(by)), "_pref": preferred})
    kept = ranked.filter(F.col("_pref") | (F.col("_any") == 0)).withColumn("rank", F.row_number().over(w))
    return kept.filter(F.col("rank") <= F.when(F.col("_any") == 1, most).otherwise(fallback)).drop("_any", "_pref")


def likely_cause(reason: Column, familiar: Column, known: Column, expected: Column, predicted: Column, directive: Column) -> Column:
    """Why a sentence was probably judged wrongly: first cause that applies. ``directive`` is the expected one."""
    return (
        F.when(F.contains(F.lower(reason), F.lit("ambiguous")), "ambiguous_label").when(familiar, "familiar_overlap").when(known, "known_overlap")
        .when((expected == "bridge") & (predicted == "delta"), "bridge_as_delta").when(directive == "leave_normal", "low_value").otherwise("unknown")
    )


def broken_invariants(counts: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per group and check that does not hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return counts.withColumn("check", F.explode(failed))
