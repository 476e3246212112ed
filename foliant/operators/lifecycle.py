"""What becomes of every annotation on its page: matched, given spans, shown or dropped, with the reason; counts and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import match_form
from foliant.operators import allocation, annotations, diagnostics, evaluation, matching

PAGE = ["document_id", "page"]
#: Final states of an annotation.
STATES = ("rendered_inline", "inline_fallback_without_usable_match", "rendered_as_page_note", "left_normal", "dropped")
#: What the best line's share of a confidence is worth where no phrase was found.
FALLBACK_SHARE = 0.82


def page_lifecycle(rows: DataFrame, items: DataFrame, focus: bool = False) -> DataFrame:
    """The final state of each annotation: rows (unit, document_id, page, text, priority, directive, confidence, source), items.

    Valid annotations with an inline directive are looked for in their page: exactly, else by phrase windows; what is found is
    turned into items, which are the spans, and the spans are allocated under the page's caps. A unit without any match whose
    style is delta takes the lines most like it instead. In ``focus`` phrases must be longer and caps are lower. Each unit is one row; null texts are never found; annotations on pages
    without items are dropped as unmatched.
    """
    valid = annotations.is_valid(F.col("priority"), F.col("directive"), F.col("confidence"))
    style = F.when(F.col("directive") == "highlight", "delta").when(F.col("directive") == "soft_fade", "familiar")
    units = rows.select("unit", *PAGE, "source", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "directive", valid.alias("validated"), F.when(valid, style).alias("style"), match_form(F.coalesce("text", F.lit(""))).alias("part"))
    ranges = diagnostics.match_ranges(items.filter("str is not null"))
    inline = units.filter("style is not null and part <> ''").select("unit", *PAGE, "style", "confidence", "part")
    found = inline.join(diagnostics.match_text(ranges), PAGE).select("unit", *PAGE, "style", "confidence", "part", F.explode(matching.phrase_matches(F.col("whole"), F.col("part"))).alias("m"))
    needed = matching.words_needed(F.col("confidence"), F.col("style"), focus)
    exact = (F.col("m.end") - F.col("m.start")) == F.char_length("part")
    matches = found.select("unit", *PAGE, "style", "confidence", "m.start", "m.end", (exact | (F.col("m.words") >= needed)).alias("safe"), exact.alias("exact"))
    per_unit = matches.groupBy("unit").agg(F.count(F.lit(1)).alias("n_matches"), F.count_if("safe").alias("n_safe"), F.sum(F.col("end") - F.col("start")).alias("matched"), F.count_if(~F.col("exact")).alias("n_phrases"))
    touched = diagnostics.items_of_matches(matches.filter("safe"), ranges).select("unit", *PAGE, "item_no").distinct()
    missed = inline.join(per_unit, "unit", "left_anti").filter("style = 'delta'").select(*PAGE, "unit", F.col("part").alias("form"))
    lines = matching.like_lines(missed, ranges.select(*PAGE, "item_no", "form")).select("unit", *PAGE, "item_no")
    spans = touched.withColumn("repaired", F.lit(False)).unionByName(lines.withColumn("repaired", F.lit(True)))
    held = spans.groupBy("unit", *PAGE).agg(F.sort_array(F.collect_list("item_no")).alias("spans"), F.max("repaired").alias("repaired"))
    asked = held.join(inline.select("unit", "style", "confidence"), "unit").select(
        *PAGE, F.col("unit").cast("string").alias("unit"), "style", F.when(F.col("repaired"), F.col("confidence") * FALLBACK_SHARE).otherwise(F.col("confidence")).alias("confidence"), F.col("unit").alias("ordinal"), "spans")
    counts = ranges.groupBy(*PAGE).agg(F.count(F.lit(1)).cast("int").alias("n_spans"))
    given = allocation.allocate(asked, counts, allocation.FOCUS_STYLES if focus else allocation.STYLES).groupBy(F.col("unit").cast(units.schema["unit"].dataType).alias("unit")).agg(F.max(F.size("spans")).alias("n_spans"), F.min("result").alias("result"))
    joined = units.join(per_unit, "unit", "left").join(held.select("unit", "repaired"), "unit", "left").join(given, "unit", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(zero("matched").cast("double"), F.char_length("part")), F.lit(0.0)))
    facts = joined.select(
        "unit", *PAGE, "source", "directive", "validated", F.col("style").isNotNull().alias("attempted"), (zero("n_matches") > 0).alias("candidate"),
        ((zero("n_safe") > 0) & (share >= 0.5)).alias("usable"), (zero("n_phrases") > 0).alias("by_phrase"), F.coalesce("repaired", F.lit(False)).alias("repaired"),
        share.alias("share"), zero("n_spans").alias("n_spans"), "result",
    )
    shown = F.col("n_spans") > 0
    state = (
        F.when(F.col("validated") & (F.col("directive") == "callout"), "rendered_as_page_note").when(F.col("validated") & (F.col("directive") == "leave_normal"), "left_normal")
        .when(F.col("attempted") & shown & F.col("usable"), "rendered_inline").when(F.col("attempted") & shown, "inline_fallback_without_usable_match").otherwise("dropped")
    )
    reason = F.when(F.col("state") == "dropped", F.when(~F.col("validated"), "invalid").when(F.col("result").isNotNull(), F.col("result")).otherwise("unmatched_text"))
    return facts.withColumn("state", state).withColumn("reason", reason).drop("result")


#: The counts of a page's annotations, by name, as SQL; the maps of drop reasons and sources come beside them.
COUNTS = {
    "generated": "true", "validated": "validated", "invalid": "not validated", "attempted": "attempted", "candidates": "candidate", "usable": "usable", "unmatched": "attempted and not candidate",
    "by_phrase": "by_phrase", "repaired": "repaired", "with_spans": "n_spans > 0", "intended_inline": "validated and directive in ('highlight', 'soft_fade')", "dropped_invalid": "reason = 'invalid'",
    "dropped_unmatched": "reason = 'unmatched_text'", "dropped_by_cap": "reason = 'density_cap'", "dropped_by_overlap": "reason = 'overlap_conflict'",
} | {s: f"state = '{s}'" for s in STATES}


def lifecycle_counts(rows: DataFrame, *by: str) -> DataFrame:
    """The 20 counts of each group and its maps of drop reasons and of sources; maps are counted before they are gathered."""
    counts = rows.groupBy(*by).agg(*[F.count_if(F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in COUNTS.items()])
    for column, name in (("reason", "drop_reasons"), ("source", "by_source")):
        counts = counts.join(evaluation.count_map(rows, column, *by).withColumnRenamed("counts", name), list(by), "left")
    return counts


#: The checks of a page's counts and of each annotation, by name: what must hold, as SQL.
PAGE_CHECKS = {
    "states_add_up": "generated = rendered_inline + inline_fallback_without_usable_match + rendered_as_page_note + left_normal + dropped",
    "candidates_were_attempted": "candidates <= attempted", "usable_were_candidates": "usable <= candidates", "inline_were_usable": "rendered_inline <= usable",
}
ROW_CHECKS = {
    "dropped_has_reason": "state <> 'dropped' or reason is not null", "shown_has_no_reason": "state = 'dropped' or reason is null", "inline_is_usable": "state <> 'rendered_inline' or usable",
    "inline_has_spans": "state not in ('rendered_inline', 'inline_fallback_without_usable_match') or n_spans > 0", "note_is_not_searched": "state not in ('rendered_as_page_note', 'left_normal') or not attempted",
    "fallback_is_not_usable": "state <> 'inline_fallback_without_usable_match' or not usable",
}


def _columns(checks: dict[str, str]) -> dict[str, Column]:
    return {name: F.expr(sql) for name, sql in checks.items()}


def broken(rows: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """One row per check that does not hold, of a page (unit null) or of an annotation."""
    pages = diagnostics.broken_invariants(counts, _columns(PAGE_CHECKS)).select(*by, F.lit(None).cast(rows.schema["unit"].dataType).alias("unit"), "check")
    return pages.unionByName(diagnostics.broken_invariants(rows, _columns(ROW_CHECKS)).select(*by, "unit", "check"))


def checked_claims(claims: DataFrame, text: str, claimed: dict[str, Column]) -> DataFrame:
    """Rows whose delivered claims do not agree with their own text: one row per claim."""
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in claimed.items()]))
    return claims.filter(F.col(text).isNotNull()).withColumn("check", F.explode(failed))
