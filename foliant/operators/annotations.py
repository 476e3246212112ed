"""Annotations as delivered: parsing, first or last of repeats, joins to what they annotate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.measure import clamp_unit
from foliant.functions.text import enum_token, trim

# Priorities with their directive, confidence and label; and spellings of directives.
PRIORITIES = (("delta", "highlight", 0.74, "New insight"), ("bridge", "callout", 0.55, "Bridge context"), ("familiar", "soft_fade", 0.68, "Likely familiar"))
DIRECTIVES = {
    "highlight": "highlight", "callout": "callout", "soft_fade": "soft_fade", "softfade": "soft_fade", "fade": "soft_fade",
    "leave_normal": "leave_normal", "leavenormal": "leave_normal", "normal": "leave_normal",
}


def _lookup(key: Column, table: dict[str, object]) -> Column:
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out


def priority(value: Column) -> Column:
    token = enum_token(value)
    return F.when(token.isin([p for p, *_ in PRIORITIES]), token)


def directive(value: Column) -> Column:
    return _lookup(enum_token(value), DIRECTIVES)


def directive_of(priority_name: Column) -> Column:
    return _lookup(priority_name, {p: d for p, d, _, _ in PRIORITIES})


def confidence_of(priority_name: Column) -> Column:
    return _lookup(priority_name, {p: c for p, _, c, _ in PRIORITIES})


def label_of(priority_name: Column) -> Column:
    return _lookup(priority_name, {p: n for p, _, _, n in PRIORITIES})


def first_of_each(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key, before any check: a bad first row keeps later good ones out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_of_each(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key wins; pass the order reversed."""
    return first_of_each(rows, keys, *order)


def with_fallback(units: DataFrame, annotations: DataFrame, keys: list[str], **defaults: object) -> DataFrame:
    """Every unit with its annotation, or with the defaults where it has none; ``generated`` tells which."""
    joined = units.join(annotations.withColumn("generated", F.lit(True)), keys, "left")
    return joined.withColumns({"generated": F.coalesce("generated", F.lit(False)), **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}})


def parsed(rows: DataFrame, priority_column: str, directive_column: str) -> DataFrame:
    """Rows with parsed priority and directive, null where unknown."""
    return rows.withColumns({"priority": priority(F.col(priority_column)), "directive": directive(F.col(directive_column))})


def with_confidence(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, clamp_unit(F.col(column)))


def anchors(requests: DataFrame, sentences: DataFrame) -> DataFrame:
    """requests (chunk_key, anchor_no, sent_nos array<int>) joined with sentences (chunk_key, sent_no, text, start, end).

    Kept are anchors of one to three sentences that all exist and follow each other, joined text of
    30 to 500 characters, or shorter if it is a heading.
    """
    from foliant.functions.kinds import is_short_heading

    asked = requests.filter(F.size("sent_nos").between(1, 3)).select("chunk_key", "anchor_no", F.size("sent_nos").alias("n"), F.posexplode("sent_nos").alias("at", "sent_no"))
    joined = asked.join(sentences.select("chunk_key", "sent_no", "text", "start", "end"), ["chunk_key", "sent_no"])
    parts = F.sort_array(F.collect_list(F.struct("at", "sent_no", "text", "start", "end")))
    grouped = joined.groupBy("chunk_key", "anchor_no").agg(F.max("n").alias("n"), parts.alias("parts"))
    row = F.col("parts")
    follows = F.forall(F.sequence(F.lit(1), F.size(row)), lambda i: F.element_at(row, i)["sent_no"] == F.element_at(row, 1)["sent_no"] + i - 1)
    text = F.array_join(F.transform(row, lambda p: p["text"]), " ")
    kept = grouped.filter((F.size(row) == F.col("n")) & follows).select(
        "chunk_key", "anchor_no", F.element_at(row, 1)["sent_no"].alias("first_sent"), F.element_at(row, -1)["sent_no"].alias("last_sent"), text.alias("text"),
        F.element_at(row, 1)["start"].alias("start"), F.element_at(row, -1)["end"].alias("end"),
    )
    n = F.char_length("text")
    return kept.filter((n <= 500) & ((n >= 30) | is_short_heading(F.col("text"))))


def best_kind(*unit_kinds: DataFrame) -> DataFrame:
    """For each document the units of the first kind it has any of; columns of all must agree."""
    union = None
    for rank, rows in enumerate(unit_kinds):
        rows = rows.withColumn("_rank", F.lit(rank))
        union = rows if union is None else union.unionByName(rows)
    top = F.min("_rank").over(Window.partitionBy("document_id"))
    return union.withColumn("_top", top).filter("_rank = _top").drop("_rank", "_top")


def export_tags(text: Column, multi: Column) -> Column:
    """very_short (under 30 characters), contains_numeric_result (an ASCII digit), multi_item_range."""
    return F.array_compact(F.array(
        F.when(F.char_length(text) < 30, F.lit("very_short")), F.when(text.rlike("[0-9]"), F.lit("contains_numeric_result")), F.when(multi, F.lit("multi_item_range")),
    ))


def blank(value: Column) -> Column:
    return F.coalesce(trim(value) == "", F.lit(True))


def is_valid(priority_name: Column, directive_name: Column, confidence: Column) -> Column:
    """Known priority and directive, and a confidence that is a number from 0 to 1."""
    known = priority_name.isin([p for p, *_ in PRIORITIES]) & directive_name.isin(list(set(DIRECTIVES.values())))
    return F.coalesce(known & ~F.isnan(confidence) & confidence.between(0.0, 1.0), F.lit(False))


def is_plain_name(name: Column) -> Column:
    """Letters, digits, hyphens, underscores and dots, no dot in front."""
    return F.coalesce(name.rlike("^[A-Za-z0-9_-][A-Za-z0-9_.-]*$"), F.lit(False))
