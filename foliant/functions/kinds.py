"""Structural kinds of sentences: rules in strict order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.measure import utf16_length
from foliant.functions.text import WS, trim, words

# The kinds, and labels that are headings by themselves.
KINDS = ("body_sentence", "heading", "metadata", "reference", "formula_or_table", "short_fragment", "unknown")
HEADING_LABELS = (
    "abstract", "introduction", "transactions", "timestamp server", "proof-of-work", "network", "incentive", "reclaiming disk space",
    "simplified payment verification", "combining and splitting value", "privacy", "calculations", "conclusion",
)
# Signs of formulas and tables.
MATH_SIGNS = "=+−×÷∑√<>|{}"


def begins_references(text: Column) -> Column:
    low = F.lower(text)
    return low.isin("references", "references.") | low.startswith("references [") | low.startswith("references 1.")


def is_reference_entry(text: Column) -> Column:
    return text.rlike(r"^\[[0-9]+\]") | (text.rlike(f"^[0-9]+\\.[{WS}]") & text.rlike('["“”]'))


def is_heading(text: Column) -> Column:
    label = F.lower(F.regexp_replace(text, "[.:]+$", ""))
    numbered = text.rlike(f"(?s)^[0-9]+(\\.[0-9]+)*\\.+([{WS}].*)?$") & (utf16_length(text) <= 100)
    return label.isin(*HEADING_LABELS) | numbered


def is_short_heading(text: Column) -> Column:
    """At most 100 characters and 12 words, not closed by a full stop, exclamation or question mark."""
    n_words = F.size(words(F.trim(F.regexp_replace(text, f"[{WS}]+", " "))))
    return (F.char_length(text) <= 100) & (n_words <= 12) & ~trim(text).rlike("[.!?]$")


def is_front_matter(text: Column, page: Column, start: Column) -> Column:
    """An address or a title-like line near the top of the first page."""
    address = F.contains(text, F.lit("@")) | F.lower(text).rlike(r"https?://|www\.")
    spoken = F.filter(words(F.trim(F.regexp_replace(text, f"[{WS}]+", " "))), lambda w: w.rlike(r"\p{IsAlphabetic}"))
    titled = F.filter(spoken, lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}]+", "").rlike(r"^\p{IsUppercase}"))
    title_like = F.size(spoken).between(2, 14) & ~text.rlike("[.!?]$") & (F.size(titled) * 5 >= F.size(spoken) * 3)
    return (page == 1) & (start <= 500) & (address | title_like)


def is_formula_or_table(text: Column) -> Column:
    table = F.lower(text).rlike("^table[ :]")
    total = F.char_length(F.regexp_replace(text, f"[{WS}]+", ""))
    signs = F.regexp_count(text, F.lit("[=+−×÷∑√<>|{}]"))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    return table | ((total > 0) & (signs >= 2) & ((signs + digits) * 4 >= total))


def kind(text: Column, page: Column, start: Column, in_references: Column) -> Column:
    """The kind of a trimmed sentence; ``in_references`` says whether a reference section began at or before it."""
    low = F.lower(text)
    return (
        F.when(begins_references(text), F.when(low.isin("references", "references."), "heading").otherwise("reference"))
        .when(in_references | is_reference_entry(text), "reference")
        .when(is_heading(text), "heading")
        .when(is_front_matter(text, page, start), "metadata")
        .when(text == "", "unknown")
        .when(is_formula_or_table(text), "formula_or_table")
        .when(utf16_length(text) < 30, "short_fragment")
        .otherwise("body_sentence")
    )
