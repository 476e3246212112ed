"""Quality of labels and of a model's annotations: issues as one table, and annotations that stand."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import annotations, segments

# What optional fields of a label may hold.
LABEL_TYPES = ("standard", "trap", "control")
DIFFICULTIES = ("easy", "medium", "hard", "adversarial")
STATUSES = ("draft", "reviewed", "approved", "rejected")
#: Fixed value: the longest text of an annotation shown in the text, in characters.
INLINE_LIMIT = 500


def label_issues(labels: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Every issue of every label once: (label_key, keys, issue).

    Repeated and unknown sentences; of known ones, sentences that are no body text without leave, unknown priorities and directives,
    missing reasons, and optional fields with a value that is none of the known ones. Counts and joins only: no group is gathered.
    """
    given = labels.join(candidates.select(*keys), keys, "left_semi")
    other = lambda column, values: ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    known = lambda column, values: F.col(column).isNotNull() & other(column, values)
    own = {
        "bad_priority": other("expected_priority", [p for p, *_ in annotations.PRIORITIES]), "bad_directive": other("expected_directive", sorted(set(annotations.DIRECTIVES.values()))),
        "empty_reason": annotations.blank(F.col("reason")),
        "bad_label_type": known("label_type", LABEL_TYPES), "bad_difficulty": known("difficulty", DIFFICULTIES), "bad_review_status": known("review_status", STATUSES),
    }
    in_row = given.select("label_key", *keys, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in own.items()]))).alias("issue"))
    mark = lambda df, issue: df.select("label_key", *keys, F.lit(issue).alias("issue"))
    often = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    body = candidates.filter("candidate_kind = 'body_sentence'")
    parts = [
        in_row, mark(labels.join(often, keys, "left_semi"), "repeated"), mark(labels.join(candidates.select(*keys), keys, "left_anti"), "unknown_sentence"),
        mark(given.filter("not coalesce(allow_non_body, false)").join(body.select(*keys), keys, "left_anti"), "not_body"),
    ]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def standing_annotations(raw: DataFrame, candidates: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """A model's annotations that stand: raw (keys, priority and directive as written, reason, ...), candidates with text and ranges.

    The first of each sentence counts, whatever is wrong with it; its sentence must be known and lie on items, priority and
    directive must be known, and a text shown inline must not be too long. Confidence is the priority's.
    """
    first = annotations.parsed(annotations.first_of_each(raw, keys, *order), "expected_priority", "expected_directive")
    known = first.join(candidates.select(*keys, "candidate_kind", F.col("text").alias("unit_text"), "item_ranges_present"), keys)
    inline = F.col("directive").isin("highlight", "soft_fade")
    kept = known.filter("item_ranges_present and priority is not null and directive is not null").filter(~inline | (F.char_length("unit_text") <= INLINE_LIMIT))
    return kept.select(
        F.concat(F.lit("ca-"), "sentence_id").alias("annotation_id"), *keys, "priority", "directive", annotations.confidence_of(F.col("priority")).alias("confidence"),
        annotations.label_of(F.col("priority")).alias("label"), F.coalesce("reason", F.lit("")).alias("reason"), F.col("unit_text").alias("text"),
    )


def gold_template(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The sheet to fill in: each body sentence once, the last export first, with blank fields."""
    blank = F.lit("")
    once = segments.latest(candidates.filter("candidate_kind = 'body_sentence'"), keys, F.col("exported_at").desc_nulls_last(), F.col("candidate_key").desc())
    return once.select(*keys, "text", *[blank.alias(c) for c in ("expected_priority", "expected_directive", "reason")])
