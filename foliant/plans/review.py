"""Queries on labels, model output and what becomes of annotations, and pipelines of several operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import annotations, concepts, evaluation, labelqa, lifecycle, pages, segments
from foliant.plans import corpus
from foliant.plans import sql as S
from foliant.plans.corpus import PAGE, SENT
from foliant.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# labels and model output

_KNOWN = "EXISTS (SELECT 1 FROM candidate_exports c WHERE c.document_id = l.document_id AND c.sentence_id = l.sentence_id)"
_BODY = "EXISTS (SELECT 1 FROM candidate_exports c WHERE c.document_id = l.document_id AND c.sentence_id = l.sentence_id AND candidate_kind = 'body_sentence')"
_CHECKS = {
    "bad_priority": "NOT coalesce(expected_priority IN ('delta', 'bridge', 'familiar'), false)", "bad_directive": "NOT coalesce(expected_directive IN ('highlight', 'callout', 'soft_fade', 'leave_normal'), false)",
    "empty_reason": f"coalesce({S.trim('reason')} = '', true)", "bad_label_type": f"label_type IS NOT NULL AND NOT list_contains({S.strings(labelqa.LABEL_TYPES)}, label_type)",
    "bad_difficulty": f"difficulty IS NOT NULL AND NOT list_contains({S.strings(labelqa.DIFFICULTIES)}, difficulty)", "bad_review_status": f"review_status IS NOT NULL AND NOT list_contains({S.strings(labelqa.STATUSES)}, review_status)",
    "not_body": f"NOT coalesce(allow_non_body, false) AND NOT {_BODY}",
}


@query(f"""SELECT DISTINCT * FROM (
  {' UNION ALL '.join(f"SELECT label_key, document_id, sentence_id, '{name}' AS issue FROM manual_labels l WHERE ({check}) AND {_KNOWN}" for name, check in _CHECKS.items())}
  UNION ALL SELECT label_key, document_id, sentence_id, 'unknown_sentence' FROM manual_labels l WHERE NOT {_KNOWN}
  UNION ALL SELECT label_key, document_id, sentence_id, 'repeated' FROM manual_labels l WHERE (SELECT count(*) FROM manual_labels o WHERE o.document_id = l.document_id AND o.sentence_id = l.sentence_id) > 1)""")
def label_issues(s, d):
    return labelqa.label_issues(table(s, d, "manual_labels"), table(s, d, "candidate_exports"), SENT)


@query("SELECT label_key FROM manual_labels l WHERE NOT EXISTS (SELECT 1 FROM candidate_exports c WHERE c.document_id = l.document_id AND c.sentence_id = l.sentence_id AND c.candidate_kind = 'body_sentence')")
def labels_off_body(s, d):
    """Labels of sentences that are no body text."""
    body = table(s, d, "candidate_exports").filter("candidate_kind = 'body_sentence'")
    return evaluation.unknown(table(s, d, "manual_labels"), body, SENT).select("label_key")


@query("SELECT document_id, sentence_id, count(*) AS n FROM candidate_exports GROUP BY ALL HAVING count(*) > 1")
def repeated_exports(s, d):
    return evaluation.repeated(table(s, d, "candidate_exports"), SENT)


def _case(pairs) -> str:
    return "CASE priority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + " END"


@query(f"""WITH f AS (SELECT *, {corpus._PRIORITY_SQL} AS priority, {corpus._DIRECTIVE_SQL} AS directive FROM {corpus._FIRST_LABEL})
  SELECT 'ca-' || sentence_id AS annotation_id, document_id, sentence_id, priority, directive, CAST({_case((p, c) for p, _, c, _ in annotations.PRIORITIES)} AS DOUBLE) AS confidence,
    {_case((p, f"'{n}'") for p, _, _, n in annotations.PRIORITIES)} AS label, coalesce(f.reason, '') AS reason, c.text AS text
  FROM f JOIN {corpus._LAST_EXPORT} c USING (document_id, sentence_id) WHERE item_ranges_present AND priority IS NOT NULL AND directive IS NOT NULL AND (directive NOT IN ('highlight', 'soft_fade') OR length(c.text) <= {labelqa.INLINE_LIMIT})""")
def standing_annotations(s, d):
    return labelqa.standing_annotations(table(s, d, "manual_labels"), corpus._last_exports(s, d), SENT, F.col("labelled_at").asc_nulls_first(), "label_key")


@query("""SELECT document_id, sentence_id, text, '' AS expected_priority, '' AS expected_directive, '' AS reason
  FROM (SELECT * FROM candidate_exports WHERE candidate_kind = 'body_sentence' QUALIFY row_number() OVER (PARTITION BY document_id, sentence_id ORDER BY exported_at DESC NULLS LAST, candidate_key DESC) = 1)""")
def gold_template(s, d):
    return labelqa.gold_template(table(s, d, "candidate_exports"), SENT)


_RATIOS = {
    "delta_precision": ("expected = 'delta' AND predicted = 'delta'", "predicted = 'delta'"), "delta_recall": ("expected = 'delta' AND predicted = 'delta'", "expected = 'delta'"),
    "bridge_precision": ("expected = 'bridge' AND predicted = 'bridge'", "predicted = 'bridge'"), "bridge_recall": ("expected = 'bridge' AND predicted = 'bridge'", "expected = 'bridge'"),
    "familiar_suppression_rate": ("expected = 'familiar' AND directive IN ('soft_fade', 'leave_normal')", "expected = 'familiar'"), "known_as_delta_rate": ("expected = 'familiar' AND predicted = 'delta'", "expected = 'familiar'"),
    "familiar_highlight_rate": ("expected = 'familiar' AND directive = 'highlight'", "expected = 'familiar'"), "over_annotation_rate": ("expected = 'familiar' AND directive NOT IN ('soft_fade', 'leave_normal')", "true"),
}
_DENSITIES = {"visible_per_page": "directive <> 'leave_normal'", "highlight_per_page": "directive = 'highlight'", "callout_per_page": "directive = 'callout'", "soft_fade_per_page": "directive = 'soft_fade'"}


@query(f"""WITH r AS (
  {' UNION ALL '.join(f"SELECT fixture, '{m}' AS metric, count(*) FILTER ({a}) AS numerator, count(*) FILTER ({b}) AS denominator FROM {corpus._PAIRS} GROUP BY fixture" for m, (a, b) in _RATIOS.items())}
  UNION ALL {' UNION ALL '.join(f"SELECT p.fixture, '{m}', count(*) FILTER ({c}), greatest(coalesce(max(n), 0), 1) FROM {corpus._PREDICTED} p LEFT JOIN (SELECT fixture, count(DISTINCT page) AS n FROM candidate_exports GROUP BY 1) g ON g.fixture = p.fixture GROUP BY p.fixture" for m, c in _DENSITIES.items())}
  UNION ALL SELECT p.fixture, 'gold_coverage', coalesce(max(n), 0), count(*) FROM {corpus._PREDICTED} p LEFT JOIN (SELECT fixture, count(*) AS n FROM {corpus._PAIRS} GROUP BY 1) g ON g.fixture = p.fixture GROUP BY p.fixture)
  SELECT *, CAST(numerator AS DOUBLE) / nullif(denominator, 0) AS "value" FROM r""")
def eval_ratios(s, d):
    pairs, predicted = corpus._pairs(s, d)
    n_pages = table(s, d, "candidate_exports").groupBy("fixture").agg(F.countDistinct("page").alias("n_pages"))
    return evaluation.ratios(pairs, predicted, n_pages, ["fixture"])


@query(f"""WITH l AS (SELECT document_id, sentence_id, {corpus._DIRECTIVE_SQL} AS wanted FROM {corpus._FIRST_LABEL})
  SELECT document_id, sentence_id, expected, predicted, wanted AS expected_directive, directive AS predicted_directive FROM {corpus._PAIRS} JOIN l USING (document_id, sentence_id)
  WHERE expected <> predicted OR wanted IS DISTINCT FROM directive""")
def label_mismatches(s, d):
    """Labelled sentences whose prediction differs in priority or directive."""
    pairs, _ = corpus._pairs(s, d)
    wanted = annotations.parsed(corpus._first_labels(s, d), "expected_priority", "expected_directive").select(*SENT, F.col("directive").alias("expected_directive"))
    rows = pairs.join(wanted, SENT).withColumnRenamed("directive", "predicted_directive")
    return rows.filter("expected <> predicted or not (expected_directive <=> predicted_directive)").select(*SENT, "expected", "predicted", "expected_directive", "predicted_directive")


# what becomes of annotations


def _annotations(s, d) -> DataFrame:
    """First labels on last exports, with a confidence by priority; unparsed ones stay, as invalid."""
    labels = annotations.parsed(corpus._first_labels(s, d), "expected_priority", "expected_directive")
    units = corpus._last_exports(s, d).select("candidate_key", *SENT, "page", "text")
    rows = units.join(labels.select(*SENT, "priority", "directive", F.col("annotator").alias("source")), SENT)
    return rows.select(F.col("candidate_key").alias("unit"), *PAGE, "text", "priority", "directive", annotations.confidence_of(F.col("priority")).alias("confidence"), "source")


@query()
def annotation_states(s, d):
    """The final state of every labelled candidate on its page, with what led to it."""
    return lifecycle.page_lifecycle(_annotations(s, d), corpus._items(s, d))


@query()
def lifecycle_counts(s, d):
    """Counts of states, matches and drop reasons of each page."""
    rows = lifecycle.lifecycle_counts(lifecycle.page_lifecycle(_annotations(s, d), corpus._items(s, d)), *PAGE)
    as_text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias(c)
    return rows.select(*[c for c in rows.columns if c not in ("drop_reasons", "by_source")], as_text("drop_reasons"), as_text("by_source"))


@query()
def lifecycle_violations(s, d):
    """Checks that do not hold; none should be broken."""
    rows = lifecycle.page_lifecycle(_annotations(s, d), corpus._items(s, d))
    return lifecycle.broken(rows, lifecycle.lifecycle_counts(rows, *PAGE), *PAGE)


_CLAIMS = {
    "length": "length IS DISTINCT FROM length(text)", "normalized": "normalized_text IS NULL", "ranges": "NOT coalesce(item_ranges_present, false)",
    "very_short": "coalesce(list_contains(tags, 'very_short'), false) <> (length(text) < 30)", "numeric": "coalesce(list_contains(tags, 'contains_numeric_result'), false) <> regexp_matches(text, '[0-9]')",
}


@query(f"""SELECT candidate_key, "check" FROM (SELECT candidate_key, unnest([{', '.join(f"CASE WHEN {c.replace('length IS', 'e.length IS')} THEN '{n}' END" for n, c in _CLAIMS.items())}]) AS "check" FROM candidate_exports e WHERE text IS NOT NULL) WHERE "check" IS NOT NULL""")
def broken_claims(s, d):
    """Exports whose length, tags, ranges or normal form do not agree with their text."""
    tagged = lambda tag: F.coalesce(F.array_contains("tags", tag), F.lit(False))
    n = F.char_length("text")
    claims = {
        "length": ~F.col("length").eqNullSafe(n), "normalized": F.col("normalized_text").isNull(), "ranges": ~F.coalesce("item_ranges_present", F.lit(False)),
        "very_short": tagged("very_short") != (n < 30), "numeric": tagged("contains_numeric_result") != F.col("text").rlike("[0-9]"),
    }
    return lifecycle.checked_claims(table(s, d, "candidate_exports"), "text", claims).select("candidate_key", "check")


# pipelines

_CHUNKS = f"({corpus.ORACLE_SQL['paragraph_chunks']})"


@query(f"SELECT * FROM {S.sentences(_CHUNKS, 'text', 'doc_id, chunk_no', closers=False, unit=S.chars)}")
def chunk_sentences(s, d):
    """Texts packed into chunks, and these divided into sentences."""
    packed = segments.chunks(table(s, d, "documents"), "text", "doc_id")
    return segments.sentences(packed, "text", "doc_id", "chunk_no", closers=False, unit=F.char_length)


_FOLDED_SENT = S.sentences(corpus._FOLDED, "normalized_text", "document_id, page")


@query(f"SELECT * FROM {corpus._KINDED.replace(corpus._SENT, _FOLDED_SENT)}")
def folded_unit_kinds(s, d):
    """Items folded into pages, pages divided into sentences, and these given kinds."""
    folded = pages.page_texts(pages.placed_items(corpus._items(s, d)))
    return pages.with_kinds(segments.sentences(folded, "normalized_text", *PAGE))


#: Chunks of a document that the keyword scan reads.
SCANNED = 8
_SCANNED = "(SELECT document_id, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, chunk_key) AS n FROM text_chunks WHERE text IS NOT NULL) WHERE n <= 8)"
_SCANNED_WORDS = corpus._KEYWORDS.replace("doc_id", "document_id").replace("FROM documents", f"FROM {_SCANNED}")


@query(f"SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY n DESC, word) AS INTEGER) AS rank, word, n FROM {_SCANNED_WORDS} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, word) <= 12")
def scanned_keywords(s, d):
    """Keywords of the first chunks of each document."""
    first = segments.first_per(table(s, d, "text_chunks").filter("text is not null").select("document_id", "page", "chunk_key", "text"), SCANNED, ["document_id"], "page", "chunk_key")
    return concepts.top_keywords(first.select("document_id", "text"), "text", "document_id").select("document_id", "rank", "word", "n")


@query("SELECT document_id, count(*) AS n, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, round(avg(length(text)), 1) AS mean_chars FROM candidate_exports WHERE text IS NOT NULL GROUP BY 1")
def length_extremes(s, d):
    n = F.char_length("text")
    return table(s, d, "candidate_exports").filter("text is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 1).alias("mean_chars"))


# SQL of queries whose plans are elsewhere

_SPANS = f"(SELECT document_id, page, item_no, row_number() OVER (PARTITION BY document_id, page ORDER BY item_no) - 1 AS span FROM {S.ITEMS} WHERE length(str) > 0)"
_OVERLAPS = f"({corpus.ORACLE_SQL['item_overlaps']})"
ORACLE_SQL["item_range_status"] = f"""WITH i AS (SELECT document_id, page, item_no, {S.u16("coalesce(normalized_str, '')")} AS length FROM {S.ITEMS}),
  r AS (SELECT o.document_id, o.page, o.item_no AS range_no, 'p' || o.page || 'i' || o.item_no AS item_id, o.item_start, o.item_end, i.length, s.span FROM {_OVERLAPS} o
    LEFT JOIN i ON i.document_id = o.document_id AND i.page = o.page AND i.item_no = o.item_no LEFT JOIN {_SPANS} s ON s.document_id = o.document_id AND s.page = o.page AND s.item_no = o.item_no),
  t AS (SELECT *, CASE WHEN length IS NULL THEN 'invalid_item' WHEN span IS NULL THEN 'missing_span' WHEN item_start < 0 OR item_end <= item_start OR item_end > length THEN 'invalid_item' ELSE 'fragment' END AS status FROM r)
  SELECT document_id, page, range_no, item_id, status, CASE WHEN status = 'fragment' THEN CAST(span AS INTEGER) END AS span, CASE WHEN status = 'fragment' THEN item_start = 0 AND item_end = length END AS full_item FROM t"""
ORACLE_SQL["density_allocation"] = f"""WITH RECURSIVE sp AS (SELECT * FROM {_SPANS}), n AS (SELECT document_id, page, count(*) AS n_spans FROM sp GROUP BY ALL),
  held AS (SELECT o.document_id, o.page, o.sent_no, list_sort(list(DISTINCT s.span)) AS spans FROM {_OVERLAPS} o JOIN sp s ON s.document_id = o.document_id AND s.page = o.page AND s.item_no = o.item_no GROUP BY ALL),
  c AS (SELECT h.*, CASE WHEN sent_no % 3 = 0 THEN 'familiar' ELSE 'delta' END AS style, greatest(1, CAST(floor(n_spans * CASE WHEN sent_no % 3 = 0 THEN 0.34 ELSE 0.18 END) AS INTEGER)) AS cap FROM held h JOIN n USING (document_id, page)),
  k AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY CASE style WHEN 'delta' THEN 0 ELSE 1 END, sent_no) AS i FROM c),
  step AS (
    SELECT document_id, page, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS sent_no, '' AS style, 0 AS used, CAST([] AS BIGINT[]) AS taken, '' AS result, CAST([] AS BIGINT[]) AS own FROM n
    UNION ALL
    SELECT document_id, page, i, sent_no, style, used + CASE WHEN result = 'allocated' THEN len(free) ELSE 0 END, CASE WHEN result = 'allocated' THEN list_concat(taken, free) ELSE taken END, result, CASE WHEN result = 'allocated' THEN free ELSE [] END FROM (
      SELECT *, CASE WHEN used >= cap THEN 'density_cap' WHEN len(free) = 0 THEN 'overlap_conflict' WHEN used + len(free) > cap THEN 'density_cap' ELSE 'allocated' END AS result FROM (
        SELECT k.document_id, k.page, k.i, k.sent_no, k.style, k.cap, CASE WHEN k.style = s.style THEN s.used ELSE 0 END AS used, s.taken, list_filter(k.spans, lambda x: NOT list_contains(s.taken, x)) AS free
        FROM step s JOIN k ON k.document_id = s.document_id AND k.page = s.page AND k.i = s.i + 1)))
  SELECT document_id, page, CAST(sent_no AS VARCHAR) AS unit, style, result, array_to_string(own, ',') AS spans FROM step WHERE i > 0"""
