"""Queries over the corpus tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import kinds, measure, text
from foliant.operators import allocation, annotations, concepts, diagnostics, evaluation, matching, pages, segments, store
from foliant.plans import sql as S
from foliant.sources import files
from foliant.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = ["document_id", "page"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def _items(s: SparkSession, d: str) -> DataFrame:
    return pages.delivered_items(table(s, d, "text_items"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return pages.delivered_pages(table(s, d, "text_pages"))


def _units(s: SparkSession, d: str) -> DataFrame:
    whole = pages.delivered_pages(table(s, d, "text_pages"), whole_documents=True)
    return pages.with_kinds(segments.sentences(whole, "normalized_text", *PAGE))


_SENT = S.sentences(S.PAGES, "normalized_text", "document_id, page")


# sentences and chunks


@query(f"SELECT * FROM {S.sentences('documents', 'text', 'doc_id')}")
def sentence_split(s, d):
    return segments.sentences(table(s, d, "documents"), "text", "doc_id")


@query(f"SELECT chunk_key, sent_no, text, start AS char_start, \"end\" AS char_end FROM {S.sentences('text_chunks', 'text', 'chunk_key', closers=False, unit=S.chars)}")
def legacy_sentence_offsets(s, d):
    rows = segments.sentences(table(s, d, "text_chunks"), "text", "chunk_key", closers=False, unit=F.char_length)
    return rows.select("chunk_key", "sent_no", "text", F.col("start").alias("char_start"), F.col("end").alias("char_end"))


@query(f"""
  WITH RECURSIVE para AS (
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {S.trim('p')}), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL),
  step(doc_id, ps, i, now, done) AS (
    SELECT doc_id, ps, 0, '', CAST(NULL AS VARCHAR) FROM para
    UNION ALL
    SELECT doc_id, ps, i + 1,
      CASE WHEN i = len(ps) THEN '' WHEN strlen(now) + strlen(ps[i + 1]) > 1500 AND now <> '' THEN ps[i + 1] || chr(10) || chr(10) ELSE now || ps[i + 1] || chr(10) || chr(10) END,
      CASE WHEN i = len(ps) THEN nullif({S.trim('now')}, '') WHEN strlen(now) + strlen(ps[i + 1]) > 1500 AND now <> '' THEN {S.trim('now')} END
    FROM step WHERE i <= len(ps))
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk_no, done AS text FROM step WHERE done IS NOT NULL""")
def paragraph_chunks(s, d):
    return segments.chunks(table(s, d, "documents"), "text", "doc_id")


@query(f"SELECT doc_id, chunk_no, substring(text, 1, 1200) AS text FROM (SELECT doc_id, 1 AS chunk_no, text FROM documents WHERE text IS NOT NULL)")
def compact_texts(s, d):
    rows = table(s, d, "documents").filter("text is not null")
    return rows.select("doc_id", F.lit(1).alias("chunk_no"), text.truncated(F.col("text"), 1200).alias("text"))


@query(f"""SELECT candidate_kind AS kind, count(*) AS n, round(avg(length(text)), 1) AS mean_chars, count(*) FILTER (length(text) > 500) AS n_long, count(*) FILTER (length(text) < 30) AS n_short,
  round(count(*) FILTER (regexp_matches({S.trim('text')}, '[.!?]["'')\\]]?$')) / CAST(count(*) AS DOUBLE), 3) AS complete_share FROM candidate_exports GROUP BY 1""")
def sentence_length_stats(s, d):
    n = F.char_length("text")
    return table(s, d, "candidate_exports").groupBy(F.col("candidate_kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 1).alias("mean_chars"), F.count_if(n > 500).alias("n_long"), F.count_if(n < 30).alias("n_short"),
        F.round(F.count_if(text.is_complete_sentence(F.col("text"))) / F.count(F.lit(1)).cast("double"), 3).alias("complete_share"),
    )


@query("""SELECT document_id, candidate_key, CAST((row_number() OVER (PARTITION BY document_id ORDER BY candidate_key) - 1) // 18 AS INTEGER) AS batch_no
  FROM candidate_exports WHERE candidate_kind = 'body_sentence'""")
def candidate_batches(s, d):
    body = table(s, d, "candidate_exports").filter("candidate_kind = 'body_sentence'").select("document_id", "candidate_key")
    return segments.batches(body, 18, ["document_id"], ["candidate_key"])


@query("""WITH b AS (SELECT document_id, page, candidate_key, (row_number() OVER (PARTITION BY document_id ORDER BY candidate_key) - 1) // 18 AS batch_no FROM candidate_exports WHERE candidate_kind = 'body_sentence'),
  p AS (SELECT DISTINCT document_id, page, CAST(batch_no AS INTEGER) AS batch_no FROM b)
  SELECT h.document_id, h.page, p.batch_no, h.candidate_key, h.text FROM candidate_exports h JOIN p ON p.document_id = h.document_id AND p.page = h.page WHERE h.candidate_kind = 'heading'""")
def heading_context(s, d):
    rows = table(s, d, "candidate_exports")
    body = segments.batches(rows.filter("candidate_kind = 'body_sentence'").select(*PAGE, "candidate_key"), 18, ["document_id"], ["candidate_key"])
    heads = rows.filter("candidate_kind = 'heading'").select(*PAGE, "candidate_key", "text")
    return heads.join(body.select(*PAGE, "batch_no").distinct(), PAGE).select(*PAGE, "batch_no", "candidate_key", "text")


# pages and items

_PLACED = f"""(
  WITH r AS (SELECT document_id, page, item_no, str, coalesce(normalized_str, '') AS norm, coalesce(has_eol, false) AS eol FROM {S.ITEMS} WHERE str IS NOT NULL),
  j AS (SELECT *, coalesce(lag(eol AND norm LIKE '%-') OVER w, false) AND norm <> '' AS joins, coalesce(max(CASE WHEN norm <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS follows FROM r WINDOW w AS (PARTITION BY document_id, page ORDER BY item_no)),
  o AS (SELECT *, CASE WHEN norm <> '' AND follows AND NOT joins THEN 1 ELSE 0 END AS gap, CASE WHEN coalesce(lead(joins) OVER (PARTITION BY document_id, page ORDER BY item_no), false) THEN left(norm, length(norm) - 1) ELSE norm END AS own FROM j),
  e AS (SELECT *, sum(gap + {S.u16('own')}) OVER w AS e, sum({S.u16('str')}) OVER w + coalesce(sum(CASE WHEN eol THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS re
    FROM o WINDOW w AS (PARTITION BY document_id, page ORDER BY item_no ROWS UNBOUNDED PRECEDING))
  SELECT document_id, page, item_no, str, own, gap, eol, CAST(re - {S.u16('str')} AS INTEGER) AS raw_start, CAST(re AS INTEGER) AS raw_end, CAST(e - {S.u16('own')} AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM e)"""
_FOLDED = f"""(SELECT document_id, page, count(*) AS n_items, string_agg(str || CASE WHEN eol THEN chr(10) ELSE '' END, '' ORDER BY item_no) AS raw_text,
  string_agg(CASE WHEN gap = 1 THEN ' ' ELSE '' END || own, '' ORDER BY item_no) AS normalized_text FROM {_PLACED} GROUP BY ALL)"""


@query(f"SELECT document_id, page, item_no, raw_start, raw_end, start, \"end\" FROM {_PLACED}")
def item_offsets(s, d):
    return pages.placed_items(_items(s, d)).select(*PAGE, "item_no", "raw_start", "raw_end", "start", "end")


@query(f"SELECT * FROM {_FOLDED}")
def page_fold(s, d):
    return pages.page_texts(pages.placed_items(_items(s, d)))


@query(f"""WITH f AS (SELECT document_id, page, normalized_text FROM {_FOLDED}), u AS (SELECT * FROM {S.sentences('f', 'normalized_text', 'document_id, page')})
  SELECT u.document_id, u.page, u.sent_no, i.item_no, greatest(u.start, i.start) - i.start AS item_start, least(u."end", i."end") - i.start AS item_end
  FROM u JOIN {_PLACED} i ON i.document_id = u.document_id AND i.page = u.page AND greatest(u.start, i.start) < least(u."end", i."end")""")
def item_overlaps(s, d):
    placed = pages.placed_items(_items(s, d))
    units = segments.sentences(pages.page_texts(placed), "normalized_text", *PAGE)
    return pages.item_overlaps(units, placed)


@query()
def item_forms(s, d):
    """Items whose delivered normal form is not that of their string."""
    rows = table(s, d, "text_items").filter("str is not null").select("item_key", "normalized_str", "str")
    ascii_only = rows.filter(~F.col("str").rlike(r"[^\x00-\x7f]")).withColumn("form", F.trim(F.regexp_replace("str", r"[\t-\r ]+", " ")))
    other = rows.filter(F.col("str").rlike(r"[^\x00-\x7f]")).withColumn("form", text.item_form(F.col("str")))
    return ascii_only.unionByName(other).filter("not (form <=> normalized_str)").select("item_key", "form", "normalized_str")


@query(f"""SELECT document_id, page, item_no, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY item_no) - 1 AS INTEGER) AS span FROM {S.ITEMS} WHERE length(str) > 0""")
def item_span_index(s, d):
    return pages.span_index(_items(s, d)).filter("span is not null")


_TOP = "bbox.y"


@query(f"""SELECT document_id, page, CAST(floor({_TOP} / 4 + 0.5) * 4 AS INTEGER) AS line, count(*) AS n_items, min(item_no) AS first_item, max(item_no) AS last_item FROM {S.ITEMS} WHERE {_TOP} IS NOT NULL GROUP BY ALL""")
def line_groups(s, d):
    return pages.line_groups(_items(s, d).filter(F.col(_TOP).isNotNull()), F.col(_TOP))


@query(f"""WITH l AS (SELECT document_id, page, item_no, str, CAST(floor({_TOP} / 4 + 0.5) * 4 AS INTEGER) AS line FROM {S.ITEMS} WHERE {_TOP} IS NOT NULL),
  c AS (SELECT DISTINCT document_id, page, line FROM l WHERE str LIKE '%?%')
  SELECT l.document_id, l.page, l.item_no, l.line FROM l JOIN c USING (document_id, page, line)""")
def question_lines(s, d):
    """The whole lines of items that hold a question mark."""
    rows = _items(s, d).filter(F.col(_TOP).isNotNull())
    return pages.whole_lines(rows, rows.filter(F.contains("str", F.lit("?"))), F.col(_TOP))


@query(f"""SELECT p.document_id, p.page, coalesce(n, 0) AS n_items, CAST(length(coalesce(raw_text, '')) AS INTEGER) AS raw_chars, CAST(length(coalesce(normalized_text, '')) AS INTEGER) AS normalized_chars, coalesce(normalized_text, '') <> '' AS has_text, left(coalesce(normalized_text, ''), 120) AS preview
  FROM {S.PAGES} p LEFT JOIN (SELECT document_id, page, count(*) AS n FROM {S.ITEMS} GROUP BY ALL) i USING (document_id, page)""")
def page_stats(s, d):
    return pages.page_stats(_pages(s, d), _items(s, d))


@query("""SELECT item_key, coalesce(len(item_transform) = 6 AND NOT list_bool_or(list_transform(item_transform, lambda v: v IS NULL OR NOT isfinite(v))), false) AS transform_ok,
  coalesce(isfinite(width), true) AND coalesce(isfinite(height), true) AS size_ok FROM text_items""")
def geometry_checks(s, d):
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.lit(True))
    return table(s, d, "text_items").select("item_key", measure.all_finite(F.col("item_transform"), 6).alias("transform_ok"), (finite("width") & finite("height")).alias("size_ok"))


# kinds

_LOW = "lower(text)"
_WORDS = f"list_filter(string_split(trim(regexp_replace(text, '[{S.WS}]+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '[{S.ALPHA}]'))"
_TITLED = f"list_filter({_WORDS}, lambda w: regexp_matches(regexp_replace(w, '^[^{S.ALPHA}]+', ''), '^\\p{{Lu}}'))"
_BEGINS = f"({_LOW} IN ('references', 'references.') OR starts_with({_LOW}, 'references [') OR starts_with({_LOW}, 'references 1.'))"
_KIND = f"""CASE WHEN {_BEGINS} THEN CASE WHEN {_LOW} IN ('references', 'references.') THEN 'heading' ELSE 'reference' END
  WHEN in_references OR regexp_matches(text, '^\\[[0-9]+\\]') OR (regexp_matches(text, '^[0-9]+\\.[{S.WS}]') AND regexp_matches(text, '["“”]')) THEN 'reference'
  WHEN lower(regexp_replace(text, '[.:]+$', '')) IN (SELECT unnest({S.strings(kinds.HEADING_LABELS)})) OR (regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\.+([{S.WS}](?s:.*))?$') AND {S.u16('text')} <= 100) THEN 'heading'
  WHEN page = 1 AND start <= 500 AND (contains(text, '@') OR regexp_matches({_LOW}, 'https?://|www\\.') OR (len({_WORDS}) BETWEEN 2 AND 14 AND NOT regexp_matches(text, '[.!?]$') AND len({_TITLED}) * 5 >= len({_WORDS}) * 3)) THEN 'metadata'
  WHEN text = '' THEN 'unknown'
  WHEN regexp_matches({_LOW}, '^table[ :]') OR (length(regexp_replace(text, '[^=+−×÷∑√<>|{{}}]', '', 'g')) >= 2 AND (length(regexp_replace(text, '[^=+−×÷∑√<>|{{}}]', '', 'g')) + length(regexp_replace(text, '[^0-9]', '', 'g'))) * 4 >= length(regexp_replace(text, '[{S.WS}]+', '', 'g'))) THEN 'formula_or_table'
  WHEN {S.u16('text')} < 30 THEN 'short_fragment' ELSE 'body_sentence' END"""
_KINDED = f"""(SELECT document_id, page, sent_no, text, start, "end", {_KIND} AS kind FROM (
  SELECT *, bool_or({_BEGINS}) OVER (PARTITION BY document_id ORDER BY page, sent_no ROWS UNBOUNDED PRECEDING) AS in_references FROM {_SENT}))"""


@query(f"SELECT * FROM {_KINDED}")
def unit_kinds(s, d):
    return _units(s, d)


@query(f"SELECT document_id, {', '.join(f'''count(*) FILTER (kind = '{k}') AS {k}''' for k in kinds.KINDS)} FROM {_KINDED} GROUP BY document_id")
def kind_counts(s, d):
    return evaluation.zero_filled(_units(s, d), "kind", kinds.KINDS, "document_id")


@query(f"SELECT p.document_id, p.page, count(u.sent_no) AS n_sentences FROM {S.PAGES} p LEFT JOIN {_SENT} u ON u.document_id = p.document_id AND u.page = p.page GROUP BY ALL")
def sentences_per_page(s, d):
    """Every page, also one without a sentence."""
    return _pages(s, d).select(*PAGE, F.size(F.coalesce(segments.sentence_spans(F.col("normalized_text")), F.array())).cast("bigint").alias("n_sentences"))


@query(f"""SELECT u.document_id, u.page, u.sent_no, u.text AS exact, {S.trim('substring(normalized_text, greatest(start - 32, 0) + 1, start - greatest(start - 32, 0))')} AS prefix, {S.trim('substring(normalized_text, "end" + 1, 32)')} AS suffix
  FROM {S.sentences(S.PAGES, 'normalized_text', 'document_id, page', 'normalized_text')} u""")
def quote_selectors(s, d):
    return pages.reading_units(_pages(s, d)).select(*PAGE, "sent_no", F.col("text").alias("exact"), "prefix", "suffix")


@query(f"SELECT document_id, page, sent_no, text FROM {_KINDED} WHERE kind = 'body_sentence' QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY sent_no) <= 2")
def first_body_sentences(s, d):
    return segments.first_per(_units(s, d).filter("kind = 'body_sentence'"), 2, PAGE, "sent_no").select(*PAGE, "sent_no", "text")


@query(f"""SELECT document_id, kind, CAST(n AS INTEGER) AS rank, text FROM (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY page, sent_no) AS n FROM {_KINDED}) WHERE n <= CASE kind WHEN 'short_fragment' THEN 5 WHEN 'body_sentence' THEN 5 ELSE 3 END""")
def kind_examples(s, d):
    """The first sentences of each kind of a document, as in its sheet."""
    most = F.when(F.col("kind").isin("short_fragment", "body_sentence"), 5).otherwise(3)
    rows = segments.first_per(_units(s, d), 5, ["document_id", "kind"], "page", "sent_no")
    return rows.filter(F.col("rank") <= most).select("document_id", "kind", "rank", "text")


# words, scores and cues

_WORD = rf"unnest(regexp_split_to_array(text, '[^{S.ALPHA}\p{{N}}]+'))"
_KEYWORDS = f"""(SELECT doc_id, upper(left(w, 1)) || substring(w, 2) AS word, count(*) AS n FROM (SELECT doc_id, lower({_WORD}) AS w FROM documents) WHERE strlen(w) >= 6 AND w NOT IN (SELECT unnest({S.strings(text.KEYWORD_STOP)})) GROUP BY ALL)"""


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank, word, n FROM {_KEYWORDS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 12")
def document_keywords(s, d):
    return concepts.top_keywords(table(s, d, "documents"), "text", "doc_id").select("doc_id", "rank", "word", "n")


@query(f"SELECT word, CAST(sum(n) AS BIGINT) AS n FROM {_KEYWORDS} GROUP BY word")
def keyword_counts(s, d):
    return concepts.keyword_counts(table(s, d, "documents"), "text")


def _score_sql(t: str, p: str, tokens) -> str:
    return f"""CASE WHEN {p} = '' THEN 0.0 WHEN contains({t}, {p}) THEN 1.0 WHEN len({tokens(p)}) = 0 THEN 0.0
      ELSE CAST(len(list_intersect({tokens(p)}, {tokens(t)})) AS DOUBLE) / len({tokens(p)}) END"""


def _policy_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: strlen(w) > 2))"


def _word_tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: strlen(w) > 1 AND NOT list_contains({S.strings(text.STOP_WORDS)}, w)))"


@query(f"""WITH f AS (SELECT doc_id, {S.word_form('text')} AS wt, {S.word_form('title')} AS wp, {S.policy_form('text')} AS pt, {S.policy_form('title')} AS pp FROM documents WHERE text IS NOT NULL AND title IS NOT NULL)
  SELECT doc_id, {_score_sql('wt', 'wp', _word_tokens)} AS word_score, {_score_sql('pt', 'pp', _policy_tokens)} AS policy_score FROM f""")
def title_scores(s, d):
    """How far a document's title is found in its text, by both scorers; one normal form per column, computed once."""
    rows = table(s, d, "documents").filter("text is not null and title is not null").select(
        "doc_id", text.word_form(F.col("text")).alias("wt"), text.word_form(F.col("title")).alias("wp"), text.policy_form(F.col("text")).alias("pt"), text.policy_form(F.col("title")).alias("pp")
    )
    return rows.select("doc_id", text.phrase_score(F.col("wt"), F.col("wp")).alias("word_score"), text.phrase_score(F.col("pt"), F.col("pp"), text.policy_tokens).alias("policy_score"))


#: Phrases of a reader for the scoring queries, made of words that the corpus uses.
KNOWN_PHRASES = ("the review queue of the novelty gate", "recall rose from", "cache tier", "freshness check and rerank stage")


@query(f"""WITH f AS (SELECT candidate_key, {S.word_form('text')} AS t FROM candidate_exports WHERE text IS NOT NULL)
  SELECT candidate_key, greatest({', '.join(_score_sql('t', S.word_form("'" + p + "'"), _word_tokens) for p in KNOWN_PHRASES)}) AS score FROM f""")
def best_phrase_scores(s, d):
    rows = table(s, d, "candidate_exports").filter("text is not null").select("candidate_key", text.word_form(F.col("text")).alias("t"))
    return rows.select("candidate_key", text.best_phrase_score(F.col("t"), KNOWN_PHRASES).alias("score"))


@query(f"""WITH f AS (SELECT candidate_key, {S.policy_form('text')} AS t FROM candidate_exports WHERE text IS NOT NULL)
  SELECT candidate_key, array_to_string(list_filter({S.strings(text.NOVELTY_CUES)}, lambda c: contains(' ' || t || ' ', ' ' || c || ' ') AND NOT (c = 'new' AND (contains(t, 'not new') OR contains(t, 'no new')))), ',') AS novelty,
    array_to_string(list_filter({S.strings(text.FAMILIAR_CUES)}, lambda c: contains(' ' || t || ' ', ' ' || c || ' ')), ',') AS familiar,
    regexp_matches(t, '[0-9]') AND (regexp_matches(t, '[%<>]| percent| versus | compared | than ') OR (contains(t, ' from ') AND contains(t, ' to '))) AS compares FROM f""")
def cue_detection(s, d):
    rows = table(s, d, "candidate_exports").filter("text is not null").select("candidate_key", text.policy_form(F.col("text")).alias("t"))
    t = F.col("t")
    return rows.select("candidate_key", F.array_join(text.novelty_cues(t), ",").alias("novelty"), F.array_join(text.cues(t, text.FAMILIAR_CUES), ",").alias("familiar"), text.compares_numbers(t).alias("compares"))


# finding candidates in pages


def _located(s, d) -> DataFrame:
    """Candidates with the match forms of their own text and of their page; forms are made before the join."""
    c = table(s, d, "candidate_exports").filter("text is not null").select("candidate_key", *PAGE, text.match_form(F.col("text")).alias("part"))
    p = _pages(s, d).filter("normalized_text is not null").select(*PAGE, text.match_form(F.col("normalized_text")).alias("whole"))
    return c.join(p, PAGE)


_LOCATED = f"""(SELECT candidate_key, document_id, page, part, whole FROM (SELECT candidate_key, document_id, page, {S.match_form('text')} AS part FROM candidate_exports WHERE text IS NOT NULL)
  JOIN (SELECT document_id, page, {S.match_form('normalized_text')} AS whole FROM {S.PAGES} WHERE normalized_text IS NOT NULL) USING (document_id, page))"""


@query(f"SELECT candidate_key, CAST(instr(whole, part) - 1 AS INTEGER) AS start, CAST(instr(whole, part) - 1 + length(part) AS INTEGER) AS \"end\" FROM {_LOCATED} WHERE part <> '' AND contains(whole, part)")
def exact_spans(s, d):
    rows = _located(s, d).filter((F.col("part") != "") & F.contains("whole", "part"))
    at = text.exact_index(F.col("whole"), F.col("part"))
    return rows.select("candidate_key", at.alias("start"), (at + F.char_length("part")).alias("end"))


@query()
def phrase_windows(s, d):
    """Where each chunk stands in its page: exactly, or by windows of its longer words."""
    c = table(s, d, "text_chunks").filter("text is not null").select("chunk_key", *PAGE, text.match_form(F.col("text")).alias("part"))
    p = _pages(s, d).filter("normalized_text is not null").select(*PAGE, text.match_form(F.col("normalized_text")).alias("whole"))
    found = c.join(p, PAGE).select("chunk_key", F.explode(matching.phrase_matches(F.col("whole"), F.col("part"))).alias("m"))
    return found.select("chunk_key", "m.start", "m.end", "m.words")


@query(f"""WITH f AS (SELECT candidate_key, {S.words('part')} AS a, {S.words('whole')} AS p FROM {_LOCATED} WHERE NOT contains(whole, part)),
  w AS (SELECT candidate_key, a, p, least(len(a), len(p)) AS n FROM f),
  e AS (SELECT candidate_key, a, n, unnest(range(0, len(p) - n + 1)) AS i, p FROM w WHERE n > 0),
  g AS (SELECT candidate_key, i, array_to_string(p[i + 1 : i + n], ' ') AS text, 2.0 * len(list_intersect(list_distinct(a), list_distinct(p[i + 1 : i + n]))) / (len(list_distinct(a)) + len(list_distinct(p[i + 1 : i + n]))) AS score FROM e),
  b AS (SELECT candidate_key, CAST(score AS DOUBLE) AS score, text FROM g QUALIFY row_number() OVER (PARTITION BY candidate_key ORDER BY score DESC, i) = 1)
  SELECT w.candidate_key, round(coalesce(b.score, 0.0), 6) AS score, CASE WHEN coalesce(b.score, 0) > 0 THEN b.text ELSE '' END AS text FROM w LEFT JOIN b USING (candidate_key)""")
def fuzzy_windows(s, d):
    """The most similar window of the page for candidates that are not found exactly."""
    best = matching.best_window(F.col("whole"), F.col("part"))
    rows = _located(s, d).filter(~F.contains("whole", "part")).select("candidate_key", best.alias("b"))
    return rows.select("candidate_key", F.round("b.score", 6).alias("score"), "b.text")


@query(f"""WITH p AS (SELECT document_id, page, {S.match_form('normalized_text')} AS whole FROM {S.PAGES} WHERE normalized_text IS NOT NULL),
  c AS (SELECT candidate_key, document_id, page, {S.match_form('text')} AS part FROM candidate_exports WHERE text IS NOT NULL)
  SELECT candidate_key, c.page, min(p.page) AS other_page FROM c JOIN p ON p.document_id = c.document_id AND p.page <> c.page AND contains(p.whole, c.part) WHERE part <> '' GROUP BY ALL""")
def page_mismatches(s, d):
    """Candidates whose text stands on another page of their document: the first such page."""
    c = table(s, d, "candidate_exports").filter("text is not null").select("candidate_key", "document_id", "page", text.match_form(F.col("text")).alias("part")).filter("part <> ''")
    p = _pages(s, d).filter("normalized_text is not null").select("document_id", F.col("page").alias("other"), text.match_form(F.col("normalized_text")).alias("whole"))
    return matching.pages_holding(c, p).filter(F.col("page") != F.col("other")).groupBy("candidate_key", "page").agg(F.min("other").alias("other_page"))


@query(f"""WITH f AS (SELECT candidate_key, document_id, page, regexp_replace(part, ' ', '', 'g') AS part, regexp_replace(whole, ' ', '', 'g') AS whole, contains(whole, part) AS exact FROM {_LOCATED})
  SELECT CASE WHEN part = '' THEN 'empty' WHEN exact THEN 'exact' WHEN contains(whole, part) THEN 'spacing' ELSE 'missing' END AS found, count(*) AS n FROM f GROUP BY ALL""")
def text_integrity(s, d):
    """How candidates are found on their pages: exactly, but for spacing, or not."""
    loc = _located(s, d)
    found = F.when(F.col("part") == "", "empty").when(F.contains("whole", "part"), "exact").when(F.contains(text.compact(F.col("whole")), text.compact(F.col("part"))), "spacing").otherwise("missing")
    return loc.groupBy(found.alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH u AS (SELECT candidate_key, document_id, page, {S.match_form('text')} AS form FROM candidate_exports WHERE text IS NOT NULL AND candidate_kind = 'body_sentence'),
  i AS (SELECT document_id, page, item_no, {S.meaningful(S.match_form('str'))} AS have FROM {S.ITEMS} WHERE str IS NOT NULL),
  m AS (SELECT candidate_key, item_no, CAST(len(list_filter(have, lambda w: list_contains({S.meaningful('form')}, w))) AS DOUBLE) / len(have) AS score FROM u JOIN i USING (document_id, page) WHERE len(have) >= 3),
  r AS (SELECT candidate_key, item_no, score, row_number() OVER (PARTITION BY candidate_key ORDER BY score DESC, item_no) AS rank FROM m WHERE score >= 0.38)
  SELECT candidate_key AS unit, item_no, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""")
def like_lines(s, d):
    units = table(s, d, "candidate_exports").filter("text is not null and candidate_kind = 'body_sentence'").select(*PAGE, F.col("candidate_key").alias("unit"), text.match_form(F.col("text")).alias("form"))
    items = _items(s, d).filter("str is not null").select(*PAGE, "item_no", text.match_form(F.col("str")).alias("form"))
    return matching.like_lines(units, items).select("unit", "item_no", F.round("score", 6).alias("score"), "rank")


@query()
def item_range_status(s, d):
    """The item ranges of sentences against the items they name."""
    placed = pages.placed_items(_items(s, d))
    units = segments.sentences(pages.page_texts(placed), "normalized_text", *PAGE)
    ranges = pages.item_overlaps(units, placed).select(
        *PAGE, "sent_no", F.col("item_no").alias("range_no"), F.concat(F.lit("p"), "page", F.lit("i"), "item_no").alias("item_id"), F.col("item_start").alias("start"), F.col("item_end").alias("end")
    )
    return matching.resolve_ranges(ranges.drop("sent_no"), _items(s, d))


@query()
def density_allocation(s, d):
    """Spans given to labelled candidates under each page's caps."""
    spans = pages.span_index(_items(s, d)).filter("span is not null")
    counts = spans.groupBy(*PAGE).agg(F.count(F.lit(1)).cast("int").alias("n_spans"))
    placed = pages.placed_items(_items(s, d))
    units = segments.sentences(pages.page_texts(placed), "normalized_text", *PAGE)
    held = pages.item_overlaps(units, placed).join(spans, [*PAGE, "item_no"]).groupBy(*PAGE, "sent_no").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    style = F.when(F.col("sent_no") % 3 == 0, "familiar").otherwise("delta")
    cands = held.select(*PAGE, F.col("sent_no").alias("unit"), style.alias("style"), (F.lit(1.0) / (F.col("sent_no") + 1)).alias("confidence"), F.col("sent_no").alias("ordinal"), "spans")
    return allocation.allocate(cands, counts).withColumn("spans", F.array_join(F.col("spans").cast("array<string>"), ","))


# labels and exports

_FIRST_LABEL = "(SELECT * FROM manual_labels QUALIFY row_number() OVER (PARTITION BY document_id, sentence_id ORDER BY labelled_at NULLS FIRST, label_key) = 1)"
_LAST_EXPORT = "(SELECT * FROM candidate_exports QUALIFY row_number() OVER (PARTITION BY document_id, sentence_id ORDER BY exported_at DESC NULLS LAST, candidate_key DESC) = 1)"
SENT = ["document_id", "sentence_id"]


def _first_labels(s, d) -> DataFrame:
    return annotations.first_of_each(table(s, d, "manual_labels"), SENT, F.col("labelled_at").asc_nulls_first(), "label_key")


def _last_exports(s, d) -> DataFrame:
    return annotations.last_of_each(table(s, d, "candidate_exports"), SENT, F.col("exported_at").desc_nulls_last(), F.col("candidate_key").desc())


@query(f"SELECT label_key, document_id, sentence_id FROM {_FIRST_LABEL}")
def first_labels(s, d):
    return _first_labels(s, d).select("label_key", *SENT)


@query(f"SELECT candidate_key, document_id, sentence_id FROM {_LAST_EXPORT}")
def last_exports(s, d):
    return _last_exports(s, d).select("candidate_key", *SENT)


def _token_sql(x: str) -> str:
    return f"translate(lower({S.trim(x)}), '- ', '__')"


_DIRECTIVE_SQL = f"CASE {_token_sql('expected_directive')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in annotations.DIRECTIVES.items()) + " END"
_PRIORITY_SQL = f"CASE WHEN {_token_sql('expected_priority')} IN ('delta', 'bridge', 'familiar') THEN {_token_sql('expected_priority')} END"


@query(f"SELECT label_key, {_PRIORITY_SQL} AS priority, {_DIRECTIVE_SQL} AS directive, {_token_sql('label_type')} AS label_type FROM manual_labels")
def parsed_labels(s, d):
    rows = annotations.parsed(table(s, d, "manual_labels"), "expected_priority", "expected_directive")
    return rows.select("label_key", "priority", "directive", text.enum_token(F.col("label_type")).alias("label_type"))


@query(f"SELECT {_token_sql('label_type')} AS value, count(*) AS n FROM manual_labels WHERE {_token_sql('label_type')} <> '' GROUP BY 1")
def label_type_distribution(s, d):
    return evaluation.distribution(table(s, d, "manual_labels"), text.enum_token(F.col("label_type")))


@query("SELECT c.candidate_key FROM candidate_exports c WHERE c.candidate_kind = 'body_sentence' AND NOT EXISTS (SELECT 1 FROM manual_labels l WHERE l.document_id = c.document_id AND l.sentence_id = c.sentence_id)")
def unlabelled_candidates(s, d):
    body = table(s, d, "candidate_exports").filter("candidate_kind = 'body_sentence'")
    return evaluation.unlabelled(body, table(s, d, "manual_labels"), SENT).select("candidate_key")


@query("SELECT label_key FROM manual_labels l WHERE NOT EXISTS (SELECT 1 FROM candidate_exports c WHERE l.document_id = c.document_id AND l.sentence_id = c.sentence_id)")
def unknown_labels(s, d):
    return evaluation.unknown(table(s, d, "manual_labels"), table(s, d, "candidate_exports"), SENT).select("label_key")


@query("SELECT document_id, sentence_id, count(*) AS n FROM manual_labels GROUP BY ALL HAVING count(*) > 1")
def repeated_labels(s, d):
    return evaluation.repeated(table(s, d, "manual_labels"), SENT)


@query(f"""SELECT c.candidate_key, coalesce(l.expected_priority, '') AS expected_priority, coalesce(l.reason, 'no label') AS reason, l.label_key IS NOT NULL AS generated
  FROM {_LAST_EXPORT} c LEFT JOIN {_FIRST_LABEL} l USING (document_id, sentence_id)""")
def labels_with_fallback(s, d):
    units, labels = _last_exports(s, d).select("candidate_key", *SENT), _first_labels(s, d).select(*SENT, "expected_priority", "reason")
    return annotations.with_fallback(units, labels, SENT, expected_priority="", reason="no label").select("candidate_key", "expected_priority", "reason", "generated")


@query("""SELECT candidate_key, array_to_string(list_filter([CASE WHEN length(text) < 30 THEN 'very_short' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'contains_numeric_result' END, CASE WHEN list_contains(tags, 'multi_item_range') THEN 'multi_item_range' END], lambda t: t IS NOT NULL), ',') AS tags,
  CAST(length(text) AS INTEGER) AS length FROM candidate_exports WHERE text IS NOT NULL""")
def export_tags(s, d):
    rows = table(s, d, "candidate_exports").filter("text is not null")
    return rows.select("candidate_key", F.array_join(annotations.export_tags(F.col("text"), F.array_contains("tags", "multi_item_range")), ",").alias("tags"), F.char_length("text").alias("length"))


@query(f"SELECT document_id, count(*) AS n_lines, string_agg('- ' || sentence_id || ' (' || coalesce(candidate_kind, 'unknown') || ') ' || coalesce(text, ''), chr(10) ORDER BY page, candidate_key) AS sheet FROM {_LAST_EXPORT} GROUP BY document_id")
def candidate_sheets(s, d):
    line = F.concat(F.lit("- "), "sentence_id", F.lit(" ("), F.coalesce("candidate_kind", F.lit("unknown")), F.lit(") "), F.coalesce("text", F.lit("")))
    return files.sheet(_last_exports(s, d), line, ["page", "candidate_key"], "document_id").select("document_id", "n_lines", "sheet")


@query("""SELECT document_id, string_agg(k || '=' || n, ' ' ORDER BY k) AS counts FROM (SELECT document_id, candidate_kind AS k, count(*) AS n FROM candidate_exports WHERE candidate_kind IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def kind_count_lines(s, d):
    rows = evaluation.count_map(table(s, d, "candidate_exports"), "candidate_kind", "document_id")
    return rows.select("document_id", files.counts_text(F.col("counts")).alias("counts"))


@query("SELECT annotator, count(DISTINCT expected_directive) AS n_directives FROM manual_labels GROUP BY annotator")
def distinct_directives(s, d):
    return table(s, d, "manual_labels").groupBy("annotator").agg(F.countDistinct("expected_directive").alias("n_directives"))


def _pairs(s, d) -> tuple[DataFrame, DataFrame]:
    """(labelled pairs, all predictions); a candidate's prediction follows its cues and length."""
    long, digit = F.char_length("text") >= 60, F.col("text").rlike("[0-9]")
    p = F.when(long & digit, "delta").when(long, "bridge").otherwise("familiar")
    predicted = _last_exports(s, d).filter("text is not null").select(*SENT, "fixture", p.alias("predicted")).withColumn("directive", annotations.directive_of(F.col("predicted")))
    labels = annotations.parsed(_first_labels(s, d), "expected_priority", "expected_directive").filter("priority is not null").select(*SENT, F.col("priority").alias("expected"))
    return evaluation.joined(labels, predicted, SENT), predicted


_PREDICTED = f"""(SELECT document_id, sentence_id, fixture, predicted, CASE predicted WHEN 'delta' THEN 'highlight' WHEN 'bridge' THEN 'callout' ELSE 'soft_fade' END AS directive FROM
  (SELECT *, CASE WHEN length(text) >= 60 AND regexp_matches(text, '[0-9]') THEN 'delta' WHEN length(text) >= 60 THEN 'bridge' ELSE 'familiar' END AS predicted FROM {_LAST_EXPORT} WHERE text IS NOT NULL))"""
_PAIRS = f"(SELECT p.*, l.expected FROM (SELECT document_id, sentence_id, {_PRIORITY_SQL} AS expected FROM {_FIRST_LABEL}) l JOIN {_PREDICTED} p USING (document_id, sentence_id) WHERE expected IS NOT NULL)"
_METRICS = f"""(WITH c AS (SELECT fixture, count(*) AS n_labels, count(*) FILTER (expected = 'delta' AND predicted = 'delta') AS true_delta, count(*) FILTER (expected <> 'delta' AND predicted = 'delta') AS false_delta,
    count(*) FILTER (expected = 'delta' AND predicted <> 'delta') AS false_negative_delta_count, count(*) FILTER (expected = 'familiar') AS familiar, count(*) FILTER (expected = 'familiar' AND directive IN ('soft_fade', 'leave_normal')) AS suppressed,
    count(*) FILTER (expected = 'familiar' AND predicted = 'delta') AS known FROM {_PAIRS} GROUP BY fixture),
  v AS (SELECT fixture, count(*) FILTER (directive <> 'leave_normal') AS visible FROM {_PREDICTED} GROUP BY fixture),
  g AS (SELECT fixture, count(DISTINCT page) AS n_pages FROM candidate_exports GROUP BY fixture)
  SELECT c.fixture, n_labels, true_delta, false_delta, false_negative_delta_count, CAST(true_delta AS DOUBLE) / nullif(true_delta + false_delta, 0) AS delta_precision, CAST(true_delta AS DOUBLE) / nullif(true_delta + false_negative_delta_count, 0) AS delta_recall,
    CAST(suppressed AS DOUBLE) / nullif(familiar, 0) AS familiar_suppression_rate, CAST(known AS DOUBLE) / nullif(familiar, 0) AS known_as_delta_rate, coalesce(CAST(coalesce(visible, 0) AS DOUBLE) / nullif(n_pages, 0), 0.0) AS visible_guidance_per_page
  FROM c LEFT JOIN v ON v.fixture = c.fixture LEFT JOIN g ON g.fixture = c.fixture)"""


def _metrics(s, d) -> DataFrame:
    pairs, predicted = _pairs(s, d)
    n_pages = table(s, d, "candidate_exports").groupBy("fixture").agg(F.countDistinct("page").alias("n_pages"))
    return evaluation.metrics(pairs, predicted, n_pages, ["fixture"])


@query(f"SELECT * FROM {_METRICS}")
def eval_metrics(s, d):
    return _metrics(s, d)


@query(f"""SELECT error_group, count(*) AS n FROM (SELECT unnest([CASE WHEN expected <> 'delta' AND predicted = 'delta' THEN 'false_positive_delta' END, CASE WHEN expected = 'delta' AND predicted <> 'delta' THEN 'false_negative_delta' END,
  CASE WHEN expected = 'familiar' AND directive = 'highlight' THEN 'familiar_highlight' END, CASE WHEN (expected = 'bridge') <> (predicted = 'bridge') THEN 'bridge_confusion' END,
  CASE WHEN expected = 'familiar' AND directive NOT IN ('soft_fade', 'leave_normal') THEN 'over_annotated' END]) AS error_group FROM {_PAIRS}) WHERE error_group IS NOT NULL GROUP BY 1""")
def error_groups(s, d):
    return evaluation.error_groups(_pairs(s, d)[0]).groupBy("error_group").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT document_id, sentence_id, expected, predicted FROM {_PAIRS} WHERE expected <> predicted")
def mismatched_labels(s, d):
    return _pairs(s, d)[0].filter("expected <> predicted").select(*SENT, "expected", "predicted")


_BOUNDS = ", ".join(f"CAST({c} AS DOUBLE)" for c, _, _ in evaluation.THRESHOLDS)
_MEASURED = ", ".join(f"CAST({m} AS DOUBLE)" for _, m, _ in evaluation.THRESHOLDS)
_NAMED = f"unnest({S.strings([m for _, m, _ in evaluation.THRESHOLDS])}) AS metric, unnest({S.strings([w for _, _, w in evaluation.THRESHOLDS])}) AS direction"


@query(f"""WITH t AS (SELECT fixture, {_NAMED}, unnest([{_BOUNDS}]) AS bound FROM fixture_thresholds), m AS (SELECT fixture, {_NAMED}, unnest([{_MEASURED}]) AS measured FROM {_METRICS})
  SELECT t.fixture, t.metric, t.direction, bound, measured AS "value" FROM t JOIN m ON m.fixture = t.fixture AND m.metric = t.metric
  WHERE bound IS NOT NULL AND CASE t.direction WHEN 'min' THEN measured IS NULL OR measured < bound ELSE coalesce(measured > bound, false) END""")
def threshold_violations(s, d):
    return evaluation.violations(table(s, d, "fixture_thresholds"), _metrics(s, d), "fixture")


# stores


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def same_content(s, d):
    return store.same_content(table(s, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, uploaded_at FROM documents WHERE uploaded_at >= (SELECT max(uploaded_at) FROM documents) - INTERVAL 6 HOUR")
def unexpired_documents(s, d):
    """Documents of the six hours before the last upload."""
    rows = table(s, d, "documents").select("doc_id", "uploaded_at")
    return store.unexpired_at_last(rows, "uploaded_at")


@query("""SELECT m.document_id, m.page_count, coalesce(n, 0) AS n_pages, coalesce(n, 0) = m.page_count AS complete FROM (SELECT * FROM canonical_models QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST, model_key DESC) = 1) m
  LEFT JOIN (SELECT document_id, count(DISTINCT page) AS n FROM text_pages GROUP BY 1) p USING (document_id)""")
def capture_completeness(s, d):
    models = segments.latest(table(s, d, "canonical_models"), ["document_id"], F.col("ingested_at").desc_nulls_last(), F.col("model_key").desc())
    return files.complete_captures(table(s, d, "text_pages"), models)


@query("""SELECT model_key, CASE WHEN NOT coalesce(schema_version = '1.0', false) THEN 'schema_version' WHEN NOT coalesce(regexp_full_match(document_id, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'), false) THEN 'document_id'
  WHEN NOT coalesce(regexp_full_match(pdf_hash, '[0-9a-f]{64}'), false) THEN 'pdf_hash' END AS reason FROM canonical_models WHERE reason IS NOT NULL""")
def invalid_models(s, d):
    return files.split_valid(table(s, d, "canonical_models"))[1].select("model_key", "reason")


@query("""SELECT l.label_key, l.text FROM (SELECT * FROM manual_labels WHERE review_status <> 'draft' OR review_status IS NULL) l WHERE NOT EXISTS (SELECT 1 FROM manual_labels u WHERE u.review_status = 'draft' AND u.document_id = l.document_id AND u.sentence_id = l.sentence_id)
  UNION ALL SELECT label_key, text FROM manual_labels WHERE review_status = 'draft'""")
def upserted_labels(s, d):
    """Labels with all those of a sentence replaced where there is a draft."""
    rows = table(s, d, "manual_labels").select("label_key", *SENT, "text", "review_status")
    return store.upsert(rows.filter("review_status <> 'draft' or review_status is null"), rows.filter("review_status = 'draft'"), SENT).select("label_key", "text")


@query("""SELECT document_id, candidate_key, 'export' AS unit_kind FROM candidate_exports UNION ALL SELECT document_id, chunk_key AS candidate_key, 'chunk' AS unit_kind FROM text_chunks WHERE document_id NOT IN (SELECT document_id FROM candidate_exports WHERE document_id IS NOT NULL)""")
def best_units(s, d):
    """A document's exported sentences if it has any, else its chunks."""
    a = table(s, d, "candidate_exports").select("document_id", "candidate_key", F.lit("export").alias("unit_kind"))
    b = table(s, d, "text_chunks").select("document_id", F.col("chunk_key").alias("candidate_key"), F.lit("chunk").alias("unit_kind"))
    return annotations.best_kind(a, b)


@query(f"""WITH st AS (SELECT * FROM {S.sentences('text_chunks', 'text', 'chunk_key', closers=False, unit=S.chars)}),
  a AS (SELECT chunk_key, sent_no AS anchor_no, string_agg(text, ' ' ORDER BY sent_no) OVER w AS text, min(start) OVER w AS start, max("end") OVER w AS "end", count(*) OVER w AS n, max(sent_no) OVER w AS last_sent FROM st WINDOW w AS (PARTITION BY chunk_key ORDER BY sent_no ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
  SELECT chunk_key, anchor_no, anchor_no AS first_sent, last_sent, text, start, "end" FROM a WHERE n = 2 AND length(text) <= 500 AND (length(text) >= 30 OR (length(text) <= 100 AND len({S.words(f"trim(regexp_replace(text, '[{S.WS}]+', ' ', 'g'))")}) <= 12 AND NOT regexp_matches({S.trim('text')}, '[.!?]$')))""")
def paired_anchors(s, d):
    """Anchors over each two neighbouring sentences of a chunk."""
    st = segments.sentences(table(s, d, "text_chunks"), "text", "chunk_key", closers=False, unit=F.char_length)
    asked = st.select("chunk_key", F.col("sent_no").alias("anchor_no"), F.array(F.col("sent_no"), F.col("sent_no") + 1).alias("sent_nos"))
    return annotations.anchors(asked, st)


@query("""SELECT document_id, page, candidate_key, text FROM candidate_exports WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY length(text) DESC, candidate_key) = 1""")
def top_candidate_per_page(s, d):
    rows = table(s, d, "candidate_exports").filter("text is not null").select(*PAGE, "candidate_key", "text")
    return segments.first_per(rows, 1, PAGE, F.char_length("text").desc(), "candidate_key").drop("rank")


@query("""SELECT fixture, to_json(struct_pack(fixture := fixture, fixture_type := fixture_type, baseline_name := baseline_name)) AS json FROM fixture_thresholds WHERE fixture_type IS NOT NULL AND baseline_name IS NOT NULL""")
def fixture_json(s, d):
    rows = table(s, d, "fixture_thresholds").filter("fixture_type is not null and baseline_name is not null")
    return rows.select("fixture", F.to_json(F.struct("fixture", "fixture_type", "baseline_name")).alias("json"))


# diagnostics

_RANGES = f"""(WITH r AS (SELECT document_id, page, item_no, {S.match_form("coalesce(str, '')")} AS form, CASE WHEN lag(coalesce(str, '')) OVER w IS NULL OR (regexp_matches(lag(coalesce(str, '')) OVER w, '(?i)[a-z]-\\s*$') AND regexp_matches(coalesce(str, ''), '(?i)^\\s*[a-z]')) THEN 0 ELSE 1 END AS gap
    FROM {S.ITEMS} WINDOW w AS (PARTITION BY document_id, page ORDER BY item_no)),
  e AS (SELECT *, sum(gap + length(form)) OVER (PARTITION BY document_id, page ORDER BY item_no ROWS UNBOUNDED PRECEDING) AS e FROM r)
  SELECT document_id, page, item_no, form, gap, CAST(e - length(form) AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM e)"""
_MATCHES = f"""(SELECT candidate_key AS unit, document_id, page, CAST(instr(whole, part) - 1 AS INTEGER) AS start, CAST(instr(whole, part) - 1 + length(part) AS INTEGER) AS "end" FROM
  (SELECT candidate_key, document_id, page, {S.match_form('text')} AS part FROM candidate_exports WHERE text IS NOT NULL) JOIN
  (SELECT document_id, page, string_agg(CASE WHEN gap = 1 THEN ' ' ELSE '' END || form, '' ORDER BY item_no) AS whole FROM {_RANGES} GROUP BY ALL) USING (document_id, page) WHERE part <> '' AND contains(whole, part))"""


def _match_ranges(s, d) -> DataFrame:
    return diagnostics.match_ranges(_items(s, d))


def _item_matches(s, d) -> DataFrame:
    c = table(s, d, "candidate_exports").filter("text is not null").select(F.col("candidate_key").alias("unit"), *PAGE, text.match_form(F.col("text")).alias("part"))
    rows = c.join(diagnostics.match_text(_match_ranges(s, d)), PAGE).filter((F.col("part") != "") & F.contains("whole", "part"))
    at = text.exact_index(F.col("whole"), F.col("part")).cast("int")
    return rows.select("unit", *PAGE, at.alias("start"), (at + F.char_length("part")).alias("end"))


@query(f"SELECT document_id, page, item_no, form, start, \"end\" FROM {_RANGES}")
def match_ranges(s, d):
    return _match_ranges(s, d).drop("gap")


@query(f"SELECT unit, m.document_id, m.page, item_no FROM {_MATCHES} m JOIN {_RANGES} r ON r.document_id = m.document_id AND r.page = m.page AND r.\"end\" > m.start AND r.start < m.\"end\"")
def items_of_matches(s, d):
    return diagnostics.items_of_matches(_item_matches(s, d), _match_ranges(s, d))


@query(f"""WITH u AS (SELECT candidate_key AS unit, {S.match_form('text')} AS part FROM candidate_exports WHERE text IS NOT NULL), t AS (SELECT unit, sum("end" - start) AS matched, count(*) AS n FROM {_MATCHES} GROUP BY 1),
  r AS (SELECT unit, coalesce(n, 0) AS n_matches, least(1.0, coalesce(CAST(coalesce(matched, 0) AS DOUBLE) / nullif(length(part), 0), 0.0)) AS share FROM u LEFT JOIN t USING (unit))
  SELECT unit, n_matches, CAST(share AS DOUBLE) AS share, n_matches >= 1 AND share >= 0.5 AS usable FROM r""")
def matched_shares(s, d):
    units = table(s, d, "candidate_exports").filter("text is not null").select(F.col("candidate_key").alias("unit"), text.match_form(F.col("text")).alias("part"))
    return diagnostics.matched_share(_item_matches(s, d), units)


def _page_counts(s, d) -> DataFrame:
    conditions = {"n_short": F.char_length("text") < 30, "n_long": F.char_length("text") > 500, "n_ranges": F.col("item_ranges_present")}
    return diagnostics.page_counts(table(s, d, "candidate_exports"), "candidate_kind", conditions, *PAGE)


_PAGE_COUNTS = """(SELECT document_id, page, count(*) AS n, count(*) FILTER (length(text) < 30) AS n_short, count(*) FILTER (length(text) > 500) AS n_long, count(*) FILTER (item_ranges_present) AS n_ranges FROM candidate_exports GROUP BY ALL)"""


@query(f"""SELECT c.*, coalesce(m.kinds, '') AS kinds FROM {_PAGE_COUNTS} c LEFT JOIN (SELECT document_id, page, string_agg(k || '=' || n, ' ' ORDER BY k) AS kinds FROM (SELECT document_id, page, candidate_kind AS k, count(*) AS n FROM candidate_exports WHERE candidate_kind IS NOT NULL GROUP BY ALL) GROUP BY ALL) m USING (document_id, page)""")
def page_lifecycle_counts(s, d):
    return _page_counts(s, d).withColumn("kinds", files.counts_text(F.col("by_status"))).drop("by_status")


@query("""SELECT document_id, string_agg(k || '=' || n, ' ' ORDER BY k) AS kinds FROM (SELECT document_id, candidate_kind AS k, count(*) AS n FROM candidate_exports WHERE candidate_kind IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def document_rollup(s, d):
    """The pages' maps of counts added up by document."""
    return diagnostics.merged_counts(_page_counts(s, d), "by_status", "document_id").select("document_id", files.counts_text(F.col("by_status")).alias("kinds"))


@query(f"""SELECT document_id, page, "check" FROM (SELECT document_id, page, unnest([CASE WHEN NOT (n_short + n_long <= n) THEN 'lengths' END, CASE WHEN NOT (n_ranges <= n) THEN 'ranges' END]) AS "check" FROM {_PAGE_COUNTS}) WHERE "check" IS NOT NULL""")
def broken_invariants(s, d):
    """No row: the counts of a page agree with each other."""
    checks = {"lengths": F.col("n_short") + F.col("n_long") <= F.col("n"), "ranges": F.col("n_ranges") <= F.col("n")}
    return diagnostics.broken_invariants(_page_counts(s, d), checks).select(*PAGE, "check")


@query("""WITH r AS (SELECT document_id, candidate_key, coalesce(candidate_kind = 'metadata', false) AS p, bool_or(coalesce(candidate_kind = 'metadata', false)) OVER (PARTITION BY document_id) AS some FROM candidate_exports),
  k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY candidate_key) AS rank FROM r WHERE p OR NOT some) SELECT document_id, candidate_key, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= CASE WHEN some THEN 5 ELSE 2 END""".replace(" some", " has_some"))
def quest_anchors(s, d):
    """The first five metadata lines of each document, or its first two candidates."""
    preferred = F.coalesce(F.col("candidate_kind") == "metadata", F.lit(False))
    rows = table(s, d, "candidate_exports").select("document_id", "candidate_key", "candidate_kind")
    return diagnostics.top_or_first(rows, preferred, "document_id", 5, 2, "candidate_key").select("document_id", "candidate_key", "rank")


@query(f"""SELECT p.document_id, p.sentence_id, c.text, p.expected, p.predicted, CASE WHEN contains(lower(l.reason), 'ambiguous') THEN 'ambiguous_label' WHEN p.expected = 'familiar' THEN 'familiar_overlap' WHEN list_contains(c.tags, 'very_short') THEN 'known_overlap' WHEN p.expected = 'bridge' AND p.predicted = 'delta' THEN 'bridge_as_delta' WHEN {_DIRECTIVE_SQL} = 'leave_normal' THEN 'low_value' ELSE 'unknown' END AS cause
  FROM {_PAIRS} p JOIN {_LAST_EXPORT} c USING (document_id, sentence_id) JOIN {_FIRST_LABEL} l USING (document_id, sentence_id) WHERE p.expected <> p.predicted""")
def error_details(s, d):
    """Wrongly predicted sentences with text and likely cause: labels, predictions and candidates joined on one key."""
    pairs = _pairs(s, d)[0].filter("expected <> predicted")
    rows = pairs.join(_last_exports(s, d).select(*SENT, "text", "tags"), SENT).join(_first_labels(s, d).select(*SENT, "reason", annotations.directive(F.col("expected_directive")).alias("wanted")), SENT)
    cause = diagnostics.likely_cause(F.col("reason"), F.col("expected") == "familiar", F.coalesce(F.array_contains("tags", "very_short"), F.lit(False)), F.col("expected"), F.col("predicted"), F.col("wanted"))
    return rows.select(*SENT, "text", "expected", "predicted", cause.alias("cause"))


@query("SELECT c.candidate_kind AS kind, CAST(count(*) AS BIGINT) AS n, count(DISTINCT c.document_id) AS n_documents FROM candidate_exports c WHERE EXISTS (SELECT 1 FROM text_chunks k WHERE k.document_id = c.document_id AND k.page = c.page) GROUP BY 1")
def candidates_on_chunked_pages(s, d):
    chunked = table(s, d, "text_chunks").select(*PAGE)
    return table(s, d, "candidate_exports").join(chunked, PAGE, "left_semi").groupBy(F.col("candidate_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("n_documents"))


# reviews


@query(f"""SELECT cause, count(*) AS n FROM (SELECT CASE WHEN contains(lower(l.reason), 'ambiguous') THEN 'ambiguous_label' WHEN p.expected = 'familiar' THEN 'familiar_overlap' WHEN list_contains(c.tags, 'very_short') THEN 'known_overlap' WHEN p.expected = 'bridge' AND p.predicted = 'delta' THEN 'bridge_as_delta' WHEN {_DIRECTIVE_SQL} = 'leave_normal' THEN 'low_value' ELSE 'unknown' END AS cause
  FROM {_PAIRS} p JOIN {_LAST_EXPORT} c USING (document_id, sentence_id) JOIN {_FIRST_LABEL} l USING (document_id, sentence_id) WHERE p.expected <> p.predicted) GROUP BY 1""")
def error_causes(s, d):
    return error_details(s, d).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT document_id, count(*) FILTER (p = 'delta') AS delta, count(*) FILTER (p = 'bridge') AS bridge, count(*) FILTER (p = 'familiar') AS familiar FROM (SELECT document_id, {_PRIORITY_SQL} AS p FROM {_FIRST_LABEL}) GROUP BY 1""")
def priority_counts(s, d):
    labels = _first_labels(s, d).withColumn("p", annotations.priority(F.col("expected_priority")))
    return evaluation.zero_filled(labels, "p", ("delta", "bridge", "familiar"), "document_id")


@query(f"""SELECT c.document_id, c.page, count(*) AS n_candidates, count(l.sentence_id) AS n_labelled, count(l.sentence_id) / CAST(count(*) AS DOUBLE) AS coverage FROM {_LAST_EXPORT} c LEFT JOIN (SELECT document_id, sentence_id FROM {_FIRST_LABEL}) l USING (document_id, sentence_id) GROUP BY ALL""")
def label_coverage(s, d):
    labels = _first_labels(s, d).select(*SENT, F.lit(1).alias("one"))
    rows = _last_exports(s, d).select(*PAGE, "sentence_id").join(labels, SENT, "left").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n_candidates"), F.count("one").alias("n_labelled"))
    return rows.withColumn("coverage", measure.ratio_or_zero(F.col("n_labelled"), F.col("n_candidates")))


@query(f"""WITH f AS (SELECT candidate_key, {S.policy_form('text')} AS t FROM candidate_exports WHERE text IS NOT NULL),
  m AS (SELECT candidate_key, list_filter([{', '.join(f"CASE WHEN {_score_sql('t', S.policy_form(chr(39) + p + chr(39)), _policy_tokens)} >= 0.55 THEN '{p}' END" for p in KNOWN_PHRASES)}], lambda x: x IS NOT NULL) AS found FROM f)
  SELECT candidate_key, array_to_string(found, '|') AS phrases FROM m WHERE len(found) > 0""")
def matched_phrase_lists(s, d):
    rows = table(s, d, "candidate_exports").filter("text is not null").select("candidate_key", text.policy_form(F.col("text")).alias("t"))
    found = rows.select("candidate_key", text.matched_phrases(F.col("t"), KNOWN_PHRASES).alias("found")).filter(F.size("found") > 0)
    return found.select("candidate_key", F.array_join("found", "|").alias("phrases"))


@query(f"""SELECT label_key, p AS priority, CASE p WHEN 'delta' THEN 'highlight' WHEN 'bridge' THEN 'callout' WHEN 'familiar' THEN 'soft_fade' END AS directive, CAST(CASE p WHEN 'delta' THEN 0.74 WHEN 'bridge' THEN 0.55 WHEN 'familiar' THEN 0.68 END AS DOUBLE) AS confidence,
  CASE p WHEN 'delta' THEN 'New insight' WHEN 'bridge' THEN 'Bridge context' WHEN 'familiar' THEN 'Likely familiar' END AS label FROM (SELECT label_key, {_PRIORITY_SQL} AS p FROM manual_labels) WHERE p IS NOT NULL""")
def label_defaults(s, d):
    p = F.col("priority")
    rows = table(s, d, "manual_labels").select("label_key", annotations.priority(F.col("expected_priority")).alias("priority")).filter("priority is not null")
    return rows.select("label_key", "priority", annotations.directive_of(p).alias("directive"), annotations.confidence_of(p).alias("confidence"), annotations.label_of(p).alias("label"))


@query(f"""SELECT label_key, unnest(range(1, len(c) + 1)) AS claim_no, unnest(c) AS claim FROM (SELECT label_key, list_filter(list_transform(regexp_split_to_array(reason, '[\n.;]'), lambda x: {S.trim('x')}), lambda x: x <> '') AS c FROM manual_labels)""")
def claims_of_reasons(s, d):
    rows = table(s, d, "manual_labels").select("label_key", F.posexplode(text.split_claims(F.col("reason"))).alias("n", "claim"))
    return rows.select("label_key", (F.col("n") + 1).cast("bigint").alias("claim_no"), "claim")


@query("""SELECT fixture, regexp_full_match(fixture, '[A-Za-z0-9_-][A-Za-z0-9_.-]*') AS plain FROM fixture_thresholds""")
def plain_fixture_names(s, d):
    return table(s, d, "fixture_thresholds").select("fixture", annotations.is_plain_name(F.col("fixture")).alias("plain"))


@query(f"""SELECT c.chunk_key, CASE WHEN c.page IS NULL THEN NULL ELSE c.page END AS page, p.page_key FROM text_chunks c LEFT JOIN {S.PAGES} p ON p.document_id = c.document_id AND p.page = c.page""")
def chunk_pages(s, d):
    """Each chunk with the page it lies on, if that was delivered."""
    return table(s, d, "text_chunks").select("chunk_key", *PAGE).join(_pages(s, d).select(*PAGE, "page_key"), PAGE, "left").select("chunk_key", "page", "page_key")
