"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import boilerplate, encodings, mixing, packing, sentences, shared_spans, splitting
from foliant.sources.tables import table


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Garbled rows with the chain undone and the original text where it can be had."""
    return encodings.garbled(table(spark, d, "text_items"), table(spark, d, "candidate_exports"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_repaired(spark, d).select("rec_kind", "rec_key")


def _boilerplate(spark: SparkSession, d: str, **options) -> boilerplate.Boilerplate:
    return boilerplate.Boilerplate(table(spark, d, "text_items"), table(spark, d, "candidate_exports"), table(spark, d, "canonical_models"), **options)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _boilerplate(spark, d).places()


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each repeated line of each site, with the clusters, dates and items that hold it."""
    return _boilerplate(spark, d).report()


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every document without its site's repeated lines."""
    return _boilerplate(spark, d).cleaned()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.corpus_sentences(table(spark, d, "text_pages"), table(spark, d, "candidate_exports"), table(spark, d, "text_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.SharedSpans(table(spark, d, "documents")).pairs()


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each document how much of its text is found elsewhere."""
    documents = table(spark, d, "documents")
    return shared_spans.SharedSpans(documents, edges=True).report(documents)


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Shared passages and the documents that hold them, without spelling out the pairs."""
    return shared_spans.SharedSpans(table(spark, d, "documents")).passages()


def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    """How long each document's longest shared passages are at least."""
    return shared_spans.SharedSpans(table(spark, d, "documents")).longest()


#: Overlap of consecutive pieces, in the unit of each limit.
OVERLAP = 60


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "text_chunks"), table(spark, d, "candidate_exports"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.summary(_oversized(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pieces of all oversized items, overlapping."""
    return splitting.pieces(_oversized(spark, d), OVERLAP)


def _packing(spark: SparkSession, d: str) -> packing.Packing:
    return packing.Packing(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).placement()


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).unused()


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).mixture()


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).chosen()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


QUERIES = {
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_lines": p3_lines,
    "p3_cleaned": p3_cleaned,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_placed": p6_placed,
    "p6_unused": p6_unused,
    "p7_mixture": p7_mixture,
    "p7_chosen": p7_chosen,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_coverage": p8_coverage,
    "p8_passages": p8_passages,
    "p8_longest": p8_longest,
}

_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BLANK = r"\r?\n(?:[ \t]*\r?\n)+"


def _cut_sql(kind: str, key: str, source: str, size: str, limit: int) -> str:
    longest = lambda cut: f"list_max(list_transform(regexp_split_to_array(text, '{cut}'), lambda x: {size}(x)))"
    return f"""SELECT '{kind}' AS rec_kind, {key} AS rec_key,
      CASE WHEN {longest(_BLANK)} <= {limit} THEN 'paragraph' WHEN {longest(_WS)} <= {limit} THEN 'word' ELSE 'forced' END AS cut_at
      FROM {source} WHERE {size}(text) > {limit}"""


ORACLE_SQL: dict[str, str] = {
    "p2_found": _cut_sql("chunk", "chunk_key", "text_chunks", "strlen", splitting.CHUNK_BYTES)
    + " UNION ALL " + _cut_sql("candidate", "candidate_key", "candidate_exports", "length", splitting.CANDIDATE_CHARS),
    "p8_found": """WITH w AS (SELECT DISTINCT doc_id, md5(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
      h AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), k AS (SELECT w.* FROM w JOIN h USING (h))
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
