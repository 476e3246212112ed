import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.functions import measure as ms, text as tx
from foliant.operators import concepts
from foliant.plans import corpus


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())] if cells else [(1,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cells.items()) or "one int")
    return row.select(column.alias("v")).first()["v"]


def of(spark, f, s):
    return value(spark, f(F.col("s")), s=s)


def test_three_length_units(spark):
    assert of(spark, lambda c: F.struct(ms.utf16_length(c), F.char_length(c), F.octet_length(c)), "a😀é") == (4, 3, 7)


@pytest.mark.parametrize("start, end, want", [(0, 4, "a😀é"), (1, 3, "😀"), (2, 4, "é"), (0, 2, "a"), (3, 3, ""), (2, 9, "é")])
def test_utf16_slice_leaves_out_half_characters(spark, start, end, want):
    assert of(spark, lambda c: ms.utf16_slice(c, F.lit(start), F.lit(end)), "a😀é") == want


@pytest.mark.parametrize("s, want", [("  A   B  ", "A B"), ("soft­hyphen", "softhyphen"), ("ﬁn e\u0085x", "fin e\u0085x"), ("﻿a", "a"), (None, None)])
def test_item_form(spark, s, want):
    assert of(spark, tx.item_form, s) == want


def test_trim_takes_all_unicode_white_space(spark):
    assert of(spark, tx.trim, "　 \t a b \n") == "a b"


@pytest.mark.parametrize("f, s, want", [
    (tx.policy_form, "Up 31% — from <2 to >3!", "up 31% from <2 to >3"), (tx.word_form, "Up 31% — from <2!", "up 31 from 2"),
    (tx.match_form, "Cut-  off Café WORDS", "cutoff caf words"), (tx.enum_token, " Soft-Fade ", "soft_fade"), (tx.title_case, "élan vital", "Élan vital"),
])
def test_forms(spark, f, s, want):
    assert of(spark, f, s) == want


def test_tokens(spark):
    assert sorted(of(spark, tx.word_tokens, "the cache of a cache is x 是")) == ["cache", "is", "是"]
    assert sorted(of(spark, tx.policy_tokens, "the cache of 是 cache")) == ["cache", "the", "是"]
    assert of(spark, tx.meaningful_words, "the cache of cache") == ["the", "cache", "cache"]


@pytest.mark.parametrize("text, phrase, want", [("a b cache tier c", "cache tier", 1.0), ("tier cache", "cache tier drift gone", 0.5), ("x", "", 0.0), ("x", "the of", 0.0), ("", "cache", 0.0)])
def test_phrase_score(spark, text, phrase, want):
    assert value(spark, tx.phrase_score(F.col("t"), F.col("p")), t=text, p=phrase) == want


def test_cues(spark):
    assert of(spark, tx.novelty_cues, "it is not new evidence that reduced cost") == ["reduced"]
    assert of(spark, lambda c: tx.cues(c, tx.FAMILIAR_CUES), "it is not new evidence") == ["not new evidence"]
    assert of(spark, tx.novelty_cues, "renewed") == []


@pytest.mark.parametrize("s, want", [("reduced by 31 percent", True), ("up from 2 to 3", True), ("from 2 to 3", False), ("from 2", False), ("more than", False), ("5 > 4", True)])
def test_number_comparison(spark, s, want):
    assert of(spark, tx.compares_numbers, s) is want


def test_claims_paragraphs_and_sentences_end(spark):
    assert of(spark, tx.split_claims, "One; two.\n\n three ") == ["One", "two", "three"]
    assert of(spark, tx.paragraphs, "First idea.\n\n \n\nSecond idea.") == ["First idea.", "Second idea."]
    assert [of(spark, tx.is_complete_sentence, s) for s in ("Done.", 'Done!" ', "not done", "")] == [True, True, False, False]


@pytest.mark.parametrize("x, want", [(2.5, 1.0), (-1.0, 0.0), (float("nan"), 0.5), (0.3, 0.3)])
def test_clamp(spark, x, want):
    assert value(spark, ms.clamp_unit(F.col("x")), x=x) == want


def test_ratios_and_rounding(spark):
    assert value(spark, ms.ratio(F.lit(1), F.lit(0))) is None and value(spark, ms.ratio_or_zero(F.lit(1), F.lit(0))) == 0.0
    assert [value(spark, ms.round_half_up(F.lit(x))) for x in (2.5, -2.5, 1.4)] == [3, -2, 1]
    assert value(spark, tx.dice(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b"), F.lit("c")))) == 0.5


def test_keywords_change_case_one_character_at_a_time(spark):
    texts = ["ßahne ßahne", "ΟΔΟΣ οδος", "İstanbul", "ŉamibia ǰanuar", "ᾳδης և՜ևրոպա", "ﬁnance"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {(r["doc_id"], r["word"], r["n"]) for r in concepts.keyword_counts(rows, "text", "doc_id").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id int, text text)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == set(con.execute(f"SELECT doc_id, word, n FROM {corpus._KEYWORDS}").fetchall())
    assert (0, "ẞahne", 2) in got and (1, "Οδοσ", 1) in got and (2, "Istanbul", 1) in got


@pytest.mark.parametrize("first", ["ß", "ŉ", "ǰ", "ᾀ", "ᾳ", "ﬁ", "և"])
def test_a_capital_is_one_character(spark, first):
    assert of(spark, tx.title_case, first + "abc") == duckdb.execute("SELECT upper(?)", [first]).fetchone()[0] + "abc"
