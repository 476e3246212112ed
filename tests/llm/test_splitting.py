import pytest

from foliant.llm import splitting as sp

CHUNKS, CANDS = "chunk_key long, text string", "candidate_key long, text string"


def tables(spark, chunks, candidates):
    return sp.oversized(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(candidates, CANDS))


def size(text, in_bytes):
    return len(text.encode()) if in_bytes else len(text)


TEXTS = [
    "A short paragraph of words.\n\n" * 90,
    "# Heading\n\n" + "Sentence one is here. Sentence two is there. " * 60,
    "x" * 4000,
    "日本語の文です。" * 300,
    "- item of a list\n" * 150,
    "a " + "y" * 1600 + " b. " + "word " * 200,
    "😀" * 700,
    " \t\n" * 800,
    "Title\n\nBody text follows.\r\n \t\r\n" * 80,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit, in_bytes, overlap", [(1500, True, 0), (500, False, 0), (500, False, 60), (37, True, 11)])
def test_pieces_keep_limit_order_cover_and_overlap(text, limit, in_bytes, overlap):
    pieces = sp.split(text, limit, in_bytes, overlap)
    last = 0
    for i, p in enumerate(pieces):
        assert size(text[p.start - p.lead : p.end], in_bytes) <= limit
        assert text[last : p.start].strip(" \t\r\n") == "" and p.start < p.end
        assert 0 <= size(text[p.start - p.lead : p.start], in_bytes) <= overlap and (i or not p.lead)
        last = p.end
    assert text[last:].strip() == ""


def test_cuts_are_at_the_highest_level_that_fits():
    paragraphs = "\n\n".join(["word " * 50] * 8)
    assert {p.level for p in sp.split(paragraphs, 500, False)} <= {"section", "paragraph"}
    assert sp.cut_at(paragraphs, 500, False) == "paragraph"
    assert sp.cut_at("word " * 200, 500, False) == "word"
    assert sp.cut_at("w" * 600, 500, False) == "forced"
    assert [p.level for p in sp.split("One is here. " * 60, 500, False)] == ["sentence"] * 2


def test_heading_stays_with_its_paragraph():
    text = "word " * 80 + "\n\nHeading\n\n" + "more " * 60
    first, second = sp.split(text, 500, False)
    assert text[second.start :].startswith("Heading")


def test_limits_nulls_repeats_and_extra_columns(spark):
    long = "w" * 501
    rows = tables(spark, [(1, None), (2, ""), (3, "é" * 750), (4, "é" * 751)], [(1, "w" * 500), (2, long), (2, long), (3, None)])
    found = sorted(tuple(r) for r in sp.summary(rows.selectExpr("*", "1 as piece_no", "2 as cut_at")).collect())
    assert found == [("candidate", 2, "forced"), ("candidate", 2, "forced"), ("chunk", 4, "forced")]


def test_very_long_text_and_empty_tables(spark):
    rows = tables(spark, [(1, "many words here. " * 60_000)], [])
    assert sp.pieces(rows, 40).count() > 600
    empty = tables(spark, [], [])
    assert sp.summary(empty).count() == 0 and sp.pieces(empty, 10).count() == 0


def test_agrees_with_cutting_everywhere(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    rows = sp.oversized(spark.read.parquet(f"{d}/text_chunks.parquet"), spark.read.parquet(f"{d}/candidate_exports.parquet"))
    texts = {(r["rec_kind"], r["rec_key"]): r["text"] for r in rows.collect()}
    for kind, key, cut in (tuple(r) for r in sp.summary(rows).collect()):
        limit, in_bytes = sp._limit(kind)
        fits = lambda cutter: all(size(s, in_bytes) <= limit for s in cutter.split(texts[kind, key]))
        assert cut == ("paragraph" if fits(sp.BLANK_LINES) else "word" if fits(sp._WORDS) else "forced")


def test_overlap_must_be_below_the_limit():
    with pytest.raises(ValueError):
        sp.split("a", 10, False, 10)


def test_sections_nest_by_the_depth_of_their_headings():
    body = "\n\n".join(["words " * 30] * 2)
    text = f"# A\n\n{body}\n\n## B\n\n{body}\n\n## C\n\n{body}\n\n# D\n\n{body}"
    top = sp._Tree(text, 500, False).sections()
    heads = lambda nodes: [text[n.start : n.start + 4].strip() for n in nodes if n.level == -1]
    assert heads(top) == ["# A", "# D"] and heads(top[0].parts) == ["## B", "## C"]
    starts = [text[p.start : p.start + 4].strip() for p in sp.split(text, 800, False)]
    assert starts[0] == "# A" and "## C" in starts  # A is too large: cut between its parts, never behind a heading
    for limit in (300, 450, 800):
        assert not any(text[p.start : p.end].rstrip().endswith(("# A", "## B", "## C", "# D")) for p in sp.split(text, limit, False))


def test_list_items_hold_what_is_indented_under_them():
    text = "\n".join(f"- item {i} {'word ' * 8}\n  - under {i} {'word ' * 8}\n    more of it" for i in range(12))
    pieces = sp.split(text, 300, False)
    assert len(pieces) > 3 and all(text[p.start :].startswith("- item") for p in pieces)


def test_the_rest_of_an_oversized_node_is_merged_with_its_next_sibling():
    text = "word " * 110 + "\n\nshort end."
    assert len(sp.split(text, 500, False)) == 2


def test_the_first_piece_has_the_whole_limit():
    first, *others = sp.split("word " * 300, 500, False, 60)
    assert first.end - first.start > 440 and all(p.lead for p in others)


def test_marks_stay_with_their_characters():
    for unit in ("e\u0301\u0323", "👩\u200d👩\u200d👧", "\u0915\u094d\u0937"):
        text = unit * 200
        assert all((p.end) % len(unit) == 0 for p in sp.split(text, 100, False))
    assert len(sp.split("a" + "\u0301" * 300, 100, False)) == 4


@pytest.mark.parametrize("text, cut", [("\n" * 600, "paragraph"), (" " * 600, "word"), ("日本語の文です。" * 90, "forced"), ("日本語の文です。 " * 90, "word"), (" " * 501 + "\n\n" + "a", "word")])
def test_cut_at_of_white_space_and_of_sentences_without_it(text, cut):
    assert sp.cut_at(text, 500, False) == cut
