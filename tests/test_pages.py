from datetime import datetime

from pyspark.sql import functions as F

from foliant.functions import kinds
from foliant.operators import annotations, concepts, pages, segments, store

DAY = datetime(2025, 1, 1)
ITEMS = "item_key long, document_id string, page int, item_no int, str string, normalized_str string, has_eol boolean, ingested_at timestamp"


def items(spark, rows):
    return spark.createDataFrame([(n, "d", p, i, s, " ".join(s.split()) if s is not None else None, e, DAY) for n, (p, i, s, e) in enumerate(rows)], ITEMS)


PAGE = [(1, 1, "A ", False), (1, 2, "trans-", True), (1, 3, "former spans   lines.", True), (1, 4, "Repeated phrase.", False), (1, 5, "Repeated phrase.", False), (2, 1, "Unicode café text.", None)]


def test_pages_are_folded_with_hyphens_joined(spark):
    placed = pages.placed_items(items(spark, PAGE))
    rows = {(r["page"], r["item_no"]): r for r in placed.collect()}
    second = rows[1, 2]
    assert (second["raw_start"], second["raw_end"], second["start"], second["end"]) == (2, 8, 2, 7)
    text = {r["page"]: r for r in pages.page_texts(placed).collect()}
    assert text[1]["normalized_text"] == "A transformer spans lines. Repeated phrase. Repeated phrase."
    assert text[2]["normalized_text"] == "Unicode café text." and text[1]["raw_text"].startswith("A trans-\nformer")


def test_offsets_agree_with_a_plain_loop(spark, data):
    rows = pages.delivered_items(spark.read.parquet(f"{data}/text_items.parquet"))
    got = {(r["document_id"], r["page"], r["item_no"]): (r["start"], r["end"], r["raw_start"], r["raw_end"]) for r in pages.placed_items(rows).collect()}
    by_page = {}
    for r in rows.collect():
        if r["str"] is not None:
            by_page.setdefault((r["document_id"], r["page"]), []).append(r)
    size = lambda s: len(s.encode("utf-16-le")) // 2
    for key, own in by_page.items():
        raw = norm = ""
        last = None
        for r in sorted(own, key=lambda r: r["item_no"]):
            n = r["normalized_str"] or ""
            if last is not None and last["has_eol"] and (last["normalized_str"] or "").endswith("-") and n:
                norm = norm[:-1]
                k = (*key, last["item_no"])
                assert got[k][1] == size(norm)
            elif n and norm and not norm.endswith(" "):
                norm += " "
            a, ra = size(norm), size(raw)
            norm += n
            raw += r["str"]
            cell = got[(*key, r["item_no"])]
            assert cell[0] == a and cell[2:] == (ra, size(raw))
            raw += "\n" if r["has_eol"] else ""
            last = r


def test_units_over_items(spark):
    placed = pages.placed_items(items(spark, PAGE))
    units = segments.sentences(pages.page_texts(placed), "normalized_text", "document_id", "page")
    assert [(r["page"], r["sent_no"]) for r in units.orderBy("page", "sent_no").collect()] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    over = pages.item_overlaps(units, placed).filter("page = 1 and sent_no = 1").orderBy("item_no").collect()
    assert [(r["item_no"], r["item_start"], r["item_end"]) for r in over] == [(1, 0, 1), (2, 0, 5), (3, 0, 19)]
    read = pages.reading_units(pages.page_texts(placed)).filter("page = 1").orderBy("sent_no").collect()
    assert read[1]["text"] == read[2]["text"] and read[1]["prefix"] and read[1]["prefix"] != read[2]["prefix"]


def test_legacy_sentences(spark):
    rows = spark.createDataFrame([(1, "First sentence. Second sentence!"), (2, None), (3, "  "), (4, 'He said "go." Then left.')], "k long, t string")
    got = segments.sentences(rows, "t", "k", closers=False, unit=F.char_length).orderBy("k", "sent_no").collect()
    assert [tuple(r)[:5] for r in got][:2] == [(1, 1, "First sentence.", 0, 15), (1, 2, "Second sentence!", 16, 32)]
    assert [r["text"] for r in got if r["k"] == 4] == ['He said "go." Then left.']
    assert [r["text"] for r in segments.sentences(rows, "t", "k").filter("k = 4").orderBy("sent_no").collect()] == ['He said "go."', "Then left."]


def test_offsets_are_utf16(spark):
    rows = spark.createDataFrame([(1, "😀 one. 　Two")], "k long, t string")
    assert [(r["start"], r["end"]) for r in segments.sentences(rows, "t", "k").orderBy("sent_no").collect()] == [(0, 7), (9, 12)]


def test_paragraph_packing(spark):
    long = "x" * 900
    rows = spark.createDataFrame([(1, "First idea.\n\nSecond idea."), (2, "\n\n".join([long, long, "y" * 2000, "z"])), (3, ""), (4, None)], "k long, t string")
    got = {}
    for r in segments.chunks(rows, "t", "k").orderBy("k", "chunk_no").collect():
        got.setdefault(r["k"], []).append(r["text"])
    assert got == {1: ["First idea.\n\nSecond idea."], 2: [long, long, "y" * 2000, "z"]}


def test_kinds(spark):
    units = [
        (1, 1, 0, "reader@example.org", "metadata"), (1, 2, 40, "Novelty And Bridges In Reading", "metadata"), (1, 3, 90, "Introduction.", "heading"), (1, 4, 600, "Novelty And Bridges In Reading", "body_sentence"),
        (1, 5, 700, "2.1. Results of the run", "heading"), (2, 1, 0, "Too short.", "short_fragment"), (2, 2, 20, "a + b = c | d = 12 | 13", "formula_or_table"), (2, 3, 60, "Table 4 shows the sizes.", "formula_or_table"),
        (2, 4, 90, "The cache tier reordered the whole index.", "body_sentence"), (3, 1, 0, "[4] A. Author, a title.", "reference"), (3, 2, 30, "References", "heading"), (3, 3, 50, "Anything after it stays one.", "reference"), (4, 1, 0, "Also on the next page it does.", "reference"),
    ]
    df = spark.createDataFrame([("d", p, n, s, t) for p, n, s, t, _ in units], "document_id string, page int, sent_no int, start int, text string")
    got = {(r["page"], r["sent_no"]): r["kind"] for r in pages.with_kinds(df).collect()}
    assert got == {(p, n): k for p, n, _, _, k in units} and set(got.values()) <= set(kinds.KINDS)


def test_line_groups_round_half_up(spark):
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate([0.0, 1.9, 2.0, 5.9, 6.0])], "document_id string, page int, item_no int, top double")
    assert {r["line"]: r["n_items"] for r in pages.line_groups(df, F.col("top")).collect()} == {0: 2, 4: 2, 8: 1}
    assert sorted(r["item_no"] for r in pages.whole_lines(df, df.filter("item_no = 1"), F.col("top")).collect()) == [0, 1]


def test_span_index_skips_empty_items(spark):
    df = items(spark, [(1, 1, "a", False), (1, 2, "", False), (1, 3, "b", False), (1, 4, None, False)])
    assert {r["item_no"]: r["span"] for r in pages.span_index(df).collect()} == {1: 0, 2: None, 3: 1, 4: None}


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Cachet cachet, index-index; because BECAUSE zebras Zebras"), (2, None)], "k long, t string")
    got = [(r["rank"], r["word"], r["n"]) for r in concepts.top_keywords(df, "t", "k").orderBy("rank").collect()]
    assert got == [(1, "Cachet", 2), (2, "Zebras", 2)]


def test_parsing_of_enums(spark):
    df = spark.createDataFrame([(" Delta", "Soft-Fade"), ("bridge", "fade"), ("x", "leave normal"), (None, None)], "p string, d string")
    got = annotations.parsed(df, "p", "d").collect()
    assert [(r["priority"], r["directive"]) for r in got] == [("delta", "soft_fade"), ("bridge", "soft_fade"), (None, "leave_normal"), (None, None)]
    row = spark.range(1).select(annotations.directive_of(F.lit("familiar")), annotations.confidence_of(F.lit("familiar")), annotations.label_of(F.lit("delta"))).first()
    assert tuple(row) == ("soft_fade", 0.68, "New insight")


def test_first_entry_blocks_later_ones(spark):
    df = spark.createDataFrame([(1, "s", "bad"), (2, "s", "delta"), (3, "t", "delta")], "n int, id string, p string")
    kept = annotations.first_of_each(df, ["id"], "n").filter(annotations.priority(F.col("p")).isNotNull())
    assert [r["id"] for r in kept.collect()] == ["t"]


def test_anchors(spark):
    st = spark.createDataFrame([(1, n, t, 10 * n, 10 * n + 9) for n, t in enumerate(["The first sentence is long.", "The second one too.", "Short", "x" * 600], 1)], "chunk_key long, sent_no int, text string, start int, end int")
    asked = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [1, 3]), (1, 3, [2, 1]), (1, 4, [3]), (1, 5, [4]), (1, 6, [9]), (1, 7, []), (1, 8, [1, 2, 3, 4]), (1, 9, [2])], "chunk_key long, anchor_no int, sent_nos array<int>")
    got = {r["anchor_no"]: (r["text"], r["start"], r["end"]) for r in annotations.anchors(asked, st).collect()}
    assert got == {1: ("The first sentence is long. The second one too.", 10, 29), 4: ("Short", 30, 39)}


def test_fallback_and_choice_of_kind(spark):
    units = spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, k int")
    ann = spark.createDataFrame([(1, "delta")], "k int, priority string")
    got = {r["k"]: (r["priority"], r["generated"]) for r in annotations.with_fallback(units, ann, ["k"], priority="bridge").collect()}
    assert got == {1: ("delta", True), 2: ("bridge", False)}
    other = spark.createDataFrame([("d", 7), ("e", 8)], "document_id string, k int")
    assert sorted(r["k"] for r in annotations.best_kind(units, other).collect()) == [1, 2, 8]


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert store.lookup(old, "k", 2).count() == 1
    at = spark.createDataFrame([(1, datetime(2025, 1, 1, 6)), (2, datetime(2025, 1, 1, 5, 59))], "k int, t timestamp")
    assert [r["k"] for r in store.unexpired(at, "t", F.lit(datetime(2025, 1, 1, 12))).collect()] == [1]
    same = store.same_content(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "k int, t string"), "k", "t").collect()
    assert [(r["n"], r["first_key"]) for r in same] == [(2, 1)]


def test_valid_annotations_and_plain_names(spark):
    rows = [("delta", "highlight", 0.5), ("delta", "other", 0.5), ("delta", "highlight", float("nan")), ("x", "callout", 0.5), ("bridge", "callout", 1.1), ("bridge", "callout", None), ("familiar", "leave_normal", 1.0)]
    df = spark.createDataFrame(rows, "p string, d string, c double")
    assert [r[0] for r in df.select(annotations.is_valid(F.col("p"), F.col("d"), F.col("c"))).collect()] == [True, False, False, False, False, False, True]
    names = spark.createDataFrame([("a-b_1",), (".a",), ("a/b",), ("",), (None,), ("a.b",)], "n string")
    assert [r[0] for r in names.select(annotations.is_plain_name(F.col("n"))).collect()] == [True, False, False, False, False, True]
