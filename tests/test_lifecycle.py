import random

import pytest
from pyspark.sql import functions as F


from foliant.operators import allocation, labelqa, lifecycle, segments, store

ROWS = "unit long, document_id string, page int, text string, priority string, directive string, confidence double, source string"
ITEMS = "document_id string, page int, item_no int, str string"
#: One page of 20 items of eight words each, all different.
LINES = [" ".join(f"word{n:02d}x{k}" for k in range(8)) for n in range(20)]


def states(spark, rows, items=None):
    items = [("d", 1, n, t) for n, t in enumerate(LINES)] if items is None else items
    return lifecycle.page_lifecycle(spark.createDataFrame(rows, ROWS), spark.createDataFrame(items, ITEMS))


def one(unit, text, directive="highlight", confidence=0.9, priority="delta"):
    return (unit, "d", 1, text, priority, directive, confidence, "model")


def test_states_and_reasons(spark):
    changed = LINES[8].split(" ")
    rows = [
        one(1, LINES[0]), one(2, LINES[0], confidence=0.8), one(3, "nothing of this is there at all"), one(4, LINES[1], "callout"), one(5, LINES[2], "leave_normal"), one(6, LINES[3], "shout"),
        one(7, LINES[4], confidence=float("nan")), one(8, None), one(9, " ".join(LINES[5:10]), confidence=0.7), one(10, " ".join(changed[:6] + ["new", "words"]), "soft_fade", priority="familiar"),
        (11, "other", 1, LINES[0], "delta", "highlight", 0.9, None),
    ]
    got = {r["unit"]: (r["state"], r["reason"]) for r in states(spark, rows).collect()}
    assert got == {
        1: ("rendered_inline", None), 2: ("dropped", "overlap_conflict"), 3: ("dropped", "unmatched_text"), 4: ("rendered_as_page_note", None), 5: ("left_normal", None), 6: ("dropped", "invalid"),
        7: ("dropped", "invalid"), 8: ("dropped", "unmatched_text"), 9: ("dropped", "density_cap"), 10: ("dropped", "unmatched_text"), 11: ("dropped", "unmatched_text"),
    }


def test_focus_has_lower_caps(spark):
    rows = [one(n, LINES[n]) for n in range(4)]
    shown = lambda focus: lifecycle.page_lifecycle(spark.createDataFrame(rows, ROWS), spark.createDataFrame([("d", 1, n, t) for n, t in enumerate(LINES)], ITEMS), focus).filter("state = 'rendered_inline'").count()
    assert (shown(False), shown(True)) == (3, 2)


def test_a_delta_without_a_match_takes_lines_like_it(spark):
    words = LINES[6].split(" ")
    (row,) = states(spark, [one(1, " ".join(words[:3] + ["quite", "another"] + words[3:6]))]).collect()
    assert (row["state"], row["repaired"], row["candidate"], row["n_spans"]) == ("inline_fallback_without_usable_match", True, False, 1)


def test_counts_maps_and_checks(spark):
    rows = states(spark, [one(n, LINES[n % 4], d) for n, d in enumerate(["highlight", "callout", "leave_normal", "shout"] * 3)])
    (c,) = lifecycle.lifecycle_counts(rows, "document_id", "page").collect()
    assert c["generated"] == 12 and c["invalid"] == 3 and c["by_source"] == {"model": 12} and len(lifecycle.COUNTS) == 20
    assert sum(c[s] for s in lifecycle.STATES) == 12 and sum(c["drop_reasons"].values()) == c["dropped"]
    assert lifecycle.broken(rows, lifecycle.lifecycle_counts(rows, "document_id", "page"), "document_id", "page").count() == 0
    empty = states(spark, [])
    assert lifecycle.lifecycle_counts(empty, "document_id").count() == 0


FACTS = "unit long, state string, reason string, usable boolean, candidate boolean, attempted boolean, validated boolean, by_phrase boolean, repaired boolean, n_spans int, directive string, source string, page int"


@pytest.mark.parametrize("name, change", [
    ("dropped_has_reason", {"state": "dropped", "reason": None}), ("shown_has_no_reason", {"reason": "density_cap"}), ("inline_is_usable", {"usable": False}), ("inline_has_spans", {"n_spans": 0}),
    ("note_is_not_searched", {"state": "left_normal"}), ("fallback_is_not_usable", {"state": "inline_fallback_without_usable_match"}), ("usable_were_candidates", {"candidate": False}),
    ("candidates_were_attempted", {"attempted": False}), ("states_add_up", {"state": "lost"}), ("inline_were_usable", {"usable": False}),
])
def test_every_check_finds_its_fault(spark, name, change):
    good = {"unit": 1, "state": "rendered_inline", "reason": None, "usable": True, "candidate": True, "attempted": True, "validated": True, "by_phrase": False, "repaired": False, "n_spans": 2, "directive": "highlight", "source": "m", "page": 1}
    rows = spark.createDataFrame([tuple((good | change).values())], FACTS)
    assert name in {r["check"] for r in lifecycle.broken(rows, lifecycle.lifecycle_counts(rows, "page"), "page").collect()}
    fine = spark.createDataFrame([tuple(good.values())], FACTS)
    assert lifecycle.broken(fine, lifecycle.lifecycle_counts(fine, "page"), "page").count() == 0


def plain_allocation(candidates, n_spans):
    """The rules restated with loops."""
    taken, out = set(), {}
    for style, _, share in allocation.STYLES:
        cap, used = max(1, int(n_spans * share)), 0
        own = [c for c in candidates if c[1] == style and c[4]]
        for unit, _, confidence, ordinal, spans in sorted(own, key=lambda c: (-c[2], -len(c[4]), c[3])):
            free = [s for s in spans if s not in taken]
            if used >= cap:
                out[unit] = "density_cap", []
            elif not free:
                out[unit] = "overlap_conflict", []
            elif used + len(free) > cap:
                out[unit] = "density_cap", []
            else:
                out[unit] = "allocated", free
                taken.update(free)
                used += len(free)
    return out


def test_allocation_equals_loops(spark):
    r = random.Random(8)
    pages, rows = {}, []
    for page in range(25):
        n = r.randrange(1, 60)
        own = [(page * 100 + k, r.choice(["delta", "familiar"]), r.choice([0.5, 0.7, 0.9]), k, sorted(r.sample(range(n), r.randrange(0, min(n, 6) + 1)))) for k in range(r.randrange(0, 25))]
        pages[page] = n, own
        rows += [("d", page, *c) for c in own]
    cands = spark.createDataFrame(rows, "document_id string, page int, unit long, style string, confidence double, ordinal int, spans array<int>")
    counts = spark.createDataFrame([("d", p, n) for p, (n, _) in pages.items()], "document_id string, page int, n_spans int")
    got = {int(x["unit"]): (x["result"], list(x["spans"])) for x in allocation.allocate(cands, counts).collect()}
    want = {}
    for n, own in pages.values():
        want |= plain_allocation(own, n)
    assert got == want and {v[0] for v in want.values()} == {"allocated", "density_cap", "overlap_conflict"}


LABELS = "label_key long, document_id string, sentence_id string, expected_priority string, expected_directive string, reason string, label_type string, difficulty string, review_status string, allow_non_body boolean, labelled_at timestamp"
CANDS = "candidate_key long, document_id string, sentence_id string, candidate_kind string, text string, item_ranges_present boolean, exported_at timestamp"
KEYS = ["document_id", "sentence_id"]


def test_issues_and_standing_annotations(spark):
    good = ("delta", "highlight", "why")
    labels = [
        (1, "d", "s1", *good, None, None, None, None, None), (2, "d", "s1", *good, "trap", "hard", "draft", None, None), (3, "d", "zz", *good, "odd", None, None, None, None),
        (4, "d", "s2", "Delta", "shout", " ", "odd", "odd", "odd", None, None), (5, "d", "s3", *good, None, None, None, True, None), (6, "d", "s4", *good, None, None, None, None, None), (7, None, None, *good, None, None, None, None, None),
    ]
    cands = [(1, "d", "s1", "body_sentence", "x" * 500, True, None), (2, "d", "s2", "body_sentence", "x", True, None), (3, "d", "s3", "heading", "x" * 501, True, None), (4, "d", "s4", "heading", "h", False, None)]
    df, c = spark.createDataFrame(labels, LABELS), spark.createDataFrame(cands, CANDS)
    got = sorted((r["label_key"], r["issue"]) for r in labelqa.label_issues(df, c, KEYS).collect())
    assert got == sorted([(1, "repeated"), (2, "repeated"), (3, "unknown_sentence"), (6, "not_body"), (7, "unknown_sentence")] + [(4, f"bad_{x}") for x in ("priority", "directive", "label_type", "difficulty", "review_status")] + [(4, "empty_reason")])
    assert [r["annotation_id"] for r in labelqa.standing_annotations(df, c, KEYS, "label_key").collect()] == ["ca-s1"]
    assert [r["sentence_id"] for r in labelqa.gold_template(c, KEYS).orderBy("sentence_id").collect()] == ["s1", "s2"]
    none = df.limit(0)
    assert labelqa.label_issues(none, c.limit(0), KEYS).count() == 0


def test_offsets_of_very_many_sentences(spark):
    text = "".join(f"No {i} é😀. " for i in range(3000))
    (row,) = spark.createDataFrame([(text,)], "t string").select(segments.sentence_spans(F.col("t")).alias("x")).collect()
    raw = text.encode("utf-16-le")
    assert len(row["x"]) == 3000 and all(raw[2 * s["start"] : 2 * s["end"]].decode("utf-16-le") == s["text"] for s in row["x"])


def test_unexpired_without_rows_and_with_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "k int, t timestamp")
    assert store.unexpired_at_last(rows, "t").count() == 0 and store.unexpired_at_last(rows.limit(0), "t").count() == 0
