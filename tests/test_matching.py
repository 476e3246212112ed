import random

from pyspark.sql import functions as F

from foliant.operators import allocation, diagnostics, evaluation, matching


def plain_matches(page, part):
    """The search restated with loops."""
    if not part:
        return []
    spoken = [w for w in part.split(" ") if len(w) > 2]
    if part in page:
        return [(page.index(part), page.index(part) + len(part), len(spoken))]
    out = []
    for size in matching.WINDOW_SIZES:
        for i in range(0, len(spoken) - size + 1, size // 2):
            phrase = " ".join(spoken[i : i + size])
            at = page.find(phrase)
            if at >= 0 and not any(at < e and at + len(phrase) > s for s, e, _ in out):
                out.append((at, at + len(phrase), size))
        if len(out) >= matching.ENOUGH:
            break
    return sorted(out)


def test_phrase_windows_equal_a_plain_search(spark):
    r = random.Random(4)
    vocabulary = ["abc", "of", "cache", "tier", "an", "index", "novelty", "gate", "zone"]
    rows = []
    for n in range(60):
        page = [r.choice(vocabulary[:1] + vocabulary[2:4] + vocabulary[5:]) for _ in range(r.randrange(0, 160))]
        a = r.randrange(0, max(1, len(page)))
        part = page[a : a + r.randrange(0, 60)]
        if part and r.random() < 0.6:
            part[r.randrange(len(part))] = "changed"
        rows.append((n, " ".join(page), " ".join(part)))
    df = spark.createDataFrame(rows, "k int, page string, part string")
    got = {r["k"]: [tuple(m) for m in r["m"]] for r in df.select("k", matching.phrase_matches(F.col("page"), F.col("part")).alias("m")).collect()}
    want = {k: plain_matches(page, part) for k, page, part in rows}
    assert got == want and any(len(m) > 1 for m in want.values())


def test_words_needed(spark):
    df = spark.createDataFrame([("delta", 0.0), ("delta", 1.0), ("familiar", 0.9)], "s string, c double")
    assert [r[0] for r in df.select(matching.words_needed(F.col("c"), F.col("s"))).collect()] == [20, 12, 18]
    assert [r[0] for r in df.select(matching.words_needed(F.col("c"), F.col("s"), focus=True)).collect()] == [20, 20, 24]


def test_best_window(spark):
    df = spark.createDataFrame([("a b c d e f", "c x d"), ("a a a", "a b"), ("", "a"), ("a", ""), ("a b", "z")], "p string, q string")
    got = [(round(r["b"]["score"], 4), r["b"]["text"]) for r in df.select(matching.best_window(F.col("p"), F.col("q")).alias("b")).collect()]
    assert got == [(0.6667, "b c d"), (0.6667, "a a"), (0.0, ""), (0.0, ""), (0.0, "")]


def test_resolved_ranges(spark):
    items = spark.createDataFrame([("d", 1, 1, "ab", "ab"), ("d", 1, 2, "", ""), ("d", 1, 3, "cde", "cde")], "document_id string, page int, item_no int, str string, normalized_str string")
    asked = [("p1i1", 0, 2), ("p1i3", 1, 3), ("p1i2", 0, 1), ("p2i1", 0, 1), ("x", 0, 1), ("p1i9", 0, 1), ("p1i3", 1, 4), ("p1i3", 2, 2), ("p1i3", -1, 2)]
    ranges = spark.createDataFrame([("d", 1, n, i, s, e) for n, (i, s, e) in enumerate(asked)], "document_id string, page int, range_no int, item_id string, start int, end int")
    got = {r["range_no"]: (r["status"], r["span"], r["full_item"]) for r in matching.resolve_ranges(ranges, items).collect()}
    bad = ("invalid_item", None, None)
    assert got == {0: ("fragment", 0, True), 1: ("fragment", 1, False), 2: ("missing_span", None, None), **dict.fromkeys(range(3, 9), bad)}


def test_raw_place(spark):
    df = spark.createDataFrame([("a   b c",)], "s string")
    form = lambda c: F.trim(F.regexp_replace(c, " +", " "))
    assert df.select(matching.raw_place(F.col("s"), F.lit(3), form)).first()[0] == 5


def plain_allocation(n_spans, cands):
    styles, taken, out = {}, set(), {}
    for style, _, share in allocation.STYLES:
        cap, used = max(1, int(n_spans * share)), 0
        own = sorted((c for c in cands if c[1] == style and c[4]), key=lambda c: (-c[2], -len(c[4]), c[3]))
        for unit, _, _, _, spans in own:
            free = [s for s in spans if s not in taken]
            if used >= cap:
                out[unit] = ("density_cap", [])
            elif not free:
                out[unit] = ("overlap_conflict", [])
            elif used + len(free) > cap:
                out[unit] = ("density_cap", [])
            else:
                taken.update(free)
                used += len(free)
                out[unit] = ("allocated", free)
    return out


def test_allocation_equals_a_plain_loop(spark):
    r = random.Random(7)
    rows, counts, want = [], [], {}
    for page in range(60):
        n = r.randrange(1, 60)
        counts.append(("d", page, n))
        cands = []
        for o in range(r.randrange(0, 12)):
            a = r.randrange(n)
            spans = list(range(a, min(n, a + r.randrange(0, 6))))
            cands.append((f"{page}-{o}", r.choice(["delta", "familiar"]), r.choice([0.5, 0.7, 0.9]), o, spans))
        rows += [("d", page, *c) for c in cands]
        want |= plain_allocation(n, cands)
    df = spark.createDataFrame(rows, "document_id string, page int, unit string, style string, confidence double, ordinal int, spans array<int>")
    got = allocation.allocate(df, spark.createDataFrame(counts, "document_id string, page int, n_spans int")).collect()
    assert {x["unit"]: (x["result"], x["spans"]) for x in got} == want
    assert {v[0] for v in want.values()} == {"allocated", "density_cap", "overlap_conflict"}


def test_match_ranges_join_hyphenated_items(spark):
    items = spark.createDataFrame([("d", 1, i, s) for i, s in enumerate(["Cut-", "off", "", "Next 1"], 1)], "document_id string, page int, item_no int, str string")
    ranges = diagnostics.match_ranges(items)
    assert diagnostics.match_text(ranges).first()["whole"] == "cutoff  next 1"
    m = spark.createDataFrame([("u", "d", 1, 2, 9)], "unit string, document_id string, page int, start int, end int")
    assert sorted(r["item_no"] for r in diagnostics.items_of_matches(m, ranges).collect()) == [1, 2, 3, 4]


def test_metrics_and_thresholds(spark):
    rows = [("f", "delta", "delta", "highlight"), ("f", "delta", "familiar", "soft_fade"), ("f", "familiar", "familiar", "soft_fade"), ("f", "bridge", "delta", "highlight"), ("g", "bridge", "bridge", "callout")]
    pairs = spark.createDataFrame(rows, "fixture string, expected string, predicted string, directive string")
    pages = spark.createDataFrame([("f", 2)], "fixture string, n_pages int")
    got = {r["fixture"]: r for r in evaluation.metrics(pairs, pairs, pages, ["fixture"]).collect()}
    assert got["f"]["delta_precision"] == 0.5 and got["f"]["delta_recall"] == 0.5 and got["f"]["familiar_suppression_rate"] == 1.0 and got["f"]["visible_guidance_per_page"] == 2.0
    assert got["g"]["delta_precision"] is None and got["g"]["visible_guidance_per_page"] == 0.0
    bounds = spark.createDataFrame([("f", 0.5, 0.6, None, None, 1.0, 1), ("g", 0.1, None, None, 0.2, None, None)], "fixture string, delta_precision_min double, delta_recall_min double, familiar_suppression_rate_min double, known_as_delta_rate_max double, visible_guidance_per_page_max double, false_negative_delta_count_max int")
    broken = sorted((r["fixture"], r["metric"]) for r in evaluation.violations(bounds, evaluation.metrics(pairs, pairs, pages, ["fixture"]), "fixture").collect())
    assert broken == [("f", "delta_recall"), ("f", "visible_guidance_per_page"), ("g", "delta_precision")]
    groups = sorted(r["error_group"] for r in evaluation.error_groups(pairs).collect())
    assert groups == ["bridge_confusion", "false_negative_delta", "false_positive_delta"]


def test_counts_and_rollup(spark):
    df = spark.createDataFrame([("d", 1, "x"), ("d", 1, "y"), ("d", 2, "x"), ("d", 2, None)], "document_id string, page int, s string")
    pages = diagnostics.page_counts(df, "s", {"n_x": F.col("s") == "x"}, "document_id", "page")
    got = {r["page"]: (r["n"], r["n_x"], r["by_status"]) for r in pages.collect()}
    assert got == {1: (2, 1, {"x": 1, "y": 1}), 2: (2, 1, {"x": 1})}
    assert diagnostics.merged_counts(pages, "by_status", "document_id").first()["by_status"] == {"x": 2, "y": 1}
    top = diagnostics.top_or_first(df, F.coalesce(F.col("s") == "y", F.lit(False)), "page", 5, 1, "s")
    assert sorted((r["page"], r["s"]) for r in top.collect()) == [(1, "y"), (2, None)]


def test_label_joins(spark):
    c = spark.createDataFrame([("d", "s1"), ("d", "s2")], "document_id string, sentence_id string")
    labels = spark.createDataFrame([("d", "s1"), ("d", "s1"), ("d", "s9")], "document_id string, sentence_id string")
    k = ["document_id", "sentence_id"]
    assert [r[1] for r in evaluation.unlabelled(c, labels, k).collect()] == ["s2"]
    assert [r[1] for r in evaluation.unknown(labels, c, k).collect()] == ["s9"]
    assert [(r[1], r["n"]) for r in evaluation.repeated(labels, k).collect()] == [("s1", 2)]


def test_pages_holding_a_text_equal_a_plain_search(spark):
    r = random.Random(11)
    pages = [("d", n, " ".join(r.choice(["ab", "cd", "ef", "g"]) for _ in range(30))) for n in range(12)]
    parts = []
    for n in range(60):
        whole = r.choice(pages)[2]
        a = r.randrange(len(whole))
        parts.append(("d", n, whole[a : a + r.randrange(1, 30)].strip()))
    got = matching.pages_holding(spark.createDataFrame(parts, "document_id string, k int, part string"), spark.createDataFrame(pages, "document_id string, other int, whole string"))
    want = sorted((k, n) for _, k, part in parts for _, n, whole in pages if part in whole)
    assert sorted((x["k"], x["other"]) for x in got.collect()) == want
