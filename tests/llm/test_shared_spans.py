import random

from foliant.llm import shared_spans as ss

DOCS = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def brute(rows, length):
    """Pairs and shared characters by looking up every window."""
    held = {}
    for i, text in rows:
        for s in range(len(text or "") - length + 1):
            held.setdefault(text[s : s + length], set()).add(i)
    pairs, covered = set(), {}
    for i, text in rows:
        for s in range(len(text or "") - length + 1):
            others = held[text[s : s + length]]
            if len(others) > 1:
                covered.setdefault(i, set()).update(range(s, s + length))
            pairs |= {(a, b) for a in others for b in others if a < b}
    return sorted(pairs), {i: len(c) for i, c in covered.items()}


def corpus(seed, n=60, length=40):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh é漢😀") for _ in range(k))
    passages = [word(r.choice([length - 1, length, length + 1, length + 7, 2 * length, 5 * length])) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [word(r.randrange(0, 3 * length))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p) + 1), r.randrange(len(p) + 1)))
            parts += [p if r.random() < 0.6 else p[a:b], word(r.randrange(0, 2 * length))]
        rows.append((i, "".join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, None), (n + 3, ""), (n + 4, word(length) * 3)]


def test_pairs_and_coverage_equal_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        pairs, covered = brute(rows, 40)
        assert pairs
        df = frame(spark, rows)
        assert sorted(map(tuple, ss.SharedSpans(df, 40).pairs().collect())) == pairs
        report = {r["doc_id"]: r for r in ss.SharedSpans(df, 40, edges=True).report(df).collect()}
        assert {i: r["shared_chars"] for i, r in report.items() if r["shared_chars"]} == covered
        assert len(report) == len(rows)


def test_local_minima_agree_on_common_runs():
    import numpy as np

    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 60, 400, dtype=np.uint64)
    b = np.concatenate([r.integers(0, 1 << 60, 57, dtype=np.uint64), a[100:220]])
    at = lambda x: set(ss.local_minima(x, np.ones(len(x), bool), 100).tolist())
    assert {p - 100 for p in at(a) if 100 <= p < 220} & {p - 57 for p in at(b)}


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    monkeypatch.setattr(ss, "SEGMENT", 500)
    rows = corpus(9, n=20)
    rows.append((900, "".join(t or "" for _, t in rows)))
    assert sorted(map(tuple, ss.SharedSpans(frame(spark, rows), 40).pairs().collect())) == brute(rows, 40)[0]


def test_very_long_text_repeats_empty_tables_and_extra_columns(spark):
    base = "".join(random.Random(1).choice("abcdefghij") for _ in range(300))
    rows = [(1, "x" * 2_000_000), (2, base), (2, base), (3, base + "tail"), (4, "short")]
    df = frame(spark, rows).selectExpr("*", "1 as q", "2 as h", "3 as places", "4 as key", "5 as rep")
    assert [tuple(r) for r in ss.SharedSpans(df, 200).pairs().collect()] == [(2, 3)]
    empty = frame(spark, [])
    assert ss.SharedSpans(empty).pairs().count() == 0 and ss.SharedSpans(empty, edges=True).report(empty).count() == 0


def test_copies_of_one_text_are_one_class(spark):
    text = "".join(random.Random(2).choice("abcdefghij") for _ in range(120))
    rows = [(i, text) for i in range(12)] + [(99, "zz" + text[:80] + "yy")]
    pairs = sorted(map(tuple, ss.SharedSpans(frame(spark, rows), 40).pairs().collect()))
    assert pairs == brute(rows, 40)[0] and len(pairs) == 12 * 11 // 2 + 12


def test_passages_keep_every_link_and_no_other(spark):
    for seed in (4, 5):
        rows = corpus(seed)
        held, same = {}, {}
        for r in ss.SharedSpans(frame(spark, rows), 40).passages().collect():
            (same if r["passage"].startswith("text:") else held).setdefault(r["passage"], set()).add(r["doc_id"])
        rep = {i: min(own) for own in same.values() for i in own}
        links = {(a, b) for own in held.values() for a in own for b in own if a < b}
        pairs = {(rep.get(a, a), rep.get(b, b)) for a, b in brute(rows, 40)[0]}
        assert links == {(min(p), max(p)) for p in pairs if p[0] != p[1]}
        assert sum(map(len, same.values())) == 3


def test_longest_doubles_until_none_survives(spark):
    r = random.Random(7)
    word = lambda k: "".join(r.choice("abcdefgh") for _ in range(k))
    long, short = word(900), word(60)
    rows = [(1, word(30) + long + word(9)), (2, long[:700]), (3, short + word(50)), (4, word(20) + short), (5, word(300)), (6, short * 2), (7, "same " * 20), (8, "same " * 20)]
    got = {x["doc_id"]: x["shared_at_least"] for x in ss.SharedSpans(frame(spark, rows), 40).longest().collect()}
    assert got[1] == got[2] == 640 and got[7] == got[8] == 100 and 5 not in got
    assert all(got.get(i, 40) == 40 for i in (3, 4, 6))
    assert ss.SharedSpans(frame(spark, []), 40).longest().count() == 0
