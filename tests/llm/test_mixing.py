import numpy as np

from foliant.llm import mixing as mx

DOCS, TARGETS = "doc_id long, source string, text string", "source string, target_share double, max_repeats int"


def mixture(spark, docs, targets, **options):
    return mx.Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **options)


def test_repeats_invert_the_poisson_distribution():
    for mean in (0.2, 1.0, 3.5):
        k = mx.repeats(mean, 30)
        assert abs(k.mean() - mean) < 0.01 and abs(k.var() - mean) < 0.05
        assert (np.diff(k) >= 0).all()
    assert mx.repeats(50.0, 3).max() == 3 and mx.repeats(0.0, 3).max() == 0


def test_fit_mean_comes_close():
    tokens = np.ones(mx.DRAWS)
    for target in (100.0, 2048.0, 9000.0):
        mean = mx.fit_mean(tokens, 8, target)
        assert abs(tokens @ mx.repeats(mean, 8) - target) <= 2


def docs(n=4000):
    spelled = {"big": ["big", " Big", "BIG ", "big"], "small-set": ["small-set", "small_set", "Small Set", "SMALL-SET"]}
    return [(i, spelled["small-set" if i % 8 == 0 else "big"][i % 4 if i % 8 else i // 8 % 4], "some words " * (1 + i % 5)) for i in range(n)]


def test_shares_hold_and_caps_are_kept(spark):
    m = mixture(spark, docs(), [("big", 0.5, 1), ("small-set", 0.5, 4)])
    by = {r["source"]: r for r in m.shares().collect()}
    assert set(by) == {"big", "small-set"}
    for s in by:
        assert abs(by[s]["actual_share"] - 0.5) < 0.01
    assert by["big"]["most_repeats"] == 1 and by["small-set"]["most_repeats"] <= 4
    rows = m.mixture().collect()
    chosen = {r["doc_id"]: r["repeats"] for r in m.chosen().collect()}
    assert len(rows) == sum(chosen.values()) and [r["order_key"] for r in rows] == sorted(r["order_key"] for r in rows)
    assert sum(r["n_tokens"] for r in rows) == sum(r["mixed_tokens"] for r in by.values())


def test_same_seed_same_choice_other_seed_another(spark):
    t = [("big", 0.5, 1), ("small-set", 0.5, 4)]
    pick = lambda seed: sorted(map(tuple, mixture(spark, docs(800), t, seed=seed).chosen().collect()))
    assert pick(0) == pick(0) != pick(1)


def test_nulls_unknown_sources_missing_targets_and_extra_columns(spark):
    rows = [(1, None, "a b c"), (2, "other", "a b"), (3, "big", None), (4, "big", ""), (5, "big", "one two"), (5, "big", "one two")]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as draw", "2 as repeats", "3 as n_tokens")
    m = mx.Mixture(frame, spark.createDataFrame([("big", 0.7, None), ("absent", 0.3, 5)], TARGETS))
    by = {r["source"]: r for r in m.shares().collect()}
    assert by["big"]["actual_share"] == 1.0 and by["absent"]["mixed_tokens"] == 0 and by[""]["target_share"] == 0.0 and by["other"]["n_chosen"] == 0
    assert [(r["doc_id"], r["repeats"]) for r in m.chosen().collect()] == [(5, 1), (5, 1)]


def test_empty_tables(spark):
    m = mixture(spark, [], [("big", 1.0, 2)])
    assert m.mixture().count() == 0 and [r["mixed_tokens"] for r in m.shares().collect()] == [0]
    assert mixture(spark, [(1, "big", "a")], []).mixture().count() == 0


def test_a_large_cap_is_reached(spark):
    for cap in (1, 40, 400, 2000):
        assert (mx.repeats(mx.top_mean(cap), cap) == cap).all()
    assert all(a <= b for a, b in zip(mx.cumulative(900.0, 1000), mx.cumulative(900.0, 1000)[1:])) and abs(mx.cumulative(900.0, 1400)[-1] - 1) < 1e-9
    tiny, big = [(i, "tiny", "a few words") for i in range(20)], [(100 + i, "big", "some words " * 40) for i in range(400)]
    by = {r["source"]: r for r in mixture(spark, tiny + big, [("tiny", 0.5, 400), ("big", 0.5, 1)]).shares().collect()}
    assert abs(by["tiny"]["actual_share"] - 0.5) < 0.02 and abs(by["tiny"]["deviation"]) < 0.02 and by["tiny"]["most_repeats"] > 100


def test_the_total_may_be_chosen(spark):
    some = docs(2000)
    targets = [("big", 0.5, 1), ("small-set", 0.5, 4)]
    for total in (2000, 4000):
        assert abs(sum(r["mixed_tokens"] for r in mixture(spark, some, targets, total_tokens=total).shares().collect()) - total) < 60
    by = {r["source"]: r for r in mixture(spark, some, targets, total_tokens=10**9).shares().collect()}
    assert by["big"]["most_repeats"] == 1 and by["small-set"]["most_repeats"] == 4
