from hypothesis import given, settings, strategies as st

from foliant.llm import packing as pk
from foliant.llm.tokens import encoding

DOCS, KINDS = "doc_id long, text string", "container_kind string, capacity_tokens int"


@given(st.lists(st.integers(1, 100), max_size=200), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_best_fit_never_overfills_and_takes_the_tightest_bin(sizes, open_bins):
    place, left, still = pk.best_fit(sizes, 100, open_bins)
    used = [0] * len(left)
    opened: list[int] = []
    for size, b in zip(sizes, place):
        fitting = [o for o in opened if 100 - used[o] >= size]
        if fitting:
            assert used[b] == max(used[o] for o in fitting)
            opened.remove(b)
        else:
            assert used[b] == 0
            if len(opened) >= open_bins:
                fullest = max(used[o] for o in opened)
                opened.remove(next(o for o in reversed(opened) if used[o] == fullest))
        used[b] += size
        if used[b] < 100:
            opened.append(b)
        assert len(opened) <= open_bins
    assert [100 - u for u in used] == left and len(still) <= open_bins


def packing(spark, docs, kinds=(("card", 8), ("window", 64)), **options):
    return pk.Packing(spark.createDataFrame(docs, DOCS), spark.createDataFrame(list(kinds), KINDS), **options)


def test_every_token_is_placed_once_and_nothing_overflows(spark):
    docs = [(i, "word " * (i % 40) + "end") for i in range(300)] + [(7, "twice"), (8, None), (9, "")]
    p = packing(spark, docs, group_items=50, open_bins=4)
    rows = p.placement().collect()
    sizes = sum(len(encoding().encode_ordinary(t)) for _, t in docs if t)
    for kind, capacity in (("card", 8), ("window", 64)):
        own = [r for r in rows if r["container_kind"] == kind]
        assert sum(r["n_tokens"] for r in own) == sizes
        used = {}
        for r in own:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
        assert all(u <= capacity for u in used.values())
        assert all(r["unused_tokens"] == capacity - used[r["container_id"]] for r in own)
        assert all(r["token_end"] - r["token_start"] == r["n_tokens"] for r in own)
        cut = {r["doc_id"] for r in own if r["part_no"] > 0}
        assert all(len(encoding().encode_ordinary("word " * (i % 40) + "end")) > capacity for i in cut)
    unused = {r["container_kind"]: r for r in p.unused().collect()}
    assert unused["window"]["unused_share"] < 0.1


def test_same_containers_whatever_the_partitioning(spark):
    docs = [(i, "w " * (i % 17) + "x") for i in range(200)]
    a = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as bin", "2 as grp", "'k' as container_kind")
    kinds = spark.createDataFrame([("card", 16)], KINDS)
    one = sorted(map(tuple, pk.Packing(a.coalesce(1), kinds, group_items=40).placement().collect()))
    many = sorted(map(tuple, pk.Packing(a.repartition(7), kinds, group_items=40).placement().collect()))
    assert one == many


def test_empty_tables(spark):
    assert packing(spark, []).placement().count() == 0
    assert packing(spark, [(1, "a")], kinds=()).placement().count() == 0


def test_very_long_text(spark):
    p = packing(spark, [(1, "word " * 50_000)], kinds=(("card", 256),))
    assert sum(r["n_tokens"] for r in p.placement().collect()) == len(encoding().encode_ordinary("word " * 50_000))


def test_kinds_of_one_name_and_without_a_name(spark):
    docs = [(i, "word " * (i % 90)) for i in range(200)]
    rows = packing(spark, docs, kinds=(("a", 50), ("a", 100), (None, 70)), group_items=50, open_bins=4).placement().collect()
    used = {}
    for r in rows:
        used.setdefault((r["container_kind"], r["capacity_tokens"], r["container_id"]), []).append(r)
    assert {k[:2] for k in used} == {("a", 50), ("a", 100), ("", 70)} and len({k[2] for k in used}) == len(used)
    assert all(sum(r["n_tokens"] for r in own) + r0["unused_tokens"] == k[1] for k, own in used.items() for r0 in own)
    per = {}
    for (kind, capacity, _), own in used.items():
        per[kind, capacity] = per.get((kind, capacity), 0) + sum(r["n_tokens"] for r in own)
    assert len(set(per.values())) == 1
