import json
import random
from collections import defaultdict
from datetime import datetime
from itertools import permutations

import pytest

from foliant.operators import schema_drift as sd

FILES = "file_id long, series string, family string, file_name string, written_at timestamp, received_at timestamp, n_records int"
RECORDS = "record_id long, file_id long, line_no int, payload string"


def tables(spark, files, lines):
    """files: (id, series, day); lines: (file id, payload)."""
    f = [(i, s, "manual_label", f"{i}", datetime(2025, 1, d), datetime(2025, 2, 1), None) for i, s, d in files]
    r = [(n, i, n, p) for n, (i, p) in enumerate(lines)]
    return spark.createDataFrame(r, RECORDS), spark.createDataFrame(f, FILES)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(records, files):
    """The definition, restated with nested loops over decoded payloads."""
    by_file = defaultdict(list)
    for r in records:
        try:
            o = json.loads(r["payload"], parse_float=lambda x: ("number", float(x)), parse_int=lambda x: ("integer", int(x)))
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            by_file[r["file_id"]].append(o)

    def leaves(o, pre=""):
        for k, v in o.items():
            if isinstance(v, dict):
                yield from leaves(v, pre + k + ".")
            elif v is not None:
                t = v[0] if isinstance(v, tuple) else "boolean" if isinstance(v, bool) else "array" if isinstance(v, list) else "string"
                yield pre + k, (t, json.dumps(v))

    out = set()
    series = defaultdict(list)
    for f in files:
        series[f["series"]].append(f)
    for own in series.values():
        own.sort(key=lambda f: (f["written_at"], f["file_id"]))
        for a, b in zip(own, own[1:]):
            key = sd.RECORD_KEYS[a["family"]]
            A, B = by_file[a["file_id"]], by_file[b["file_id"]]
            ta, tb = defaultdict(set), defaultdict(set)
            for t, recs in ((ta, A), (tb, B)):
                for o in recs:
                    for p, (kind, _) in leaves(o):
                        t[p].add(kind)
            shared = {o.get(key) for o in A} & {o.get(key) for o in B} - {None}
            va, vb = defaultdict(set), defaultdict(set)
            for v, recs in ((va, A), (vb, B)):
                for o in recs:
                    if o.get(key) in shared:
                        for p, x in leaves(o):
                            v[p].add((o[key], x))
            for p in ta.keys() & tb.keys():
                if ta[p] != tb[p]:
                    out.add((b["file_id"], "retyped", p, p))
            gone, come = ta.keys() - tb.keys(), tb.keys() - ta.keys()
            pairs = {(p, q) for p in gone for q in come if va[p] and va[p] == vb[q]}
            out |= {(b["file_id"], "renamed", p, q) for p, q in pairs}
            out |= {(b["file_id"], "removed", p, "") for p in gone - {p for p, _ in pairs}}
            out |= {(b["file_id"], "added", "", q) for q in come - {q for _, q in pairs}}
    return sorted(out)


def test_matches_brute_force_on_the_tables(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    records, files = spark.read.parquet(f"{d}/raw_records.parquet"), spark.read.parquet(f"{d}/raw_files.parquet")
    assert rows(sd.found(records, files)) == brute(records.collect(), files.collect())


def test_kinds(spark):
    a = {"sentence_id": "s1", "x": 1, "kept": "k", "o": {"n": True}, "gone": "g"}
    b = {"sentence_id": "s1", "y": 1, "kept": 1.5, "p": {"n": True}, "new": []}
    records, files = tables(spark, [(1, "s", 1), (2, "s", 2)], [(1, json.dumps(a)), (2, json.dumps(b))])
    assert rows(sd.found(records, files)) == [
        (2, "added", "", "new"), (2, "removed", "gone", ""), (2, "renamed", "o.n", "p.n"), (2, "renamed", "x", "y"), (2, "retyped", "kept", "kept"),
    ]
    ops = {(r["op"], r["old_path"]) for r in sd.schema_changes(records, files).collect()}
    assert {("carry", "o.n"), ("rename node", "o"), ("rename", "x")} <= ops


def test_equal_number_of_another_type_is_no_rename(spark):
    records, files = tables(spark, [(1, "s", 1), (2, "s", 2)], [(1, '{"sentence_id":"a","x":1}'), (2, '{"sentence_id":"a","y":1.0}')])
    assert rows(sd.found(records, files)) == [(2, "added", "", "y"), (2, "removed", "x", "")]


def test_dirty_lines_nulls_and_repeats(spark):
    good = '{"sentence_id":"a","x":"v","n":null,"o":{}}'
    lines = [(1, good), (1, good), (1, None), (1, ""), (1, "null"), (1, "[1]"), (1, '{"x":NaN}'), (1, '{"x":'), (2, good), (2, '{"x":"w"}'), (9, good)]
    records, files = tables(spark, [(1, "s", 1), (2, "s", 1), (3, "s", 3)], lines)
    assert rows(sd.found(records, files)) == [(3, "removed", "sentence_id", ""), (3, "removed", "x", "")]


def test_empty_tables_and_extra_columns(spark):
    records, files = tables(spark, [], [])
    assert rows(sd.found(records, files)) == []
    records, files = tables(spark, [(1, "s", 1)], [(1, '{"sentence_id":"a"}')])
    assert rows(sd.found(records.selectExpr("*", "1 as path", "2 as series"), files.selectExpr("*", "'q' as payload", "3 as type"))) == []


def test_consistent_table_follows_renames_and_widens_types(spark):
    lines = [(1, '{"sentence_id":"a","label":"l","n":1,"b":true}'), (2, '{"sentence_id":"a","labelText":"l","n":1.5,"b":"x"}'), (2, '{"sentence_id":"b","labelText":"m"}')]
    records, files = tables(spark, [(1, "s", 1), (2, "s", 2)], lines)
    df = sd.consistent_table(records, files, "manual_label")
    assert df.columns == ["record_id", "file_id", "line_no", "b", "label", "n", "sentence_id"]
    assert dict(df.dtypes)["n"] == "double" and dict(df.dtypes)["b"] == "string"
    assert sorted(r["label"] for r in df.collect()) == ["l", "l", "m"]


S = ("string",)


def test_one_to_one_choice_among_equal_columns():
    script = sd.tree_script({"a": S, "b": S}, {"c": S, "d": S}, {("a", "c"), ("a", "d"), ("b", "c")})
    assert {(o, n) for *_, o, n, _, kept in script if kept} == {("a", "d"), ("b", "c")}
    assert len(script) == 3


def test_assignment_is_cheapest():
    rng = random.Random(5)
    for _ in range(400):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        cost = [[rng.choice([0.0, 1.0, 1.25, rng.random() * 3]) for _ in range(m)] for _ in range(n)]
        got = sd.assignment(cost)
        assert len(set(got)) == n
        assert abs(sum(cost[i][j] for i, j in enumerate(got)) - min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))) < 1e-9


def distance(old, new, evidence):
    return sum(cost for *_, cost, kept in sd.tree_script(old, new, evidence) if kept)


def test_a_renamed_node_is_one_edit():
    names = ["x", "y", "z"]
    old, new = {f"m.a.{n}": S for n in names} | {"k": S}, {f"m.b.{n}": S for n in names} | {"k": S}
    evidence = {(f"m.a.{n}", f"m.b.{n}") for n in names}
    script = sd.tree_script(old, new, evidence)
    assert [(op, u, v, c) for op, _, u, v, c, _ in script if op.endswith("node")] == [("rename node", "m.a", "m.b", 1.0), ("rename node", "m", "m", 1.0)][:1]
    assert distance(old, new, evidence) == sd.RENAME and {op for op, kind, *_ in script if kind} == {"carry"}


def test_a_moved_node_and_a_node_without_evidence():
    old, new = {"p.m.x": S, "p.m.y": S, "p.k": S, "q.k": S}, {"q.m.x": S, "q.m.y": S, "p.k": S, "q.k": S}
    evidence = {("p.m.x", "q.m.x"), ("p.m.y", "q.m.y")}
    assert distance(old, new, evidence) == sd.MOVE
    assert distance(old, new, set()) == 6.0  # two leaves and a node each
    assert [k for _, k, *_ in sd.tree_script(old, new, {("p.m.x", "q.m.x")}) if k] == ["renamed", "removed", "added"]


def least_distance(old, new, evidence):
    """All one-to-one mappings of nodes, tried one by one."""
    inner = [sorted(sd._inner(t)) for t in (old, new)]
    kept = set(inner[0]) & set(inner[1])
    us, vs = [u for u in inner[0] if u not in kept], [v for v in inner[1] if v not in kept]
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())

    def mappings(a, b, allowed):
        if not a:
            yield {}
            return
        for rest in mappings(a[1:], b, allowed):
            yield rest
            for x in b:
                if x not in rest.values() and allowed(a[0], x):
                    yield rest | {a[0]: x}

    best = float("inf")
    for nodes in mappings(us, vs, lambda u, v: True):
        for leaves in mappings(gone, come, lambda a, b: (a, b) in evidence):
            total = len(us) + len(vs) - 2 * len(nodes) + len(gone) + len(come) - 2 * len(leaves)
            for a, b in [*nodes.items(), *leaves.items()]:
                above = nodes.get(sd._parent(a), sd._parent(a) if sd._parent(a) in kept else None)
                total += sd.MOVE if above != sd._parent(b) else sd.KEEP if a.split(".")[-1] == b.split(".")[-1] else sd.RENAME
            used = {v for v in nodes.values()}
            carried = all(any(a.startswith(u + ".") and b.startswith(v + ".") for a, b in evidence) for u, v in nodes.items())
            best = min(best, total) if carried and len(used) == len(nodes) else best
    return best


def test_distance_against_all_mappings():
    rng = random.Random(11)
    more = 0  # where changing pair by pair ends short of the least
    for _ in range(150):
        make = lambda: {p: S for p in rng.sample(["a", "b", "m.a", "m.b", "n.a", "n.b", "m.o.a", "n.o.b", "r.a"], 4)}
        old, new = make(), make()
        gone, come = old.keys() - new.keys(), new.keys() - old.keys()
        if any(p + "." in q for t in (old, new) for p in t for q in t):
            continue
        evidence = {(a, b) for a in gone for b in come if rng.random() < 0.5}
        want = least_distance(old, new, evidence)
        assert abs(distance(old, new, evidence) - want) < 1e-9
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sd, "MAPPINGS", 0)  # pair by pair
            near = distance(old, new, evidence)
        assert near >= want - 1e-9
        more += near > want + 1e-9
    assert more <= 5


def test_long_numbers_lone_surrogates_and_deep_nesting(spark):
    long = "9" * 5000
    lines = [(1, f'{{"sentence_id":"a","n":{long},"l":[{long}],"s":"\\ud800","k\\udc00":1}}'), (2, f'{{"sentence_id":"a","m":{long},"s":"\\ud800","d":-0}}'), (2, '{"a":' * 50_000 + "1" + "}" * 50_000)]
    records, files = tables(spark, [(1, "s", 1), (2, "s", 2)], lines)
    assert rows(sd.found(records, files)) == [(2, "added", "", "d"), (2, "removed", "k\\udc00", ""), (2, "removed", "l", ""), (2, "renamed", "n", "m")]
    df = sd.consistent_table(records, files, "manual_label")
    assert dict(df.dtypes)["n"] == "string" and {r["n"] for r in df.collect()} == {long}


def test_names_are_followed_through_chains_of_renames(spark):
    names = ["first", "second", "third", "fourth", "fifth", "first"]
    lines = [(i, json.dumps({"sentence_id": "a", n: f"v{0}"})) for i, n in enumerate(names, 1)]
    records, files = tables(spark, [(i, "s", i) for i in range(1, 7)], lines)
    df = sd.consistent_table(records, files, "manual_label")
    assert df.columns == ["record_id", "file_id", "line_no", "first", "sentence_id"] and all(r["first"] == "v0" for r in df.collect())
