"""Schemas that drift between the files of a series.

Every file's records form a schema tree: inner nodes are objects, leaves the dotted paths of all other
values. For each pair of consecutive files a tree edit script (add, delete, rename, move, retype of
leaves; add, delete, rename, move of inner nodes, which carry what hangs on them) turns one tree into
the other; the scripts of a series compile into one projection per file, and these give one consistent
table per family.

Cases with a defined result: null, empty or non-JSON payloads and JSON values other than objects are
skipped, and so are payloads nested too deep to be read; a null value or an empty object makes no path;
an empty array is a value of type ``array``; numbers of any length are kept as written; halves of
surrogate pairs are written as escapes; records without an identifier count for paths and types but
give no evidence for renames; a record repeated in one file counts once per distinct value; two files
written at the same time are ordered by ``file_id``; a series' first file has no case; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

#: The field that identifies a record of each family.
RECORD_KEYS = {"canonical_model": "document_id", "manual_label": "sentence_id", "fixture_metadata": "fixture"}

#: Costs of the edits. A rename is cheaper than a deletion and an addition; a move (another parent)
#: costs a little more than a rename under the same parent.
KEEP, RETYPE, RENAME, MOVE, DELETE, ADD = 0.0, 1.0, 1.0, 1.25, 1.0, 1.0

#: Mappings of inner nodes between two trees up to which all are tried.
MAPPINGS = 512

LEAF_SCHEMA = "file_id long, record_id long, line_no int, rec string, path string, type string, value string"


class _NotJson(ValueError):
    pass


class _Num(str):
    """A number as written, so that 1, 1.0 and 1e0 stay apart."""


def _constant(word: str) -> None:
    raise _NotJson(word)


class _Int(_Num):
    pass


class _Frac(_Num):
    pass


def _decode(payload: str) -> dict | None:
    try:
        value = json.loads(payload, parse_int=_Int, parse_float=_Frac, parse_constant=_constant)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _number(value: _Num) -> str:
    """A number in one spelling; whole numbers stay as written, since they may be too long to be read."""
    if isinstance(value, _Frac):
        return repr(float(value))
    return "0" if value == "-0" else str(value)


def _canonical(value: object) -> str:
    """JSON in one spelling: keys in order, numbers as ``_number`` writes them."""
    if isinstance(value, list):
        return f"[{', '.join(map(_canonical, value))}]"
    if isinstance(value, dict):
        return f"{{{', '.join(f'{json.dumps(k, ensure_ascii=False)}: {_canonical(value[k])}' for k in sorted(value))}}}"
    return _number(value) if isinstance(value, _Num) else json.dumps(value, ensure_ascii=False)


def _text(value: str) -> str:
    """The string with halves of surrogate pairs, which cannot be stored, as escapes."""
    try:
        value.encode("utf-8")
    except UnicodeEncodeError:
        return value.encode("utf-8", "backslashreplace").decode("utf-8")
    return value


def _leaves(node: dict, prefix: str = "") -> Iterator[tuple[str, str, str]]:
    for key, value in node.items():
        path = f"{prefix}{_text(key)}"
        if isinstance(value, dict):
            yield from _leaves(value, f"{path}.")
        elif value is None:
            continue
        elif isinstance(value, bool):
            yield path, "boolean", "true" if value else "false"
        elif isinstance(value, _Num):
            yield path, "integer" if isinstance(value, _Int) else "number", _number(value)
        elif isinstance(value, list):
            yield path, "array", _text(_canonical(value))
        else:
            yield path, "string", _text(value)


def _explode_payloads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file_id", "record_id", "line_no", "rec", "path", "type", "value"]
    for batch in batches:
        rows = []
        for file_id, record_id, line_no, family, payload in batch.itertuples(index=False, name=None):
            node = _decode(payload) if isinstance(payload, str) else None
            if node is None:
                continue
            rec = node.get(RECORD_KEYS.get(family, ""))
            rec = None if rec is None or isinstance(rec, (dict, list)) else _text(str(rec))
            try:
                rows += [(file_id, record_id, line_no, rec, *leaf) for leaf in _leaves(node)]
            except RecursionError:
                continue
        yield pd.DataFrame(rows, columns=names)


def ordered_files(files: DataFrame) -> DataFrame:
    """The files of each series in order of writing: file_no from 1, and the next file's id."""
    w = Window.partitionBy("series").orderBy(F.col("written_at").asc_nulls_first(), "file_id")
    return files.select("file_id", "series", "family", "written_at").dropDuplicates(["file_id"]).withColumns(
        {"file_no": F.row_number().over(w), "next_file_id": F.lead("file_id").over(w)}
    )


def leaf_values(records: DataFrame, files: DataFrame) -> DataFrame:
    """One row per record and leaf path: JSON type and value as text."""
    known = files.select("file_id", "family").dropDuplicates(["file_id"])
    return (
        records.select("file_id", "record_id", "line_no", "payload")
        .join(known, "file_id")
        .select("file_id", "record_id", "line_no", "family", "payload")
        .mapInPandas(_explode_payloads, LEAF_SCHEMA)
    )


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row at the least total cost; as many rows as columns or fewer. Shortest augmenting paths with potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    row_price, column_price, row_of = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        least, via, done = [float("inf")] * m, [-1] * m, [False] * m
        row, column = start, -1
        while True:
            step, nearest = float("inf"), -1
            for j in range(m):
                if not done[j]:
                    reduced = cost[row][j] - row_price[row] - column_price[j]
                    if reduced < least[j]:
                        least[j], via[j] = reduced, column
                    if least[j] < step:
                        step, nearest = least[j], j
            row_price[start] += step
            for j in range(m):
                if done[j]:
                    row_price[row_of[j]] += step
                    column_price[j] -= step
                else:
                    least[j] -= step
            column, done[nearest] = nearest, True
            if row_of[column] < 0:
                break
            row = row_of[column]
        while column >= 0:
            before = via[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    out = [-1] * n
    for j, row in enumerate(row_of):
        if row >= 0:
            out[row] = j
    return out


def most_saving(savings: dict[tuple[str, str], float]) -> dict[str, str]:
    """A one-to-one choice among the pairs that saves the most, component by component; of equal ones the pairs first in order."""
    with_old: dict[str, list[str]] = {}
    with_new: dict[str, list[str]] = {}
    for a, b in sorted(savings):
        with_old.setdefault(a, []).append(b)
        with_new.setdefault(b, []).append(a)
    out: dict[str, str] = {}
    seen: set[str] = set()
    for first in with_old:
        if first in seen:
            continue
        olds, news, waiting = [], set(), [first]
        seen.add(first)
        while waiting:
            a = waiting.pop()
            olds.append(a)
            for b in with_old[a]:
                news.add(b)
                for c in with_new[b]:
                    if c not in seen:
                        seen.add(c)
                        waiting.append(c)
        olds, columns = sorted(olds), sorted(news)
        cost = [[-savings.get((a, b), 0.0) for b in columns] + [0.0] * len(olds) for a in olds]  # a column of its own for none
        out |= {a: columns[j] for a, j in zip(olds, assignment(cost)) if j < len(columns) and (a, columns[j]) in savings}
    return out


def _parent(path: str) -> str:
    return path.rpartition(".")[0]


def _inner(paths: Iterable[str]) -> set[str]:
    """All proper prefixes of the paths, the root ("") among them."""
    out = {""}
    for path in paths:
        while path:
            path = _parent(path)
            out.add(path)
    return out


class _Trees:
    """Two schema trees and what it costs to edit one into the other.

    Nodes whose path is in both are mapped to themselves. Leaves of different paths are mapped only with evidence in the records
    (the same values under both names), inner nodes only if a leaf below comes along. For a mapping of the inner nodes, the cheapest
    one of the leaves is an assignment. All mappings of the inner nodes are tried where there are at most MAPPINGS, so the script
    costs the least; where there are more, the start (children of mapped nodes to children of their images, bottom-up) is improved pair
    by pair until no change of one pair helps.
    """

    def __init__(self, old: dict[str, tuple[str, ...]], new: dict[str, tuple[str, ...]], evidence: set[tuple[str, str]]):
        self.old, self.new = old, new
        self.gone, self.come = old.keys() - new.keys(), new.keys() - old.keys()
        self.evidence = {(a, b) for a, b in evidence if a in self.gone and b in self.come}
        inner_old, inner_new = _inner(old), _inner(new)
        self.gone_inner, self.come_inner = inner_old - inner_new, inner_new - inner_old
        self.kept_inner = inner_old & inner_new
        self.under_old, self.under_new = self._children(old, inner_old), self._children(new, inner_new)
        self.known: dict[tuple[str, str], tuple[float, dict[str, str]]] = {}
        self.inner = self._map_inner()
        self._improve()

    @staticmethod
    def _children(leaves: Iterable[str], inner: set[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for path in [*leaves, *(p for p in inner if p)]:
            out.setdefault(_parent(path), []).append(path)
        return out

    def _retype(self, a: str, b: str) -> float:
        return RETYPE if self.old[a] != self.new[b] else KEEP

    def saved(self, u: str, v: str) -> tuple[float, dict[str, str]]:
        """What mapping the inner node ``u`` with all below it to ``v`` saves against deleting and adding both, but for the edit of its
        own name; and the inner nodes mapped with it. 0 if no leaf comes along."""
        if (u, v) not in self.known:
            pairs: dict[tuple[str, str], float] = {}
            deeper: dict[tuple[str, str], dict[str, str]] = {}
            for a in self.under_old.get(u, ()):
                for b in self.under_new.get(v, ()):
                    named = KEEP if a[len(u) :] == b[len(v) :] else RENAME
                    if a in self.old and b in self.new and (a, b) in self.evidence:
                        pairs[a, b] = DELETE + ADD - named - self._retype(a, b)
                    elif a in self.gone_inner and b in self.come_inner:
                        below, mapped = self.saved(a, b)
                        if below > 0:
                            pairs[a, b], deeper[a, b] = below - named, mapped
            chosen = most_saving({k: x for k, x in pairs.items() if x > 0})
            total = sum(pairs[k] for k in chosen.items())
            mapped = {u: v}
            for k in chosen.items():
                mapped |= deeper.get(k, {})
            self.known[u, v] = (total + DELETE + ADD if chosen else 0.0), mapped
        return self.known[u, v]

    def _map_inner(self) -> dict[str, str]:
        """Old inner nodes to new ones: the highest that are in one tree alone, and those mapped with them."""
        tops = [[p for p in some if _parent(p) in self.kept_inner] for some in (self.gone_inner, self.come_inner)]
        leaf_pairs: set[tuple[str, str]] = set()
        for a, b in self.evidence:  # pairs without a common leaf save nothing
            ua, ub = (self._top(p, some) for p, some in ((a, self.gone_inner), (b, self.come_inner)))
            if ua and ub:
                leaf_pairs.add((ua, ub))
        assert all(u in tops[0] and v in tops[1] for u, v in leaf_pairs)
        savings = {}
        for u, v in leaf_pairs:
            below, _ = self.saved(u, v)
            if below > 0 and (x := below - (RENAME if _parent(u) == _parent(v) else MOVE)) > 0:
                savings[u, v] = x
        out: dict[str, str] = {}
        for u, v in most_saving(savings).items():
            out |= self.saved(u, v)[1]
        return out

    def cost(self, inner: dict[str, str]) -> float:
        """The whole script's cost if the inner nodes are mapped so."""
        self.inner = inner
        leaves = self.leaves()
        edits = sum(self.edit(u, v)[1] for u, v in inner.items()) + sum(self.edit(a, b)[1] + self._retype(a, b) for a, b in leaves.items())
        return edits + DELETE * (len(self.gone_inner) + len(self.gone) - len(inner) - len(leaves)) + ADD * (len(self.come_inner) + len(self.come) - len(inner) - len(leaves))

    def _improve(self) -> None:
        """Replace ``inner`` by a cheaper mapping, if there is one."""
        above = lambda path, alone: [p for p in _inner([path]) if p in alone]
        pairs = sorted({(u, v) for a, b in self.evidence for u in above(a, self.gone_inner) for v in above(b, self.come_inner)})
        options: dict[str, list[str]] = {}
        for u, v in pairs:
            options.setdefault(u, []).append(v)
        best, least = self.inner, self.cost(self.inner)
        number = 1
        for some in options.values():
            number = min(number * (len(some) + 1), MAPPINGS + 1)

        def all_of(nodes: list[str], inner: dict[str, str]) -> Iterator[dict[str, str]]:
            if not nodes:
                yield dict(inner)
                return
            yield from all_of(nodes[1:], inner)
            for v in options[nodes[0]]:
                if v not in inner.values():
                    yield from all_of(nodes[1:], inner | {nodes[0]: v})

        def changes(inner: dict[str, str]) -> Iterator[dict[str, str]]:
            for u, v in pairs:
                rest = {a: b for a, b in inner.items() if a != u and b != v}
                yield rest if inner.get(u) == v else rest | {u: v}

        better = True
        while better:
            better = False
            for inner in all_of(list(options), {}) if number <= MAPPINGS else list(changes(best)):
                if (cost := self.cost(inner)) < least - 1e-9:
                    best, least, better = inner, cost, number > MAPPINGS
        self.inner = best

    @staticmethod
    def _top(path: str, alone: set[str]) -> str:
        """The highest node above the leaf that is in its tree alone; empty if there is none."""
        top = ""
        while path := _parent(path):
            if path in alone:
                top = path
        return top

    def edit(self, a: str, b: str) -> tuple[str, float]:
        """The operation that makes leaf or inner node ``b`` of ``a``, and its cost."""
        above = self.inner.get(_parent(a), _parent(a) if _parent(a) in self.kept_inner else None)
        if above != _parent(b):
            return "move", MOVE
        return ("carry", KEEP) if a.rpartition(".")[2] == b.rpartition(".")[2] else ("rename", RENAME)

    def leaves(self) -> dict[str, str]:
        """The leaves mapped to leaves of another path."""
        return most_saving({(a, b): x for a, b in self.evidence if (x := DELETE + ADD - self.edit(a, b)[1] - self._retype(a, b)) > 0})


def tree_script(
    old: dict[str, tuple[str, ...]], new: dict[str, tuple[str, ...]], evidence: set[tuple[str, str]]
) -> list[tuple[str, str, str, str, float, bool]]:
    """The edit script between two schema trees: (op, change_kind, old_path, new_path, cost, chosen).

    The chosen edits turn the old tree into the new one; their costs add up to the distance. Where several renames of leaves
    compete, all are listed, the others not chosen. ``change_kind`` names the change of a leaf and is empty for edits of inner
    nodes, and for leaves deleted or added because another one won such a competition.
    """
    trees = _Trees(old, new, evidence)
    mapped = trees.leaves()
    script = [("retype", "retyped", p, p, RETYPE, True) for p in sorted(old.keys() & new.keys()) if old[p] != new[p]]
    for a, b in sorted(trees.evidence):
        op, cost = trees.edit(a, b)
        script.append((op, "renamed", a, b, cost + trees._retype(a, b), mapped.get(a) == b))
    named = [{p[i] for p in trees.evidence} for i in (0, 1)]
    taken = set(mapped.values())
    script += [("delete", "" if a in named[0] else "removed", a, "", DELETE, True) for a in sorted(trees.gone - mapped.keys())]
    script += [("add", "" if b in named[1] else "added", "", b, ADD, True) for b in sorted(trees.come - taken)]
    script += [(f"{op} node", "", u, v, cost, True) for u, v in sorted(trees.inner.items()) for op, cost in [trees.edit(u, v)] if op != "carry"]
    script += [("delete node", "", u, "", DELETE, True) for u in sorted(trees.gone_inner - trees.inner.keys())]
    script += [("add node", "", "", v, ADD, True) for v in sorted(trees.come_inner - set(trees.inner.values()))]
    return script


SCRIPT_SCHEMA = "file_id long, op string, change_kind string, old_path string, new_path string, old_types string, new_types string, cost double, chosen boolean"

def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per pair of files in, with its paths and evidence (as many as the schemas are wide); its script out."""
    names = [c.split()[0] for c in SCRIPT_SCHEMA.split(", ")]
    text = lambda t: ",".join(t) if t is not None else ""
    for batch in batches:
        rows = []
        for file_id, facts in zip(batch["file_id"], batch["facts"]):
            old = {f["path"]: tuple(f["old_types"]) for f in facts if f["old_types"] is not None}
            new = {f["path"]: tuple(f["new_types"]) for f in facts if f["new_types"] is not None}
            pairs = {(f["path"], f["renamed_to"]) for f in facts if f["renamed_to"] is not None}
            rows += [(file_id, op, kind, a, b, text(old.get(a)), text(new.get(b)), cost, kept) for op, kind, a, b, cost, kept in tree_script(old, new, pairs)]
        yield pd.DataFrame(rows, columns=names)


def _types(side: str) -> Column:
    return F.max(F.when(F.col("side") == side, F.col("types")))


def edit_scripts(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """The edit script of every file against the one before it in its series.

    ``leaves`` is read several times; pass a materialized table. Only per-file type sets and the
    values under changed paths are shuffled.
    """
    order = materialize(ordered_files(files), "file-order")
    later = order.filter("file_no > 1").select("file_id")
    chain = order.filter("next_file_id is not null").select("file_id", "next_file_id")
    present = leaves.groupBy("file_id", "path").agg(F.sort_array(F.collect_set("type")).alias("types"))
    sides = present.join(later, "file_id").withColumn("side", F.lit("new")).unionByName(
        present.join(chain, "file_id").select(F.col("next_file_id").alias("file_id"), "path", "types", F.lit("old").alias("side"))
    )
    both_trees = materialize(sides.groupBy("file_id", "path").agg(_types("old").alias("old_types"), _types("new").alias("new_types")), "schema-trees")
    diff = materialize(both_trees.filter("not (old_types <=> new_types)"), "schema-diff")  # by itself, so that its size is known
    gone = diff.filter("new_types is null").select("file_id", "path")
    come = diff.filter("old_types is null").select("file_id", "path")
    value = leaves.filter("rec is not null").select("file_id", "rec", "path", "type", F.xxhash64("value").alias("h1"), F.hash("value").alias("h2"))
    shift = chain.select(F.col("file_id").alias("from_id"), F.col("next_file_id").alias("file_id"))
    old_value = (
        value.withColumnRenamed("file_id", "from_id").join(shift.join(gone.select("file_id").distinct(), "file_id", "left_semi"), "from_id")
        .drop("from_id").join(gone, ["file_id", "path"], "left_semi").distinct()
    )
    new_value = value.join(come, ["file_id", "path"], "left_semi").distinct()
    recs = leaves.filter("rec is not null").select("file_id", "rec").distinct()
    both = recs.join(recs.withColumnRenamed("file_id", "from_id").join(shift, "from_id").select("file_id", "rec"), ["file_id", "rec"], "left_semi")
    old_value = old_value.join(both, ["file_id", "rec"], "left_semi")
    new_value = new_value.join(both, ["file_id", "rec"], "left_semi")
    n_old = old_value.groupBy("file_id", "path").agg(F.count(F.lit(1)).alias("n_old"))
    n_new = new_value.groupBy("file_id", F.col("path").alias("renamed_to")).agg(F.count(F.lit(1)).alias("n_new"))
    equal = (
        old_value.join(new_value.withColumnRenamed("path", "renamed_to"), ["file_id", "rec", "type", "h1", "h2"])
        .groupBy("file_id", "path", "renamed_to")
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    evidence = (
        equal.join(n_old, ["file_id", "path"]).join(n_new, ["file_id", "renamed_to"])
        .filter("n_equal = n_old and n_equal = n_new").select("file_id", "path", "renamed_to")
    )
    rows = both_trees.join(diff.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "path", "old_types", "new_types", F.lit(None).cast("string").alias("renamed_to")).unionByName(
        evidence.withColumns({"old_types": F.lit(None).cast("array<string>"), "new_types": F.lit(None).cast("array<string>")})
    )
    facts = F.collect_list(F.struct("path", "old_types", "new_types", "renamed_to")).alias("facts")
    return rows.groupBy("file_id").agg(facts).mapInPandas(_scripts, SCRIPT_SCHEMA)


def schema_changes(records: DataFrame, files: DataFrame) -> DataFrame:
    """The report: every change of every file, with its cost."""
    leaves = materialize(leaf_values(records, files), "schema-leaves")
    return edit_scripts(leaves, files)


LINEAGE_SCHEMA = "family string, file_id long, path string, field string, name string"


def snake(name: str) -> str:
    """A path in one spelling: camelCase, kebab-case and dotted names become snake_case, without an x_ in front or a version behind."""
    out = []
    for i, c in enumerate(name):
        if c.isupper() and i and (name[i - 1].islower() or name[i - 1].isdigit()):
            out.append("_")
        out.append(c.lower() if c.isalnum() else "_")
    parts = [p for p in "".join(out).split("_") if p]
    while len(parts) > 1 and parts[0] == "x":
        parts = parts[1:]
    while len(parts) > 1 and re.fullmatch("v[0-9]+", parts[-1]):
        parts = parts[:-1]
    return "_".join(parts) or "field"


def _snake_of(names: pd.Series) -> pd.Series:
    return names.map(snake)


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per file in, with its paths and their fields' names (as many as its schema is wide): fields whose names differ in
    underscores only are one field, unless a file has both."""
    for batch in batches:
        out = []
        for family, file_id, fields in zip(batch["family"], batch["file_id"], batch["fields"]):
            used: set[str] = set()
            for f in sorted(fields, key=lambda f: f["path"]):
                name = f["name"]
                while name.replace("_", "") in used:
                    name += "_also"
                used.add(name.replace("_", ""))
                out.append((family, file_id, f["path"], name.replace("_", ""), name))
        yield pd.DataFrame(out, columns=["family", "file_id", "path", "field", "name"])


def first_names(renames: DataFrame) -> DataFrame:
    """The first name of the field behind every rename (series, file_no, old_path, new_path): adds ``name``.

    A rename's field is that of the latest rename to its old path before it. These references are followed by doubling, in as many
    rounds as the logarithm of the longest chain; each round reads and writes one row per rename.
    """
    snake_of = F.pandas_udf(_snake_of, "string")
    told = renames.select("series", "file_no", F.col("new_path").alias("path"), F.struct("file_no", "new_path").alias("made"), F.lit(None).cast("string").alias("new_path"))
    asks = renames.select("series", "file_no", F.col("old_path").alias("path"), F.lit(None).cast(told.schema["made"].dataType).alias("made"), "new_path")
    before = Window.partitionBy("series", "path").orderBy("file_no").rangeBetween(Window.unboundedPreceding, -1)
    linked = told.unionByName(asks).withColumn("origin", F.last("made", ignorenulls=True).over(before)).filter("new_path is not null")
    links = linked.select("series", "file_no", "new_path", F.when(F.col("origin").isNull(), snake_of("path")).alias("name"), F.col("origin.file_no").alias("up_no"), F.col("origin.new_path").alias("up_path"))
    links = materialize(links, "schema-links")
    while links.filter("name is null").limit(1).count():
        up = links.select("series", F.col("file_no").alias("up_no"), F.col("new_path").alias("up_path"), F.col("name").alias("up_name"), F.col("up_no").alias("next_no"), F.col("up_path").alias("next_path"))
        links = materialize(
            links.join(up, ["series", "up_no", "up_path"], "left").select(
                "series", "file_no", "new_path", F.coalesce("name", "up_name").alias("name"), F.col("next_no").alias("up_no"), F.col("next_path").alias("up_path")),
            "schema-links",
        )
    return links.select("series", "file_no", "new_path", "name")


def projections(leaves: DataFrame, scripts: DataFrame, files: DataFrame) -> DataFrame:
    """The scripts compiled: for each file, which path fills which field of the family's table.

    A path's field is that of the latest rename to it in its series, up to the file, or its own name. Nothing is gathered but one
    file's paths.
    """
    order = ordered_files(files).select("file_id", "series", "family", "file_no")
    renames = scripts.filter("chosen and op in ('rename', 'move', 'carry')").join(order, "file_id").select("series", "file_no", "old_path", "new_path")
    named = first_names(renames).select("series", F.col("new_path").alias("path"), "file_no", "name", F.lit(None).cast("bigint").alias("file_id"), F.lit(None).cast("string").alias("family"))
    present = leaves.select("file_id", "path").distinct().join(order, "file_id").select("series", "path", "file_no", F.lit(None).cast("string").alias("name"), "file_id", "family")
    up_to = Window.partitionBy("series", "path").orderBy("file_no").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = present.unionByName(named).withColumn("name", F.last("name", ignorenulls=True).over(up_to)).filter("file_id is not null")
    fields = F.collect_list(F.struct("path", F.coalesce("name", F.pandas_udf(_snake_of, "string")("path")).alias("name"))).alias("fields")
    return told.groupBy("file_id").agg(F.first("family").alias("family"), fields).select("family", "file_id", "fields").mapInPandas(_spelled, LINEAGE_SCHEMA)


def consistent_table(records: DataFrame, files: DataFrame, family: str) -> DataFrame:
    """All records of a family in one table: the projections applied to every file.

    A field that holds whole numbers only is BIGINT, unless one of them is too long, one with any numbers DOUBLE, one with booleans
    only BOOLEAN; any other mixture keeps the text. Columns: record_id, file_id, line_no, then the
    fields in alphabetical order. Field names, not values, come to the driver; their number is that
    of the family's distinct fields.
    """
    files = files.filter(F.col("family") == family)
    leaves = materialize(leaf_values(records, files), "schema-leaves")
    mapping = projections(leaves, edit_scripts(leaves, files), files)
    mapping = materialize(mapping, "schema-projections")
    named = materialize(leaves.join(mapping.select("file_id", "path", "field"), ["file_id", "path"]), "schema-fields")
    too_long = F.max((F.col("type") == "integer") & F.col("value").try_cast("bigint").isNull())
    kinds = {
        r["field"]: set(r["types"]) | ({"string"} if r["too_long"] else set())
        for r in named.groupBy("field").agg(F.collect_set("type").alias("types"), too_long.alias("too_long")).collect()
    }
    spelled = mapping.groupBy("field", "name").agg(F.count(F.lit(1)).alias("n")).groupBy("field").agg(F.max(F.struct("n", "name")).alias("x"))
    names = {r["field"]: r["name"] for r in spelled.select("field", "x.name").collect()}
    columns = []
    for field, types in sorted(kinds.items(), key=lambda k: names[k[0]]):
        picked = F.first(F.when(F.col("field") == field, F.col("value")), ignorenulls=True)
        cast = "bigint" if types == {"integer"} else "double" if types <= {"integer", "number"} else "boolean" if types == {"boolean"} else "string"
        name = names[field]
        columns.append((picked if cast == "string" else picked.try_cast(cast)).alias(name if name not in ("record_id", "file_id", "line_no") else f"{name}_value"))
    keys = named.groupBy("record_id", "file_id", "line_no")
    return keys.agg(*columns) if columns else keys.agg(F.count(F.lit(1)).alias("n")).drop("n")


def found(records: DataFrame, files: DataFrame) -> DataFrame:
    """Each file's changes of leaves, read from its edit script: file_id, change_kind, old_path, new_path."""
    return schema_changes(records, files).filter("change_kind <> ''").select("file_id", "change_kind", "old_path", "new_path").distinct()
