"""Splitting oversized items at natural boundaries.

A text is parsed into a tree: sections nested by the depth of their headings, lists with their items
nested by indentation, paragraphs, lines, sentences, words, sentences written without spaces,
characters. Sibling subtrees are merged up to the limit from the bottom up; only a node over the limit
is descended into, so every cut is at the highest level that fits, and what is left of such a node is
merged with what follows it. Pieces come in order, cover all text but the white space between them,
and may begin with the end of the piece before.

Cases with a defined result: null texts and texts within the limit are not returned; a text of white
space only has no piece, and is cut at its blank lines or words like any other; sizes are those of the
text as stored, in UTF-8 bytes or characters; no cut falls inside a character or, unless it is longer
than the limit by itself, a cluster of a character and the marks that belong to it; repeated rows are
split each; an overlap must be smaller than the limit; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of the two kinds of item, and the characters with the Unicode property White_Space.
CHUNK_BYTES, CANDIDATE_CHARS = 1500, 500
WHITE_SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLANK_LINES = re.compile(r"\r?\n(?:[ \t]*\r?\n)+")
_LINES = re.compile(r"\r?\n")
_SENTENCES = re.compile(f"(?<=[.!?。！？؟।…])[\"”’»)\\]」』]*[{WHITE_SPACE}]+")
_STOPS = re.compile("(?<=[。！？])(?=[^”’」』])")
_WORDS = re.compile(f"[{WHITE_SPACE}]+")
_HEADING = re.compile(r"(?:(#{1,6})\s|(\d+(?:\.\d+)*)\.?\s+\S)[^\n]{0,120}$|[^\n.!?:;,]{1,60}$")
_LIST_ITEM = re.compile(r"([ \t]*)(?:[-*+•–]|\d{1,3}[.)]|[a-z][.)])[ \t]+\S")

#: The levels of the tree below sections, and how a cut there is reported.
LEVELS = (("paragraph", BLANK_LINES), ("line", _LINES), ("sentence", _SENTENCES), ("word", _WORDS), ("stop", _STOPS), ("forced", None))
REPORTED = {"section": "paragraph", "paragraph": "paragraph", "line": "word", "sentence": "word", "word": "word", "stop": "forced", "forced": "forced"}
_LEVEL_NAMES = ("section", *(n for n, _ in LEVELS))
_RANK = {name: i for i, name in enumerate(_LEVEL_NAMES)}


@dataclass
class Piece:
    start: int
    end: int
    lead: int
    level: str


@dataclass
class Node:
    """A stretch of the text; its parts are made when they are asked for, unless the markup gave them."""

    start: int
    end: int
    level: int
    parts: list[Node] | None = None


#: Depth of a heading without a number or signs in front; deeper than any with them.
PLAIN_DEPTH = 7


def heading_depth(text: str) -> int | None:
    """The depth of a heading: its signs (#) or numbers (1.2.3); None if the text is none."""
    m = _HEADING.match(text) if len(text) <= 130 else None
    if m is None:
        return None
    return len(m[1]) if m[1] else m[2].count(".") + 1 if m[2] else PLAIN_DEPTH


class _Tree:
    """The nodes of one text, made as the packing comes to them."""

    def __init__(self, text: str, limit: int, in_bytes: bool, overlap: int = 0):
        self.text, self.limit, self.overlap = text, limit, overlap
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF) if in_bytes else np.ones(len(points), dtype=np.int64)
        self.sums = np.concatenate([[0], np.cumsum(width)])
        self.out: list[tuple[int, int, int]] = []
        self.blank = False  # whether white space alone was over the limit somewhere

    def size(self, start: int, end: int) -> int:
        return int(self.sums[end] - self.sums[start])

    def room(self, first: bool) -> int:
        """Room of a piece; all but the first leave some for what they repeat."""
        return self.limit if first else self.limit - self.overlap

    def parts(self, node: Node) -> list[Node]:
        """The node's parts, without what lies between them."""
        if node.parts is not None:
            return node.parts
        level = node.level + 1
        cut = LEVELS[level][1]
        if cut is None:
            return self.forced(node.start, node.end)
        spans, at = [], node.start
        for m in cut.finditer(self.text, node.start, node.end):
            keep = m.start()
            if cut is _SENTENCES:  # closing quotes stay with their sentence
                keep += len(m.group()) - len(m.group().lstrip("\"”’»)]」』"))
            if keep > at:
                spans.append((at, keep))
            at = m.end()
        if at < node.end:
            spans.append((at, node.end))
        nodes = [Node(a, b, level) for a, b in spans]
        return self.lists(nodes, level) if cut is _LINES else nodes

    def forced(self, start: int, end: int) -> list[Node]:
        """Stretches of as many characters as fit; marks stay with the character they belong to."""
        out: list[Node] = []
        while start < end:
            room = self.room(not self.out and not out)
            stop = min(end, int(np.searchsorted(self.sums, self.sums[start] + room, side="right")) - 1)
            stop = max(stop, start + 1)
            whole = stop
            while start + 1 < whole < end and _belongs(self.text[whole - 1], self.text[whole]):
                whole -= 1
            if whole > start + 1 or not (stop < end and _belongs(self.text[stop - 1], self.text[stop])):
                stop = whole
            out.append(Node(start, stop, len(LEVELS) - 1))
            start = stop
        return out

    def lists(self, lines: list[Node], level: int) -> list[Node]:
        """Lines in which list items hold the deeper and plain lines behind them."""
        out: list[Node] = []
        above: list[tuple[int, Node]] = []  # the open items, by indentation
        for line in lines:
            m = _LIST_ITEM.match(self.text, line.start, line.end)
            if m is None:
                if above:
                    self._into(above[-1][1], line)
                    for _, item in above:
                        item.end = line.end
                else:
                    out.append(line)
                continue
            indent = len(m[1].expandtabs(4))
            while above and above[-1][0] >= indent:
                above.pop()
            item = Node(line.start, line.end, level)
            if above:
                self._into(above[-1][1], item)
                for _, other in above:
                    other.end = line.end
            else:
                out.append(item)
            above.append((indent, item))
        return out

    def _into(self, item: Node, child: Node) -> None:
        if item.parts is None:
            item.parts = [Node(item.start, item.end, item.level)]  # its own first line
        item.parts.append(child)

    def sections(self) -> list[Node]:
        """The text's paragraphs, in sections nested by the depth of their headings; a heading directly behind another begins its section there."""
        root = Node(0, len(self.text), -2, [])
        above: list[tuple[int, Node]] = [(0, root)]
        plain_before = False
        for part in self.parts(Node(0, len(self.text), -1)):
            depth = heading_depth(self.text[part.start : part.end].strip())
            if depth == PLAIN_DEPTH and plain_before:
                depth = None  # of short lines in a row the first is the heading
            plain_before = depth == PLAIN_DEPTH
            if depth is not None:
                while above[-1][0] >= depth:
                    above.pop()
                section = Node(part.start, part.end, -1, [])
                above[-1][1].parts.append(section)
                above.append((depth, section))
            above[-1][1].parts.append(part)
            for _, section in above[1:]:
                section.end = part.end
        return root.parts

    def pack(self, nodes: list[Node], apart: bool = False) -> None:
        """Merge siblings up to the limit, what is left of an oversized one too; descend into those over it.

        ``apart``: the first is not merged with what stands before, as the heading of an oversized section.
        """
        for i, node in enumerate(nodes):
            rank = node.level + 1
            if self.out and not (apart and i == 0):
                start, end, level = self.out[-1]
                if self.size(start, node.end) <= self.room(len(self.out) == 1):
                    self.out[-1] = start, node.end, max(level, rank)
                    continue
            if self.size(node.start, node.end) <= self.room(not self.out):
                self.out.append((node.start, node.end, rank))
            elif _WORDS.fullmatch(self.text, node.start, node.end):
                self.blank = True
            else:
                self.pack(self.parts(node), apart=node.level < 0 or (apart and i == 0))

    def split(self) -> list[tuple[int, int, str]]:
        self.pack(self.sections())
        return [(start, end, _LEVEL_NAMES[rank]) for start, end, rank in self.out]


def _belongs(before: str, mark: str) -> bool:
    """Whether a mark, joiner or line feed belongs to the character before it."""
    return unicodedata.category(mark)[0] == "M" or "\u200d" in (before, mark) or (before, mark) == ("\r", "\n") or 0x1F3FB <= ord(mark) <= 0x1F3FF


def split(text: str, limit: int, in_bytes: bool, overlap: int = 0) -> list[Piece]:
    """The ordered pieces of a text, each within ``limit``; ``lead`` is how far a piece reaches back into the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    tree = _Tree(text, limit, in_bytes, overlap)
    pieces: list[Piece] = []
    for start, end, level in tree.split():
        lead = 0
        if overlap and pieces:
            room = limit - tree.size(start, end)
            floor = pieces[-1].start
            at = start
            low = int(np.searchsorted(tree.sums, tree.sums[start] - min(overlap, room), side="left"))
            at = max(low, floor)
            word = _WORDS.search(text, at, start)
            if at > floor and word is not None and word.end() < start and not _WORDS.match(text, at - 1, at):
                at = word.end()
            lead = start - at
        pieces.append(Piece(start, end, lead, level))
    return pieces


def cut_at(text: str, limit: int, in_bytes: bool) -> str:
    """How far the packing had to descend: paragraph, word or forced."""
    tree = _Tree(text, limit, in_bytes)
    reached = [_RANK[level] for _, _, level in tree.split()] + [_RANK["word"]] * tree.blank
    return REPORTED[_LEVEL_NAMES[max(reached, default=0)]]


def oversized(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The items over their limits: rec_kind, rec_key, text. The filter runs in the scan's stage."""
    a = chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_key").alias("rec_key"), "text").filter(F.octet_length("text") > CHUNK_BYTES)
    b = candidates.select(F.lit("candidate").alias("rec_kind"), F.col("candidate_key").alias("rec_key"), "text").filter(F.char_length("text") > CANDIDATE_CHARS)
    return a.unionByName(b)


def _limit(kind: str) -> tuple[int, bool]:
    return (CHUNK_BYTES, True) if kind == "chunk" else (CANDIDATE_CHARS, False)


def summary(items: DataFrame) -> DataFrame:
    """One row per oversized item: how it has to be cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["rec_kind", "rec_key"]].assign(cut_at=[cut_at(t, *_limit(k)) for k, t in zip(batch["rec_kind"], batch["text"])])

    return items.mapInPandas(run, "rec_kind string, rec_key long, cut_at string")


PIECE_SCHEMA = "rec_kind string, rec_key long, piece_no int, start_at int, end_at int, lead int, cut_level string, text string"


def pieces(items: DataFrame, overlap: int) -> DataFrame:
    """Every piece of every oversized item; ``overlap`` in the unit of the item's limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, key, text in zip(batch["rec_kind"], batch["rec_key"], batch["text"]):
                for i, p in enumerate(split(text, *_limit(kind), overlap), 1):
                    rows.append((kind, key, i, p.start - p.lead, p.end, p.lead, p.level, text[p.start - p.lead : p.end]))
            yield pd.DataFrame(rows, columns=["rec_kind", "rec_key", "piece_no", "start_at", "end_at", "lead", "cut_level", "text"])

    return items.mapInPandas(run, PIECE_SCHEMA)
