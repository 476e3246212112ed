"""Long exact spans shared between records.

Level-wise doubling. Windows of a quarter of the wanted length are sampled from every text by local
minima of their hash, so that any two texts with a common run of the wanted length sample a common
window. Windows repeated in another text are extended to twice their length, to the right and to the
left; those still repeated are extended to the wanted length at every offset. Windows alone at one
length are not looked at again. Equal texts are one class throughout and are told apart only in the
result. Beyond the wanted length the doubling goes on, on sampled windows, until none survives, and
tells how long the longest spans are. Occurrences whose whole surroundings are equal are one class too, so a passage copied a
thousand times costs no more than once at the last level.

Cases with a defined result: null texts and texts shorter than the wanted length share nothing; equal
texts of that length or more share all; a passage repeated within one text only is not shared;
repeated doc_ids are one record, whose texts are all looked at; texts of any length are read whole,
in overlapping segments; extra columns are ignored; an empty table gives empty results. Windows of the
wanted length and longer are compared by 95 bits of hash, classes of surroundings by 128; the shorter
windows before them by 64, where an accident only adds a candidate.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.codepoints import MIX, mix
from foliant.session import materialize

#: Characters handled at a time in one task.
SEGMENT = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Windows:
    """Hashes of any window of a stretch of text, from sums of powers modulo 2**64."""

    def __init__(self, points: np.ndarray, which: int = 0):
        base = _BASES[which]
        n = len(points) + 1
        power = np.full(n, base, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(_final(points.astype(np.uint64) + np.uint64(which + 1)) * power[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _final((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, length: int) -> np.ndarray:
        return _final((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length])


def local_minima(order: np.ndarray, allowed: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the (leftmost) least value of some stretch of ``width`` values starting at an allowed position."""
    n = len(order)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(max(1, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = (order & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NONE, dtype=np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    least = least[allowed[:starts]]
    return np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])] & mask).astype(np.int64) if len(least) else np.zeros(0, dtype=np.int64)


def _segments(ids: np.ndarray, texts: list[str], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about SEGMENT characters: code points, id of each piece, where it starts in the group, and in its text.

    A longer text comes in pieces that overlap by ``span`` - 1 characters, so each window of that length is in just one.
    """
    group: list[str] = []
    owner: list[int] = []
    base: list[int] = []
    size = 0
    for i, text in zip(ids, texts):
        for at in range(0, max(1, len(text) - span + 1), SEGMENT):
            piece = text[at : at + SEGMENT + span - 1]
            group.append(piece)
            owner.append(i)
            base.append(at)
            size += len(piece)
            if size >= SEGMENT:
                yield _joined(group, owner, base)
                group, owner, base, size = [], [], [], 0
    if group:
        yield _joined(group, owner, base)


def _joined(group: list[str], owner: list[int], base: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(group) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in group], out=offsets[1:])
    return points, np.array(owner, dtype=np.int64), offsets, np.array(base, dtype=np.int64)


def _sampler(length: int, window: int):
    """Emits the sampled windows of each text: doc_id, pos, h."""
    width = length - window + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for points, owner, offsets, base in _segments(batch["doc_id"].to_numpy(), batch["text"].tolist(), length):
                if len(points) < length:
                    continue
                h = Windows(points).every(window)
                piece = np.repeat(np.arange(len(owner)), np.diff(offsets))[: len(h)]
                allowed = np.arange(len(h)) + length <= offsets[1:][piece]
                at = local_minima(_final(h), allowed, width)
                yield pd.DataFrame({"doc_id": owner[piece[at]], "pos": (at - offsets[piece[at]] + base[piece[at]]).astype(np.int32), "h": h[at].view(np.int64)})

    return run


def _texts_together(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Rows in groups of about SEGMENT characters: the rows, their code points in a row, and where each text starts."""
    sizes = batch["text"].str.len().to_numpy(dtype=np.int64)
    group = np.cumsum(sizes) // SEGMENT
    for k in np.unique(group):
        rows = batch[group == k]
        points = np.frombuffer("".join(rows["text"]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        yield rows, points, np.concatenate([[0], np.cumsum(sizes[group == k])])


def _extender(length: int, half: int):
    """Extends each repeated window of length half / 2 to ``half`` on both sides.

    Emits doc_id, q, h of [q, q + half), and the hashes of the two windows of the full length that
    begin or end with it; a window that would reach beyond its text has a hash of its own.
    """
    quarter = half // 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, points, offsets in _texts_together(batch):
                w, v = Windows(points), Windows(points, 1)
                k = np.repeat(np.arange(len(rows)), rows["places"].str.len().to_numpy(dtype=np.int64))
                p = np.concatenate(rows["places"].to_list()).astype(np.int64)
                n = np.diff(offsets)[k]
                right, left = p + half <= n, p >= quarter
                k, q = np.concatenate([k[right], k[left]]), np.concatenate([p[right], p[left] - quarter])
                places = np.unique(offsets[k] + q)
                k = np.searchsorted(offsets, places, side="right") - 1
                if not len(places):
                    continue
                out = {"doc_id": rows["doc_id"].to_numpy()[k], "q": (places - offsets[k]).astype(np.int32), "h": w.at(places, places + half).view(np.int64)}
                alone = _final(mix(out["doc_id"].view(np.uint64), places.astype(np.uint64)))
                for side, start in (("l", places - (length - half)), ("r", places)):
                    fits = (start >= offsets[k]) & (start + length <= offsets[k + 1])
                    at = np.where(fits, start, 0)
                    end = np.where(fits, start + length, 0)
                    out[f"{side}h"] = np.where(fits, w.at(at, end), alone).view(np.int64)
                    out[f"{side}g"] = np.where(fits, (v.at(at, end) >> np.uint64(33)).astype(np.int32), -1).astype(np.int32)
                yield pd.DataFrame(out)

    return run


def _completer(length: int, half: int):
    """Extends each repeated window of length ``half`` to ``length`` at every offset; emits around, around2, shift, h, g."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, points, offsets in _texts_together(batch):
                w, v = Windows(points), Windows(points, 1)
                k = np.repeat(np.arange(len(rows)), rows["places"].str.len().to_numpy(dtype=np.int64))
                q = np.array([r["q"] for own in rows["places"] for r in own], dtype=np.int64)
                around, around2 = (np.array([r[c] for own in rows["places"] for r in own], dtype=np.int64) for c in ("around", "around2"))
                shifts = np.arange(-(length - half), 1)
                start = (offsets[k] + q)[:, None] + shifts
                fits = (start >= offsets[k][:, None]) & (start + length <= offsets[k + 1][:, None])
                at = start[fits]
                yield pd.DataFrame({
                    "around": np.broadcast_to(around[:, None], fits.shape)[fits], "around2": np.broadcast_to(around2[:, None], fits.shape)[fits], "shift": np.broadcast_to(shifts, fits.shape)[fits].astype(np.int32),
                    "h": w.at(at, at + length).view(np.int64), "g": (v.at(at, at + length) >> np.uint64(33)).astype(np.int32),
                })

    return run


def _leveller(length: int):
    """The windows of this length at given places that lie within their texts: doc_id, pos, h, g."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, points, offsets in _texts_together(batch):
                w, v = Windows(points), Windows(points, 1)
                k = np.repeat(np.arange(len(rows)), rows["places"].str.len().to_numpy(dtype=np.int64))
                p = np.concatenate(rows["places"].to_list()).astype(np.int64)
                fits = p + length <= np.diff(offsets)[k]
                k, p = k[fits], p[fits]
                at = offsets[k] + p
                yield pd.DataFrame({
                    "doc_id": rows["doc_id"].to_numpy()[k], "pos": p.astype(np.int32),
                    "h": w.at(at, at + length).view(np.int64), "g": (v.at(at, at + length) >> np.uint64(33)).astype(np.int32),
                })

    return run


#: Bits of the filter that keeps texts without a repeated window out of the shuffle: 1 MB, whatever the corpus' size.
FILTER_BITS = 1 << 23


def _held(texts: DataFrame, places: DataFrame) -> DataFrame:
    """``texts`` joined with ``places`` by doc_id; a bitmap of fixed size drops most other texts before they are shuffled."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = places.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = texts.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "bucket")  # 256 rows of 4 KB
    likely = likely.filter(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1)
    return likely.drop("bucket", "bits").join(places, "doc_id")


class SharedSpans:
    """Runs of at least ``length`` characters that different records have in common.

    ``edges`` finds where each run begins and ends, which coverage needs; pairs do without.
    """

    def __init__(self, documents: DataFrame, length: int = 200, edges: bool = False):
        self.length, self.edges, half, quarter = length, edges, length // 2, length // 4
        if quarter < 4:
            raise ValueError("length must be at least 16")
        texts = documents.select("doc_id", "text").filter(F.length("text") >= length)
        key = (F.xxhash64("text"), F.xxhash64(F.lit(7), "text"))
        same = materialize(texts.select("doc_id", key[0].alias("t1"), key[1].alias("t2"), F.length("text").alias("n")), "text-keys")
        self.classes = same.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"))
        copied = self.classes.filter("other > rep")
        #: doc_id -> the record that stands for all equal texts; only records with a double.
        self.members = materialize(same.join(copied.select("t1", "t2", "rep"), ["t1", "t2"]).select("doc_id", "rep", "n").distinct(), "text-classes")
        doubles = self.members.filter("doc_id <> rep").select("doc_id").distinct()

        samples = materialize(texts.mapInPandas(_sampler(length, quarter), "doc_id long, pos int, h long"), "windows")
        samples = samples.join(doubles, "doc_id", "left_anti")
        again = self._repeated(samples.select("h", "doc_id"), ["h"], ["doc_id"])
        places = samples.join(again, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
        self.held = held = materialize(_held(texts, places), "texts-with-repeats")

        wider = materialize(held.mapInPandas(_extender(length, half), "doc_id long, q int, h long, lh long, lg int, rh long, rg int"), "wider-windows")
        groups = wider.groupBy("h").agg(
            F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), (F.min("lh") != F.max("lh")).alias("l"), (F.min("rh") != F.max("rh")).alias("r")
        ).filter("d0 <> d1")
        mixed = (F.col("l") | F.col("r")) if edges else (F.col("l") & F.col("r"))
        kept = wider.join(groups.select("h", mixed.alias("mixed")), "h")
        #: Occurrences of windows repeated at half the length; equal surroundings, one class.
        self.places = materialize(kept.select("doc_id", "q", "lh", "lg", "rh", "rg", "mixed", F.xxhash64("lh", "rh", "lg", "rg").alias("around"), F.xxhash64(F.lit(7), "lh", "rh", "lg", "rg").alias("around2")), "half-windows")
        first = self.places.filter("mixed").groupBy("around", "around2").agg(F.min(F.struct("doc_id", "q")).alias("x")).select("around", "around2", "x.doc_id", "x.q")
        firsts = first.groupBy("doc_id").agg(F.collect_list(F.struct("q", "around", "around2")).alias("places"))
        whole = held.select("doc_id", "text").join(firsts, "doc_id").mapInPandas(_completer(length, half), "around long, around2 long, shift int, h long, g int")
        whole = materialize(whole, "whole-windows")
        shared = self._repeated(whole.select("h", "g", "around", "around2"), ["h", "g"], ["around", "around2"])
        #: (window of the full length, class) for windows in more than one class.
        self.windows = materialize(whole.join(shared, ["h", "g"], "left_semi"), "shared-windows")

    def _sides(self) -> DataFrame:
        """The windows of the full length that begin or end with a window repeated at half the length: h, g, doc_id, start."""
        rest = self.length - self.length // 2
        both = [(F.col(f"{s}h"), F.col(f"{s}g"), F.col("q") - (rest if s == "l" else 0)) for s in "lr"]
        out = [self.places.filter(g >= 0).select(h.alias("h"), g.alias("g"), "doc_id", start.alias("s")) for h, g, start in both]
        return out[0].unionByName(out[1])

    @staticmethod
    def _repeated(rows: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
        """Keys that occur with more than one value of ``of``; pre-aggregated, no group is collected."""
        ends = [f(c).alias(f"_{n}_{c}") for c in of for n, f in (("a", F.min), ("b", F.max))]
        several = functools.reduce(Column.__or__, [F.col(f"_a_{c}") != F.col(f"_b_{c}") for c in of])
        return rows.groupBy(*keys).agg(*ends).filter(several).select(*keys)

    @staticmethod
    def _one_of_each(rows: DataFrame, members: list[str]) -> DataFrame:
        """One window (h, g) for each different set of members, with its members; rows are distinct."""
        sets = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*members)).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), *members)).alias("y"))
        one = sets.filter("n > 1").groupBy("n", "x", "y").agg(F.min("h").alias("h"), F.min_by("g", "h").alias("g")).select("h", "g")
        return rows.join(one, ["h", "g"], "left_semi")

    @functools.cached_property
    def holders(self) -> DataFrame:
        """Windows of the full length (h, g) with the records that hold them (doc_id), one window for each different set of records.

        Any two different texts with a common run hold a window together here; of equal texts one record stands for all.
        """
        met = self._one_of_each(self.windows.select("h", "g", "around", "around2").distinct(), ["around", "around2"])
        joined = met.join(self.places.select("around", "around2", "doc_id").distinct(), ["around", "around2"]).select("h", "g", "doc_id")
        every = materialize(self._sides().select("h", "g", "doc_id").unionByName(joined).distinct(), "window-holders")
        return materialize(self._one_of_each(every, ["doc_id"]), "holder-sets")

    def passages(self) -> DataFrame:
        """Passages with the records that hold them, one row per record of each: passage, doc_id.

        Records with a common run hold a passage together, so no link between different texts is lost, and a passage in n records
        has n rows. Records with equal texts are held together by a passage of their own and stand in the others by the first.
        """
        shared = self.holders.select(F.concat_ws(":", F.hex("h"), F.hex("g")).alias("passage"), "doc_id")
        equal = self.members.select(F.concat_ws(":", F.lit("text"), "rep").alias("passage"), "doc_id")
        return shared.unionByName(equal).distinct()

    def longest(self) -> DataFrame:
        """For each record with a repeated window the greatest length of the doubling at which one of its windows is repeated elsewhere.

        A run common to two records of at least that length and what two samples may lie apart, ``length`` - ``length`` // 4
        characters, is found. Equal texts are repeated in full.
        """
        level, places, reached = self.length // 2, self.held, []
        while True:
            windows = materialize(places.select("doc_id", "text", "places").mapInPandas(_leveller(level), "doc_id long, pos int, h long, g int"), "level-windows")
            kept = materialize(windows.join(self._repeated(windows, ["h", "g"], ["doc_id"]), ["h", "g"], "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("places")), "level")
            if not kept.limit(1).count():
                break
            if level >= self.length:
                reached.append(kept.select("doc_id", F.lit(level).alias("n")))
            places = self.held.select("doc_id", "text").join(kept, "doc_id")
            level *= 2
        equal = self.members.select("doc_id", "n")
        every = functools.reduce(DataFrame.unionByName, reached, equal)
        return every.groupBy("doc_id").agg(F.max("n").cast("bigint").alias("shared_at_least"))

    def pairs(self) -> DataFrame:
        """Pairs of different records with a common run: doc_id_a < doc_id_b. As many rows as there are pairs, no candidate pairs before."""
        a, b = (self.holders.withColumnRenamed("doc_id", c) for c in "ab")
        between = a.join(b, ["h", "g"]).filter("a < b").select("a", "b").distinct()
        # equal texts: each stands for its class, so pairs of classes become pairs of their members
        m = self.members.select("doc_id", "rep")
        ma, mb = m.select(F.col("rep").alias("a"), F.col("doc_id").alias("a2")), m.select(F.col("rep").alias("b"), F.col("doc_id").alias("b2"))
        spread = between.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        within = m.select("rep", F.col("doc_id").alias("a")).join(m.select("rep", F.col("doc_id").alias("b")), "rep").filter("a < b").select("a", "b")
        every = spread.unionByName(within).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
        return every.filter("doc_id_a < doc_id_b").distinct()

    def coverage(self) -> DataFrame:
        """For each record with shared text: characters found elsewhere too, their share, and the number of separate spans.

        Equal texts count as found elsewhere in full.
        """
        if not self.edges:
            raise ValueError("coverage needs the exact ends of every span: edges=True")
        met = self.windows.select("around", "around2", "shift", "h", "g").join(self.places.select("around", "around2", "doc_id", "q"), ["around", "around2"])
        found = self._sides().unionByName(met.select("h", "g", "doc_id", (F.col("q") + F.col("shift")).alias("s"))).distinct()
        elsewhere = found.join(self._repeated(found, ["h", "g"], ["doc_id"]), ["h", "g"], "left_semi")
        spans = merged(elsewhere.select("doc_id", "s").distinct().withColumn("e", F.col("s") + self.length))
        per = spans.groupBy("doc_id").agg(F.sum(F.col("e") - F.col("s")).alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
        return per

    def report(self, documents: DataFrame) -> DataFrame:
        sizes = documents.select("doc_id", F.length("text").alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
        per = self.coverage()
        m = self.members.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n").alias("n"))
        joined = sizes.join(per, "doc_id", "left").join(m, "doc_id", "left")
        chars = F.when(F.col("n").isNotNull(), F.col("n")).otherwise(F.coalesce("shared_chars", F.lit(0)))
        return joined.select(
            "doc_id", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("n_chars"), chars.cast("bigint").alias("shared_chars"),
            F.when(F.col("n").isNotNull(), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
            F.coalesce(F.try_divide(chars, F.col("n_chars")), F.lit(0.0)).alias("share"),
        )


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (doc_id, s, e) of a record as one."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    return begins.withColumn("k", F.sum("new").over(w)).groupBy("doc_id", "k").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("k")
