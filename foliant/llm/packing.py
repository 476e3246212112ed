"""Filling fixed-capacity containers with items.

Bounded-space online best-fit: items come one after another; each goes into the open container with
the least room that still holds it. At most ``open_bins`` containers are open; to open one more, the
fullest is closed. Open containers are kept by free room, the rooms in use as bits of one integer, so
the best one is found by a shift and a count of trailing zeros. Items are divided by hash into groups
of bounded size that are packed independently; the containers left open at the groups' ends are
packed together the same way in a second pass.

Cases with a defined result: null and empty texts take no room and are not placed; an item larger
than the capacity is cut into full containers and a rest, an item of exactly the capacity is not cut;
rows with the same doc_id are items of their own; where doc_ids differ, the same input gives the same
containers whatever the partitioning; two capacities of one kind are two kinds, a null kind is one
without a name; without documents, or without capacities, there is no container; capacities below
one are an error.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import VOCABULARY, with_sizes
from foliant.session import materialize

OPEN_BINS = 64
#: Items of a group that one task packs.
GROUP_ITEMS = 20_000


def best_fit(sizes: list[int], capacity: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int], set[int]]:
    """(bin of each item, room left in each bin, bins still open at the end)."""
    rooms = 0
    by_room: dict[int, list[int]] = defaultdict(list)
    n_open = 0
    place: list[int] = []
    left: list[int] = []
    for size in sizes:
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_no = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            n_open -= 1
        else:
            if n_open >= open_bins:
                fullest = (rooms & -rooms).bit_length() - 1
                by_room[fullest].pop()
                if not by_room[fullest]:
                    rooms &= ~(1 << fullest)
                n_open -= 1
            bin_no, room = len(left), capacity
            left.append(capacity)
        place.append(bin_no)
        left[bin_no] = room - size
        if room > size:
            by_room[room - size].append(bin_no)
            rooms |= 1 << (room - size)
            n_open += 1
    return place, left, {b for bins in by_room.values() for b in bins}


PLACED = "container_kind string, capacity_tokens int, grp long, bin int, is_open boolean, room int, doc_id long, row_no long, part_no int, token_start long, token_end long, n_tokens long"


def _pack_group(open_bins: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["ord", "doc_id", "row_no", "part_no"], kind="stable")
        place, left, still = best_fit(items["n_tokens"].tolist(), int(items["capacity_tokens"].iloc[0]), open_bins)
        out = items.drop(columns=["ord"]).assign(bin=place, room=[left[b] for b in place], is_open=[b in still for b in place])
        return out[[c.split()[0] for c in PLACED.split(", ")]]

    return run


def _groups(n: int, per: int) -> int:
    return max(1, -(-n // per))


class Packing:
    """Where each text lies, for each kind of container."""

    def __init__(self, documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, open_bins: int = OPEN_BINS, group_items: int = GROUP_ITEMS):
        sized = materialize(with_sizes(documents, "doc_id", vocabulary=vocabulary).withColumn("place", F.monotonically_increasing_id()), "token-sizes")
        n = sized.count()
        # rows that share a doc_id are told apart by their place in the written table, so they spread over the groups
        shared = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("shared"))
        sized = sized.join(shared, "doc_id", "left").select("doc_id", "n_tokens", F.when(F.col("shared"), F.col("place") + 1).otherwise(F.lit(0)).alias("row_no"))
        # the kinds of container are a short list of settings, whose length does not depend on the corpus
        kinds = {(r["container_kind"] or "", r["capacity_tokens"]) for r in containers.select("container_kind", "capacity_tokens").filter("capacity_tokens is not null").distinct().collect()}
        if any(capacity < 1 for _, capacity in kinds):
            raise ValueError("a capacity must be at least 1")
        each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in sorted(kinds)])
        if not kinds:
            each = F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
        parts = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_tokens") / F.col("capacity_tokens")) - 1).cast("int")))
        items = sized.select("*", F.inline(each)).select("*", parts.alias("part_no")).withColumns({
            "token_start": F.col("part_no").cast("bigint") * F.col("capacity_tokens"),
            "token_end": F.least((F.col("part_no").cast("bigint") + 1) * F.col("capacity_tokens"), F.col("n_tokens")),
        }).withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
        kind = F.concat_ws("-", "container_kind", "capacity_tokens")
        order = F.xxhash64("container_kind", "capacity_tokens", "doc_id", "row_no", "part_no")
        full = items.filter("n_tokens = capacity_tokens").select(
            "container_kind", "capacity_tokens", F.concat_ws("-", kind, F.lit("full"), "doc_id", "row_no", "part_no").alias("container_id"),
            "doc_id", "row_no", "part_no", "token_start", "token_end", "n_tokens", F.lit(0).alias("unused_tokens"),
        )
        rest = items.filter("n_tokens < capacity_tokens").withColumns({"ord": order, "grp": F.pmod(order, F.lit(_groups(n, group_items)))})
        columns = ["container_kind", "capacity_tokens", "grp", "ord", "doc_id", "row_no", "part_no", "token_start", "token_end", "n_tokens"]
        placed = materialize(rest.select(*columns).groupBy("container_kind", "capacity_tokens", "grp").applyInPandas(_pack_group(open_bins), PLACED), "placed")

        ends = placed.filter("is_open").groupBy("container_kind", "capacity_tokens", "grp", "bin").agg((F.max("capacity_tokens") - F.max("room")).cast("bigint").alias("n_tokens"))
        again = F.xxhash64("container_kind", "capacity_tokens", "grp", "bin")
        bins = ends.select(
            "container_kind", "capacity_tokens", F.pmod(again, F.lit(_groups(_groups(n, group_items) * open_bins, group_items))).alias("grp"), again.alias("ord"),
            F.col("grp").alias("doc_id"), F.col("bin").cast("bigint").alias("row_no"), F.lit(0).alias("part_no"), F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("token_end"), "n_tokens",
        )
        merged = bins.groupBy("container_kind", "capacity_tokens", "grp").applyInPandas(_pack_group(open_bins), PLACED)
        moved = merged.select("container_kind", "capacity_tokens", F.col("doc_id").alias("grp"), F.col("row_no").cast("int").alias("bin"), F.lit(True).alias("is_open"), F.concat_ws("-", kind, F.lit("end"), "grp", "bin").alias("new_id"), F.col("room").alias("new_room"))
        joined = placed.join(moved, ["container_kind", "capacity_tokens", "grp", "bin", "is_open"], "left")
        packed = joined.select(
            "container_kind", "capacity_tokens", F.coalesce("new_id", F.concat_ws("-", kind, "grp", "bin")).alias("container_id"),
            "doc_id", "row_no", "part_no", "token_start", "token_end", "n_tokens", F.coalesce("new_room", "room").alias("unused_tokens"),
        )
        self.placed = full.unionByName(packed)

    def placement(self) -> DataFrame:
        """Which text, or which tokens of it, lies in which container, and the container's unused room."""
        return self.placed.drop("row_no")

    def unused(self) -> DataFrame:
        """For each kind of container: containers, tokens placed, room left, and its share."""
        one = self.placed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
        return one.groupBy("container_kind", "capacity_tokens").agg(
            F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("used_tokens"), F.sum(F.col("capacity_tokens") - F.col("used")).alias("unused_tokens"),
            (F.sum(F.col("capacity_tokens") - F.col("used")) / F.sum("capacity_tokens").cast("double")).alias("unused_share"),
        )
