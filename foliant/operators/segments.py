"""Sentences with offsets, paragraph packing, batches: row-local segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.measure import utf16_length
from foliant.functions.text import WS, paragraphs, trim

_MARK = "\u0001"


def _pieces(text: Column, closers: bool) -> Column:
    """The text cut before the white space behind each closing mark; the pieces joined are the text."""
    ends = """([.!?]['"’”)\\]]*)""" if closers else "([.!?])"
    return F.split(F.regexp_replace(text, f"{ends}([{WS}])", f"$1{_MARK}$2"), _MARK)


#: Pieces summed up in one fold; a fold copies its array at each step.
_BLOCK = 256


def _starts(pieces: Column, unit) -> Column:
    """Where each piece starts: the sizes of those before it added up, within blocks and over the blocks."""
    running = lambda sizes, first: F.aggregate(sizes, F.array(first), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    sizes = F.transform(pieces, unit)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")), lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK)))
    firsts = running(F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), lambda a, n: a + n)), F.lit(0))
    within = F.zip_with(blocks, F.slice(firsts, 1, F.size(blocks)), lambda own, first: F.slice(running(own, first), 1, F.size(own)))
    return F.flatten(within)


def sentence_spans(text: Column, closers: bool = True, unit=utf16_length) -> Column:
    """array<struct<sent_no, text, start, end>> of the sentences, trimmed, in ``unit``; null text has none.

    Offsets are running sums of the pieces before, in folds of a row, so nothing is shuffled.
    """
    pieces = _pieces(text, closers)
    spans = F.zip_with(pieces, _starts(pieces, unit), lambda p, s: F.struct(
        trim(p).alias("text"), (s + unit(p) - unit(F.regexp_replace(p, f"^[{WS}]+", ""))).alias("start"),
    ))
    kept = F.filter(spans, lambda x: x["text"] != "")
    return F.transform(kept, lambda x, i: F.struct((i + 1).alias("sent_no"), x["text"].alias("text"), x["start"].alias("start"), (x["start"] + unit(x["text"])).alias("end")))


def sentences(rows: DataFrame, text: str, *keep: str, closers: bool = True, unit=utf16_length) -> DataFrame:
    """One row per sentence: ``keep``, sent_no, text, start, end."""
    return rows.select(*keep, F.explode(sentence_spans(F.col(text), closers, unit)).alias("x")).select(*keep, "x.sent_no", "x.text", "x.start", "x.end")


def packed_paragraphs(text: Column, limit: int = 1500, separator: str = "\n\n") -> Column:
    """Paragraphs joined up to ``limit`` UTF-8 bytes, separators behind each counted; a longer paragraph stays whole."""
    seed = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    gap = F.lit(separator)

    def step(acc: Column, p: Column) -> Column:
        full = (F.octet_length(acc["now"]) + F.octet_length(p) > limit) & (acc["now"] != "")
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(trim(acc["now"])))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, F.lit("")).otherwise(acc["now"]), p, gap).alias("now"),
        )

    def finish(acc: Column) -> Column:
        return F.when(trim(acc["now"]) != "", F.concat(acc["done"], F.array(trim(acc["now"])))).otherwise(acc["done"])

    return F.aggregate(paragraphs(text, separator), seed, step, finish)


def chunks(rows: DataFrame, text: str, *keep: str, limit: int = 1500, separator: str = "\n\n") -> DataFrame:
    """One row per packed chunk: ``keep``, chunk_no, text."""
    packed = rows.select(*keep, F.posexplode(packed_paragraphs(F.col(text), limit, separator)).alias("chunk_no", "text"))
    return packed.withColumn("chunk_no", F.col("chunk_no") + 1)


def batches(rows: DataFrame, size: int, partition: list[str], order: list[str]) -> DataFrame:
    """Rows numbered in batches of ``size`` from 0 within each partition."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("batch_no", F.floor((n - 1) / size).cast("int"))


def first_per(rows: DataFrame, n: int, partition: list[str], *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each partition, numbered in ``rank``; Catalyst keeps only n per partition before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in ``order``."""
    return first_per(rows, 1, keys, *order).drop("rank")
