"""Lengths and slices in the three units in use: UTF-8 bytes, characters, UTF-16 units; and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The characters that lie wholly in [start, end), counted in UTF-16 units; half a surrogate pair is left out."""
    raw = F.substring(F.encode(text, "UTF-16BE"), start * 2 + 1, F.greatest(end - start, F.lit(0)) * 2)
    low = F.hex(F.substring(raw, F.lit(1), F.lit(1))).between("DC", "DF")
    tail = F.when(low, F.substring(raw, F.lit(3), F.octet_length(raw))).otherwise(raw)
    high = F.hex(F.substring(tail, F.octet_length(tail) - 1, F.lit(1))).between("D8", "DB")
    return F.decode(F.when(high, F.substring(tail, F.lit(1), F.octet_length(tail) - 2)).otherwise(tail), "UTF-16BE")


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def clamp_unit(x: Column, missing: float = 0.5) -> Column:
    """Into [0, 1]; null and NaN become ``missing``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(missing)), F.lit(missing))))


def all_finite(xs: Column, size: int) -> Column:
    """Whether an array has ``size`` numbers, all finite."""
    bad = F.exists(xs, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(xs) == size) & ~bad, F.lit(False))
