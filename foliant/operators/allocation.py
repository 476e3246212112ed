"""Greedy allocation of page spans under density caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank and largest share of a page's spans of each style, as a rule and in focus.
STYLES = (("delta", 2, 0.18), ("familiar", 1, 0.34))
FOCUS_STYLES = (("delta", 2, 0.1), ("familiar", 1, 0.22))

_STATE = "struct<used:int,taken:array<int>,out:array<struct<unit:string,style:string,result:string,spans:array<int>>>>"


def _take(style: str, cap: Column):
    def step(acc: Column, c: Column) -> Column:
        free = F.array_except(c["spans"], acc["taken"])
        n = F.size(free)
        result = (
            F.when(acc["used"] >= cap, "density_cap").when(n == 0, "overlap_conflict").when(acc["used"] + n > cap, "density_cap").otherwise("allocated")
        )
        fits = result == "allocated"
        own = F.when(fits, free).otherwise(F.array().cast("array<int>"))
        row = F.struct(c["unit"].alias("unit"), F.lit(style).alias("style"), result.alias("result"), own.alias("spans"))
        return F.struct(
            (acc["used"] + F.when(fits, n).otherwise(0)).cast("int").alias("used"),
            F.concat(acc["taken"], own).alias("taken"), F.concat(acc["out"], F.array(row)).alias("out"),
        ).cast(_STATE)

    return step


def allocate(candidates: DataFrame, span_counts: DataFrame, styles: tuple[tuple[str, int, float], ...] = STYLES) -> DataFrame:
    """candidates (document_id, page, unit, style, confidence, ordinal, spans array<int>), span_counts (document_id, page, n_spans).

    On each page the styles take spans in order of rank, within a style by confidence, number of spans
    and input order. A candidate is refused when the cap is reached or would be passed (a later,
    smaller one may still fit) and when all its spans are taken. One page's candidates meet in one fold.
    """
    entry = F.struct((-F.col("confidence")).alias("c"), (-F.size("spans")).alias("n"), "ordinal", F.col("unit").cast("string").alias("unit"), "spans")
    by_style = [F.array_sort(F.collect_list(F.when((F.col("style") == s) & (F.size("spans") > 0), entry))).alias(s) for s, _, _ in styles]
    pages = candidates.join(span_counts, ["document_id", "page"]).groupBy("document_id", "page").agg(F.max("n_spans").alias("n_spans"), *by_style)
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"), F.array().alias("out")).cast(_STATE)
    for style, _, share in styles:
        cap = F.greatest(F.lit(1), F.floor(F.col("n_spans") * F.lit(share))).cast("int")
        state = F.aggregate(style, F.struct(F.lit(0).alias("used"), state["taken"].alias("taken"), state["out"].alias("out")).cast(_STATE), _take(style, cap))
    return pages.select("document_id", "page", F.explode(state["out"]).alias("x")).select("document_id", "page", "x.unit", "x.style", "x.result", "x.spans")
