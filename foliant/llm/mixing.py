"""Mixing sources to target weights.

Each document is repeated a Poisson number of times, found by inverting the distribution at a number
drawn from a hash of seed and doc_id, and never more often than its source allows. The mean of each
source is the one at which the source's tokens, so counted, come closest to its target. The total is
the largest that all sources can fill within their repeats, or ``total_tokens``; at a total above that
largest one, sources that cannot fill their share give all they may, and the report shows the deviation. The draw has 4,096 values, so a table of
tokens by source and draw gives each source's tokens at any mean exactly; it comes to the driver, and
its size depends on the number of targets alone.

Cases with a defined result: null and empty texts hold no token and are not chosen; spellings of a
source that differ in case, surrounding space, or between space, hyphen and underscore are one
source; documents without a source, or of one without a target, are not chosen and are reported with
target 0; a target source without documents is reported with 0 tokens and leaves the others' relation
as it is; a null or smaller max_repeats than 1 counts as 1; rows with one doc_id are repeated alike;
empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import VOCABULARY, with_sizes
from foliant.session import materialize

DRAWS = 4096


def clean_source(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"[\s ]+", " "))), "[ _]", "-")


def cumulative(mean: float, cap: int) -> list[float]:
    """P(N <= j) for j = 0 .. cap - 1, N Poisson with this mean."""
    if mean <= 0.0:
        return [1.0] * cap
    log, total, out = -mean, 0.0, []
    for j in range(cap):  # by logarithms, as exp(-mean) alone may be too small for a number
        total += math.exp(log)
        out.append(min(total, 1.0))
        log += math.log(mean / (j + 1))
    return out


def top_mean(cap: int) -> float:
    """A mean at which every draw gives ``cap`` repeats: fewer have less than half a draw's probability there."""
    return cap + 6.0 * math.sqrt(cap) + 12.0


def repeats(mean: float, cap: int) -> np.ndarray:
    """The number of repeats at each draw."""
    u = (np.arange(DRAWS) + 0.5) / DRAWS
    return np.searchsorted(np.array(cumulative(mean, cap)), u, side="left")


def fit_mean(tokens: np.ndarray, cap: int, target: float) -> float:
    """The mean at which the repeated tokens come closest to ``target``; they never fall as the mean rises."""
    filled = lambda mean: float(tokens @ repeats(mean, cap))
    low, high = 0.0, top_mean(cap)
    if filled(high) <= target:
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if filled(middle) <= target else (low, middle)
    return low if target - filled(low) <= filled(high) - target else high


class Mixture:
    """Chosen documents with their repeats, and the shares that come out."""

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY, total_tokens: float | None = None):
        spark = documents.sparkSession
        self.seed = seed
        draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(DRAWS)).cast("int")
        named = documents.select("doc_id", F.coalesce(clean_source(F.col("source")), F.lit("")).alias("source"), "text")
        self.sized = materialize(with_sizes(named, "doc_id", "source", vocabulary=vocabulary).withColumn("draw", draw), "mix-sizes")
        wanted = targets.select(clean_source(F.col("source")).alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("cap")).filter("source is not null and target_share > 0")
        wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("cap").alias("cap"))
        table = {r["source"]: (float(r["target_share"]), int(r["cap"])) for r in wanted.collect()}
        whole = sum(share for share, _ in table.values())
        by_draw: dict[str, np.ndarray] = {s: np.zeros(DRAWS) for s in table}
        held = self.sized.join(wanted.select("source"), "source", "left_semi").groupBy("source", "draw").agg(F.sum("n_tokens").alias("n"))
        for source, at, n in held.toPandas().itertuples(index=False, name=None):
            by_draw[source][at] = n
        present = [s for s in table if by_draw[s].sum()]
        fillable = min((by_draw[s].sum() * table[s][1] / (table[s][0] / whole) for s in present), default=0.0)
        self.total = fillable if total_tokens is None else float(total_tokens)
        plan = []
        for s in sorted(table):
            share, cap = table[s][0] / whole, table[s][1]
            mean = fit_mean(by_draw[s], cap, self.total * share) if s in present else 0.0
            plan.append((s, share, cap, mean, cumulative(mean, cap)))
        self.plan = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, mean double, cdf array<double>")

    def chosen(self) -> DataFrame:
        """Every chosen document with its number of repeats: doc_id, source, n_tokens, repeats."""
        u = (F.col("draw") + 0.5) / DRAWS
        counted = self.sized.join(self.plan.select("source", "cdf"), "source").withColumn("repeats", F.size(F.filter("cdf", lambda c: c < u)))
        return counted.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")

    def mixture(self) -> DataFrame:
        """The mixture itself, each document once per repeat, in a global random order."""
        each = self.chosen().select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("repeat_no"))
        return each.withColumn("order_key", F.xxhash64(F.lit(self.seed + 1), "doc_id", "repeat_no")).orderBy("order_key", "doc_id", "repeat_no")

    def shares(self) -> DataFrame:
        """For each source: what it holds, what it was to give, what it gives, and the difference. A source whose few documents are large
        comes only as close as they allow."""
        all_of = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("n_documents"))
        used = self.chosen().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("n_chosen"))
        used = materialize(used, "mix-used")
        total = used.agg(F.sum("mixed_tokens").alias("total")).first()["total"]
        joined = all_of.join(self.plan.drop("cdf"), "source", "full").join(used, "source", "left").withColumn("total", F.lit(total).cast("bigint"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
        actual = F.coalesce(F.try_divide("mixed_tokens", "total"), F.lit(0.0))
        return joined.select(
            "source", zero("source_tokens"), zero("n_documents"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), F.coalesce("mean", F.lit(0.0)).alias("mean"),
            zero("mixed_tokens"), zero("most_repeats"), zero("n_chosen"), actual.alias("actual_share"), (actual - F.coalesce("target_share", F.lit(0.0))).alias("deviation"),
        )
