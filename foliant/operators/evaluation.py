"""Predictions against labels: counts, ratios, error groups, thresholds, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.measure import ratio, ratio_or_zero

#: The metrics and the threshold each is held against: column, metric, direction.
THRESHOLDS = (
    ("delta_precision_min", "delta_precision", "min"), ("delta_recall_min", "delta_recall", "min"),
    ("familiar_suppression_rate_min", "familiar_suppression_rate", "min"), ("known_as_delta_rate_max", "known_as_delta_rate", "max"),
    ("visible_guidance_per_page_max", "visible_guidance_per_page", "max"), ("false_negative_delta_count_max", "false_negative_delta_count", "max"),
)


def joined(labels: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with the predictions of the same sentence."""
    return labels.join(predictions, keys)


def metrics(pairs: DataFrame, all_predictions: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, suppression and density by group.

    pairs (by, expected, predicted, directive) are labelled sentences; densities use all predictions
    (by, predicted, directive) over ``pages`` (by, n_pages). A ratio without denominator is null.
    """
    e, p, d = F.col("expected"), F.col("predicted"), F.col("directive")
    counts = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if((e == "delta") & (p == "delta")).alias("true_delta"), F.count_if((e != "delta") & (p == "delta")).alias("false_delta"),
        F.count_if((e == "delta") & (p != "delta")).alias("false_negative_delta_count"), F.count_if(e == "familiar").alias("familiar"),
        F.count_if((e == "familiar") & d.isin("soft_fade", "leave_normal")).alias("suppressed"), F.count_if((e == "familiar") & (p == "delta")).alias("known_as_delta"),
    )
    shown = all_predictions.groupBy(*by).agg(F.count_if(d != "leave_normal").alias("visible"))
    rows = counts.join(shown, by, "left").join(pages, by, "left")
    return rows.select(
        *by, "n_labels", "true_delta", "false_delta", "false_negative_delta_count",
        ratio(F.col("true_delta"), F.col("true_delta") + F.col("false_delta")).alias("delta_precision"),
        ratio(F.col("true_delta"), F.col("true_delta") + F.col("false_negative_delta_count")).alias("delta_recall"),
        ratio(F.col("suppressed"), F.col("familiar")).alias("familiar_suppression_rate"), ratio(F.col("known_as_delta"), F.col("familiar")).alias("known_as_delta_rate"),
        ratio_or_zero(F.coalesce("visible", F.lit(0)), F.coalesce("n_pages", F.lit(0))).alias("visible_guidance_per_page"),
    )


def ratios(pairs: DataFrame, predictions: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """Every measure of a group as one row: by, metric, numerator, denominator, value (null where the denominator is 0).

    pairs and predictions as for ``metrics``; densities count all predictions over the group's pages, at least one.
    """
    e, p, d = F.col("expected"), F.col("predicted"), F.col("directive")
    n = lambda c: F.count_if(c)
    hit = lambda v: n((e == v) & (p == v))
    familiar = n(e == "familiar")
    of_pairs = {
        "delta_precision": (hit("delta"), n(p == "delta")), "delta_recall": (hit("delta"), n(e == "delta")), "bridge_precision": (hit("bridge"), n(p == "bridge")), "bridge_recall": (hit("bridge"), n(e == "bridge")),
        "familiar_suppression_rate": (n((e == "familiar") & d.isin("soft_fade", "leave_normal")), familiar), "known_as_delta_rate": (n((e == "familiar") & (p == "delta")), familiar),
        "familiar_highlight_rate": (n((e == "familiar") & (d == "highlight")), familiar), "over_annotation_rate": (n((e == "familiar") & ~d.isin("soft_fade", "leave_normal")), F.count(F.lit(1))),
    }
    of_pages = {"visible_per_page": d != "leave_normal", "highlight_per_page": d == "highlight", "callout_per_page": d == "callout", "soft_fade_per_page": d == "soft_fade"}
    long = lambda rows, names: rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_n").alias("numerator"), F.col(f"{m}_d").alias("denominator")) for m in names])).alias("x")).select(*by, "x.*")
    labelled = pairs.groupBy(*by).agg(*[c.alias(f"{m}_{s}") for m, two in of_pairs.items() for s, c in zip("nd", two)])
    shown = predictions.groupBy(*by).agg(*[n(c).alias(f"{m}_n") for m, c in of_pages.items()]).join(pages, by, "left")
    shown = shown.withColumns({f"{m}_d": F.greatest(F.coalesce("n_pages", F.lit(0)), F.lit(1)).cast("bigint") for m in of_pages})
    coverage = predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("gold_coverage_d")).join(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("gold_coverage_n")), by, "left").withColumn("gold_coverage_n", F.coalesce("gold_coverage_n", F.lit(0)))
    rows = long(labelled, of_pairs).unionByName(long(shown, of_pages)).unionByName(long(coverage, ["gold_coverage"]))
    return rows.withColumn("value", ratio(F.col("numerator"), F.col("denominator")))


def error_groups(pairs: DataFrame) -> DataFrame:
    """Each labelled sentence once per group of errors it falls in."""
    e, p, d = F.col("expected"), F.col("predicted"), F.col("directive")
    groups = F.array_compact(F.array(
        F.when((e != "delta") & (p == "delta"), F.lit("false_positive_delta")), F.when((e == "delta") & (p != "delta"), F.lit("false_negative_delta")),
        F.when((e == "familiar") & (d == "highlight"), F.lit("familiar_highlight")), F.when((e == "bridge") != (p == "bridge"), F.lit("bridge_confusion")),
        F.when((e == "familiar") & ~d.isin("soft_fade", "leave_normal"), F.lit("over_annotated")),
    ))
    return pairs.withColumn("error_group", F.explode(groups))


def unpivot_thresholds(thresholds: DataFrame, key: str) -> DataFrame:
    """One row per set threshold: key, metric, direction, bound."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.col(c).cast("double").alias("bound")) for c, m, d in THRESHOLDS]))
    return thresholds.select(key, rows.alias("x")).select(key, "x.*").filter("bound is not null")


def violations(thresholds: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """Thresholds not kept. A metric that could not be computed breaks a minimum, never a maximum."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for _, m, _ in THRESHOLDS]))
    long = measured.select(key, values.alias("x")).select(key, "x.*")
    rows = unpivot_thresholds(thresholds, key).join(long, [key, "metric"])
    broken = F.when(F.col("direction") == "min", F.col("value").isNull() | (F.col("value") < F.col("bound"))).otherwise(F.coalesce(F.col("value") > F.col("bound"), F.lit(False)))
    return rows.filter(broken)


def distribution(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """Count by value; null and empty values don't count."""
    return rows.withColumn("value", value).filter("value is not null and value <> ''").groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(rows: DataFrame, value: str, values: tuple[str, ...], *by: str) -> DataFrame:
    """One column of counts for each of the values, 0 where none occurs."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(value) == v).alias(v) for v in values])


def count_map(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Counts by value as one map per group; counted before they are gathered."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "n")))).alias("counts"))


def unlabelled(candidates: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a label."""
    return candidates.join(labels.select(*keys), keys, "left_anti")


def unknown(labels: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Labels of no candidate."""
    return labels.join(candidates.select(*keys), keys, "left_anti")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
