"""Detection and text metrics over matches.

Two policies for empty denominators stand side by side on purpose: page metrics give 0.0, pooled
corpus metrics give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.matching import match_regions


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn; 0.0 on empty denominators."""
    tp = F.col("tp")
    rated = counts.withColumn("precision", F.coalesce(_ratio(tp, tp + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(_ratio(tp, tp + F.col("fn")), F.lit(0.0)))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def _counted(truth: DataFrame, predictions: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp and fn by keys: one aggregation over all regions and matches together."""
    parts = [(truth, 1, 0, 0), (predictions, 0, 1, 0), (matches, 0, 0, 1)]
    rows = [df.select(*keys, *(F.lit(v).alias(n) for v, n in zip(x, ("t", "p", "m"), strict=True))) for df, *x in parts]
    total = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in "tpm"))
    return total.select(*keys, F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("t") - F.col("m")).alias("fn"))


def detection_metrics(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5, same_type: bool = True) -> DataFrame:
    """By page: tp, fp, fn, precision, recall and f1."""
    return with_rates(_counted(truth, predictions, match_regions(truth, predictions, threshold, same_type), ["page_id"]))


def metrics_by_type(truth: DataFrame, predictions: DataFrame, threshold: float = 0.5, large: int | None = None) -> DataFrame:
    """By page and type, matched within the type; types of either side have a row. ``large``: see ``matching``."""
    matches = match_regions(truth, predictions, threshold, True, large=large).withColumn("region_type", F.col("t_type"))
    return with_rates(_counted(truth, predictions, matches, ["page_id", "region_type"]))


def classification_accuracy(matches: DataFrame, *by: str) -> DataFrame:
    """Share of matches with equal types; 0.0 without matches."""
    return matches.groupBy(*by).agg(F.coalesce(F.avg(F.col("type_match").cast("double")), F.lit(0.0)).alias("accuracy"))


def pooled_metrics(by_type: DataFrame, min_pages: int = 1, run: str = "run") -> DataFrame:
    """By run and type over pages: summed counts and their ratios, null on empty denominators.
    ``by_type`` has run, page_id, region_type, tp, fp, fn, and the pages of a run even if empty;
    runs with fewer than ``min_pages`` pages are left out."""
    if min_pages < 1:
        raise ValueError("min_pages must be positive")
    pages = by_type.groupBy(run).agg(F.countDistinct("page_id").alias("pages")).where(F.col("pages") >= min_pages)
    total = by_type.where("region_type is not null").groupBy(run, "region_type").agg(
        *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")),
        F.count_if((F.col("tp") + F.col("fn")) > 0).alias("truth_pages"), F.count_if((F.col("tp") + F.col("fp")) > 0).alias("predicted_pages"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.join(pages, run).select(
        run, "region_type", "pages", (tp + fn).alias("reference_regions"), (tp + fp).alias("predicted_regions"), "tp", "fp", "fn", "truth_pages", "predicted_pages",
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
