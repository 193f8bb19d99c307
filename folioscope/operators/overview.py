"""Corpus roll-ups from the normalised tables.

``systems``: page_id, system, source, prompt_version, reviewed, skipped_blocks, sys_ord;
``regions``: page_id, source, ord, region_type, box; ``artifacts``: page_id, path, kind, origin, role,
reviewed_text; ``manifest``: page_id, manuscript_id, layout_review_complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.labels import SYSTEM_NAMES, SYSTEM_ORDER, display_label, system_name
from folioscope.functions.text import strip
from folioscope.operators.matching import LARGE
from folioscope.operators.metrics import metrics_by_type, pooled_metrics


def type_counts(regions: DataFrame, *by: str) -> DataFrame:
    """Regions by display label."""
    return regions.groupBy(*by, display_label(F.col("region_type")).alias("label")).agg(F.count("*").alias("n"))


def type_pivot(regions: DataFrame, systems: list[str]) -> DataFrame:
    """A row for each type, a column for each system, 0 where there is none."""
    return regions.groupBy("region_type").pivot("system", systems).count().na.fill(0)


def type_totals(regions: DataFrame) -> DataFrame:
    """Counts by type and system with both kinds of totals (null stands for all)."""
    return regions.cube("region_type", "system").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def run_name(system: Column, prompt_version: Column) -> Column:
    return F.concat_ws(" · ", system, F.coalesce(prompt_version, F.lit("unrecorded")))


def coverage(artifacts: DataFrame, spark: SparkSession) -> DataFrame:
    """Pages with a prediction of each known system, of any task; known systems always have a row."""
    known = spark.createDataFrame([(n,) for n in SYSTEM_ORDER], "system string")
    origins = [*SYSTEM_NAMES, SYSTEM_ORDER[0]]
    found = artifacts.where((F.col("role") == "prediction") & F.col("origin").isin(origins)).groupBy(system_name(F.col("origin")).alias("system")).agg(F.countDistinct("page_id").alias("pages"))
    return known.join(found, "system", "left").select("system", F.coalesce("pages", F.lit(0)).alias("pages"))


def reviewed_pages(*sources: DataFrame) -> DataFrame:
    """Distinct pages in any of the sources (page_id)."""
    rows = sources[0].select("page_id")
    for s in sources[1:]:
        rows = rows.unionByName(s.select("page_id"))
    return rows.agg(F.countDistinct("page_id").alias("reviewed_pages"))


def run_counts(systems: DataFrame, regions: DataFrame) -> DataFrame:
    """By run: pages, records and regions. Records without regions count."""
    per_record = regions.groupBy("page_id", "source").agg(F.count("*").alias("n"))
    rows = systems.where(~F.col("reviewed")).join(per_record, ["page_id", "source"], "left")
    return rows.groupBy(run_name(F.col("system"), F.col("prompt_version")).alias("run")).agg(
        F.countDistinct("page_id").alias("pages"), F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("regions")
    )


def run_type_counts(systems: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions by run and display label; a run without regions has no row."""
    runs = systems.where(~F.col("reviewed")).select("page_id", "source", run_name(F.col("system"), F.col("prompt_version")).alias("run"))
    return type_counts(runs.join(regions.select("page_id", "source", "region_type"), ["page_id", "source"]), "run")


def manuscript_count(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """manuscripts (null if none is mapped), mapped_pages and mapping_complete, over known pages."""
    named = F.col("manuscript_id").isNotNull() & (strip(F.col("manuscript_id")) != "")
    joined = pages.select("page_id").distinct().join(manifest.select("page_id", "manuscript_id"), "page_id", "left")
    return joined.agg(
        F.nullif(F.countDistinct(F.when(named, F.col("manuscript_id"))), F.lit(0)).alias("manuscripts"), F.count_if(named).alias("mapped_pages"),
        F.coalesce((F.count_if(named) == F.count("*")) & (F.count("*") > 0), F.lit(False)).alias("mapping_complete"),
    )


def htr_coverage(readings: DataFrame, groups: DataFrame) -> DataFrame:
    """available and evaluated regions, pairs, and pages evaluated. Readings and groups of a page are counted where
    the page is, so only its sums travel."""
    done = F.col("metrics").isNotNull()
    read = readings.select("page_id", F.col("group_ord").alias("ord"), F.lit(1).alias("n"), F.when(done, 1).otherwise(0).alias("done"))
    rows = groups.select("page_id", "ord", F.struct("region_source", "id").alias("key")).unionByName(read, allowMissingColumns=True)
    placed = rows.where("page_id is not null and ord is not null").groupBy("page_id", "ord").agg(F.collect_list("key").alias("keys"), F.sum("n").alias("n"), F.sum("done").alias("done"))
    keyed = placed.where("n > 0").select("page_id", F.explode("keys").alias("key"), "done")
    pages = keyed.groupBy("page_id", "key").agg(F.sum("done").alias("done")).groupBy("page_id").agg(F.count("*").alias("available"), F.count_if(F.col("done") > 0).alias("evaluated"), F.sum("done").alias("pairs"))
    return pages.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("available", "evaluated", "pairs")), F.count_if(F.col("evaluated") > 0).alias("evaluated_pages"))


def eligible_records(systems: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be evaluated (page_id, run, source, reference), and combinations of page and
    run with several records. A page counts if its layout is declared complete and it has exactly one
    corrected layout, without skipped blocks."""
    complete = manifest.where("layout_review_complete").select("page_id").distinct()
    reference = systems.where("reviewed").groupBy("page_id").agg(F.count("*").alias("n"), F.max("skipped_blocks").alias("skipped"), F.min("source").alias("reference")).where("n = 1 and skipped = 0")
    runs = systems.where(~F.col("reviewed")).groupBy("page_id", run_name(F.col("system"), F.col("prompt_version")).alias("run")).agg(F.count("*").alias("records"), F.min("source").alias("source"))
    usable = runs.join(complete, "page_id", "left_semi").join(reference.select("page_id", "reference"), "page_id")
    return usable.where("records = 1").drop("records"), usable.where("records > 1")


def evaluations(systems: DataFrame, regions: DataFrame, manifest: DataFrame, min_pages: int = 5, threshold: float = 0.5) -> dict[str, DataFrame]:
    """evaluations by run and type, eligible runs with their pages, and the ambiguous count."""
    records, ambiguous = eligible_records(systems, manifest)
    part = lambda source: records.select(F.concat_ws("\u0001", "run", "page_id").alias("k"), F.col("page_id").alias("page"), F.col(source).alias("source")).join(
        regions.withColumnRenamed("page_id", "page"), ["page", "source"]
    ).select(F.col("k").alias("page_id"), "ord", "region_type", "x1", "y1", "x2", "y2")
    by_type = metrics_by_type(part("reference"), part("source"), threshold, LARGE)
    by_type = by_type.select(F.split("page_id", "\u0001").alias("k"), "region_type", "tp", "fp", "fn").select(F.col("k")[0].alias("run"), F.col("k")[1].alias("page_id"), "region_type", "tp", "fp", "fn")
    empty = records.select("run", "page_id", *(F.lit(None).cast(t).alias(c) for c, t in (("region_type", "string"), ("tp", "long"), ("fp", "long"), ("fn", "long"))))
    return {
        "evaluations": pooled_metrics(by_type.unionByName(empty), min_pages),
        "eligible": records.groupBy("run").agg(F.countDistinct("page_id").alias("pages")),
        "ambiguous": ambiguous.agg(F.count("*").alias("excluded_ambiguous")),
    }
