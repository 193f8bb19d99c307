"""Frozen inputs of a batch: which regions of each page are read, fixed once, and the crops to read.

A page's regions are taken from its annotations, or else its layout, or else are the whole page, and
written as a manifest that is never written again: what later layouts say changes nothing. The jobs
are named by the bytes of their crops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, has_extent
from folioscope.operators.batch import WHOLE_PAGE
from folioscope.sources import images as pictures
from folioscope.sources.corpus import exists, load_corpus
from folioscope.sources.files import create_once, safe_column, save_whole, write_each
from folioscope.sources.publish import parts_of
from folioscope.sources.records import COORDINATES, read_frozen_inputs
from folioscope.sources.store import settle

FOLDER, CROPS = "htr-inputs", "crops"
_REGION = "struct<ord: int, r: struct<id: string, type: string, bbox: array<double>>>"


def _manifests(spark: SparkSession, root: str, pages: DataFrame, padding: int) -> DataFrame:
    """file and content of the manifest of each page (page_id, image)."""
    corpus = load_corpus(spark, root)
    drawn = corpus.artifacts.where("kind = 'annotations'").groupBy("page_id").agg(F.min("path").alias("drawn"))
    laid_out = corpus.artifacts.where("kind = 'layout' and path like 'alto/%'").groupBy("page_id").agg(F.min("path").alias("laid_out"))
    source = pages.join(drawn, "page_id", "left").join(laid_out, "page_id", "left").withColumn("source", F.coalesce("drawn", "laid_out"))
    source = source.withColumn("region_source", F.when(F.col("drawn").isNotNull(), F.col("drawn")).when(F.col("laid_out").isNotNull(), F.concat("laid_out", F.lit(" (machine layout)"))).otherwise(F.lit("whole image")))
    found = corpus.annotated.select("page_id", "source", "ord", "id", "region_type", *Box._fields).unionByName(corpus.machine.select("page_id", "source", "ord", "id", "region_type", *Box._fields))
    found = found.where("region_type <> 'illustration'").join(source.select("page_id", "source"), ["page_id", "source"])
    one = F.struct(F.col("ord").cast("int").alias("ord"), F.struct("id", F.col("region_type").alias("type"), F.array(*Box._fields).alias("bbox")).alias("r"))
    listed = found.groupBy("page_id").agg(F.sort_array(F.collect_list(one)).alias("listed"))
    whole = F.array(F.struct(F.lit(0).alias("ord"), F.struct(F.lit(WHOLE_PAGE["id"]).alias("id"), F.lit(WHOLE_PAGE["region_type"]).alias("type"), F.array(*(F.lit(WHOLE_PAGE[c]) for c in Box._fields)).alias("bbox")).alias("r")))
    rows = source.join(listed, "page_id", "left").withColumn("listed", F.when(F.col("source").isNull(), whole).otherwise(F.coalesce("listed", F.array().cast(f"array<{_REGION}>"))))
    document = F.to_json(F.struct("image", F.lit(COORDINATES).alias("coordinate_system"), "region_source", F.lit(padding).alias("padding"), F.transform("listed", lambda x: x["r"]).alias("regions")))
    return rows.select(F.concat(F.lit(f"{FOLDER}/"), "page_id", F.lit(".json")).alias("file"), document.cast("binary").alias("content"))


def prepare(spark: SparkSession, root: str, padding: int = pictures.PADDING) -> tuple[DataFrame, DataFrame]:
    """(inputs, issues) of the imaged pages of a corpus. Freezes the pages that aren't yet, and cuts the crops.

    inputs: page_id, ord, region_id, region_type, x1..y2, region_source (the manifest), frozen_from (where that
    has its regions from), image (the crop's path) and image_sha256 (of its bytes)."""
    root = root.rstrip("/")
    shown = pictures.read_images(spark, f"{root}/images")
    seen = settle(shown.where("ord = 0").withColumn("image", F.element_at(F.split("path", "/"), -1)), "prepare-images")
    fresh = seen
    if exists(spark, f"{root}/{FOLDER}"):
        have = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/{FOLDER}").select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("page_id"))
        fresh = settle(seen.join(have, "page_id", "left_anti"), "prepare-fresh")
    if not fresh.isEmpty():
        write_each(_manifests(spark, root, fresh.select("page_id", "image"), padding).repartition(parts_of(fresh), "file"), root, create_once)
    regions, issues = read_frozen_inputs(spark, root)
    regions = settle(regions, "prepare-regions")
    placed = regions.join(seen.select("page_id", "width", "height", "orientation", "path"), "page_id").withColumnsRenamed({c: f"box_{c}" for c in Box._fields})
    place = pictures.crop_rectangle(Box.of("box_"), F.col("width"), F.col("height"), F.col("orientation"), F.coalesce("padding", F.lit(padding)))
    placed = placed.select("page_id", "ord", F.col("id").alias("region_id"), "region_type", F.col("source").alias("region_source"), F.col("region_source").alias("frozen_from"), "path", *(f"box_{c}" for c in Box._fields), *place.columns())
    cut = settle(pictures.crop_images(seen.where("format is not null"), placed, parts_of(seen)), "prepare-crops")
    named = placed.join(cut.drop("path"), ["page_id", *Box._fields]).withColumn("image", F.concat(F.lit(f"{CROPS}/"), safe_column(F.col("page_id")), F.lit("/"), safe_column(F.col("region_id")), F.lit(".png")))
    write_each(named.where("content is not null").select(F.col("image").alias("file"), "content"), root, save_whole)
    empty = placed.where(~has_extent(Box.of())).select("path", F.concat(F.lit("no pixels in region "), "region_id").alias("message"))
    odd = seen.where("format is null").select("path", F.lit("no image that can be read").alias("message"))
    failed = cut.where("message is not null").select("path", "message").distinct().unionByName(empty).unionByName(odd)
    inputs = named.where("content is not null").select("page_id", "ord", "region_id", "region_type", *(F.col(f"box_{c}").alias(c) for c in Box._fields), "region_source", "frozen_from", "image", F.sha2("content", 256).alias("image_sha256"))
    return inputs, issues.unionByName(failed.select("path", F.lit("crops").alias("stage"), "message"))
