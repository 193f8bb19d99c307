"""Saved JSON records as tables: model results, annotations, frozen inputs, failures, the manifest.

Files are read whole and parsed to VARIANT, so values keep the types they were saved with: a
confidence saved as a string stays readable as a number, and unknown keys stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, valid_box
from folioscope.functions.ids import stem
from folioscope.functions.labels import region_type
from folioscope.sources.paths import either, file_path, placed, unpacked

COORDINATES = "normalized-1000"
OUTSIDE = "outside the data folder"
KNOWN_KEYS = ("id", "type", "bbox", "confidence", "text", "language", "script")
_VARIANTS = "array<variant>"


def read_json(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """path (below ``root``), outside (it isn't below it) and v (null if the file is no JSON), for all files below ``path``,
    plain or compressed (*.json.gz, named without that end)."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=either("json"), recursiveFileLookup=True)
    return unpacked(placed(files, root or path)).select("path", "outside", F.try_parse_json("value").alias("v"))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, ... of a variant; null for none."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def text_of(v: Column, path: str) -> Column:
    """The string at ``path``; null if there is something else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def shown(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _list(v: Column, path: str) -> Column:
    return F.when(kind(F.try_variant_get(v, path, "variant")) == "ARRAY", F.try_variant_get(v, path, _VARIANTS))


def item_box(item: Column) -> Column:
    """The array of four at bbox as doubles; null if it isn't that. Elements that are no numbers are null."""
    box = _list(item, "$.bbox")
    return F.when(F.size(box) == 4, F.transform(box, lambda x: F.try_variant_get(x, "$", "double")))


def _box(values: Column) -> Box:
    return Box(*(F.get(values, F.lit(i)) for i in range(4)))


def json_regions(records: DataFrame, source: Column, items: Column) -> tuple[DataFrame, DataFrame]:
    """(regions, rejected): the regions of records with a list of ``items`` (array of variant).

    Items that are no object, or whose bbox is no list of four, are skipped. A box with other than
    numbers, out of range or without extent rejects its whole record. Regions: path, ord, id,
    region_type, box, confidence, confidence_raw, text, language, script, metadata (other keys)."""
    # Kind and box of each item are taken once; what follows reads them as fields.
    taken = F.transform(items, lambda x: F.struct(x.alias("item"), kind(x).alias("kind"), item_box(x).alias("box")))
    rows = records.withColumn("source_name", source).withColumn("items", taken)
    usable = lambda x: (x["kind"] == "OBJECT") & x["box"].isNotNull()
    bad = F.exists("items", lambda x: F.coalesce(usable(x), F.lit(False)) & ~valid_box(_box(x["box"])))
    rows = rows.withColumn("bad", F.coalesce(bad, F.lit(False)))
    rejected = rows.where("bad").select("path", F.lit("regions").alias("stage"), F.lit("invalid bounding box").alias("message"))
    flat = rows.where("not bad").select("path", "source_name", F.posexplode("items").alias("ord", "x")).where(usable(F.col("x")))
    item, box = F.col("x.item"), _box(F.col("x.box"))
    label = F.when(kind(F.try_variant_get(item, "$.type", "variant")) == "STRING", shown(item, "$.type"))
    others = F.map_filter(F.try_variant_get(item, "$", "map<string,variant>"), lambda k, v: ~k.isin(*KNOWN_KEYS))
    return flat.select(
        "path", "ord", F.coalesce(shown(item, "$.id"), F.format_string("%s-%04d", F.col("source_name"), F.col("ord"))).alias("id"), region_type(label).alias("region_type"), *box.columns(),
        F.try_variant_get(item, "$.confidence", "double").alias("confidence"), F.try_variant_get(item, "$.confidence", "variant").alias("confidence_raw"),
        shown(item, "$.text").alias("text"), shown(item, "$.language").alias("language"), shown(item, "$.script").alias("script"), F.to_json(others).alias("metadata"),
    ), rejected


def read_results(spark: SparkSession, root: str, folder: str = "results") -> tuple[DataFrame, DataFrame]:
    """(results, issues). results: path, page_id, model_dir, and the record's typed fields, with v.

    A path of fewer than three parts, a file that isn't JSON, or a response that is no object is an
    issue; so is a layout without a list of regions."""
    base = f"{root.rstrip('/')}/{folder}"
    rows = read_json(spark, base, root).withColumn("parts", F.split(F.substring("path", len(folder) + 2, 1 << 20), "/"))
    v = F.col("v")
    rows = rows.withColumn("task", F.coalesce(F.nullif(shown(v, "$.task"), F.lit("")), F.lit("Unspecified task")))
    message = (
        F.when(F.col("outside"), OUTSIDE)
        .when(F.size("parts") < 3, "expected page/model/name")
        .when(v.isNull() | (kind(v) != "OBJECT"), "not a JSON object")
        .when(F.coalesce(kind(F.try_variant_get(v, "$.response", "variant")), F.lit("")) != "OBJECT", "response is not an object")
        .when((F.col("task") == "segmentation") & _list(v, "$.response.regions").isNull(), "no region list")
    )
    rows = rows.withColumn("message", message)
    issues = rows.where("message is not null").select("path", F.lit("results").alias("stage"), "message")
    r = "$.response"
    return rows.where("message is null").select(
        "path", F.get("parts", F.lit(0)).alias("page_id"), F.get("parts", F.lit(1)).alias("model_dir"), "task",
        F.coalesce(F.nullif(shown(v, "$.model"), F.lit("")), F.get("parts", F.lit(1))).alias("model"),
        *(shown(v, f"$.{c}").alias(c) for c in ("prompt_version", "image", "prompt", "region_id", "region_source", "image_sha256", "raw_content")),
        F.try_variant_get(v, "$.elapsed_seconds", "double").alias("elapsed_seconds"),
        text_of(v, f"{r}.transcription").alias("transcription"), shown(v, f"{r}.script").alias("script"), shown(v, f"{r}.language").alias("language"),
        _list(v, f"{r}.regions").alias("items"), "v",
    ), issues


def read_annotations(spark: SparkSession, root: str, folder: str = "ground-truth") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, regions, issues) of annotation files directly in ``folder``. A document's
    ``reviewed_text`` says whether a human has read any of its regions."""
    rows = read_json(spark, f"{root.rstrip('/')}/{folder}", root).where(F.col("outside") | F.col("path").rlike(f"^{folder}/[^/]+$"))
    v, items = F.col("v"), _list(F.col("v"), "$.regions")
    have = lambda x, k: F.try_variant_get(x, f"$.{k}", "variant").isNotNull()
    whole = have(v, "image") & have(v, "image_width") & have(v, "image_height") & F.forall(F.coalesce(items, F.array().cast(_VARIANTS)), lambda x: have(x, "id") & have(x, "type") & item_box(x).isNotNull())
    system = F.coalesce(shown(v, "$.coordinate_system"), F.lit(COORDINATES))
    rows = rows.withColumn("message", F.when(F.col("outside"), OUTSIDE).when(v.isNull(), "not JSON").when(~F.coalesce(whole, F.lit(False)), "required fields are missing").when(system != COORDINATES, "unsupported coordinates"))
    issues = rows.where("message is not null").select("path", F.lit("annotations").alias("stage"), "message")
    good = rows.where("message is null").withColumn("page_id", stem(F.col("path")))
    read = lambda x: F.coalesce((shown(x, "$.review_status") == "human_corrected") & text_of(x, "$.transcription").isNotNull(), F.lit(False))
    documents = good.select("path", "page_id", shown(v, "$.image").alias("image"), F.try_variant_get(v, "$.image_width", "int").alias("image_width"), F.try_variant_get(v, "$.image_height", "int").alias("image_height"), F.coalesce(shown(v, "$.schema_version"), F.lit("0.1")).alias("schema_version"), F.coalesce(F.exists(items, read), F.lit(False)).alias("reviewed_text"))
    item = F.col("item")
    regions = good.select("path", "page_id", F.posexplode(items).alias("ord", "item"))
    regions = regions.select(
        F.col("path").alias("source"), "page_id", "ord", shown(item, "$.id").alias("id"), shown(item, "$.type").alias("region_type"), *_box(item_box(item)).columns(),
        shown(item, "$.notes").alias("notes"), shown(item, "$.review_status").alias("review_status"), text_of(item, "$.transcription").alias("transcription"), shown(item, "$.script").alias("script"), shown(item, "$.language").alias("language"),
    )
    return documents, regions, issues


def read_frozen_inputs(spark: SparkSession, root: str, folder: str = "htr-inputs") -> tuple[DataFrame, DataFrame]:
    """(regions, issues) of the frozen inputs; each region with its page's image and padding."""
    v, items = F.col("v"), _list(F.col("v"), "$.regions")
    rows = read_json(spark, f"{root.rstrip('/')}/{folder}", root)
    rows = rows.withColumn("message", F.when(F.col("outside"), OUTSIDE).when(v.isNull() | items.isNull(), "no region list").when(F.coalesce(shown(v, "$.coordinate_system"), F.lit("")) != COORDINATES, "unsupported coordinates"))
    issues = rows.where("message is not null").select("path", F.lit("frozen inputs").alias("stage"), "message")
    item = F.col("item")
    regions = rows.where("message is null").select("path", stem(F.col("path")).alias("page_id"), shown(v, "$.region_source").alias("region_source"), shown(v, "$.image").alias("image"), F.try_variant_get(v, "$.padding", "int").alias("padding"), F.posexplode(items).alias("ord", "item"))
    return regions.select(F.col("path").alias("source"), "page_id", "region_source", "ord", shown(item, "$.id").alias("id"), shown(item, "$.type").alias("region_type"), *_box(item_box(item)).columns(), "image", "padding"), issues


def read_failures(spark: SparkSession, root: str, folder: str = "htr-errors") -> DataFrame:
    v = F.col("v")
    rows = read_json(spark, f"{root.rstrip('/')}/{folder}", root).where("v is not null and not outside")
    return rows.select("path", F.get(F.split("path", "/"), F.lit(1)).alias("page_id"), *(shown(v, f"$.{c}").alias(c) for c in ("model", "region_id", "image_sha256", "prompt", "error", "raw_content", "finish_reason")))


def parse_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, issues) of corpus manifests in column v: page_id, manuscript_id (if it is a string that
    isn't blank), layout_review_complete (only a JSON true counts)."""
    v = F.col("v")
    pages = F.try_variant_get(v, "$.pages", "variant")
    bad = v.isNull() | (kind(v) != "OBJECT") | (pages.isNotNull() & (kind(pages) != "OBJECT"))
    issues = rows.where(bad).select("path", F.lit("manifest").alias("stage"), F.lit("expected an object with a pages mapping").alias("message"))
    each = rows.where(~bad).select(F.explode(F.try_variant_get(v, "$.pages", "map<string,variant>")).alias("page_id", "p"))
    p = F.col("p")
    done = F.try_variant_get(p, "$.layout_review_complete", "variant")
    return each.where(kind(p) == "OBJECT").select("page_id", text_of(p, "$.manuscript_id").alias("manuscript_id"), F.coalesce((kind(done) == "BOOLEAN") & F.try_variant_get(p, "$.layout_review_complete", "boolean"), F.lit(False)).alias("layout_review_complete")), issues


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(path, wholetext=True)
    return parse_manifest(files.select(file_path().alias("path"), F.try_parse_json("value").alias("v")))
