"""A corpus folder as one set of tables.

What a file is follows from where it lies, never from its format: layout in alto/ or
predictions/escriptorium/ is a prediction, only ground-truth/alto/ is a reference. Any file makes its
page known; a bad one is an issue and nothing more.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box
from folioscope.functions.ids import stem
from folioscope.functions.labels import system_name, system_rank
from folioscope.sources import images, layout, records
from folioscope.sources.paths import placed
from folioscope.sources.store import settle

LAYOUT_FOLDERS = {"alto": False, "predictions/escriptorium": False, "ground-truth/alto": True}
_BOXES = ", ".join(f"{c} double" for c in Box._fields)


class Corpus:
    """The tables of a corpus: pages, systems, regions, artifacts, results, annotated, frozen, failures, blocks
    (of its layout files), layout (with machine and corrected, its two parts), manifest and issues.

    A table is written to the shared folder when it is first asked for, and read from there from then on;
    tables that nothing asks for are never made."""

    def __init__(self, tables: dict[str, Callable[[Corpus], DataFrame]]):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        found = settle(self._tables[name](self), f"corpus-{name}")
        setattr(self, name, found)
        return found

    @property
    def machine(self) -> DataFrame:
        return self.layout.where("not reviewed")

    @property
    def corrected(self) -> DataFrame:
        return self.layout.where("reviewed")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def _blocks(spark: SparkSession, root: str, folders: list[tuple[str, bool]]) -> DataFrame:
    """The blocks of a corpus' sound layout files, with ``reviewed``."""
    each = [layout.read_layout(spark, path, root)[0].withColumn("reviewed", F.lit(reviewed)) for path, reviewed in folders]
    return reduce(DataFrame.unionByName, each)


def _layout_regions(blocks: DataFrame, columns: list[str], blank_lines: bool = False) -> DataFrame:
    """The regions of a corpus' layout with ``reviewed``."""
    each = [layout.layout_regions(blocks.where(F.col("reviewed") == r), blank_lines).withColumnRenamed("path", "source").select(*columns).withColumn("reviewed", F.lit(r)) for r in (False, True)]
    return each[0].unionByName(each[1])


def load_corpus(spark: SparkSession, root: str) -> Corpus:
    root = root.rstrip("/")
    if not exists(spark, root):
        raise ValueError(f"no such folder: {root}")
    issues = _empty(spark, "path string, stage string, message string")
    columns = ["page_id", "source", "ord", "id", "region_type", *Box._fields, "confidence", "text"]
    regions = _empty(spark, f"page_id string, source string, ord int, id string, region_type string, {_BOXES}, confidence double, text string")
    systems = _empty(spark, "page_id string, system string, source string, prompt_version string, reviewed boolean, skipped_blocks long")
    artifacts = _empty(spark, "page_id string, path string, kind string, origin string, role string, reviewed_text boolean")
    no_text, pages, laid_out = regions.withColumn("reviewed", F.lit(False)), _empty(spark, "page_id string"), []
    for folder, reviewed in LAYOUT_FOLDERS.items():
        if not exists(spark, f"{root}/{folder}"):
            continue
        laid_out.append((f"{root}/{folder}", reviewed))
        seen = settle(layout.layout_files(spark, f"{root}/{folder}", root), "corpus-layout-files")
        issues, pages = issues.unionByName(seen.where("message is not null").select("path", F.lit("layout").alias("stage"), "message")), pages.unionByName(seen.select("page_id"))
        files = seen.where("message is null")
        name = "Human-corrected eScriptorium" if reviewed else "eScriptorium"
        systems = systems.unionByName(files.select("page_id", F.lit(name).alias("system"), F.col("path").alias("source"), F.lit(None).cast("string").alias("prompt_version"), F.lit(reviewed).alias("reviewed"), F.col("skipped").alias("skipped_blocks")))
        role = "reference" if reviewed else "prediction"
        artifacts = artifacts.unionByName(files.select("page_id", "path", F.lit("layout").alias("kind"), F.lit("eScriptorium").alias("origin"), F.lit(role).alias("role"), (F.lit(reviewed) & F.col("has_text")).alias("reviewed_text")))
    if exists(spark, f"{root}/images"):
        pages = pages.unionByName(images.list_images(spark, f"{root}/images").select("page_id"))
    annotated = _empty(spark, f"source string, page_id string, ord int, id string, region_type string, {_BOXES}, notes string, review_status string, transcription string, script string, language string")
    if exists(spark, f"{root}/ground-truth"):
        documents, annotated, bad = records.read_annotations(spark, root)
        issues, pages = issues.unionByName(bad), pages.unionByName(documents.select("page_id")).unionByName(bad.select(stem(F.col("path")).alias("page_id")))
        artifacts = artifacts.unionByName(documents.select("page_id", "path", F.lit("annotations").alias("kind"), F.lit("Human annotated").alias("origin"), F.lit("reference").alias("role"), "reviewed_text"))
    ddl = "path string, page_id string, model_dir string, task string, model string, prompt_version string, image string, region_id string, transcription string, script string, language string"
    results = _empty(spark, ddl)
    if exists(spark, f"{root}/results"):
        found, bad = records.read_results(spark, root)
        page_of = F.get(F.split("path", "/"), F.lit(1))
        pages = pages.unionByName(found.select("page_id")).unionByName(bad.where("message <> 'expected page/model/name'").select(page_of.alias("page_id")))
        drawn = found.where("task = 'segmentation'")
        boxes, rejected = records.json_regions(drawn.select("path", "page_id", "model", "items"), F.col("model"), F.col("items"))
        good = found.join(rejected.select("path"), "path", "left_anti")
        artifacts = artifacts.unionByName(good.select("page_id", "path", F.col("task").alias("kind"), F.col("model").alias("origin"), F.lit("prediction").alias("role"), F.lit(False).alias("reviewed_text")))
        record = good.where("task = 'segmentation'").select("page_id", system_name(F.col("model")).alias("system"), F.col("path").alias("source"), F.coalesce(F.nullif("prompt_version", F.lit("")), F.lit("Unavailable")).alias("prompt_version"), F.lit(False).alias("reviewed"), F.lit(0).cast("long").alias("skipped_blocks"))
        systems, issues = systems.unionByName(record), issues.unionByName(bad).unionByName(rejected)
        regions = regions.unionByName(boxes.withColumn("page_id", page_of).withColumnRenamed("path", "source").select(*columns))
        results = found.select(*(c.split()[0] for c in ddl.split(", ")))
    frozen = _empty(spark, f"source string, page_id string, region_source string, ord int, id string, region_type string, {_BOXES}, image string, padding int")
    if exists(spark, f"{root}/htr-inputs"):
        frozen, bad = records.read_frozen_inputs(spark, root)
        issues = issues.unionByName(bad)
    failures = _empty(spark, "path string, page_id string, model string, region_id string")
    if exists(spark, f"{root}/htr-errors"):
        failures = records.read_failures(spark, root).select("path", "page_id", "model", "region_id")
    manifest = _empty(spark, "page_id string, manuscript_id string, layout_review_complete boolean")
    if exists(spark, f"{root}/corpus.json"):
        manifest, bad = records.read_manifest(spark, f"{root}/corpus.json")
        issues = issues.unionByName(bad)
    order = Window.partitionBy("page_id").orderBy("reviewed", system_rank(F.col("system")), "source")
    systems = systems.withColumn("sys_ord", F.row_number().over(order) - 1)
    all_regions = lambda c: regions.unionByName(_layout_regions(c.blocks, columns).drop("reviewed")) if laid_out else regions
    with_system = lambda c: all_regions(c).join(c.systems.select("page_id", "source", "system", "sys_ord", "reviewed"), ["page_id", "source"])
    # Regions of a page's corrected layout in document order, over its files.
    texts = lambda c: _layout_regions(c.blocks, columns, blank_lines=True) if laid_out else no_text
    text = lambda c: texts(c).withColumn("ord", F.row_number().over(Window.partitionBy("page_id", "source").orderBy("ord")) - 1)
    plain = {"pages": pages.distinct(), "systems": systems, "artifacts": artifacts, "results": results, "annotated": annotated, "frozen": frozen, "failures": failures, "manifest": manifest, "issues": issues}
    return Corpus({k: lambda _, df=df: df for k, df in plain.items()} | {"regions": with_system, "layout": text, "blocks": lambda _: _blocks(spark, root, laid_out)})
