"""Queries over a batch: inputs frozen from a folder made of the bench tables, run by a model that answers
from a page's number, and read back from the files that the run has left."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import batch, runs
from folioscope.plans import pictures
from folioscope.plans.synthetic import REGION_SQL, regions
from folioscope.sources import frozen, layout, publish, records
from folioscope.sources.store import settle, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FOLDERS: dict[tuple[str, str], str] = {}
_INPUTS: dict[str, DataFrame] = {}

#: Suppliers as pages: one in four has annotations, one in four a layout; a third of the images can't be cut.
_PAGES = """WITH pg AS (SELECT CAST(s_suppkey AS BIGINT) AS s, 'i' || CAST(s_suppkey AS VARCHAR) AS page_id FROM supplier WHERE s_suppkey % 3 < 2),
 inp AS (SELECT s, page_id, CASE s % 4 WHEN 1 THEN 'r0' WHEN 2 THEN 'b0' ELSE 'whole-page' END AS region_id, CASE s % 4 WHEN 1 THEN 'ground-truth/' || page_id || '.json' WHEN 2 THEN 'alto/' || page_id || '.xml (machine layout)' ELSE 'whole image' END AS region_source,
  (CASE s % 4 WHEN 1 THEN 0 WHEN 2 THEN 100 ELSE 0 END)::DOUBLE AS x1, (CASE s % 4 WHEN 1 THEN 0 WHEN 2 THEN 100 ELSE 0 END)::DOUBLE AS y1, (CASE s % 4 WHEN 1 THEN 500 WHEN 2 THEN 600 ELSE 1000 END)::DOUBLE AS x2, (CASE s % 4 WHEN 1 THEN 500 WHEN 2 THEN 300 ELSE 1000 END)::DOUBLE AS y2 FROM pg)"""
_DRAWN = '{"image": "x", "image_width": 1, "image_height": 1, "regions": [{"id": "r0", "type": "main_text", "bbox": [0, 0, 500, 500]}, {"id": "r1", "type": "illustration", "bbox": [0, 0, 9, 9]}]}'
_LAID_OUT = f'<alto xmlns="{layout.NAMESPACE}"><Layout><Page WIDTH="1000" HEIGHT="2000"><PrintSpace><TextBlock ID="b0" HPOS="100" VPOS="200" WIDTH="500" HEIGHT="400"/></PrintSpace></Page></Layout></alto>'


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def folder(spark: SparkSession, sf_dir: str) -> str:
    """A data folder with the suppliers' images, annotations and layouts; a session writes it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        base = f"{shared_folder(spark)}/batch-files-{uuid.uuid4().hex}"
        pages = publish.dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s")), "s")
        publish.put_files(pages.mapInArrow(pictures._files, "file string, content binary"), base)
        name = F.concat(F.lit("i"), "s")
        written = F.when(F.col("s") % 4 == 1, F.struct(F.concat(F.lit("ground-truth/"), name, F.lit(".json")).alias("file"), F.lit(_DRAWN).alias("text"))).when(F.col("s") % 4 == 2, F.struct(F.concat(F.lit("alto/"), name, F.lit(".xml")).alias("file"), F.lit(_LAID_OUT).alias("text")))
        publish.put_files(pages.where("s % 4 in (1, 2)").select(written.alias("w")).select("w.file", F.col("w.text").cast("binary").alias("content")), base)
        _FOLDERS[key] = base
    return _FOLDERS[key]


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen inputs of a folder, prepared once."""
    base = folder(spark, sf_dir)
    if base not in _INPUTS:
        _INPUTS[base] = settle(frozen.prepare(spark, base)[0], "batch-inputs")
    return _INPUTS[base]


@query(_PAGES + " SELECT page_id, region_id, 'htr-inputs/' || page_id || '.json' AS region_source, region_source AS frozen_from, x1, y1, x2, y2, 'crops/' || page_id || '/' || region_id || '.png' AS image FROM inp")
def frozen_inputs(spark, sf_dir):
    """Manifests written once, and what they say of each region."""
    return _inputs(spark, sf_dir).select("page_id", "region_id", "region_source", "frozen_from", "x1", "y1", "x2", "y2", "image")


def _model(job: dict) -> dict:
    n = int(job["page_id"][1:])
    if n % 5 == 4:
        raise OSError("no connection")
    content = ('```json\n{"transcription": "read %d"}\n```' % n, '{"transcription": "%s", "language": "ar"}' % job["label"], '{"text": "none"}', '{"transcription": "part"}')[n % 5]
    return {"content": content, "finish_reason": "length" if n % 5 == 3 else "stop", "elapsed_seconds": 0.25}


@query(_PAGES + """ SELECT page_id, region_id, model, s % 5 < 2 AS ok, CASE s % 5 WHEN 0 THEN 'read ' || CAST(s AS VARCHAR) WHEN 1 THEN label END AS transcription,
 CASE s % 5 WHEN 2 THEN 'ValueError: no transcription string' WHEN 3 THEN 'ValueError: incomplete: length' WHEN 4 THEN 'OSError: no connection' END AS error FROM inp, (VALUES ('m1', 'model-1'), ('m2', 'model-2')) m(label, model)""")
def batch_outcomes(spark, sf_dir):
    """A run's answers and failures, as its files have them."""
    base = folder(spark, sf_dir)
    models = spark.createDataFrame([("m1", "model-1"), ("m2", "model-2")], "label string, model string")
    jobs = batch.plan_jobs(_inputs(spark, sf_dir).withColumnRenamed("region_id", "id"), models, "read this", "v1")
    runs.run_jobs(jobs, _model, base, 8)
    answers, _ = records.read_results(spark, base)
    good = answers.select("page_id", "region_id", "model", F.lit(True).alias("ok"), "transcription", F.lit(None).cast("string").alias("error"))
    bad = records.read_failures(spark, base).select("page_id", "region_id", "model", F.lit(False).alias("ok"), F.lit(None).cast("string").alias("transcription"), "error")
    return good.unionByName(bad)


@query(REGION_SQL + " SELECT page_id, id AS region_id FROM a WHERE ord % 2 = 0 AND ord % 3 <> 0")
def resume_conflicts(spark, sf_dir):
    """Jobs whose saved result came from another image or another prompt; a result without a text is none."""
    jobs = regions(spark, sf_dir, "a").select("page_id", F.col("id").alias("region_id"), "ord", F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"), F.lit("x").alias("image_sha256"), F.lit("read this").alias("prompt"))
    key = ["page_id", "region_id", "model", "prompt_version"]
    sha = F.when(F.col("ord") % 3 == 1, "y").otherwise(F.col("image_sha256"))
    prompt = F.when(F.col("ord") % 3 == 2, "read that").otherwise(F.col("prompt"))
    done = jobs.where("ord % 2 = 0").select(*key, sha.alias("image_sha256"), prompt.alias("prompt"), F.lit("text").alias("transcription"))
    return batch.pending(jobs.drop("ord"), done)[1].select("page_id", "region_id")
