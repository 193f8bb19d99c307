"""Queries over a corpus folder: files written from the bench tables and read back by the readers.

Suppliers are pages and their order lines the blocks of a page. Which pages have a bad file, and how
it is bad, follows from the page's number. A session writes the files of its tables once, and those that
list a page's lines compressed: as they are they would take many times their table's place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators import overview
from folioscope.sources import corpus, layout, publish, records
from folioscope.sources.store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FOLDERS: dict[tuple[str, str], tuple[str, set[str]]] = {}

_LINES = "WITH l AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_partkey AS p, CAST(l_linenumber AS BIGINT) AS n FROM lineitem)"
#: Names of blocks: one in ten has that of the block before it. Kinds as saved, by the part.
_ID = "'b' || CAST(CASE WHEN i % 10 = 9 THEN i - 1 ELSE i END AS VARCHAR)"
_KIND = "CASE p % 4 WHEN 0 THEN 'main_text' WHEN 1 THEN 'stamp_or_seal' ELSE 'unknown' END"
_X1, _Y1, _X2, _Y2 = "(p % 50) * 10", "n * 20", "(p % 50) * 10 + 100 + (p % 7) * 10", "n * 20 + 50"
_GOOD = "s % 10 NOT IN (3, 4, 5, 6, 7)"
_PAGED = ", ".join(f"(({v})::DOUBLE / {d}::DOUBLE) * 1000.0::DOUBLE AS {c}" for v, d, c in ((_X1, "(1000 + s % 3 * 100)", "x1"), (_Y1, "2000", "y1"), (_X2, "(1000 + s % 3 * 100)", "x2"), (_Y2, "2000", "y2")))
_PLAIN = f"({_X1})::DOUBLE AS x1, ({_Y1})::DOUBLE AS y1, ({_X2})::DOUBLE AS x2, ({_Y2})::DOUBLE AS y2"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("s"), F.col("l_partkey").alias("p"), F.col("l_linenumber").cast("long").alias("n"), "l_orderkey", "l_extendedprice")
    # dealt by the page's own name, so that its files are made where its lines are
    place = Window.partitionBy("s").orderBy("l_orderkey", "n", "p", "l_extendedprice")
    return rows.select("s", (F.row_number().over(place) - 1).alias("i"), "p", "n")


def _spark(sql: str) -> Column:
    return F.expr(sql.replace("VARCHAR", "STRING"))


def _layout_files(rows: DataFrame) -> DataFrame:
    """s and xml: a page of blocks with two lines each, some without extent; bad in five ways."""
    extent = F.when(F.col("i") % 8 != 5, F.format_string(' HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="50"', F.expr(_X1), F.expr(_Y1), F.expr("100 + (p % 7) * 10"))).otherwise(F.lit(' HPOS="1" VPOS="1"'))
    points = F.when((F.col("s") % 10 == 7) & (F.col("i") == 0), F.lit("0 0 10")).otherwise(F.lit("0 0 10 0 10 10"))
    scores = F.when(F.col("n") % 2 == 1, F.array(F.lit("0.25"), F.lit("none"))).otherwise(F.array(F.lit("0.75"), F.lit("0.5")))
    second = F.when(F.col("p") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("x"), "n"))
    line = lambda text, k: F.concat(F.lit('<TextLine ID="l" BASELINE="1 2 3 4"><String CONTENT="'), text, F.lit('" WC="'), scores[k], F.lit('"/></TextLine>'))
    block = F.concat(F.lit('<TextBlock ID="'), _spark(_ID), F.lit('" TAGREFS="T9 T'), F.col("p") % 4, F.lit('"'), extent, F.lit('><Shape><Polygon POINTS="'), points, F.lit('"/></Shape>'), line(F.concat(F.lit("w"), "p"), 0), line(second, 1), F.lit("</TextBlock>"))
    pages = rows.groupBy("s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", block.alias("b")))), lambda x: x["b"]), "").alias("blocks"))
    bad = F.col("s") % 10
    width = F.when(bad == 5, F.lit(0)).otherwise(F.expr("1000 + s % 3 * 100"))
    page = F.when(bad == 4, F.lit("")).otherwise(F.concat(F.lit('<Page WIDTH="'), width, F.lit('" HEIGHT="2000" PHYSICAL_IMG_NR="3"><PrintSpace>'), "blocks", F.lit("</PrintSpace></Page>")))
    space = F.when(bad == 6, F.lit("http://example.org/other")).otherwise(F.lit(layout.NAMESPACE))
    tags = '<Tags><OtherTag ID="T0" LABEL="Note"/><OtherTag ID="T0" LABEL="Main"/><LayoutTag ID="T1" LABEL="Stamp"/><OtherTag ID="T2" LABEL="No such kind"/></Tags>'
    whole = F.concat(F.lit('<?xml version="1.0"?><alto xmlns="'), space, F.lit(f'">{tags}<Layout>'), page, F.lit("</Layout></alto>"))
    return pages.select("s", F.when(bad == 3, F.lit("<alto")).otherwise(whole).alias("xml"))


def _record_files(rows: DataFrame, kinds: set[str]) -> DataFrame:
    """file and json: annotations, frozen inputs, failures and results, those of some ``kinds``."""
    name = F.concat(F.lit("s"), "s")
    text = F.when(F.col("i") % 3 == 0, F.lit("\"read\"")).otherwise(F.lit("5"))
    region = F.concat(F.lit('{"id": "r'), "i", F.lit('", "type": "'), F.expr(_KIND), F.format_string('", "bbox": [%d, %d, %d, %d]', *(F.expr(v) for v in (_X1, _Y1, _X2, _Y2))), F.when(F.col("i") % 2 == 0, F.lit(', "review_status": "human_corrected"')).otherwise(F.lit("")), F.lit(', "transcription": '), text, F.lit("}"))
    pages = rows.groupBy("s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", region.alias("r")))), lambda x: x["r"]), ", ").alias("regions"))
    s, listed = F.col("s"), F.concat(F.lit('"regions": ['), "regions", F.lit("]}"))
    drawn = F.when(s % 5 == 0, F.lit("{")).when(s % 5 == 1, F.concat(F.lit('{"image": "a", "image_height": 2, '), listed)).when(s % 5 == 2, F.concat(F.lit('{"image": "a", "image_width": 1, "image_height": 2, "coordinate_system": "pixels", '), listed)).otherwise(F.concat(F.lit('{"image": "a", "image_width": 1, "image_height": 2, '), listed))
    frozen = F.when(s % 4 == 0, F.lit('{"coordinate_system": "normalized-1000"}')).when(s % 4 == 1, F.concat(F.lit("{"), listed)).otherwise(F.concat(F.lit('{"coordinate_system": "normalized-1000", "region_source": "frozen", '), listed))
    failure = F.concat(F.lit('{"model": "m'), s % 2, F.lit('", "region_id": "r0", "error": "late", "extra": [1]}'))
    reply = F.when(s % 7 == 0, F.lit("[1]")).when(s % 7 == 1, F.lit("{")).when(s % 7 == 2, F.lit('{"task": "htr", "response": []}')).when(s % 7 == 3, F.lit('{"task": "segmentation", "response": {"regions": 3}}'))
    reply = reply.when(s % 7 == 5, F.lit('{"task": "htr", "model": "own", "region_id": "r0", "elapsed_seconds": "1.5", "response": {"transcription": "read", "language": "ar"}}')).otherwise(F.lit('{"response": {"transcription": 5}}'))
    place = F.when(s % 7 == 4, F.concat(F.lit("results/"), name, F.lit(".json"))).otherwise(F.concat(F.lit("results/"), name, F.lit("/m/a.json")))
    files = {"ground-truth": (F.concat(F.lit("ground-truth/"), name, F.lit(".json.gz")), drawn), "htr-inputs": (F.concat(F.lit("htr-inputs/"), name, F.lit(".json.gz")), frozen), "htr-errors": (F.concat(F.lit("htr-errors/"), name, F.lit("/m/r0.json")), failure), "results": (place, reply)}
    each = F.explode(F.array(*(F.struct(f.alias("file"), j.alias("json")) for k, (f, j) in files.items() if k in kinds)))
    return pages.select(each.alias("x")).select("x.*")


KINDS = ("alto", "ground-truth", "htr-inputs", "htr-errors", "results")


def folder(spark: SparkSession, sf_dir: str, *kinds: str) -> str:
    """The corpus folder of the bench tables, below the folder that the cluster shares, with all files of
    those kinds, or of all kinds."""
    base, made = _FOLDERS.setdefault((spark.sparkContext.applicationId, sf_dir), (f"{shared_folder(spark)}/corpus-files-{uuid.uuid4().hex}", set()))
    if new := set(kinds or KINDS) - made:
        rows, files = _rows(spark, sf_dir), []
        if "alto" in new:
            files.append(_layout_files(rows).select(F.concat(F.lit("alto/s"), "s", F.lit(".xml.gz")).alias("file"), F.col("xml").alias("json")))
        if new - {"alto"}:
            files.append(_record_files(rows, new))
        # together, so that lines are dealt once for both
        publish.put_files(reduce(DataFrame.unionByName, files).select("file", F.col("json").cast("binary").alias("content")), base)
        made |= new
    return base


def _shown(regions: DataFrame) -> DataFrame:
    return regions.select("page_id", F.col("ord").cast("long").alias("ord"), "id", "region_type", "x1", "y1", "x2", "y2", "text", "confidence")


_TEXT = "CASE WHEN p % 3 = 0 THEN {none} ELSE chr(10) || 'x' || CAST(n AS VARCHAR) END"
_LAYOUT = f"{_LINES}, m AS (SELECT s AS ms, max(i) AS last FROM l GROUP BY s) SELECT 's' || CAST(s AS VARCHAR) AS page_id, i AS ord, {_ID} AS id, {_KIND} AS region_type, {_PAGED}, 'w' || CAST(p AS VARCHAR) || {{text}} AS text, (CASE WHEN n % 2 = 1 THEN 0.25 ELSE 0.625 END)::DOUBLE AS confidence FROM l JOIN m ON s = ms WHERE {_GOOD} AND i % 8 <> 5"


@query(_LAYOUT.format(text=_TEXT.format(none="''")))
def layout_read(spark, sf_dir):
    """Regions of layout files, with the texts of lines that have any."""
    blocks, _ = layout.read_layout(spark, f"{folder(spark, sf_dir, 'alto')}/alto")
    return _shown(layout.layout_regions(blocks))


@query(_LAYOUT.format(text=_TEXT.format(none="chr(10)")) + " AND NOT (i % 10 = 8 AND i < last)")
def layout_blank_lines(spark, sf_dir):
    """The same with blank lines; of blocks with one id the last counts."""
    blocks, _ = layout.read_layout(spark, f"{folder(spark, sf_dir, 'alto')}/alto")
    return _shown(layout.layout_regions(blocks, blank_lines=True))


_NAME = "'s' || CAST(s AS VARCHAR)"
_PAGES = _LINES + ", pg AS (SELECT DISTINCT s FROM l)"


@query(f"""{_PAGES} SELECT 'alto/' || {_NAME} || '.xml' AS path, 'layout' AS stage, CASE s % 10 WHEN 3 THEN 'malformed XML' WHEN 5 THEN 'page without extent' WHEN 7 THEN 'malformed numbers' ELSE 'no page' END AS message FROM pg WHERE NOT ({_GOOD})
 UNION ALL SELECT 'ground-truth/' || {_NAME} || '.json', 'annotations', CASE s % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'required fields are missing' ELSE 'unsupported coordinates' END FROM pg WHERE s % 5 < 3
 UNION ALL SELECT 'htr-inputs/' || {_NAME} || '.json', 'frozen inputs', CASE s % 4 WHEN 0 THEN 'no region list' ELSE 'unsupported coordinates' END FROM pg WHERE s % 4 < 2
 UNION ALL SELECT 'results/' || {_NAME} || CASE s % 7 WHEN 4 THEN '.json' ELSE '/m/a.json' END, 'results', CASE s % 7 WHEN 2 THEN 'response is not an object' WHEN 3 THEN 'no region list' WHEN 4 THEN 'expected page/model/name' ELSE 'not a JSON object' END FROM pg WHERE s % 7 < 5""")
def corpus_issues(spark, sf_dir):
    """What a corpus has of bad files, each an issue and no more."""
    return corpus.load_corpus(spark, folder(spark, sf_dir)).issues.select("path", "stage", "message")


@query(f"{_PAGES}, b AS (SELECT s AS bs, count(*) FILTER (WHERE i % 8 = 5) AS skipped FROM l GROUP BY s) SELECT {_NAME} AS page_id, 'eScriptorium' AS system, 'alto/' || {_NAME} || '.xml' AS source, false AS reviewed, skipped AS skipped_blocks, 0::BIGINT AS sys_ord FROM pg JOIN b ON s = bs WHERE {_GOOD}")
def corpus_systems(spark, sf_dir):
    found = corpus.load_corpus(spark, folder(spark, sf_dir)).systems
    return found.select("page_id", "system", "source", "reviewed", "skipped_blocks", F.col("sys_ord").cast("long").alias("sys_ord"))


@query(f"{_LINES} SELECT {_NAME} AS page_id, i AS ord, 'r' || CAST(i AS VARCHAR) AS id, {_KIND} AS region_type, {_PLAIN}, CASE WHEN i % 2 = 0 THEN 'human_corrected' END AS review_status, CASE WHEN i % 3 = 0 THEN 'read' END AS transcription FROM l WHERE s % 5 > 2")
def annotations_read(spark, sf_dir):
    _, found, _ = records.read_annotations(spark, folder(spark, sf_dir, "ground-truth"))
    return found.select("page_id", F.col("ord").cast("long").alias("ord"), "id", "region_type", "x1", "y1", "x2", "y2", "review_status", "transcription")


@query(f"{_LINES} SELECT {_NAME} AS page_id, 'frozen' AS region_source, i AS ord, 'r' || CAST(i AS VARCHAR) AS id, {_KIND} AS region_type, {_PLAIN} FROM l WHERE s % 4 > 1")
def frozen_read(spark, sf_dir):
    found, _ = records.read_frozen_inputs(spark, folder(spark, sf_dir, "htr-inputs"))
    return found.select("page_id", "region_source", F.col("ord").cast("long").alias("ord"), "id", "region_type", "x1", "y1", "x2", "y2")


@query(f"{_PAGES} SELECT {_NAME} AS page_id, 'm' || CAST(s % 2 AS VARCHAR) AS model, 'r0' AS region_id, 'late' AS error FROM pg")
def failures_read(spark, sf_dir):
    return records.read_failures(spark, folder(spark, sf_dir, "htr-errors")).select("page_id", "model", "region_id", "error")


@query(f"{_PAGES} SELECT {_NAME} AS page_id, 'm' AS model_dir, CASE s % 7 WHEN 5 THEN 'htr' ELSE 'Unspecified task' END AS task, CASE s % 7 WHEN 5 THEN 'own' ELSE 'm' END AS model, CASE s % 7 WHEN 5 THEN 'read' END AS transcription, CASE s % 7 WHEN 5 THEN 'ar' END AS language, CASE s % 7 WHEN 5 THEN 1.5::DOUBLE END AS elapsed_seconds FROM pg WHERE s % 7 > 4")
def results_read(spark, sf_dir):
    found, _ = records.read_results(spark, folder(spark, sf_dir, "results"))
    return found.select("page_id", "model_dir", "task", "model", "transcription", "language", "elapsed_seconds")


@query("SELECT 'd' || CAST(doc_id AS VARCHAR) || '.html' AS file, sha256(CASE WHEN doc_id % 3 = 1 THEN 'changed' ELSE coalesce(text, '') END) AS sha256, (SELECT count(*) FILTER (WHERE doc_id % 3 = 1) FROM documents) AS written, (SELECT count(*) FILTER (WHERE doc_id % 3 = 0) FROM documents) AS removed FROM documents WHERE doc_id % 3 <> 0")
def published_again(spark, sf_dir):
    """A report published twice: the files that the folder has after some changed and some went."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    files = lambda df, text: df.select(F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("d"), "doc_id", F.lit(".html")).alias("file"), text.cast("binary").alias("content"))
    publish.publish(files(rows, F.col("text")), base)
    done = publish.publish(files(rows.where("doc_id % 3 <> 0"), F.when(F.col("doc_id") % 3 == 1, F.lit("changed")).otherwise(F.col("text"))), base)
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(base)
    return there.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.lit(done["written"]).cast("long").alias("written"), F.lit(done["removed"]).cast("long").alias("removed"))


@query(f"{_PAGES} SELECT 'eScriptorium' AS system, count(*) FILTER (WHERE {_GOOD}) AS pages FROM pg UNION ALL SELECT 'Qwen3-VL 8B', 0 UNION ALL SELECT 'Qwen3-VL 30B', 0")
def corpus_coverage(spark, sf_dir):
    return overview.coverage(corpus.load_corpus(spark, folder(spark, sf_dir)).artifacts, spark)
