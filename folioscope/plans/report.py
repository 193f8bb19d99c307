"""The report of a corpus: an overview and a page for each manuscript page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import disagreements, linkage, overview
from folioscope.operators.matching import LARGE
from folioscope.sources.corpus import Corpus, load_corpus
from folioscope.sources.publish import FILES, publish
from folioscope.sources.sinks import html_page, html_table, page_file
from folioscope.sources.store import settle

#: Rows of a table that the overview shows; issues of a file.
SHOWN, ISSUES = 500, 10_000

METHOD = (
    ("Matching", "Regions of two systems match one to one: of all pairs of a page whose boxes overlap by at least half of their union, the best is taken, then the best of what is left."),
    ("Metrics", "Precision, recall and F1 count matches of one type; corpus metrics pool all pages of a run that has one complete, corrected layout for each, and are undefined where nothing was counted."),
    ("Disagreements", "Where two systems describe one place differently, or only one of them has a region. Neither is taken to be right."),
    ("Readings", "Character and word errors are counted only against texts that a human has marked as corrected."),
)


def compare(corpus: Corpus) -> dict[str, DataFrame]:
    """Groups, readings, failures and issues of text recognition."""
    groups = linkage.build_groups(corpus.annotated, corpus.frozen, corpus.corrected, LARGE)
    compared = linkage.htr_comparisons(groups, corpus.results.where("task = 'htr'"), corpus.machine, corpus.failures, LARGE)
    return compared | {"failures": settle(compared["failures"], "report-failures"), "groups": settle(compared["groups"], "report-groups")}


def overview_tables(corpus: Corpus, spark: SparkSession, min_pages: int = 5, compared: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The corpus roll-ups, each a small table, but for the issues."""
    if min_pages < 1:
        raise ValueError("min_pages must be positive")
    compared = compared or compare(corpus)
    predicted = corpus.regions.where("not reviewed")
    reviewed_text = corpus.artifacts.where("reviewed_text")
    tables = {
        "pages": corpus.pages.agg(F.count("*").alias("pages")), "manuscripts": overview.manuscript_count(corpus.manifest, corpus.pages),
        "coverage": overview.coverage(corpus.artifacts, spark), "reviewed": overview.reviewed_pages(corpus.systems.where("reviewed"), reviewed_text),
        "types": predicted.groupBy("region_type").agg(F.count("*").alias("n")).orderBy("region_type"), "runs": overview.run_counts(corpus.systems, corpus.regions).orderBy("run"),
        "htr": overview.htr_coverage(compared["readings"], compared["groups"]), "readings": compared["readings"].groupBy("system").agg(F.count("*").alias("readings")).orderBy("system"),
        "failures": compared["failures"].groupBy("system").agg(F.count("*").alias("failures")).orderBy("system"),
    }
    return tables | overview.evaluations(corpus.systems, corpus.regions, corpus.manifest, min_pages) | {"issues": corpus.issues.unionByName(compared["issues"].withColumn("stage", F.lit("htr")), allowMissingColumns=True)}


def _shown(tables: dict[str, DataFrame]) -> list[str]:
    """The overview's tables as HTML; of a table that grows with the corpus the first rows, and how many there are."""
    sections = []
    for title, df in tables.items():
        rows = df.orderBy(*(F.col(c) for c in df.columns)).limit(SHOWN + 1).collect()  # in an order of their own, so that an unchanged corpus gives the same bytes
        title = title if len(rows) <= SHOWN else f"{title} (the first {SHOWN} of {df.count()})"
        sections.append(html_table(title, df.columns, rows[:SHOWN]))
    return sections


#: Tables of a page: the column that holds its rows, title, and the names of what each row has.
SECTIONS = {
    "counts": ("Regions", ["system", "type", "regions"]), "ranked": ("Disagreements", ["rank", "kind", "first", "second", "x1", "y1", "x2", "y2"]),
    "seen": ("What each system has there", ["rank", "system", "reviewed", "relationship", "region", "type", "overlap", "nearby"]),
    "readings": ("Readings", ["group", "region", "system", "text", "human text", "character errors", "CER", "word errors", "WER", "source"]), "failures": ("Readings that failed", ["group", "region", "system", "source"]),
}


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, file and content of each page: what it has in each of its tables."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            sections = [html_table(title, names, [list(x.values()) for x in r[k] or []]) for k, (title, names) in SECTIONS.items()]
            out.append({"page_id": r["page_id"], "file": f"pages/{r['file']}", "content": html_page(r["page_id"], sections)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.string()), ("file", pa.string()), ("content", pa.binary())]))


def _issue_files(issues: DataFrame) -> DataFrame:
    """All issues as files of JSON lines, in the form of a build's files."""
    issues = settle(issues.select("path", "stage", "message"), "report-issues")
    parts = max(1, -(-issues.count() // ISSUES))
    part = F.pmod(F.xxhash64("path"), F.lit(parts))
    lines = F.array_join(F.sort_array(F.collect_list(F.to_json(F.struct("path", "stage", "message")))), "\n")
    files = issues.groupBy(part.alias("part")).agg(F.concat(lines, F.lit("\n")).cast("binary").alias("content"))
    return files.select(F.lit(None).cast("string").alias("page_id"), F.format_string("issues/%06d.jsonl", "part").alias("file"), "content")


def _by_page(rows: DataFrame, name: str, *columns) -> DataFrame:
    return rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def build_report(spark: SparkSession, data: str, output: str, min_pages: int = 5, only: str | None = None) -> dict[str, int]:
    """Builds and publishes. ``only``: one page's id; the other pages of the last build are kept.

    Pages are made and written by the executors; the driver sees the overview's tables only."""
    corpus = load_corpus(spark, data)
    pages = corpus.pages if only is None else corpus.pages.where(F.col("page_id") == only)
    if only is not None and pages.isEmpty():
        raise ValueError(f"no such page: {only}")
    regions, systems = corpus.regions.join(pages, "page_id", "left_semi"), corpus.systems.join(pages, "page_id", "left_semi")
    regions = settle(regions, "report-regions")
    ranked = settle(disagreements.select_varied(disagreements.disagreements(regions, systems, large=LARGE)), "report-ranked")
    seen = disagreements.observations(ranked, regions, systems, large=LARGE)
    compared = compare(corpus)
    groups = compared["groups"].select("page_id", F.col("ord").alias("group_ord"), "id", "human_text")
    m = lambda c: F.col(f"metrics.{c}").alias(c)
    tables = (
        _by_page(regions.groupBy("page_id", "system", "region_type").agg(F.count("*").alias("n")), "counts", "system", "region_type", "n"),
        _by_page(ranked, "ranked", "rank", "kind", "l_name", "r_name", "x1", "y1", "x2", "y2"),
        _by_page(seen, "seen", "rank", "system", "reviewed", "relationship", "region_id", "region_type", "overlap", "nearby_id"),
        _by_page(compared["readings"].join(groups, ["page_id", "group_ord"]), "readings", "group_ord", "id", "system", "text", "human_text", m("char_errors"), m("cer"), m("word_errors"), m("wer"), "source"),
        _by_page(compared["failures"].join(groups, ["page_id", "group_ord"]), "failures", "group_ord", "id", "system", "source"),
    )
    shown = pages.select("page_id", page_file(F.col("page_id")).alias("file"))
    for table in tables:
        shown = shown.join(table, "page_id", "left")
    found = overview_tables(corpus, spark, min_pages, compared)
    whole = html_page("Corpus overview", _shown(found))
    method = html_page("Method", [html_table(title, ["how it is done"], [[text]]) for title, text in METHOD])
    shared = spark.createDataFrame([(None, "overview.html", bytearray(whole)), (None, "method.html", bytearray(method))], FILES)
    return publish(shown.mapInArrow(_pages, FILES).unionByName(shared).unionByName(_issue_files(found["issues"])), output, [data], only)
