"""The registered queries of the evaluation operators, with the same in DuckDB's SQL.

Every query runs over whole tables and through the library's own operators; the SQL is written
apart from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import geometry as G
from folioscope.functions import ids, labels
from folioscope.functions import text as T
from folioscope.operators import batch, disagreements, linkage, matching, metrics, overview
from folioscope.plans import batches, comparisons, corpora, pictures
from folioscope.plans.pieces import DISAGREEMENTS_SQL, NAMED_SQL, SYSTEMS_SQL, equivalent_sql, fold_sql, iou_sql, named_b
from folioscope.plans.synthetic import REGION_SQL, TYPES, page_systems, regions
from folioscope.sources import layout

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
R9 = 9


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _box(*names: str) -> list[str]:
    return [f"{n}.{c}" for n in names for c in "x1 y1 x2 y2".split()]


# SQL pieces ---------------------------------------------------------------------------------------


_CAND = f", cand AS (SELECT a.page_id, a.ord AS t, b.ord AS p, {iou_sql('a', 'b')} AS iou FROM a JOIN b ON a.page_id = b.page_id WHERE {iou_sql('a', 'b')} >= 0.5)"
_CAND_TYPE = f", cand AS (SELECT a.page_id, a.region_type, a.ord AS t, b.ord AS p, {iou_sql('a', 'b')} AS iou FROM a JOIN b ON a.page_id = b.page_id AND a.region_type = b.region_type WHERE {iou_sql('a', 'b')} >= 0.5)"
_MATCH = REGION_SQL + _CAND + "," + fold_sql("cand", "m")
_MATCH_TYPE = REGION_SQL + _CAND_TYPE + "," + fold_sql("(SELECT page_id, t, p, iou FROM cand)", "m")
_RATES = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 9) AS recall, round(coalesce(2.0::DOUBLE * (coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0)) * (coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0)) / nullif(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) + coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 0.0), 0.0), 9) AS f1"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R9) for c in columns})


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# Coordinates and labels ---------------------------------------------------------------------------

_PAGE = "1600 + (page_id % 7) * 100"
_PAGE_H = "2000 + (page_id % 5) * 150"


def _sized(spark, sf_dir):
    return regions(spark, sf_dir, "a").withColumns({"width": F.expr(_PAGE), "height": F.expr(_PAGE_H)})


@query(REGION_SQL + f"SELECT page_id, ord, (x1::DOUBLE / ({_PAGE})::DOUBLE) * 1000.0::DOUBLE AS x1, (y1::DOUBLE / ({_PAGE_H})::DOUBLE) * 1000.0::DOUBLE AS y1, (x2::DOUBLE / ({_PAGE})::DOUBLE) * 1000.0::DOUBLE AS x2, (y2::DOUBLE / ({_PAGE_H})::DOUBLE) * 1000.0::DOUBLE AS y2 FROM a")
def normalize_bbox(spark, sf_dir):
    return _sized(spark, sf_dir).select("page_id", "ord", *G.normalize_box(G.Box.of(), F.col("width"), F.col("height")).columns())


@query(REGION_SQL + f"SELECT page_id, ord, round_even(x1::DOUBLE / 1000.0::DOUBLE * ({_PAGE}), 0)::BIGINT AS x1, round_even(y1::DOUBLE / 1000.0::DOUBLE * ({_PAGE_H}), 0)::BIGINT AS y1, round_even(x2::DOUBLE / 1000.0::DOUBLE * ({_PAGE}), 0)::BIGINT AS x2, round_even(y2::DOUBLE / 1000.0::DOUBLE * ({_PAGE_H}), 0)::BIGINT AS y2 FROM a")
def bbox_to_pixels(spark, sf_dir):
    return _sized(spark, sf_dir).select("page_id", "ord", *G.box_to_pixels(G.Box.of(), F.col("width"), F.col("height")).columns())


@query(REGION_SQL + "SELECT page_id, ord, greatest(0, least(x1 - 30, 800)) AS x1, greatest(0, least(y1 - 30, 600)) AS y1, greatest(0, least(x2 + 30, 800)) AS x2, greatest(0, least(y2 + 30, 600)) AS y2, greatest(0, least(x2 + 30, 800)) > greatest(0, least(x1 - 30, 800)) AND greatest(0, least(y2 + 30, 600)) > greatest(0, least(y1 - 30, 600)) AS has_extent FROM b")
def clamp_expand(spark, sf_dir):
    box = G.expand_box(G.Box.of(), 30, F.lit(800), F.lit(600))
    return regions(spark, sf_dir, "b").select("page_id", "ord", *box.columns(), G.has_extent(box).alias("has_extent"))


@query(REGION_SQL + "SELECT page_id, ord, coalesce(x1 BETWEEN 0 AND 900 AND y1 BETWEEN 0 AND 900 AND x2 BETWEEN 0 AND 900 AND y2 BETWEEN 0 AND 900 AND x2 > x1 AND y2 > y1, false) AS valid FROM b")
def validate_bbox(spark, sf_dir):
    return regions(spark, sf_dir, "b").select("page_id", "ord", G.valid_box(G.Box.of(), 900).alias("valid"))


_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ({t: t for t in labels.REGION_TYPES} | labels.TYPE_ALIASES).items()) + "}"
_RAW = "CASE l_linenumber WHEN 1 THEN ' Main ' WHEN 2 THEN 'Body-Text' WHEN 3 THEN 'STAMP seal' WHEN 4 THEN 'cataloguing_mark' WHEN 5 THEN l_returnflag WHEN 6 THEN '' WHEN 7 THEN 'handwritten annotation' ELSE NULL END"


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, {_RAW} AS raw FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce({_ALIAS}[replace(replace(lower(trim(raw)), '-', '_'), ' ', '_')], 'unknown') AS region_type FROM t")
def normalize_type(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_RAW).alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", labels.region_type(F.col("raw")).alias("region_type"))


@query(REGION_SQL + "SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM (SELECT a.page_id, a.ord, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2 FROM a JOIN b ON a.page_id = b.page_id AND a.ord = b.ord) GROUP BY page_id")
def union_bbox(spark, sf_dir):
    a, b = regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")
    other = b.select("page_id", "ord", *G.Box.of().columns("o_"))
    both = a.join(other, ["page_id", "ord"]).select("page_id", *G.union_box(G.Box.of(), G.Box.of("o_")).columns())
    return both.groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _block_of(rows: DataFrame, nth) -> DataFrame:
    """A block for each order, its lines those of ``nth`` (a struct that ends in line), in its order."""
    lines = rows.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.transform(F.sort_array(F.collect_list(nth)), lambda x: x["line"]).alias("lines"))
    whole = G.Box(*(F.lit(float(v)) for v in (0, 0, 10, 10))).as_struct()
    return lines.select("page_id", F.col("page_id").cast("string").alias("path"), F.lit(0).alias("block_ord"), F.lit("b").alias("id"), F.lit(None).cast("string").alias("block_type"), F.lit(10).alias("width"), F.lit(10).alias("height"), whole.alias("bbox"), F.array().cast("array<struct<x:double,y:double>>").alias("polygon"), "lines")


# Nested records -----------------------------------------------------------------------------------


@query("SELECT l_orderkey AS page_id, count(*) AS lines, string_agg(l_returnflag || CAST(l_linenumber AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM lineitem GROUP BY 1")
def flatten_blocks(spark, sf_dir):
    """Blocks with nested lines, flattened by position and their texts joined."""
    nth = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.lit(None).cast("double").alias("confidence")).alias("line"))
    blocks = _block_of(_t(spark, sf_dir, "lineitem"), nth)
    return layout.layout_regions(blocks).select("page_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), "text")


@query(REGION_SQL + ", flagged AS (SELECT page_id, max(CASE WHEN x2 > 850 THEN 1 ELSE 0 END) AS bad FROM a GROUP BY page_id) SELECT CAST(a.page_id AS VARCHAR) AS path, CAST(ord AS INTEGER) AS ord, CAST(a.page_id AS VARCHAR) || '-' || lpad(CAST(ord AS VARCHAR), 4, '0') AS id, region_type, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2, 0.5::DOUBLE AS confidence FROM a JOIN flagged ON a.page_id = flagged.page_id WHERE bad = 0 AND region_type <> 'illustration'")
def json_regions(spark, sf_dir):
    """Records saved as JSON and read as variants: malformed items are skipped, an invalid box rejects its record."""
    from folioscope.sources import records

    a = regions(spark, sf_dir, "a")
    wide = F.when(F.col("x2") > 850, F.lit(2000)).otherwise(F.col("x2"))
    box = F.when(F.col("region_type") == "illustration", F.array("x1", "y1", "x2")).otherwise(F.array("x1", "y1", wide, "y2"))
    box = F.when((F.col("region_type") == "illustration") & (F.col("x2") > 850), F.array("x1", "y1", wide, "y2")).otherwise(box)
    item = F.struct("ord", F.struct(F.col("region_type").alias("type"), box.alias("bbox"), F.lit("0.5").alias("confidence"), F.lit("x").alias("extra")).alias("item"))
    saved = a.groupBy(F.col("page_id").cast("string").alias("path")).agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("regions"))).alias("json"))
    parsed = saved.select("path", F.try_parse_json("json").alias("v"))
    found, _ = records.json_regions(parsed, F.col("path"), F.try_variant_get("v", "$.regions", "array<variant>"))
    # an item's place counts skipped items, and pages' rows count from 0 without gaps, so both agree
    return found.select("path", "ord", "id", "region_type", *G.Box._fields, "confidence")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def variant_fields(spark, sf_dir):
    from folioscope.sources.records import kind

    rows = _t(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "double").alias("k"), F.coalesce(kind(F.col("v")) == "OBJECT", F.lit(False)).alias("is_object"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE length(text) END AS n FROM conversations")
def reply_objects(spark, sf_dir):
    """Replies with a fence around a JSON object give the object, others give null."""
    said = F.to_json(F.struct(F.col("text").alias("t")))
    fenced = F.concat(F.lit("```json\n"), said, F.lit("\n```"))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", ids.reply_object(F.when(F.col("role") == "user", F.concat(F.lit("Sure: "), said)).otherwise(fenced)).alias("v"))
    return rows.select("conv_id", "turn", F.length(F.try_variant_get("v", "$.t", "string")).cast("long").alias("n"))


# Matching and metrics -----------------------------------------------------------------------------


@query(REGION_SQL + _CAND + " SELECT page_id, t AS t_ord, p AS p_ord, iou FROM cand")
def iou_candidates(spark, sf_dir):
    return matching.iou_candidates(regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")).select("page_id", "t_ord", "p_ord", "iou")


@query(_MATCH + " SELECT m.page_id, t AS t_ord, p AS p_ord, iou, a.region_type = b.region_type AS type_match FROM m JOIN a ON a.page_id = m.page_id AND a.ord = t JOIN b ON b.page_id = m.page_id AND b.ord = p")
def match_greedy(spark, sf_dir):
    return matching.match_regions(regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")).select("page_id", "t_ord", "p_ord", "iou", "type_match")


def _wide(spark, sf_dir, letter):
    """Twenty pages of all regions, those of an order side by side with those of others."""
    nth = F.expr("page_id div 20")
    return regions(spark, sf_dir, letter).withColumns({"x1": F.col("x1") + nth * 1000, "x2": F.col("x2") + nth * 1000, "ord": nth * 100 + F.col("ord"), "page_id": F.col("page_id") % 20})


@query(_MATCH + " SELECT m.page_id % 20 AS page_id, m.page_id // 20 * 100 + t AS t_ord, m.page_id // 20 * 100 + p AS p_ord, iou FROM m")
def match_large_pages(spark, sf_dir):
    """Matching on pages of thousands of regions, by a grid and in rounds."""
    found = matching.match_regions(_wide(spark, sf_dir, "a"), _wide(spark, sf_dir, "b"), large=matching.LARGE, many=1000)
    return found.select("page_id", "t_ord", "p_ord", "iou")


@query(_MATCH + " SELECT a.page_id, a.ord, a.region_type FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = a.page_id AND m.t = a.ord)")
def unmatched_truth(spark, sf_dir):
    a, b = regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")
    return matching.unmatched(a, matching.match_regions(a, b), "t").select("page_id", "ord", "region_type")


@query(_MATCH + " SELECT b.page_id, b.ord, b.region_type FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = b.page_id AND m.p = b.ord)")
def unmatched_pred(spark, sf_dir):
    a, b = regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")
    return matching.unmatched(b, matching.match_regions(a, b), "p").select("page_id", "ord", "region_type")


def _counts_sql(keys: str) -> str:
    return f""", u AS (SELECT {keys}, 1 AS nt, 0 AS np, 0 AS nm FROM a UNION ALL SELECT {keys}, 0, 1, 0 FROM b UNION ALL SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, 0, 0, 1 FROM m JOIN a ON a.page_id = m.page_id AND a.ord = m.t),
 g AS (SELECT {keys}, sum(nm)::BIGINT AS tp, (sum(np) - sum(nm))::BIGINT AS fp, (sum(nt) - sum(nm))::BIGINT AS fn FROM u GROUP BY {keys})"""


@query(_MATCH_TYPE + _counts_sql("page_id") + f" SELECT page_id, tp, fp, fn, {_RATES} FROM g")
def detection_metrics(spark, sf_dir):
    return _rounded(metrics.detection_metrics(regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")), "precision", "recall", "f1")


@query(_MATCH_TYPE + _counts_sql("page_id, region_type") + f" SELECT page_id, region_type, tp, fp, fn, {_RATES} FROM g")
def metrics_by_type(spark, sf_dir):
    return _rounded(metrics.metrics_by_type(regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")), "precision", "recall", "f1")


@query(_MATCH + " SELECT m.page_id, round(avg(CASE WHEN a.region_type = b.region_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM m JOIN a ON a.page_id = m.page_id AND a.ord = t JOIN b ON b.page_id = m.page_id AND b.ord = p GROUP BY m.page_id")
def classification_accuracy(spark, sf_dir):
    matches = matching.match_regions(regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b"))
    return _rounded(metrics.classification_accuracy(matches, "page_id"), "accuracy")


_POOL = _MATCH_TYPE + _counts_sql("page_id, region_type") + """, runs AS (SELECT 'run-' || CAST(page_id % 97 AS VARCHAR) AS run, * FROM g),
 pages AS (SELECT run, count(DISTINCT page_id) AS pages FROM runs GROUP BY run),
 pooled AS (SELECT run, region_type, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, count(*) FILTER (WHERE tp + fn > 0) AS truth_pages, count(*) FILTER (WHERE tp + fp > 0) AS predicted_pages FROM runs GROUP BY ALL)
 SELECT run, region_type, pages, tp + fn AS reference_regions, tp + fp AS predicted_regions, tp, fp, fn, truth_pages, predicted_pages, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM pooled JOIN pages USING (run)"""


def _pooled(spark, sf_dir, least):
    by_type = metrics.metrics_by_type(regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b")).withColumn("run", F.concat(F.lit("run-"), F.col("page_id") % 97))
    return _rounded(metrics.pooled_metrics(by_type, least), "precision", "recall", "f1")


@query(_POOL)
def pooled_metrics(spark, sf_dir):
    return _pooled(spark, sf_dir, 1)


@query(_POOL + " WHERE pages >= 155")
def pooled_having(spark, sf_dir):
    return _pooled(spark, sf_dir, 155)


_TYPES_SQL = ", ".join(f"'{t}'" for t in TYPES)


@query(REGION_SQL + " SELECT region_type, count(*) FILTER (WHERE system = 'eScriptorium') AS \"eScriptorium\", count(*) FILTER (WHERE system = 'Qwen3-VL 8B') AS \"Qwen3-VL 8B\", count(*) FILTER (WHERE system = 'Qwen3-VL 30B') AS \"Qwen3-VL 30B\" FROM regions WHERE NOT reviewed GROUP BY region_type")
def type_pivot(spark, sf_dir):
    return overview.type_pivot(regions(spark, sf_dir, "a", "b", "c"), list(labels.SYSTEM_ORDER))


@query(REGION_SQL + " SELECT region_type, system, count(*) AS n, CAST(grouping(region_type, system) AS BIGINT) AS level FROM regions GROUP BY CUBE (region_type, system)")
def type_totals(spark, sf_dir):
    return _longs(overview.type_totals(regions(spark, sf_dir)), "level")


@query(REGION_SQL + " SELECT system, CASE region_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.REGION_LABELS.items()) + " END AS label, count(*) AS n FROM regions GROUP BY ALL")
def label_counts(spark, sf_dir):
    return overview.type_counts(regions(spark, sf_dir), "system")


# Text ---------------------------------------------------------------------------------------------

_CHARS = "regexp_extract_all({}, '(?s).')"
# Levenshtein by code points or words over lists r and h, a row at a time.
_LEV = """CASE WHEN len(r) = 0 THEN len(h) WHEN len(h) = 0 THEN len(r) ELSE list_extract(list_reduce(list_transform(h, lambda w: [w]), lambda row, w: list_reduce(range(1, len(r) + 1), lambda acc, i: list_append(acc, least(acc[-1] + 1, row[i + 1] + 1, row[i] + CASE WHEN r[i] = w[1] THEN 0 ELSE 1 END)), [row[1] + 1]), range(0, len(r) + 1)), -1) END"""
# Texts of no more than 127 different characters have their distance by bytes, once each character is a byte.
_BYTES = "array_to_string(list_transform({}, lambda c: chr(CAST(list_position(list_distinct(list_concat(r, h)), c) AS INTEGER))), '')"
_LEV_CHARS = f"CASE WHEN len(list_distinct(list_concat(r, h))) <= 127 THEN levenshtein({_BYTES.format('r')}, {_BYTES.format('h')}) ELSE {_LEV} END"
_PAIRS = """WITH p AS (SELECT conv_id, turn, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations)"""


def _turns(spark, sf_dir):
    """Consecutive turns of conversations as reference and hypothesis."""
    from pyspark.sql import Window

    rows = _t(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select("conv_id", "turn", F.col("text").alias("ref"), following.alias("hyp")).where("hyp is not null")


def _text_sql(split: str, names: tuple[str, str, str], distance: str) -> str:
    errors, length, rate = names
    return f"""SELECT conv_id, turn, e AS {errors}, n AS {length}, CASE WHEN n = 0 THEN CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE round(e::DOUBLE / n, 9) END AS {rate}
 FROM (SELECT conv_id, turn, len(r) AS n, len(h) AS k, CAST({distance} AS BIGINT) AS e FROM (SELECT conv_id, turn, {split.format('ref')} AS r, {split.format('hyp')} AS h FROM p WHERE hyp IS NOT NULL))"""


_WORDS = "regexp_extract_all({}, '\\S+')"


@query(_PAIRS + _text_sql(_CHARS, ("char_errors", "ref_chars", "cer"), _LEV_CHARS))
def cer(spark, sf_dir):
    r, h = F.col("ref"), F.col("hyp")
    return _turns(spark, sf_dir).select("conv_id", "turn", T.char_distance(r, h).cast("long").alias("char_errors"), F.length(r).cast("long").alias("ref_chars"), F.round(T.cer(r, h), R9).alias("cer"))


@query(_PAIRS + _text_sql(_WORDS, ("word_errors", "ref_words", "wer"), _LEV))
def wer(spark, sf_dir):
    r, h = F.col("ref"), F.col("hyp")
    rw, hw = T.words(r), T.words(h)
    return _turns(spark, sf_dir).select("conv_id", "turn", T.word_distance(rw, hw).cast("long").alias("word_errors"), F.size(rw).cast("long").alias("ref_words"), F.round(T.wer(r, h), R9).alias("wer"))


@query(_PAIRS + f", c AS ({_text_sql(_CHARS, ('char_errors', 'ref_chars', 'cer'), _LEV_CHARS)}), w AS ({_text_sql(_WORDS, ('word_errors', 'ref_words', 'wer'), _LEV)}) SELECT * FROM c JOIN w USING (conv_id, turn)")
def htr_metrics(spark, sf_dir):
    rows = _turns(spark, sf_dir).select("conv_id", "turn", T.htr_metrics(F.col("ref"), F.col("hyp")).alias("m")).select("conv_id", "turn", "m.*")
    return _rounded(rows, "cer", "wer")


_FIRST = f"regexp_extract(text, '{T.characters_of(*T.STRONG)}')"


@query(f"SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN {_FIRST} = '' THEN 'auto' WHEN regexp_matches({_FIRST}, '{T.characters_of(*T.RIGHT_TO_LEFT)}') THEN 'rtl' ELSE 'ltr' END AS direction FROM documents")
def bidi_direction(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.direction("text").alias("direction"))


def _cut_sql(*names: str) -> str:
    """The area of what boxes share between two slanting lines: with corners cut, a box is what of it lies
    between x + y of its cuts. Of one box, or of two."""
    most, least = ("greatest", "least") if len(names) > 1 else ("", "")
    of = lambda f, v: f"{f}({', '.join(v.format(n) for n in names)})"
    x1, y1, x2, y2 = of(most, "{0}.x1"), of(most, "{0}.y1"), of(least, "{0}.x2"), of(least, "{0}.y2")
    low, high = of(most, "({0}.x1 + {0}.y1 + ({0}.x2 - {0}.x1)::DOUBLE / 3)"), of(least, "({0}.x2 + {0}.y2 - ({0}.x2 - {0}.x1)::DOUBLE / 3)")
    square = lambda k, x, y: f"power(greatest(0.0::DOUBLE, {k} - {x} - {y}), 2)"
    below = lambda k: f"({square(k, x1, y1)} - {square(k, x2, y1)} - {square(k, x1, y2)} + {square(k, x2, y2)}) / 2"
    return f"(CASE WHEN {x2} > {x1} AND {y2} > {y1} AND {high} > {low} THEN {below(high)} - {below(low)} ELSE 0.0::DOUBLE END)"


@query(REGION_SQL + f", shapes AS (SELECT a.page_id, a.ord, {_cut_sql('a', 'b')} AS shared, {_cut_sql('a')} AS one, {_cut_sql('b')} AS other FROM a JOIN b ON a.page_id = b.page_id AND a.ord = b.ord) SELECT page_id, ord, round(shared / (one + other - shared), 9) AS iou FROM shapes")
def polygon_iou(spark, sf_dir):
    """IoU of six-pointed polygons cut from the boxes of two systems."""
    a, b = regions(spark, sf_dir, "a"), regions(spark, sf_dir, "b").select("page_id", "ord", *G.Box.of().columns("o_"))

    def cut_corners(x: G.Box):
        third = (x.x2 - x.x1) / 3
        point = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
        return F.array(point(x.x1 + third, x.y1), point(x.x2, x.y1), point(x.x2, x.y2 - third), point(x.x2 - third, x.y2), point(x.x1, x.y2), point(x.x1, x.y1 + third))

    x, y = G.Box.of(), G.Box.of("o_")
    return a.join(b, ["page_id", "ord"]).select("page_id", "ord", F.round(G.region_iou(cut_corners(x), x, cut_corners(y), y), R9).alias("iou"))


# Disagreements ------------------------------------------------------------------------------------

@query(REGION_SQL + SYSTEMS_SQL + " SELECT l.page_id, l.system AS l_name, r.system AS r_name FROM s l JOIN s r ON l.page_id = r.page_id AND l.sys_ord < r.sys_ord WHERE NOT l.reviewed AND NOT r.reviewed")
def system_pairs(spark, sf_dir):
    return disagreements.system_pairs(page_systems(regions(spark, sf_dir))).select("page_id", "l_name", "r_name")


_SHOW = ("page_id", "rank", "l_name", "r_name", "kind", "x1", "y1", "x2", "y2")


def _ranked(spark, sf_dir):
    rows = regions(spark, sf_dir)
    return _longs(disagreements.disagreements(rows, page_systems(rows)), "rank")


@query(DISAGREEMENTS_SQL + f" SELECT {', '.join(_SHOW)} FROM ranked")
def disagreements_ranked(spark, sf_dir):
    return _ranked(spark, sf_dir).select(*_SHOW)


@query(DISAGREEMENTS_SQL + f""", lists AS (SELECT page_id, list_sort(list({{{', '.join(f"'{c}': {c}" for c in _SHOW[1:])}}})) AS ds FROM ranked GROUP BY page_id),
 picked AS (SELECT page_id, unnest(list_reduce(list_transform(ds, lambda k: [k]), lambda acc, k: CASE WHEN len(acc) >= 4 OR len(list_filter(acc, lambda z: {iou_sql('z', 'k[1]')} >= 0.4)) > 0 THEN acc ELSE list_concat(acc, k) END)) AS d FROM lists)
 SELECT page_id, {', '.join(f'd.{c} AS {c}' for c in _SHOW[1:])} FROM picked""")
def disagreements_nms(spark, sf_dir):
    return disagreements.select_varied(_ranked(spark, sf_dir).select(*_SHOW))


@query(REGION_SQL + f", o AS (SELECT r.page_id, r.ord AS anchor, x.system, {iou_sql('r', 'x')} AS overlap, x.ord, x.id, row_number() OVER (PARTITION BY r.page_id, r.ord, x.system ORDER BY {iou_sql('r', 'x')} DESC, x.ord) AS n FROM r JOIN regions x ON x.page_id = r.page_id WHERE NOT x.reviewed) SELECT page_id, anchor, system, overlap, overlap >= 0.5 AS matched, id AS nearest_id FROM o WHERE n = 1")
def best_overlap(spark, sf_dir):
    anchors = regions(spark, sf_dir, "r").select("page_id", F.col("ord").alias("anchor"), *G.Box._fields)
    found = matching.best_overlaps(anchors, regions(spark, sf_dir, "a", "b", "c"), ("anchor",))
    return found.select("page_id", "anchor", "system", "overlap", "matched", "nearest_id")


# Linkage ------------------------------------------------------------------------------------------

@query(REGION_SQL + NAMED_SQL + equivalent_sql("a", "bn", "e") + " SELECT * FROM e")
def equiv_link(spark, sf_dir):
    return linkage.link_equivalent(regions(spark, sf_dir, "a"), named_b(spark, sf_dir), 0.8)


@query(REGION_SQL + NAMED_SQL + equivalent_sql("a", "bn", "e") + equivalent_sql("bn", "a", "f") + " SELECT e.* FROM e JOIN f ON e.page_id = f.page_id AND e.l_ord = f.r_ord AND e.r_ord = f.l_ord")
def reciprocal_link(spark, sf_dir):
    return linkage.link_reciprocal(regions(spark, sf_dir, "a"), named_b(spark, sf_dir), 0.8)


_ONCE = REGION_SQL + NAMED_SQL + ", once AS (SELECT page_id, id, min(ord) AS group_ord FROM bn GROUP BY 1, 2 HAVING count(*) = 1)"


def _records(spark, sf_dir):
    return regions(spark, sf_dir, "a").select("page_id", F.col("id").alias("region_id"), "ord")


@query(_ONCE + " SELECT a.page_id, a.id AS region_id, a.ord, group_ord FROM a JOIN once ON once.page_id = a.page_id AND once.id = a.id")
def unique_link(spark, sf_dir):
    return linkage.link_unique(_records(spark, sf_dir), named_b(spark, sf_dir))[0]


@query(_ONCE + " SELECT a.page_id, a.id AS region_id, a.ord FROM a LEFT JOIN once ON once.page_id = a.page_id AND once.id = a.id WHERE once.id IS NULL")
def orphan_issues(spark, sf_dir):
    return linkage.link_unique(_records(spark, sf_dir), named_b(spark, sf_dir))[1]


@query(REGION_SQL + " SELECT a.page_id, a.ord AS group_ord, CASE WHEN a.ord % 2 = 0 THEN 'x' ELSE 'y' END AS system FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = a.page_id AND c.ord = a.ord AND CASE WHEN c.ord % 3 = 0 THEN 'x' ELSE 'y' END = CASE WHEN a.ord % 2 = 0 THEN 'x' ELSE 'y' END)")
def failure_antijoin(spark, sf_dir):
    named = lambda df, k: df.select("page_id", F.col("ord").alias("group_ord"), F.when(F.col("ord") % k == 0, "x").otherwise("y").alias("system"))
    return linkage.open_failures(named(regions(spark, sf_dir, "a"), 2), named(regions(spark, sf_dir, "c"), 3))


@query(REGION_SQL + NAMED_SQL + """, f AS (SELECT page_id, id, min(ord) AS ord FROM bn WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = bn.page_id AND c.id = bn.id) GROUP BY 1, 2),
 last AS (SELECT page_id, max(ord) + 1 AS after FROM c GROUP BY page_id) SELECT page_id, ord, id FROM c UNION ALL SELECT f.page_id, coalesce(after, 0) + f.ord, f.id FROM f LEFT JOIN last ON last.page_id = f.page_id""")
def frozen_merge(spark, sf_dir):
    return linkage.merge_frozen(regions(spark, sf_dir, "c").select("page_id", "ord", "id"), named_b(spark, sf_dir).select("page_id", "ord", "id"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN d.source END, d.lang) AS human FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def human_text_coalesce(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "human_corrected")
    return rows.select("doc_id", linkage.human_text(F.col("source"), status, F.col("lang")).alias("human"))


# Roll-ups -----------------------------------------------------------------------------------------


@query(REGION_SQL + ", k AS (SELECT unnest(['eScriptorium', 'Qwen3-VL 8B', 'Qwen3-VL 30B']) AS system) SELECT k.system, coalesce(n, 0) AS pages FROM k LEFT JOIN (SELECT system, count(DISTINCT page_id) AS n FROM regions WHERE NOT reviewed GROUP BY 1) g ON g.system = k.system")
def coverage(spark, sf_dir):
    origin = F.when(F.col("system") == "Qwen3-VL 8B", "qwen3-vl-8b-instruct-mlx").when(F.col("system") == "Qwen3-VL 30B", "qwen3-vl-30b-a3b-instruct-mlx").otherwise("eScriptorium")
    artifacts = regions(spark, sf_dir).select("page_id", origin.alias("origin"), F.when(F.col("reviewed"), "reference").otherwise("prediction").alias("role"))
    return overview.coverage(artifacts, spark)


def _run_systems(spark, sf_dir):
    """A record for each page, system and prompt version; pages divisible by 11 have two of a run."""
    s = page_systems(regions(spark, sf_dir)).withColumn("prompt_version", F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("page_id") % 3)))
    twice = F.explode(F.when((F.col("page_id") % 11 == 0) & ~F.col("reviewed"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    s = s.withColumn("copy", twice).withColumn("skipped_blocks", F.when(F.col("page_id") % 13 == 0, 1).otherwise(0).cast("long"))
    return s.withColumn("source", F.concat_ws("/", "system", "copy"))


_RUNS = REGION_SQL + """, s0 AS (SELECT DISTINCT page_id, system, sys_ord, reviewed FROM regions),
 rec AS (SELECT s0.*, c.copy, system || ' · ' || coalesce(CASE WHEN page_id % 3 <> 0 THEN 'v' || CAST(page_id % 3 AS VARCHAR) END, 'unrecorded') AS run FROM s0, (SELECT unnest([0, 1]) AS copy) c WHERE c.copy = 0 OR (page_id % 11 = 0 AND NOT reviewed))"""


@query(_RUNS + ", n AS (SELECT page_id, system, count(*) AS n FROM regions GROUP BY 1, 2) SELECT run, count(DISTINCT rec.page_id) AS pages, count(*) AS records, coalesce(sum(n), 0)::BIGINT AS regions FROM rec LEFT JOIN n ON n.page_id = rec.page_id AND n.system = rec.system AND rec.copy = 0 WHERE NOT reviewed GROUP BY run")
def run_counts(spark, sf_dir):
    r = regions(spark, sf_dir).withColumn("source", F.concat_ws("/", "system", F.lit("0")))
    return overview.run_counts(_run_systems(spark, sf_dir), r)


@query(_RUNS + ", n AS (SELECT page_id, system, region_type FROM regions) SELECT run, CASE region_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.REGION_LABELS.items()) + " END AS label, count(*) AS n FROM rec JOIN n ON n.page_id = rec.page_id AND n.system = rec.system AND rec.copy = 0 WHERE NOT reviewed GROUP BY ALL")
def run_type_counts(spark, sf_dir):
    r = regions(spark, sf_dir).withColumn("source", F.concat_ws("/", "system", F.lit("0")))
    return overview.run_type_counts(_run_systems(spark, sf_dir), r)


def _manifest(spark, sf_dir):
    """A manifest of all orders as pages, saved as JSON and read as variants."""
    from folioscope.sources.records import parse_manifest

    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    entry = F.struct(F.when(F.col("o_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("ms-"), F.col("o_custkey") % 40)).alias("manuscript_id"), (F.col("o_orderkey") % 2 == 0).alias("layout_review_complete"))
    rows = o.select(F.concat(F.lit('{"pages": {"'), F.col("o_orderkey").cast("string"), F.lit('": '), F.to_json(entry), F.lit("}}")).alias("json"))
    pages, _ = parse_manifest(rows.select(F.lit("corpus.json").alias("path"), F.try_parse_json("json").alias("v")))
    return pages.withColumn("page_id", F.col("page_id").cast("long"))


@query("SELECT nullif(count(DISTINCT CASE WHEN o_custkey % 5 <> 0 THEN 'ms-' || CAST(o_custkey % 40 AS VARCHAR) END), 0) AS manuscripts, count(*) FILTER (WHERE o_custkey % 5 <> 0) AS mapped_pages, count(*) FILTER (WHERE o_custkey % 5 <> 0) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS mapping_complete FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def manuscript_count(spark, sf_dir):
    return overview.manuscript_count(_manifest(spark, sf_dir), regions(spark, sf_dir, "a"))


@query(REGION_SQL + " SELECT count(DISTINCT page_id) AS reviewed_pages FROM (SELECT page_id FROM r UNION ALL SELECT doc_id FROM labels WHERE quality = 1)")
def reviewed_pages(spark, sf_dir):
    marked = _t(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return overview.reviewed_pages(regions(spark, sf_dir, "r"), marked)


@query(_RUNS + ", u AS (SELECT page_id, run, count(*) AS n FROM rec WHERE NOT reviewed AND page_id % 2 = 0 AND page_id % 13 <> 0 AND page_id IN (SELECT o_orderkey FROM orders) AND page_id IN (SELECT page_id FROM s0 WHERE reviewed) GROUP BY 1, 2) SELECT run, count(*) FILTER (WHERE n = 1) AS eligible, count(*) FILTER (WHERE n > 1) AS ambiguous FROM u GROUP BY run")
def ambiguous_runs(spark, sf_dir):
    usable, several = overview.eligible_records(_run_systems(spark, sf_dir), _manifest(spark, sf_dir))
    both = usable.select("run", F.lit(1).alias("n")).unionByName(several.select("run", F.lit(2).alias("n")))
    return both.groupBy("run").agg(F.count_if(F.col("n") == 1).alias("eligible"), F.count_if(F.col("n") > 1).alias("ambiguous"))


@query(REGION_SQL + ", rd AS (SELECT page_id, ord, id, page_id % 4 = 0 AS done FROM a WHERE (page_id + ord) % 3 <> 0) SELECT count(DISTINCT (page_id, id)) AS available, count(DISTINCT CASE WHEN done THEN (page_id, id) END) AS evaluated, count(*) FILTER (WHERE done) AS pairs, count(DISTINCT CASE WHEN done THEN page_id END) AS evaluated_pages FROM rd")
def htr_coverage(spark, sf_dir):
    groups = regions(spark, sf_dir, "a").withColumn("region_source", F.lit("layout"))
    readings = groups.where("(page_id + ord) % 3 <> 0").select("page_id", F.col("ord").alias("group_ord"), F.when(F.col("page_id") % 4 == 0, F.struct(F.lit(0.0).alias("cer"))).alias("metrics"))
    return overview.htr_coverage(readings, groups)


@query("SELECT l_orderkey AS page_id, round(avg(c), 9) AS confidence FROM (SELECT l_orderkey, l_linenumber, avg(l_discount) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def confidence_mean(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_discount").alias("c"))
    nth = F.struct("l_linenumber", F.struct(F.lit("").alias("text"), F.col("c").cast("double").alias("confidence")).alias("line"))
    return _rounded(layout.layout_regions(_block_of(lines, nth)).select("page_id", "confidence"), "confidence")


# Batches and identifiers --------------------------------------------------------------------------

_JOBS = REGION_SQL + """, src AS (SELECT a.page_id, CASE WHEN a.page_id % 5 = 0 THEN 0 WHEN a.page_id % 5 = 1 THEN 1 WHEN a.page_id % 5 = 2 THEN 2 ELSE 3 END AS k FROM (SELECT DISTINCT page_id FROM a) a),
 reg AS (SELECT c.page_id, c.id, 'frozen' AS region_source FROM c WHERE c.page_id % 5 = 0 UNION ALL SELECT r.page_id, r.id, 'annotated' FROM r WHERE r.page_id % 5 = 1 AND region_type <> 'illustration' UNION ALL SELECT b.page_id, b.id, 'layout' FROM b WHERE b.page_id % 5 = 2 AND region_type <> 'illustration'
  UNION ALL SELECT page_id, 'whole-page', 'whole image' FROM src WHERE NOT (page_id IN (SELECT page_id FROM c WHERE page_id % 5 = 0) OR page_id IN (SELECT page_id FROM r WHERE page_id % 5 = 1) OR page_id IN (SELECT page_id FROM b WHERE page_id % 5 = 2)))"""


def _planned(spark, sf_dir):
    of = lambda letter, k, name: regions(spark, sf_dir, letter).where(F.col("page_id") % 5 == k).withColumn("region_source", F.lit(name))
    return batch.plan_regions(regions(spark, sf_dir, "a"), of("c", 0, "frozen"), of("r", 1, "annotated"), of("b", 2, "layout"))


@query(_JOBS + " SELECT page_id, id AS region_id, region_source, model FROM reg, (SELECT unnest(['m1', 'm2']) AS model)")
def job_plan(spark, sf_dir):
    models = spark.createDataFrame([("m1",), ("m2",)], "model string")
    return batch.plan_jobs(_planned(spark, sf_dir), models, "read this", "v1").select("page_id", "region_id", "region_source", "model")


@query(_JOBS + " SELECT page_id, id AS region_id FROM reg WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = reg.page_id AND a.id = reg.id AND a.ord % 2 = 0)")
def resume_antijoin(spark, sf_dir):
    jobs = batch.plan_jobs(_planned(spark, sf_dir), spark.createDataFrame([("m1",)], "model string"), "read this", "v1").withColumn("image_sha256", F.lit("x"))
    done = regions(spark, sf_dir, "a").where("ord % 2 = 0").select("page_id", F.col("id").alias("region_id"), F.lit("m1").alias("model"), F.lit("v1").alias("prompt_version"), F.lit("x").alias("image_sha256"), F.lit("read this").alias("prompt"), F.lit("text").alias("transcription"))
    return batch.pending(jobs, done)[0].select("page_id", "region_id")


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 20) AS page_file, substr(sha256(source || '/' || CAST(doc_id AS VARCHAR)), 1, 16) AS group_id FROM documents")
def sha_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", "source")
    return rows.select("doc_id", ids.sha_id(F.col("doc_id").cast("string"), 20).alias("page_file"), ids.sha_id(F.concat_ws("/", "source", F.col("doc_id").cast("string")), 16).alias("group_id"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, 'data:image/png;base64,' || to_base64(encode(url)) AS data_url FROM pages")
def path_and_data_url(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", "url")
    return rows.select("page_id", F.when(F.endswith("url", F.lit("/")), F.lit("")).otherwise(ids.file_name(F.col("url"))).alias("name"), ids.data_url(F.lit("page.png"), F.col("url").cast("binary")).alias("data_url"))


for _more in (corpora, pictures, batches, comparisons):
    QUERIES |= _more.QUERIES
    SQL |= _more.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_by_type(spark, sf_dir)
