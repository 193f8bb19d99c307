"""Queries of what stands beside one another: observations at disagreements, comparison groups of regions,
and the readings and failures that link to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box
from folioscope.operators import disagreements, linkage
from folioscope.plans.pieces import DISAGREEMENTS_SQL, NAMED_SQL, equivalent_sql, iou_sql, named_b
from folioscope.plans.synthetic import REGION_SQL, page_systems, regions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Observations -------------------------------------------------------------------------------------

_OBSERVED = DISAGREEMENTS_SQL + f""",
 own AS (SELECT k.page_id, k.rank, k.l_name, k.r_name, k.kind, k.x1, k.y1, k.x2, k.y2, CASE WHEN so = 2 THEN k.rs ELSE k.ls END AS owner_sys, CASE WHEN so = 2 THEN k.ls ELSE k.rs END AS other_sys, CASE WHEN so = 0 THEN e.t ELSE k.elem END AS owner_ord, e.p AS other_ord
  FROM ranked k LEFT JOIN elem e ON k.so = 0 AND e.page_id = k.page_id AND e.ls = k.ls AND e.rs = k.rs AND e.elem = k.elem),
 near AS (SELECT o.*, s.system, s.sys_ord, s.reviewed, x.id AS n_id, x.region_type AS n_type, {iou_sql('o', 'x')} AS overlap FROM own o JOIN s ON s.page_id = o.page_id JOIN regions x ON x.page_id = s.page_id AND x.sys_ord = s.sys_ord
  QUALIFY row_number() OVER (PARTITION BY o.page_id, o.rank, s.sys_ord ORDER BY {iou_sql('o', 'x')} DESC, x.ord) = 1),
 at_pair AS (SELECT o.*, e.id AS e_id, e.region_type AS e_type, {iou_sql('o', 'e')} AS e_overlap, NOT o.reviewed AND o.sys_ord = o.other_sys AND o.other_ord IS NULL AS unpaired FROM near o LEFT JOIN regions e ON NOT o.reviewed AND e.page_id = o.page_id AND e.sys_ord = o.sys_ord AND e.ord = CASE o.sys_ord WHEN o.owner_sys THEN o.owner_ord WHEN o.other_sys THEN o.other_ord END),
 obs AS (SELECT page_id, rank, sys_ord, system, reviewed, CASE WHEN e_id IS NOT NULL THEN 'in_pair' WHEN unpaired THEN 'no_counterpart' WHEN overlap >= 0.5 THEN 'overlapping' ELSE 'none' END AS relationship,
  CASE WHEN e_id IS NOT NULL THEN e_id WHEN overlap >= 0.5 AND NOT unpaired THEN n_id END AS region_id, CASE WHEN e_id IS NOT NULL THEN e_type WHEN overlap >= 0.5 AND NOT unpaired THEN n_type END AS region_type,
  CASE WHEN e_id IS NOT NULL THEN e_overlap ELSE overlap END AS overlap, CASE WHEN e_id IS NULL AND (overlap < 0.5 OR unpaired) AND overlap > 0 THEN n_id END AS nearby_id, CASE WHEN e_id IS NULL AND (overlap < 0.5 OR unpaired) AND overlap > 0 THEN n_type END AS nearby_type FROM at_pair)"""


_SHOWN = ("l_name", "r_name", "kind", *Box._fields)


def _observed(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Disagreements and observations. Nothing is written between: all of it stays dealt by page."""
    rows = regions(spark, sf_dir)
    systems = page_systems(rows)
    ranked = disagreements.disagreements(rows, systems)
    return ranked.select("page_id", "rank", *carry), disagreements.observations(ranked, rows, systems, carry=carry)


@query(_OBSERVED + " SELECT page_id, rank, system, reviewed, relationship, region_id, region_type, round(overlap, 9) AS overlap, nearby_id, nearby_type FROM obs")
def observations(spark, sf_dir):
    """What every system of a page has where two of them disagree."""
    return _observed(spark, sf_dir)[1].withColumn("rank", F.col("rank").cast("long")).withColumn("overlap", F.round("overlap", 9))


@query(_OBSERVED + """, said AS (SELECT page_id, rank, string_agg(system || '=' || coalesce(region_id, ''), ';' ORDER BY system) AS observed FROM obs GROUP BY page_id, rank)
 SELECT k.page_id, k.rank, substr(sha256(concat_ws(chr(31), k.page_id, l_name, r_name, kind, x1, y1, x2, y2, observed)), 1, 16) AS identifier FROM ranked k JOIN said ON said.page_id = k.page_id AND said.rank = k.rank""")
def disagreement_ids(spark, sf_dir):
    ranked, seen = _observed(spark, sf_dir, _SHOWN)
    return disagreements.identified(ranked, seen).select("page_id", F.col("rank").cast("long").alias("rank"), "identifier")


# Groups and readings ------------------------------------------------------------------------------

# r is annotated, b frozen (its ids repeat), a corrected layout, one in three under another id.
_GROUPS = REGION_SQL + NAMED_SQL + """,
 drawn0 AS (SELECT page_id, ord, id, region_type, x1, y1, x2, y2, 'drawn' AS region_source, CASE WHEN ord % 2 = 0 AND ord % 3 <> 0 THEN 'human ' || CAST(ord AS VARCHAR) END AS human_text, CASE WHEN ord % 2 = 0 AND ord % 3 <> 0 THEN 'drawn' END AS human_source FROM r),
 after0 AS (SELECT page_id, max(ord) + 1 AS after FROM drawn0 GROUP BY page_id),
 fr AS (SELECT * FROM bn QUALIFY row_number() OVER (PARTITION BY page_id, id ORDER BY ord) = 1),
 merged AS (SELECT * FROM drawn0 UNION ALL SELECT fr.page_id, coalesce(after, 0) + fr.ord, fr.id, fr.region_type, fr.x1, fr.y1, fr.x2, fr.y2, 'frozen', NULL, NULL FROM fr LEFT JOIN after0 ON after0.page_id = fr.page_id WHERE NOT EXISTS (SELECT 1 FROM drawn0 WHERE drawn0.page_id = fr.page_id AND drawn0.id = fr.id)),
 cor AS (SELECT page_id, ord, CASE WHEN ord % 3 = 0 THEN 'x' || CAST(ord AS VARCHAR) ELSE id END AS id, region_type, x1, y1, x2, y2, CASE WHEN ord % 4 <> 0 THEN 'layout ' || CAST(ord AS VARCHAR) END AS text FROM a)""" + equivalent_sql("cor", "merged", "e", 0.95) + equivalent_sql("merged", "cor", "f", 0.95) + """,
 links AS (SELECT e.page_id, e.l_ord AS c_ord, e.r_ord AS ord FROM e JOIN f ON e.page_id = f.page_id AND e.l_ord = f.r_ord AND e.r_ord = f.l_ord),
 after1 AS (SELECT page_id, max(ord) + 1 AS after FROM merged GROUP BY page_id),
 groups AS (SELECT b.page_id, b.ord, b.id, b.region_type, b.x1, b.y1, b.x2, b.y2, region_source, coalesce(human_text, c.text) AS human_text, coalesce(human_source, CASE WHEN c.text IS NOT NULL THEN 'corrected' END) AS human_source FROM merged b LEFT JOIN links ON links.page_id = b.page_id AND links.ord = b.ord LEFT JOIN cor c ON c.page_id = links.page_id AND c.ord = links.c_ord
  UNION ALL SELECT c.page_id, coalesce(after, 0) + c.ord, c.id, c.region_type, c.x1, c.y1, c.x2, c.y2, 'corrected', c.text, CASE WHEN c.text IS NOT NULL THEN 'corrected' END FROM cor c LEFT JOIN after1 ON after1.page_id = c.page_id WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.page_id = c.page_id AND links.c_ord = c.ord))"""
_BOX = list(Box._fields)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("ord") % 2 == 0, "human_corrected")
    text = lambda kind, k: F.when(F.col("ord") % k != 0, F.concat(F.lit(kind), F.col("ord").cast("string")))
    drawn = regions(spark, sf_dir, "r").select("page_id", "ord", "id", "region_type", *_BOX, F.lit("drawn").alias("source"), status.alias("review_status"), text("human ", 3).alias("transcription"))
    frozen = named_b(spark, sf_dir).select("page_id", "ord", "id", "region_type", *_BOX, F.lit("frozen").alias("source"))
    other = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("x"), F.col("ord").cast("string"))).otherwise(F.col("id"))
    corrected = regions(spark, sf_dir, "a").select("page_id", "ord", other.alias("id"), "region_type", *_BOX, F.lit("corrected").alias("source"), text("layout ", 4).alias("text"))
    return linkage.build_groups(drawn, frozen, corrected)


@query(_GROUPS + " SELECT * FROM groups")
def comparison_groups(spark, sf_dir):
    """Annotated, frozen and corrected regions of all pages, merged to groups with their human text."""
    return _groups(spark, sf_dir)


_ONCE = ", once AS (SELECT page_id, id, min(ord) AS group_ord FROM groups GROUP BY 1, 2 HAVING count(*) = 1)"
# Results of b's regions, one in five without a text; c is the machine's layout; failures of c's regions.
_READINGS = _GROUPS + _ONCE + ", mach AS (SELECT page_id, ord, id, region_type, x1, y1, x2, y2, 'layout ' || CAST(ord // 2 AS VARCHAR) AS text FROM c)" + equivalent_sql("groups", "mach", "g", 0.95) + equivalent_sql("mach", "groups", "h", 0.95) + """,
 said AS (SELECT bn.page_id, group_ord, 'm1' AS system, 'human ' || CAST(bn.ord AS VARCHAR) AS text, 'results/' || CAST(bn.ord AS VARCHAR) AS source FROM bn JOIN once ON once.page_id = bn.page_id AND once.id = bn.id WHERE bn.ord % 5 <> 4
  UNION ALL SELECT g.page_id, g.l_ord, 'eScriptorium', mach.text, 'machine' FROM g JOIN h ON g.page_id = h.page_id AND g.l_ord = h.r_ord AND g.r_ord = h.l_ord JOIN mach ON mach.page_id = g.page_id AND mach.ord = g.r_ord)"""


def _compared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    b = named_b(spark, sf_dir)
    none = F.lit(None).cast("string")
    results = b.select("page_id", F.concat(F.lit("results/"), "ord").alias("path"), F.col("id").alias("region_id"), none.alias("image"), F.lit("m1").alias("model"), F.when(F.col("ord") % 5 != 4, F.concat(F.lit("human "), "ord")).alias("transcription"), none.alias("script"), none.alias("language"))
    machine = regions(spark, sf_dir, "c").select("page_id", "ord", "id", "region_type", *_BOX, F.lit("machine").alias("source"), F.concat(F.lit("layout "), F.expr("ord div 2")).alias("text"))
    failures = regions(spark, sf_dir, "c").select("page_id", F.concat(F.lit("errors/"), "ord").alias("path"), F.col("id").alias("region_id"), F.lit("m1").alias("model"))
    return linkage.htr_comparisons(_groups(spark, sf_dir), results, machine, failures)


@query(_READINGS + """ SELECT said.page_id, group_ord, system, text, source, CASE WHEN human_text IS NOT NULL THEN levenshtein(human_text, text) END AS char_errors, round(CASE WHEN human_text IS NOT NULL THEN levenshtein(human_text, text)::DOUBLE / length(human_text) END, 9) AS cer,
 CASE WHEN human_text IS NOT NULL THEN CASE WHEN split_part(human_text, ' ', 1) <> split_part(text, ' ', 1) THEN 1 ELSE 0 END + CASE WHEN split_part(human_text, ' ', 2) <> split_part(text, ' ', 2) THEN 1 ELSE 0 END END::BIGINT AS word_errors
 FROM said JOIN groups ON groups.page_id = said.page_id AND groups.ord = group_ord""")
def htr_readings(spark, sf_dir):
    """Readings that link to one group, with their errors where a human has read it too."""
    found = _compared(spark, sf_dir)["readings"]
    return found.select("page_id", "group_ord", "system", "text", "source", F.col("metrics.char_errors").alias("char_errors"), F.round("metrics.cer", 9).alias("cer"), F.col("metrics.word_errors").alias("word_errors"))


@query(_READINGS + " SELECT c.page_id, group_ord, 'm1' AS system, 'errors/' || CAST(c.ord AS VARCHAR) AS source FROM c JOIN once ON once.page_id = c.page_id AND once.id = c.id WHERE NOT EXISTS (SELECT 1 FROM said WHERE said.page_id = c.page_id AND said.group_ord = once.group_ord AND said.system = 'm1')")
def htr_failures(spark, sf_dir):
    return _compared(spark, sf_dir)["failures"]
