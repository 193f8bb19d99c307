"""Pieces of SQL, and the regions that go with them, that queries of several modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.synthetic import REGION_SQL, regions


def iou_sql(a: str, b: str) -> str:
    inter = f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    union = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {inter})"
    return f"(CASE WHEN {union} = 0 THEN 0.0::DOUBLE ELSE {inter}::DOUBLE / {union}::DOUBLE END)"


def fold_sql(cand: str, out: str, keys: str = "page_id") -> str:
    """CTEs for the greedy assignment of candidates (keys, t, p, iou)."""
    return f"""
 {out}_s AS (SELECT {keys}, list_reverse_sort(list({{'iou': iou, 't': t, 'p': p}})) AS cs FROM {cand} GROUP BY {keys}),
 {out}_f AS (SELECT {keys}, unnest(list_reduce(list_transform(cs, lambda k: [k]), lambda acc, k: CASE WHEN len(list_filter(acc, lambda z: z.t = k[1].t OR z.p = k[1].p)) > 0 THEN acc ELSE list_concat(acc, k) END)) AS m FROM {out}_s),
 {out} AS (SELECT {keys}, m.iou AS iou, m.t AS t, m.p AS p FROM {out}_f)"""



SYSTEMS_SQL = ", s AS (SELECT DISTINCT page_id, system, sys_ord, reviewed FROM regions)"


DISAGREEMENTS_SQL = REGION_SQL + SYSTEMS_SQL + f""",
 pairs AS (SELECT l.page_id, l.sys_ord AS ls, r.sys_ord AS rs, l.system AS l_name, r.system AS r_name FROM s l JOIN s r ON l.page_id = r.page_id AND l.sys_ord < r.sys_ord WHERE NOT l.reviewed AND NOT r.reviewed),
 pc AS (SELECT a.page_id, pairs.ls, pairs.rs, a.ord AS t, b.ord AS p, {iou_sql('a', 'b')} AS iou FROM pairs JOIN regions a ON a.page_id = pairs.page_id AND a.sys_ord = ls JOIN regions b ON b.page_id = pairs.page_id AND b.sys_ord = rs WHERE {iou_sql('a', 'b')} >= 0.5),
 {fold_sql('pc', 'pm', 'page_id, ls, rs')},
 elem AS (SELECT *, row_number() OVER (PARTITION BY page_id, ls, rs ORDER BY iou DESC, t DESC, p DESC) AS elem FROM pm),
 d AS (SELECT e.page_id, e.ls, e.rs, 'different_types' AS kind, 0 AS ko, -e.iou AS score, 0 AS so, e.elem, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1, greatest(a.x2, b.x2) AS x2, greatest(a.y2, b.y2) AS y2
       FROM elem e JOIN regions a ON a.page_id = e.page_id AND a.sys_ord = e.ls AND a.ord = e.t JOIN regions b ON b.page_id = e.page_id AND b.sys_ord = e.rs AND b.ord = e.p WHERE a.region_type <> b.region_type
       UNION ALL SELECT pairs.page_id, ls, rs, 'unmatched', 1, -((x2 - x1) * (y2 - y1))::DOUBLE, 1, ord, x1, y1, x2, y2 FROM pairs JOIN regions a ON a.page_id = pairs.page_id AND a.sys_ord = ls WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.page_id = pairs.page_id AND pm.ls = pairs.ls AND pm.rs = pairs.rs AND pm.t = a.ord)
       UNION ALL SELECT pairs.page_id, ls, rs, 'unmatched', 1, -((x2 - x1) * (y2 - y1))::DOUBLE, 2, ord, x1, y1, x2, y2 FROM pairs JOIN regions b ON b.page_id = pairs.page_id AND b.sys_ord = rs WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.page_id = pairs.page_id AND pm.ls = pairs.ls AND pm.rs = pairs.rs AND pm.p = b.ord)),
 ranked AS (SELECT d.page_id, row_number() OVER (PARTITION BY d.page_id ORDER BY CASE WHEN l_name LIKE 'Qwen3-VL%' AND r_name LIKE 'Qwen3-VL%' THEN 0 ELSE 1 END, ko, score, d.ls, d.rs, so, elem) AS rank, l_name, r_name, kind, x1, y1, x2, y2, d.ls, d.rs, so, elem FROM d JOIN pairs ON pairs.page_id = d.page_id AND pairs.ls = d.ls AND pairs.rs = d.rs)"""

# b's regions are named by half their place, so ids repeat and links fall back to overlap.
NAMED_SQL = ", bn AS (SELECT * REPLACE ('r' || CAST(ord // 2 * 2 AS VARCHAR) AS id) FROM b)"


def equivalent_sql(left: str, right: str, name: str, close: float = 0.8) -> str:
    return f""", {name}_p AS (SELECT l.page_id, l.ord AS l_ord, r.ord AS r_ord, l.id = r.id AS same, {iou_sql('l', 'r')} >= {close} AS near FROM {left} l JOIN {right} r ON l.page_id = r.page_id),
 {name}_c AS (SELECT *, count(*) FILTER (WHERE same) OVER (PARTITION BY page_id, l_ord) AS ns, count(*) FILTER (WHERE near) OVER (PARTITION BY page_id, l_ord) AS nn FROM {name}_p),
 {name} AS (SELECT page_id, l_ord, r_ord FROM {name}_c WHERE (ns = 1 AND same) OR (ns <> 1 AND nn = 1 AND near))"""


def named_b(spark, sf_dir):
    return regions(spark, sf_dir, "b").withColumn("id", F.concat(F.lit("r"), F.expr("ord div 2 * 2")))
