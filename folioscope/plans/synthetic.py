"""Region tables derived from the bench tables by integer arithmetic, the same in Spark and SQL.

System a is drawn from order lines; b, c and the reviewed r are shifted copies with some rows gone
and some types changed. Integer coordinates make overlaps exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = ("main_text", "marginal_text", "stamp_or_seal", "handwritten_annotation", "archival_mark", "illustration", "unknown")
# name, place on the page, reviewed, then expressions over p, s, n: shifts, whether a row is gone, and the change of type.
SYSTEMS = (
    ("Qwen3-VL 8B", 0, False, "0", "0", "false", "0"),
    ("Qwen3-VL 30B", 1, False, "(p * 7 + n * 13) % 81 - 40", "(s * 5 + n * 17) % 61 - 30", "(p + n) % 6 = 0", "CASE WHEN (s + n) % 5 = 0 THEN 1 ELSE 0 END"),
    ("eScriptorium", 2, False, "(p * 11 + n * 5) % 101 - 50", "(s * 3 + n * 7) % 71 - 35", "(p + 2 * n) % 7 = 0", "CASE WHEN (s + p) % 4 = 0 THEN 2 ELSE 0 END"),
    ("Human-corrected eScriptorium", 3, True, "(p * 3 + n) % 21 - 10", "(s * 2 + n * 3) % 15 - 7", "(s + n) % 9 = 0", "0"),
)
_TYPE_ARRAY = ", ".join(f"'{t}'" for t in TYPES)

_LINES = """
 l AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord,
              l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
 base AS (SELECT *, (p % 4) * 200 AS bx, (s % 4) * 200 AS by_, 150 + n * 20 AS w, 150 + ((p + s) % 5) * 25 AS h FROM l)"""


def _system_sql(i: int) -> str:
    name, place, reviewed, dx, dy, gone, shift = SYSTEMS[i]
    return f"""SELECT page_id, {place} AS sys_ord, '{name}' AS system, {str(reviewed).lower()} AS reviewed, ord, 'r' || CAST(ord AS VARCHAR) AS id,
   [{_TYPE_ARRAY}][CAST((p + s + {shift}) % 7 AS INTEGER) + 1] AS region_type,
   greatest(0, bx + {dx}) AS x1, greatest(0, by_ + {dy}) AS y1, bx + w + {dx} AS x2, by_ + h + {dy} AS y2 FROM base WHERE NOT ({gone})"""


#: Lines that a task should have at most, where a table has more than a task for each core could hold.
DEALT = 1 << 18


#: Common table expressions a, b, c, r (and regions: all of them) for DuckDB.
REGION_SQL = "WITH" + _LINES + "".join(f",\n {n} AS ({_system_sql(i)})" for i, n in enumerate("abcr")) + ",\n regions AS (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in "abcr") + ")"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("n"), "l_extendedprice")
    # dealt by the page's own name, so that what goes on by page stays where it is; a large table in parts of a fixed
    # size, since Spark would join small parts to a few large ones and a task's memory would grow with them
    if (parts := lines.count() // DEALT + 1) > spark.sparkContext.defaultParallelism:
        lines = lines.repartition(parts, "page_id")
    place = Window.partitionBy("page_id").orderBy("n", "p", "s", "l_extendedprice")
    named = lines.select("page_id", (F.row_number().over(place) - 1).cast("long").alias("ord"), "p", "s", "n")
    p, s, n = F.col("p"), F.col("s"), F.col("n")
    return named.select("*", (p % 4 * 200).alias("bx"), (s % 4 * 200).alias("by_"), (150 + n * 20).alias("w"), (150 + (p + s) % 5 * 25).alias("h"))


def regions(spark: SparkSession, sf_dir: str, *which: str) -> DataFrame:
    """page_id, sys_ord, system, reviewed, ord, id, region_type, x1..y2 of the named systems (a, b, c, r)."""
    rows = base(spark, sf_dir)
    types = F.array(*(F.lit(t) for t in TYPES))
    made = []
    for letter in which or "abcr":
        name, place, reviewed, dx, dy, gone, shift = SYSTEMS["abcr".index(letter)]
        kind = F.get(types, ((F.col("p") + F.col("s") + F.expr(shift)) % 7).cast("int"))
        made.append((gone, [
            F.lit(place).alias("sys_ord"), F.lit(name).alias("system"), F.lit(reviewed).alias("reviewed"), F.col("ord"), F.concat(F.lit("r"), "ord").alias("id"), kind.alias("region_type"),
            F.expr(f"greatest(0L, bx + {dx})").alias("x1"), F.expr(f"greatest(0L, by_ + {dy})").alias("y1"), F.expr(f"bx + w + {dx}").alias("x2"), F.expr(f"by_ + h + {dy}").alias("y2"),
        ]))
    if len(made) == 1:
        return rows.where(f"NOT ({made[0][0]})").select("page_id", *made[0][1])
    # the systems of a line side by side, so that lines are numbered once
    each = F.array(*(F.when(~F.expr(gone), F.struct(*columns)) for gone, columns in made))
    return rows.select("page_id", F.explode(each).alias("x")).where("x is not null").select("page_id", "x.*")


def page_systems(rows: DataFrame) -> DataFrame:
    """The systems of each page, from their regions."""
    return rows.select("page_id", "system", "sys_ord", "reviewed").distinct()
