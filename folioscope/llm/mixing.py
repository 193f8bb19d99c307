"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's size is its number of words. The mix shares ``budget`` times all sizes among the
sources by weight; no source gets more than ``cap`` times its own size, and what that leaves over
is shared again by weight among the others. A source's target is met by complete epochs first;
the fraction left is filled with documents in the order of -ln(u) / w, where u is uniform, from a
hash of the document, and w its quality weight: the first documents whose sizes reach the
fraction are taken once more, and the one that crosses it if that comes nearer to the target.

The prefix sums are made in two steps, so that a source with most of the rows is no task's alone:
sizes are summed by source and key range, those sums are scanned, and only the range in which a
source's target falls is scanned row by row.

Defined results: a null or empty text has size 0 and is never taken; null is a source of its own,
last in order; rows that repeat a document stay apart, and if a target falls among them so many of
them are taken as come nearest; a source without words has target 0; an empty table gives an empty
result. Other columns pass through ``expand`` untouched and are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import TEXT_ROWS, WORD, cut, files_for

WEIGHTS, BUDGET, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
#: Key ranges of a source, and copies of a source's row of figures against hot sources in the join.
RANGES, COPIES = 4096, 16

_SYMBOLS = r"[#*$%&|<>]"


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: str, size: Column) -> Column:
    """Words over words and stray symbols, in (0, 1]."""
    symbols = F.coalesce(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    return F.when(size > 0, size / (size + symbols)).otherwise(F.lit(1.0)).cast("double")


def exponential_key(doc_id: str, text: str, weight: Column, seed: str = SEED) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / weight


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """The sizes, keys and key ranges of all rows; everything else is decided from these."""
    sized = docs.select("doc_id", F.concat(F.lit("s"), "source").alias("source"), "text", size_of("text").alias("size"))
    keyed = sized.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "size", exponential_key("doc_id", "text", quality_of("text", F.col("size")), seed).alias("key"))
    return keyed.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))


def _targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """source, source_size, target. One row for each source comes in and goes out."""
    order = Window.orderBy(F.col("source") == "", "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    shares = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") + 1).cast("int")))
    shares = shares.withColumn("most", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    shares = shares.withColumn("level", level)  # if this source and all of higher ratio were the ones below their most
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    shares = shares.withColumn("level", level)
    return shares.select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _cutoffs(keyed: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """For each source: its size and target, whole epochs, and the key up to which documents are
    taken once more; ``ties`` rows have that key, of which ``ties_taken`` are taken."""
    ranges = cut(keyed.groupBy("source", "range").agg(F.sum("size").alias("size")), "mix-ranges", keyed.count())
    n = ranges.count()  # no fewer than the sources
    targets = _targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets", n)
    scan = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    crossed = ranges.withColumn("upto", F.sum("size").over(scan)).join(targets.select("source", "rest"), "source")
    crossed = crossed.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
    crossed = crossed.select("source", "range", "rest", (F.col("upto") - F.col("size")).alias("below"))
    rows = keyed.where("size > 0").join(crossed, ["source", "range"])
    rows = rows.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("ties"), F.first("rest").alias("rest"), F.first("below").alias("below"))
    scan = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("below") + F.sum("size").over(scan))
    rows = rows.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest")))
    one = F.col("size") / F.col("ties")
    taken = F.floor((F.col("rest") - (F.col("upto") - F.col("size"))) / one + 0.5).cast("long")
    last = rows.select("source", F.col("key").alias("last_key"), "ties", F.least("ties", taken).alias("ties_taken"))
    figures = targets.join(last, "source", "left").select("source", "source_size", "target", "epochs", "last_key", F.coalesce("ties", F.lit(0)).alias("ties"), F.coalesce("ties_taken", F.lit(0)).alias("ties_taken"))
    return cut(figures, "mix-sources", n)


def _with_copies(keyed: DataFrame, figures: DataFrame) -> DataFrame:
    """``keyed`` with source_size, target and ``copies``, the times that the mix takes each row.

    The figures have one row for each source; Spark sends them to all tasks only if that table is
    below its own size limit, and else joins them by source and copy."""
    spread = figures.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    joined = keyed.withColumn("copy", F.col("range") % COPIES).join(spread, ["source", "copy"]).drop("copy")
    fraction = F.when(F.col("key") < F.col("last_key"), 1).when(F.col("key") == F.col("last_key"), F.least("ties_taken", F.lit(1))).otherwise(0)
    with_all = joined.withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.coalesce(fraction, F.lit(0))).otherwise(0).cast("long"))
    if figures.where("ties > 1 and ties_taken > 0 and ties_taken < ties").isEmpty():
        return with_all
    tied = (F.col("ties") > 1) & (F.col("key") == F.col("last_key")) & (F.col("size") > 0)
    some = with_all.where(tied).withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("key")))
    some = some.withColumn("copies", (F.col("epochs") + F.when(F.col("nth") <= F.col("ties_taken"), 1).otherwise(0)).cast("long"))
    return with_all.where(~F.coalesce(tied, F.lit(False))).unionByName(some.drop("nth"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target and taken (words)."""
    keyed = cut(_keyed(docs, seed), "mix-keys", docs.count(), TEXT_ROWS)
    out = _with_copies(keyed, _cutoffs(keyed, weights, budget, cap))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def expand(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    n = docs.count()
    keyed = cut(_keyed(docs, seed), "mix-keys", n, TEXT_ROWS)
    figures = _cutoffs(keyed, weights, budget, cap)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    rows = rows.select("row", "doc_id", "text", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source"), size_of("text").alias("size"))
    rows = rows.select("row", "source", "size", exponential_key("doc_id", "text", quality_of("text", F.col("size")), seed).alias("key"))
    rows = rows.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * RANGES), F.lit(RANGES - 1)).cast("int"))
    taken = _with_copies(rows, figures).where("copies > 0")
    return files_for(taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*"), n, TEXT_ROWS)


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0) AS symbols,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS digest
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (CASE WHEN size > 0 THEN size::DOUBLE / (size + symbols) ELSE 1.0 END) AS key
  FROM base),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM keyed GROUP BY source),
lvl AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * coalesce(max(CASE WHEN level * weight <= 2.0 * source_size THEN level END) OVER (), 0.0)) AS target
  FROM lvl),
run AS (
  SELECT k.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN tgt t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN size > 0 AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
