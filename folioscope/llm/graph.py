"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut, files_for


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """node, component (the smallest node reachable), for every node of ``edges`` (a, b: long).

    Alternates the large-star and small-star steps, which keep components and shorten paths, until
    the edges no longer change. Each round ends in a table in the shared folder (``rows``: about how many edges there are). No step gathers a
    node's neighbours: minima are aggregated partially, and joins go by edge.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name, rows)
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            labels = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return files_for(labels.union(now.select("b", "b").distinct()), 2 * state[0])
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.where("a <> b").union(least).distinct(), name, 2 * state[0])  # at most one edge more for each node
