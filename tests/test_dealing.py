"""Large tables: dealt in parts of a fixed size, and counted where a page is."""

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.operators import overview
from folioscope.plans import pictures, queries, synthetic
from folioscope.sources import frozen, images, publish

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_dealt_in_parts(spark, monkeypatch):
    whole = synthetic.base(spark, DATA)
    rows = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(synthetic, "DEALT", 100)
    dealt = synthetic.base(spark, DATA)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > len(rows) // 200 and max(sizes) < 200
    assert sorted(map(tuple, dealt.collect())) == rows


@pytest.mark.parametrize("name", ["htr_coverage", "ambiguous_runs"])
def test_dealt_in_parts_as_in_sql(spark, monkeypatch, name):
    monkeypatch.setattr(synthetic, "DEALT", 1000)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = queries.QUERIES[name](spark, DATA)
    told = con.execute(queries.SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(told.fetchall())


def test_coverage_counts_where_the_page_is(spark):
    groups = spark.createDataFrame([("a", 0, "s", "x"), ("a", 1, "s", "x"), ("a", 2, None, None), ("a", 3, "s", "y"), ("b", 0, "s", "x"), (None, 0, "s", "x")], "page_id string, ord int, region_source string, id string")
    readings = spark.createDataFrame([("a", 0, (0.5,)), ("a", 0, None), ("a", 1, (0.0,)), ("a", 2, (1.0,)), ("a", 9, (1.0,)), ("b", 0, None), ("b", None, (1.0,)), (None, 0, (1.0,)), ("c", 0, (1.0,))], "page_id string, group_ord int, metrics struct<cer: double>")
    out = overview.htr_coverage(readings, groups)
    assert [tuple(r) for r in out.collect()] == [(3, 2, 3, 1)]
    assert [tuple(r) for r in overview.htr_coverage(readings.limit(0), groups).collect()] == [(0, 0, 0, 0)]
    assert "Expand" not in plan(out) and "Join" not in plan(out)


def test_files_are_made_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(publish, "TOGETHER", 5)
    names = spark.range(50).select(F.col("id").alias("s")).coalesce(1)
    assert publish.dealt(names, "s").groupBy(F.spark_partition_id()).count().count() > 5
    publish.put_files(publish.dealt(names, "s").mapInArrow(pictures._files, "file string, content binary"), str(tmp_path))
    inputs, _ = frozen.prepare(spark, str(tmp_path))
    rows = {r["page_id"]: r["frozen_from"] for r in inputs.collect()}
    assert rows == {f"i{s}": "whole image" for s in range(50) if s % 3 < 2}
    seen = images.read_images(spark, f"{tmp_path}/images").where("format <> 'JPEG'")
    boxes = seen.select("page_id", *(F.lit(v).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 5), ("y2", 5))))
    crops = [images.crop_images(seen, boxes, parts) for parts in (None, 8)]
    assert crops[1].groupBy(F.spark_partition_id()).count().count() > 4
    assert sorted(map(tuple, crops[0].collect())) == sorted(map(tuple, crops[1].collect()))
