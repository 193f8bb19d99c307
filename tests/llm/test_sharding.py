import random
import zlib
from collections import defaultdict

import pytest

from folioscope.llm import sharding


def check(found, shards=8):
    sizes, slots = [0] * shards, defaultdict(list)
    for r in found:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return sizes


@pytest.mark.parametrize("part_rows", [1 << 20, 60])
def test_shards_are_even_and_gapless(spark, part_rows):
    r = random.Random(7)
    rows = [(i, "é" * r.randint(0, 200) if i % 3 else "the one hot text " * 4) for i in range(3000)]
    docs = spark.createDataFrame([(*x, -1) for x in rows], "doc_id long, text string, shard int").repartition(5)
    found = sharding.assign_shards(docs, part_rows=part_rows).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for x in found:
        data = texts[x["doc_id"]].encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    sizes = check(found)
    assert max(sizes) - min(sizes) <= 2 * max(x["size"] for x in found)


def test_repeated_rows_are_divided(spark):
    docs = spark.createDataFrame([(None, None)] * 400 + [(7, "x" * 9)] * 40, "doc_id long, text string")
    sizes = check(sharding.assign_shards(docs).collect())
    assert max(sizes) - min(sizes) <= 20


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b" * 1000)], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in sharding.assign_shards(docs).collect()) == [1, 2]
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_written_shards_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "s") for i in range(200)], "doc_id long, text string, source string")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() == 8
    assert sorted(map(tuple, back.select("row.*").collect())) == sorted(map(tuple, docs.collect()))
