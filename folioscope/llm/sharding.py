"""Sharding by histogram sort: splitters of equal bytes, then one exchange.

Every row has a 64-bit key, a hash of its id, its text and its place in the input, so any number
of equal documents can be divided. Probes are put between the keys; all partitions count the
bytes and rows below each probe exactly, and the driver, which sees nothing but those counts,
moves the probes of every splitter closer until the bytes below it are within the tolerance, or
no row is left between two probes. Then the rows go to their parts in a single exchange, sorted by
key, and get their slots from the counted rows below each part.

Defined results: a null text counts as an empty one of size 1; null ids are kept; equal rows get
slots of their own; with fewer rows than shards some shards stay empty; an empty table gives an
empty result. Other columns are ignored by ``assign_shards`` and kept by ``write_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from folioscope.llm.common import cut, text_bytes

#: Share of a shard's bytes by which its border may miss, and the same for parts within a shard.
TOLERANCE, PART_TOLERANCE = 1e-4, 0.1
#: Rows that a part of a shard has at most, about; parts are what one task sorts.
PART_ROWS = 1 << 20
LOW, HIGH = -(1 << 63), 1 << 63


@dataclass
class Border:
    """What is known of the place of one splitter: probes around it and what lies below them."""

    target: float
    slack: float
    low: tuple[int, int, int]  # key, bytes below, rows below
    high: tuple[int, int, int]

    def settled(self) -> bool:
        near = min(self.target - self.low[1], self.high[1] - self.target)
        return near <= self.slack or self.high[2] - self.low[2] <= 1 or self.high[0] - self.low[0] <= 1

    def best(self) -> tuple[int, int, int]:
        return self.low if self.target - self.low[1] <= self.high[1] - self.target else self.high

    def probes(self) -> set[int]:
        a, b = self.low[0], self.high[0]
        guess = a + (b - a) * (self.target - self.low[1]) / max(1, self.high[1] - self.low[1])
        found = {a + (b - a) * i // 4 for i in (1, 2, 3)}
        for part in (0, 1 / 16, 1 / 256, 1 / 4096):
            found |= {int(guess - (b - a) * part), int(guess + (b - a) * part)}
        return {p for p in found if a < p < b}


def _below(probes: np.ndarray) -> callable:
    @F.arrow_udf("int")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(np.searchsorted(probes, keys.to_numpy(zero_copy_only=False), side="right"), type=pa.int32())

    return place


def splitters(keyed: DataFrame, parts: int, per_shard: int, total: int, rows: int) -> list[tuple[int, int, int]]:
    """The parts - 1 splitters of ``keyed`` (key, size): key, bytes below, rows below."""
    width = total / parts
    borders = []
    for j in range(1, parts):
        slack = TOLERANCE * width * per_shard if j % per_shard == 0 else PART_TOLERANCE * width
        borders.append(Border(total * j / parts, slack, (LOW, 0, 0), (HIGH, total, rows)))
    while open_ := [b for b in borders if not b.settled()]:
        probes = np.array(sorted(set().union(*(b.probes() for b in open_))), dtype=np.int64)
        counted = keyed.select("size", _below(probes)("key").alias("place")).groupBy("place").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
        sizes, counts = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
        for r in counted:
            sizes[r["place"]], counts[r["place"]] = r["size"], r["rows"]
        sizes, counts = np.cumsum(sizes), np.cumsum(counts)  # [i]: below probe i
        for b in open_:
            i = int(np.searchsorted(sizes[:-1], b.target, side="right"))
            if i > 0 and probes[i - 1] > b.low[0]:
                b.low = (int(probes[i - 1]), int(sizes[i - 1]), int(counts[i - 1]))
            if i < len(probes) and probes[i] < b.high[0]:
                b.high = (int(probes[i]), int(sizes[i]), int(counts[i]))
    return [b.best() for b in borders]


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text_crc32", "place_in_input")


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    own = docs.select("doc_id", text_bytes("text").alias("bytes"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), F.monotonically_increasing_id().alias("place_in_input"), *more)
    return own.withColumn("size", F.col("bytes") + 1).withColumn("key", _row_key()).drop("bytes")


def _parts(keyed: DataFrame, shards: int, part_rows: int) -> tuple[callable, int]:
    """A function from the key to shard, part and first slot of the part; the number of parts."""
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per_shard = max(1, ceil(rows / shards / part_rows))
    found = splitters(keyed, shards * per_shard, per_shard, total, rows) if rows else [(HIGH - 1, 0, 0)] * (shards * per_shard - 1)
    borders = np.array([k for k, _, _ in found], dtype=object).clip(LOW, HIGH - 1).astype(np.int64)
    first = np.array([0, *(n for _, _, n in found)], dtype=np.int64)

    @F.arrow_udf("part int, shard int, first long")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            part = np.searchsorted(borders, keys.to_numpy(zero_copy_only=False), side="right")
            shard = part // per_shard
            yield pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(shard, pa.int32()), pa.array(first[part] - first[shard * per_shard], pa.int64())], names=["part", "shard", "first"])

    return place, shards * per_shard


def assign_shards(docs: DataFrame, shards: int = 8, part_rows: int = PART_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    keyed = cut(_rows(docs), "shard-keys")
    place, _ = _parts(keyed, shards, part_rows)
    placed = keyed.withColumn("at", place("key")).select("*", "at.part", "at.shard", "at.first")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("key", "place_in_input"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + nth - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, part_rows: int = PART_ROWS) -> None:
    """Writes all columns of ``docs`` below ``path``/shard=N, in slot order within each file."""
    rows = _rows(docs, F.struct("*").alias("row"))
    place, parts = _parts(cut(rows.drop("row"), "shard-keys"), shards, part_rows)
    placed = rows.select("row", "key", "place_in_input", place("key").alias("at")).select("row", "key", "place_in_input", "at.part", "at.shard")
    ordered = placed.repartition(parts, "part").sortWithinPartitions("part", "key", "place_in_input")
    ordered.select("row", "shard").write.partitionBy("shard").parquet(path)
