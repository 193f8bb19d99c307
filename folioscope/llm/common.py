"""Pieces that several operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but ASCII white space (space and \x09 to \x0D).
WORD = r"[^\x20\x09-\x0D]+"
#: The same six characters, for str.strip and the like.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a table of names and numbers, and of one with texts or work done on texts, that a task
#: and its file should have at least.
FILE_ROWS, TEXT_ROWS = 100_000, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``, or the checkpoint folder of
    the running context.

    Only where there is neither, and in local mode (tests, a laptop), a temporary folder is made and
    set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="folioscope-"))
        found = spark.sparkContext.getCheckpointDir()  # the setting itself can't be changed in a running session
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def files_for(df: DataFrame, rows: int, per_file: int = FILE_ROWS) -> DataFrame:
    """``df`` in no more partitions than so many rows need; large tables are left as they are."""
    return df.coalesce(max(1, -(-rows // per_file)))


def cut(df: DataFrame, name: str, rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and a
    lost executor costs no more than the tasks that it ran. ``rows``: how many it has at most, where
    that is known; few rows then make few files."""
    df = df if rows is None else files_for(df, rows, per_file)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Shares into which the rows of one key are dealt where a small table is joined to them.
SHARES = 1024


def with_facts(rows: DataFrame, facts: DataFrame, by: list[str], salt: Column) -> DataFrame:
    """``rows`` with what ``facts`` (one row for each key) knows of their keys. One key may have any part
    of the rows, so that Spark, if it shuffles them, does so by key and share (``salt``: a hash)."""
    shared = facts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return rows.withColumn("share", F.pmod(salt, F.lit(SHARES)).cast("int")).join(shared, [*by, "share"]).drop("share")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str):
    """UTF-8 bytes of a text; null counts as none."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


#: Bits of a map of names.
MAP_BITS = 1 << 24


def name_map(names: DataFrame, column: str):
    """A broadcast map of the names (64-bit hashes) in a column, of a fixed size: most names that aren't
    there aren't on it either, as long as there are not many more of them than bits."""
    cell = F.expr(f"cast(floor(pmod({column}, {MAP_BITS}) / 64) as int)")
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {MAP_BITS}) % 64 as int))"))
    cells = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for r in names.groupBy(cell.alias("cell")).agg(bits.alias("bits")).collect():
        cells[r["cell"]] = r["bits"]
    return names.sparkSession.sparkContext.broadcast(cells.tobytes())


def on_map(shared) -> np.ndarray:
    """For each name modulo MAP_BITS whether it is on the map."""
    return np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8), bitorder="little")
