"""The published report: files of a folder, kept in step with a table.

A build is a table of files (page_id, file, content); a null page_id is for files of the report as a
whole. What is published is a table too: every build writes the list of its files with their hashes
as a new version below ``.builds``, and a pointer file names the version that holds. The difference
between two versions is two anti-joins: files whose bytes are new are written, by the executors,
each under a passing name first; files that only the old version has are removed. So a build that
breaks off leaves the old list in force, and the next one repeats what is missing.

A build fails, before it writes anything, if the folder and an input lie within one another, if the
folder has files but no list, if a file's name isn't a plain relative one or is there twice, or if a
file is there that no list has, or is reached through a link.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.paths import store_of, uri_of
from folioscope.sources.store import settle

LISTS, POINTER = ".builds", "current.json"
FILES = "page_id string, file string, content binary"
LIST = "page_id string, file string, sha256 string"
#: Names of a report's files: parts of letters, digits, dots and dashes that don't begin with a dot.
NAME = r"^[A-Za-z0-9_-][A-Za-z0-9._-]*(/[A-Za-z0-9_-][A-Za-z0-9._-]*)*$"


class Refused(ValueError):
    """The folder can't take this build."""


def _through_link(fs, path: str) -> bool:
    import os

    return fs.type_name == "local" and os.path.realpath(path) != os.path.join(os.path.realpath(os.path.dirname(path)), os.path.basename(path))


def _within(a: str, b: str) -> bool:
    return f"{a}/".startswith(f"{b}/")


def _overlaps(one: str, other: str) -> bool:
    import os

    (fs, a), (fs2, b) = store_of(one), store_of(other)
    if fs.type_name != fs2.type_name:
        return False
    a, b = (os.path.realpath(x) if fs.type_name == "local" else x for x in (a, b))
    return _within(a, b) or _within(b, a)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The list that holds for a folder; an empty one for a folder without a report."""
    fs, base = store_of(folder)
    pointer = f"{base}/{LISTS}/{POINTER}"
    if not fs.get_file_info(pointer).is_file:
        return spark.createDataFrame([], LIST)
    with fs.open_input_stream(pointer) as f:
        try:
            version = json.loads(f.read())["version"]
            rows = spark.read.schema(LIST).parquet(f"{uri_of(fs, base)}/{LISTS}/{version}")
        except (ValueError, KeyError, TypeError) as e:
            raise Refused(f"the pointer of {folder} can't be read: {e}") from e
    if not rows.where(~F.col("file").rlike(NAME)).isEmpty():
        raise Refused(f"the list of {folder} has names that no build makes")
    return rows


def _foreign(folder: str):
    """Names of files that stand where a build, which doesn't own them, would write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(folder)
        for batch in batches:
            bad = []
            for name, owned in zip(batch.column("file").to_pylist(), batch.column("owned").to_pylist(), strict=True):
                path, parts = f"{base}/{name}", name.split("/")
                linked = any(_through_link(fs, "/".join([base, *parts[:i]])) for i in range(1, len(parts) + 1))
                if linked or (not owned and fs.get_file_info(path).type.name != "NotFound"):
                    bad.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["file"])

    return run


def _write(folder: str, packed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(folder)
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target, passing = f"{base}/{name}", f"{base}/{LISTS}/{uuid.uuid4().hex}"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(passing, compression=None) as f:
                    f.write(gzip.compress(content, 1) if packed and name.endswith(".gz") else content)
                fs.move(passing, target)
            yield batch.select(["file"])

    return run


#: Names of files that a task makes and writes.
TOGETHER = 256


def parts_of(names: DataFrame) -> int:
    """Among how many tasks names are dealt of which each is a file."""
    return names.count() // TOGETHER + 1


def dealt(names: DataFrame, key: str) -> DataFrame:
    """``names``, of which each will be a file: few bytes, which Spark would leave to one task, dealt by number."""
    return names.repartition(parts_of(names), key)


def put_files(files: DataFrame, folder: str) -> int:
    """Writes ``files`` (file, content) to a new folder, from the executors and without a list, and those whose names
    end in .gz compressed; how many."""
    fs, base = store_of(folder)
    fs.create_dir(f"{base}/{LISTS}", recursive=True)
    return files.select("file", "content").mapInArrow(_write(folder, packed=True), "file string").count()


def _remove(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store_of(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                if fs.get_file_info(f"{base}/{name}").is_file:
                    fs.delete_file(f"{base}/{name}")
            yield batch.select(["file"])

    return run


def publish(files: DataFrame, folder: str, inputs: Iterable[str] = (), only: str | None = None) -> dict[str, int]:
    """Makes the folder hold ``files`` (page_id, file, content) and nothing else of earlier builds.
    ``only``: a build of that page, and of the files of the whole; the files of other pages stay.
    Returns how many files were written, removed and are there."""
    spark = files.sparkSession
    if clash := [x for x in inputs if _overlaps(folder, x)]:
        raise Refused(f"the folder and an input lie within one another: {clash[0]}")
    fs, base = store_of(folder)
    if _through_link(fs, base):
        raise Refused(f"the folder is a link: {folder}")
    before = settle(published(spark, folder), "publish-before")
    if before.isEmpty() and not fs.get_file_info(f"{base}/{LISTS}/{POINTER}").is_file and _has_files(fs, base):
        raise Refused(f"the folder has files, but no list of them: {folder}")
    made = settle(files.select("page_id", "file", "content", F.sha2("content", 256).alias("sha256")), "publish-files")
    now = made.select("page_id", "file", "sha256")
    if only is not None:
        now = now.unionByName(before.where(F.col("page_id").isNotNull() & (F.col("page_id") != only)))
    if wrong := now.where(~F.coalesce(F.col("file").rlike(NAME), F.lit(False))).select("file").take(3):
        raise Refused(f"names that a report can't have: {[r['file'] for r in wrong]}")
    if twice := now.groupBy("file").count().where("count > 1").take(3):
        raise Refused(f"files that are there twice: {[r['file'] for r in twice]}")
    changed = made.join(before.select("file", "sha256"), ["file", "sha256"], "left_anti")
    owned = before.select("file", F.lit(True).alias("owned"))
    asked = changed.select("file").join(owned, "file", "left").select("file", F.coalesce("owned", F.lit(False)).alias("owned"))
    if foreign := asked.mapInArrow(_foreign(folder), "file string").take(3):
        raise Refused(f"files that no build made, or links: {[r['file'] for r in foreign]}")
    fs.create_dir(f"{base}/{LISTS}", recursive=True)
    written = changed.select("file", "content").mapInArrow(_write(folder), "file string").count()
    version = uuid.uuid4().hex
    now.write.parquet(f"{uri_of(fs, base)}/{LISTS}/{version}")
    passing = f"{base}/{LISTS}/{uuid.uuid4().hex}"
    with fs.open_output_stream(passing, compression=None) as f:
        f.write(json.dumps({"version": version}).encode())
    fs.move(passing, f"{base}/{LISTS}/{POINTER}")
    stale = before.select("file").join(now.select("file"), "file", "left_anti")
    removed = stale.mapInArrow(_remove(folder), "file string").count()
    for info in fs.get_file_info(_children(f"{base}/{LISTS}")):
        if info.type.name == "Directory" and info.base_name != version:
            fs.delete_dir(info.path)
    return {"written": written, "removed": removed, "files": now.count()}


def _children(path: str):
    from pyarrow import fs

    return fs.FileSelector(path, allow_not_found=True)


def _has_files(fs, base: str) -> bool:
    """Whether a folder has anything but files that only tell a version control what to ignore or keep."""
    return any(not info.base_name.startswith(".git") for info in fs.get_file_info(_children(base)))
