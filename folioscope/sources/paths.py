"""Where files lie, in one spelling for all readers.

Spark names a file in its metadata by a URL with escaped characters, and a folder by whatever was asked
for: with or without scheme, relative, with a slash at its end. Here both become plain decoded paths
without scheme and authority, so they can be compared and joined whatever the store and the spelling.
"""

from __future__ import annotations

import os
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def file_path() -> Column:
    """The decoded path of a row's file, of any file source."""
    return F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), _PLACE, ""), F.lit("+"), F.lit("%2B")))


def root_path(spark: SparkSession, root: str) -> str:
    """A folder's path as ``file_path`` begins with it, without a slash at its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    return whole.toUri().getPath().rstrip("/")


def relative(path: Column, root: str) -> Column:
    """What follows a folder (see ``root_path``) in a decoded path; null outside of it."""
    return F.when(F.startswith(path, F.lit(f"{root}/")), F.substring(path, len(root) + 2, 1 << 30))


def placed(files: DataFrame, root: str) -> DataFrame:
    """``files`` with ``path``, below ``root`` where they are, and ``outside`` for those that aren't (their path is whole)."""
    base = root_path(files.sparkSession, root)
    rows = files.withColumn("path", file_path())
    return rows.withColumns({"path": F.coalesce(relative(F.col("path"), base), F.col("path")), "outside": relative(F.col("path"), base).isNull()})


def either(end: str) -> str:
    """The pattern of files of a kind, plain or compressed."""
    return f"*.{{{end},{end}.gz}}"


def unpacked(files: DataFrame) -> DataFrame:
    """``files`` with the path that a compressed one has as a plain one."""
    return files.withColumn("path", F.regexp_replace("path", r"\.gz$", ""))


def store_of(folder: str):
    """A pyarrow file system and a path on it, for a folder or file named as Spark takes it."""
    from pyarrow import fs

    scheme = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?", folder)
    if not scheme:
        return fs.LocalFileSystem(), os.path.abspath(folder)
    rest = folder[scheme.end() :]
    if scheme[1] == "file":
        return fs.LocalFileSystem(), rest.rstrip("/") or "/"
    kind = {"s3a": "s3", "s3n": "s3"}.get(scheme[1], scheme[1])
    found, path = fs.FileSystem.from_uri(f"{kind}://{scheme[2] or ''}{quote(rest)}")
    return found, path.rstrip("/")


def uri_of(fs, base: str) -> str:
    """A path on a pyarrow file system as Spark takes it."""
    return {"local": "file", "hdfs": "hdfs", "s3": "s3a", "gcs": "gs"}.get(fs.type_name, fs.type_name) + "://" + base
