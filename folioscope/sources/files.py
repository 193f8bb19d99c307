"""Single files written by tasks: whole or not at all, and where asked for, once."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.sources.paths import store_of


def safe_name(name: str) -> str:
    """A name as a part of a path: no slash in it, and none of the first characters that readers pass over."""
    plain = name.replace("%", "%25").replace("/", "%2F")
    return f"%{ord(plain[0]):02X}{plain[1:]}" if plain[:1] in (".", "_") else plain


def safe_column(name: Column) -> Column:
    """``safe_name`` of a column."""
    plain = F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return F.when(plain.startswith("."), F.concat(F.lit("%2E"), F.substring(plain, 2, 1 << 20))).when(plain.startswith("_"), F.concat(F.lit("%5F"), F.substring(plain, 2, 1 << 20))).otherwise(plain)


def content_of(store, path: str) -> bytes | None:
    """A file's bytes; null if there is none."""
    if not store.get_file_info(path).is_file:
        return None
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def _pass_in(store, path: str, data: bytes) -> str:
    folder = path.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    passing = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(passing, compression=None) as f:
        f.write(data)
    return passing


def save_whole(store, path: str, data: bytes) -> bool:
    """Writes a file under a passing name and gives it its own; whether its bytes are new."""
    if content_of(store, path) == data:
        return False
    store.move(_pass_in(store, path, data), path)
    return True


def create_once(store, path: str, data: bytes) -> bool:
    """Writes a file unless it is there; whether it was written. On a local disk no two writers can both
    succeed; in other stores the later of two at the same moment wins."""
    if store.get_file_info(path).type.name != "NotFound":
        return False
    passing = _pass_in(store, path, data)
    if store.type_name != "local":
        store.move(passing, path)
        return True
    try:
        os.link(passing, path)
        return True
    except FileExistsError:
        return False
    finally:
        store.delete_file(passing)


def write_each(files: DataFrame, folder: str, write: Callable) -> int:
    """Writes ``files`` (file, content) below a folder, by ``save_whole`` or ``create_once``; how many were new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        for batch in batches:
            new = [write(store, f"{base}/{name}", content) for name, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.bool_())], names=["new"])

    return files.select("file", "content").mapInArrow(run, "new boolean").where("new").count()
