"""Queries over image files: made from the suppliers of the bench tables, written to a folder, and read
back by their headers and in crops. Suppliers differ in size, colour, format and orientation."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box
from folioscope.sources import images, publish
from folioscope.sources.store import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FOLDERS: dict[tuple[str, str], str] = {}

_SIZED = "WITH im AS (SELECT CAST(s_suppkey AS BIGINT) AS s, 20 + s_suppkey % 7 AS w, 30 + s_suppkey % 5 AS h, s_suppkey % 8 + 1 AS o, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 3 END AS ch, s_suppkey % 3 AS f FROM supplier)"
#: Boxes that are cut from each image, by k, and pixels around them.
_BOXES = ("(s * 17 + k * 200) % 600", "(s * 29 + k * 150) % 500", "(s * 17 + k * 200) % 600 + 150 + s % 4 * 60", "(s * 29 + k * 150) % 500 + 200 + k * 50")
_AROUND = 2


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _exif(orientation: int) -> bytes:
    return b"MM\x00*" + struct.pack(">IHHHIHHI", 8, 1, images.ORIENTATION, 3, 1, orientation, 0, 0)


def _filtered(pixels: np.ndarray) -> bytes:
    """PNG lines, the filters in turn."""
    lines, step, out = pixels.reshape(len(pixels), -1).astype(int), pixels.shape[2], []
    above = np.zeros(lines.shape[1], dtype=int)
    for y, line in enumerate(lines):
        left, corner = (np.concatenate([np.zeros(step, dtype=int), v[:-step]]) for v in (line, above))
        guess = left + above - corner
        gaps = np.stack([abs(guess - v) for v in (left, above, corner)])
        near = np.choose(gaps.argmin(axis=0), (left, above, corner))  # the first of equals
        out.append(bytes([y % 5]) + ((line - (0, left, above, (left + above) // 2, near)[y % 5]) % 256).astype(np.uint8).tobytes())
        above = line
    return b"".join(out)


def _tiff(pixels: np.ndarray, orientation: int) -> bytes:
    """A TIFF of strips of four rows, its directory at the end."""
    h, w, c = pixels.shape
    parts = [pixels[y : y + 4].tobytes() for y in range(0, h, 4)]
    counts = [len(p) for p in parts]
    offsets = [8 + sum(counts[:i]) for i in range(len(parts))]
    tags = {images.TIFF_WIDTH: [w], images.TIFF_HEIGHT: [h], images.TIFF_BITS: [8], images.TIFF_COMPRESSION: [images.TIFF_PLAIN], images.TIFF_PHOTOMETRIC: [1 if c == 1 else 2], images.TIFF_OFFSETS: offsets, images.ORIENTATION: [orientation], images.TIFF_CHANNELS: [c], images.TIFF_STRIP_ROWS: [4], images.TIFF_COUNTS: counts}
    at, far, entries = 8 + sum(counts), b"", b""
    end = at + 2 + 12 * len(tags) + 4
    for tag, values in tags.items():
        data = struct.pack(f"<{len(values)}I", *values)
        place = data if len(data) == 4 else struct.pack("<I", end + len(far))
        far += b"" if len(data) == 4 else data
        entries += struct.pack("<HHI", tag, 4, len(values)) + place
    return b"II*\x00" + struct.pack("<I", at) + b"".join(parts) + struct.pack("<H", len(tags)) + entries + bytes(4) + far


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for s in batch.column("s").to_pylist():
            w, h, turn, channels = 20 + s % 7, 30 + s % 5, s % 8 + 1, 1 if s % 2 == 0 else 3
            y, x, c = np.mgrid[0:h, 0:w, 0:channels]
            pixels = ((x * 7 + y * 13 + s * 3 + c * 29) % 251).astype(np.uint8)
            if s % 3 == 0:
                content = images.png_of(w, h, 0 if channels == 1 else 2, _filtered(pixels), (b"eXIf", _exif(turn)))
            elif s % 3 == 1:
                content = _tiff(pixels, turn)
            else:
                content = b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(_exif(turn))) + b"Exif\x00\x00" + _exif(turn) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", h, w, channels) + bytes(9)
            out.append({"file": f"images/i{s}.{('png', 'tif', 'jpg')[s % 3]}", "content": content})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("content", pa.binary())]))


def folder(spark: SparkSession, sf_dir: str) -> str:
    """The folder with the suppliers' images, below the folder that the cluster shares; a session writes it once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOLDERS:
        base = f"{shared_folder(spark)}/picture-files-{uuid.uuid4().hex}"
        suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s"))
        publish.put_files(publish.dealt(suppliers, "s").mapInArrow(_files, "file string, content binary"), base)
        _FOLDERS[key] = base
    return _FOLDERS[key]


@query(_SIZED + " SELECT 'i' || CAST(s AS VARCHAR) AS page_id, w AS width, h AS height, CASE WHEN o >= 5 THEN h ELSE w END AS turned_width, CASE WHEN o >= 5 THEN w ELSE h END AS turned_height, CASE ch WHEN 1 THEN 'L' ELSE 'RGB' END AS mode, CASE f WHEN 0 THEN 'PNG' WHEN 1 THEN 'TIFF' ELSE 'JPEG' END AS format, o AS orientation FROM im")
def image_headers(spark, sf_dir):
    """Size, mode and orientation by a few short reads of each file."""
    found = images.read_images(spark, f"{folder(spark, sf_dir)}/images")
    w, h = images.turned(F.col("width"), F.col("height"), F.col("orientation"))
    whole = lambda c: c.cast("long")
    return found.select("page_id", whole(F.col("width")).alias("width"), whole(F.col("height")).alias("height"), whole(w).alias("turned_width"), whole(h).alias("turned_height"), "mode", "format", whole(F.col("orientation")).alias("orientation"))


def _scaled(v: str, size: str, turned: str, by: int) -> str:
    inside = f"greatest(0, least(CAST(round_even({v}::DOUBLE / 1000.0::DOUBLE * {size}, 0) AS BIGINT), {turned}))"
    return f"greatest(0, least({inside} + {by}, {turned}))"


_CROPS = _SIZED + f""", bx AS (SELECT s, w, h, o, ch, CASE WHEN o >= 5 THEN h ELSE w END AS tw, CASE WHEN o >= 5 THEN w ELSE h END AS th, {', '.join(f'{v} AS {c}' for v, c in zip(_BOXES, ('a', 'b', 'c', 'd'), strict=True))} FROM im, (SELECT unnest([0, 1, 2]) AS k) WHERE f < 2),
 rect AS (SELECT DISTINCT s, w, h, o, ch, {_scaled('a', 'w', 'tw', -_AROUND)} AS x1, {_scaled('b', 'h', 'th', -_AROUND)} AS y1, {_scaled('c', 'w', 'tw', _AROUND)} AS x2, {_scaled('d', 'h', 'th', _AROUND)} AS y2 FROM bx),
 px AS (SELECT s, w, h, o, x1, y1, x2, y2, unnest(range(x1, x2)) AS x, ys.y, cs.c FROM rect, LATERAL (SELECT unnest(range(y1, y2)) AS y) ys, LATERAL (SELECT unnest(range(0, ch)) AS c) cs WHERE x2 > x1),
 st AS (SELECT *, CASE o WHEN 1 THEN x WHEN 2 THEN w - 1 - x WHEN 3 THEN w - 1 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN y WHEN 7 THEN w - 1 - y ELSE w - 1 - y END AS sx, CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN h - 1 - y WHEN 4 THEN h - 1 - y WHEN 5 THEN x WHEN 6 THEN h - 1 - x WHEN 7 THEN h - 1 - x ELSE x END AS sy FROM px)
 SELECT 'i' || CAST(s AS VARCHAR) AS page_id, x1, y1, x2, y2, CAST(sum((sx * 7 + sy * 13 + s * 3 + c * 29) % 251 * (1 + (x - x1) + 2 * (y - y1))) AS BIGINT) AS weighted FROM st GROUP BY ALL"""


def _weighted(crops: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in crops:
        out = []
        for content in batch.to_pylist():
            read = images.of_bytes(content)
            size = images.header(read)
            pixels = images.cut_out(read, [(0, 0, size["width"], size["height"])])[0].astype(np.int64)
            y, x = np.mgrid[0 : size["height"], 0 : size["width"]]
            out.append(int((pixels.sum(axis=2) * (1 + x + 2 * y)).sum()))
        yield pa.array(out, pa.int64())


@query(_CROPS)
def crop_sums(spark, sf_dir):
    """Crops of turned images, each with the sum of its pixels weighted by their places."""
    found = images.read_images(spark, f"{folder(spark, sf_dir)}/images").where("format <> 'JPEG'")
    boxes = found.withColumn("s", F.substring("page_id", 2, 20).cast("long")).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    a = Box(*(F.expr(v) for v in _BOXES))
    rectangles = boxes.select("page_id", *images.crop_rectangle(a, F.col("width"), F.col("height"), F.col("orientation"), _AROUND).columns())
    crops = images.crop_images(found, rectangles, publish.parts_of(spark.read.parquet(f"{sf_dir}/supplier.parquet")))
    return crops.select("page_id", *Box._fields, F.arrow_udf(_weighted, "long")("content").alias("weighted"))
