"""Page images: listing, what their headers tell, and crops.

Nothing decodes a whole image to learn its size or to cut out a part. Headers are read by a few short
reads wherever they stand in the file. A crop's rows are inflated or read in order, unfiltered, and
kept from the crop's first row to its last; reading ends there. All crops of an image are cut in one
pass, one for each distinct rectangle.

Images are turned as their orientation says (EXIF's eight cases): a crop's rectangle is one of the turned
image, while the box it comes from is scaled by the stored size, since that is what headers and
recorded results have. PNG without interlacing and TIFF with plain or deflated strips can be cut; of
JPEG only the header is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, crop_box, has_extent
from folioscope.functions.ids import IMAGE_SUFFIXES, file_name, stem, suffix
from folioscope.sources.paths import store_of

#: Bytes at a place of a file, fewer at its end.
Read = Callable[[int, int], bytes]

# Fixed values of the formats: PNG's signature, modes by bit depth and colour type, and its channels;
# EXIF's orientation tag; TIFF's tags and the sizes of its number types.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_MODES = {(1, 0): "1", (16, 0): "I;16", 0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ORIENTATION = 274
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_COMPRESSION, TIFF_PHOTOMETRIC, TIFF_OFFSETS, TIFF_CHANNELS, TIFF_STRIP_ROWS, TIFF_COUNTS, TIFF_PLANES, TIFF_PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TIFF_NUMBERS = {3: ("H", 2), 4: ("I", 4)}
TIFF_PLAIN, TIFF_DEFLATED = 1, (8, 32946)

#: Bytes taken from a file at once; crops that are cut in one pass.
PIECE, TOGETHER = 1 << 16, 16
PADDING = 30


class Unsupported(ValueError):
    """An image of a kind that can't be cut here."""


def of_bytes(content: bytes | None) -> Read:
    return lambda at, n: (content or b"")[at : at + n]


# Headers ------------------------------------------------------------------------------------------


def _tags(read: Read, base: int = 0) -> tuple[str, dict[int, tuple[int, int, int]]]:
    """Byte order, and for each tag of the first directory its type, count, and where its value stands."""
    start = read(base, 8)
    order = {b"II*\x00": "<", b"MM\x00*": ">"}.get(start[:4])
    if not order:
        raise struct.error("no TIFF")
    at = base + struct.unpack(f"{order}I", start[4:])[0]
    (n,) = struct.unpack(f"{order}H", read(at, 2))
    entries = read(at + 2, 12 * n)
    found = {}
    for i in range(n):
        tag, form, count = struct.unpack_from(f"{order}HHI", entries, 12 * i)
        found.setdefault(tag, (form, count, at + 10 + 12 * i))
    return order, found


def _numbers(read: Read, order: str, entry: tuple[int, int, int] | None, base: int = 0) -> list[int]:
    form, count, at = entry or (0, 0, 0)
    if form not in TIFF_NUMBERS:
        return []
    code, size = TIFF_NUMBERS[form]
    if count * size > 4:
        at = base + struct.unpack(f"{order}I", read(at, 4))[0]
    return list(struct.unpack(f"{order}{count}{code}", read(at, count * size)))


def _turn(read: Read, base: int) -> int:
    """The orientation in EXIF data at a place; 1 where it isn't one of the eight."""
    try:
        order, tags = _tags(read, base)
        found = _numbers(read, order, tags.get(ORIENTATION), base)
    except struct.error:
        return 1
    return found[0] if len(found) == 1 and 1 <= found[0] <= 8 else 1


def _png(read: Read) -> tuple | None:
    start = read(0, 26)
    if start[:8] != PNG_SIGNATURE:
        return None
    width, height, depth, color = struct.unpack(">IIBB", start[16:])
    at, turn = 33, 1
    while len(head := read(at, 8)) == 8 and head[4:] not in (b"IDAT", b"IEND"):
        if head[4:] == b"eXIf":
            turn = _turn(read, at + 8)
        at += 12 + int.from_bytes(head[:4], "big")
    return width, height, PNG_MODES.get((depth, color), PNG_MODES.get(color)), "PNG", turn


def _jpeg(read: Read) -> tuple | None:
    if read(0, 2) != b"\xff\xd8":
        return None
    at, turn = 2, 1
    while len(head := read(at, 10)) >= 4 and head[0] == 0xFF:
        marker = head[1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", head[5:10])
            return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts), "JPEG", turn
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            if marker == 0xE1 and read(at + 4, 6) == b"Exif\x00\x00":
                turn = _turn(read, at + 10)
            at += 2 + int.from_bytes(head[2:4], "big")
    return None


def _tiff(read: Read) -> tuple | None:
    order, tags = _tags(read)
    size = [_numbers(read, order, tags.get(t)) for t in (TIFF_WIDTH, TIFF_HEIGHT)]
    if any(len(x) != 1 for x in size):
        return None
    channels = (_numbers(read, order, tags.get(TIFF_CHANNELS)) or [1])[0]
    return size[0][0], size[1][0], {1: "L", 3: "RGB", 4: "RGBA"}.get(channels), "TIFF", _turn(read, 0)


HEADER = ("width", "height", "mode", "format", "orientation")


def header(read: Read) -> dict | None:
    """Size, mode and format as stored, and the orientation; null for other files."""
    for kind in (_png, _jpeg, _tiff):
        try:
            found = kind(read)
        except struct.error:
            found = None
        if found:
            return dict(zip(HEADER, found, strict=True))
    return None


_INFO_DDL = "width int, height int, mode string, format string, orientation int"
_INFO = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("mode", pa.string()), ("format", pa.string()), ("orientation", pa.int32())])


def _infos(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in contents:
        yield pa.array([header(of_bytes(c.as_py())) for c in batch], type=_INFO)


def image_info(content: Column | str) -> Column:
    """Size, mode, format and orientation of PNG, JPEG and TIFF images, size and mode as stored."""
    return F.arrow_udf(_infos, _INFO_DDL)(content)


def turned(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """The size of the turned image."""
    swapped = F.coalesce(orientation, F.lit(1)) >= 5
    return F.when(swapped, height).otherwise(width), F.when(swapped, width).otherwise(height)


def crop_rectangle(a: Box, width: Column, height: Column, orientation: Column, padding: Column | float = PADDING) -> Box:
    """The pixels of the turned image that a crop of a normalised box takes. ``width`` and ``height``: as stored."""
    return crop_box(a, width, height, padding, within=turned(width, height, orientation))


def is_image(path: Column) -> Column:
    return suffix(path).isin(*IMAGE_SUFFIXES)


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, page_id, modified and length of the images directly in ``folder``."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(is_image(F.col("path"))).select("path", stem(F.col("path")).alias("page_id"), F.col("modificationTime").alias("modified"), "length")


def _opened(path: str):
    store, place = store_of(path)
    return store.open_input_file(place)


def _reader(f) -> Read:
    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    return read


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with _opened(path) as f:
                found.append(header(_reader(f)) or {})
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("page_id"), *(pa.array([x.get(k) for x in found], _INFO.field(k).type) for k in HEADER)], names=["path", "page_id", *HEADER])


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """The listing with sizes and orientation, and ``ord``: a page's TIFF images first, then by name.

    Files are opened by their paths on the executors, for a few reads each."""
    rows = list_images(spark, folder).select("path", "page_id").mapInArrow(_headers, f"path string, page_id string, {_INFO_DDL}")
    order = Window.partitionBy("page_id").orderBy(~suffix(F.col("path")).isin("tif", "tiff"), file_name(F.col("path")))
    return rows.withColumn("ord", F.row_number().over(order) - 1)


# Rows ---------------------------------------------------------------------------------------------


def _nearest(a: int, b: int, c: int) -> int:
    """Which of left, above and corner is nearest to left + above - corner."""
    to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG row without its filter; ``step``: bytes of a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        whole = np.zeros(-(-len(line) // step) * step, dtype=np.uint8)
        whole[: len(line)] = line
        return np.add.accumulate(whole.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise Unsupported(f"filter {kind}")
    out, up = line.tolist(), above.tolist()
    for i, b in enumerate(up):  # each byte needs the one before it
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        out[i] = (out[i] + ((a + b) >> 1 if kind == 3 else _nearest(a, b, c))) & 255
    return np.array(out, dtype=np.uint8)


def _png_rows(read: Read, last: int) -> Iterator[np.ndarray]:
    """Rows of a PNG as [pixel, channel], up to ``last``; inflated as they are needed."""
    width, _, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", read(16, 13))
    if interlaced or depth * PNG_CHANNELS.get(color, 0) == 0 or (depth == 16 and color == 0):
        raise Unsupported("interlaced, or of another depth")
    bits = depth * PNG_CHANNELS[color]
    step, length = max(1, bits // 8), -(-width * bits // 8)
    palette, at, waiting, inflate, above, n = None, 33, bytearray(), zlib.decompressobj(), np.zeros(length, dtype=np.uint8), 0
    while n < last:
        head = read(at, 8)
        if len(head) < 8 or head[4:] == b"IEND":
            raise Unsupported("the image ends before its last row")
        size = int.from_bytes(head[:4], "big")
        if head[4:] == b"PLTE":
            palette = np.frombuffer(read(at + 8, size), dtype=np.uint8).reshape(-1, 3)
        elif head[4:] == b"IDAT":
            for start in range(0, size, PIECE):
                waiting += inflate.decompress(read(at + 8 + start, min(PIECE, size - start)))
                done = 0
                while len(waiting) - done > length and n < last:
                    line = np.frombuffer(bytes(waiting[done : done + length + 1]), dtype=np.uint8)
                    above, done, n = unfiltered(int(line[0]), line[1:], above, step), done + length + 1, n + 1
                    yield _pixels(above, width, depth, color, palette)
                del waiting[:done]
                if n == last:
                    return
        at += 12 + size


def _pixels(line: np.ndarray, width: int, depth: int, color: int, palette: np.ndarray | None) -> np.ndarray:
    """A row's bytes as [pixel, channel] in eight bits."""
    channels = PNG_CHANNELS[color]
    if depth == 16:
        line = line[::2]
    elif depth < 8:
        shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
        line = ((line[:, None] >> shifts) & ((1 << depth) - 1)).ravel()[:width]
        if color == 0:
            line = line * np.uint8(255 // ((1 << depth) - 1))
    pixels = line.reshape(width, channels)
    return palette[pixels[:, 0]] if color == 3 and palette is not None else pixels


def _tiff_rows(read: Read, first: int, last: int) -> Iterator[np.ndarray]:
    """Rows of a TIFF from ``first``'s strip on; strips above it aren't read. Rows that were passed over are null."""
    order, tags = _tags(read)
    get = lambda tag, default: (_numbers(read, order, tags.get(tag)) or [default])
    width, height, channels = get(TIFF_WIDTH, 0)[0], get(TIFF_HEIGHT, 0)[0], get(TIFF_CHANNELS, 1)[0]
    compression, predictor = get(TIFF_COMPRESSION, 1)[0], get(TIFF_PREDICTOR, 1)[0]
    offsets, counts, rows = get(TIFF_OFFSETS, 0), get(TIFF_COUNTS, 0), min(get(TIFF_STRIP_ROWS, height)[0], height)
    if set(get(TIFF_BITS, 1)) != {8} or get(TIFF_PLANES, 1)[0] != 1 or get(TIFF_PHOTOMETRIC, 1)[0] not in (1, 2) or compression not in (TIFF_PLAIN, *TIFF_DEFLATED) or predictor not in (1, 2) or channels not in (1, 3, 4) or len(offsets) * rows < height:
        raise Unsupported("a TIFF of other than plain or deflated strips of eight bits")
    length = width * channels
    for strip, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        start, stop = strip * rows, min(height, (strip + 1) * rows)
        if start >= last:
            return
        if stop <= first:
            yield from [None] * (stop - start)
            continue
        if compression == TIFF_PLAIN:  # no more than the rows wanted
            skip = max(0, first - start)
            yield from [None] * skip
            data, start = read(at + skip * length, (min(stop, last) - start - skip) * length), start + skip
        else:
            data = zlib.decompress(read(at, size))
        for k in range(min(stop, last) - start):
            line = np.frombuffer(data[k * length : (k + 1) * length], dtype=np.uint8)
            if len(line) < length:
                raise Unsupported("the image ends before its last row")
            pixels = line.reshape(width, channels)
            yield np.add.accumulate(pixels, axis=0, dtype=np.uint8) if predictor == 2 else pixels


# Crops --------------------------------------------------------------------------------------------


def stored_rectangle(box: tuple[int, int, int, int], width: int, height: int, orientation: int) -> tuple[int, int, int, int]:
    """Where a rectangle of the turned image lies in the stored one."""
    x1, y1, x2, y2 = box
    if orientation >= 5:
        x1, y1, x2, y2 = y1, x1, y2, x2
    if orientation in (2, 3, 7, 8):
        x1, x2 = width - x2, width - x1
    if orientation in (3, 4, 6, 7):
        y1, y2 = height - y2, height - y1
    return x1, y1, x2, y2


def turn(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """A part of the stored image as it is seen."""
    if orientation in (2, 3, 7, 8):
        pixels = pixels[:, ::-1]
    if orientation in (3, 4, 6, 7):
        pixels = pixels[::-1]
    return pixels.transpose(1, 0, 2) if orientation >= 5 else pixels


def cut_out(read: Read, boxes: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """The parts of an image at rectangles of its turned form, as [row, pixel, channel]."""
    info = header(read)
    if info is None or info["format"] == "JPEG":
        raise Unsupported("no image that can be cut")
    places = [stored_rectangle(b, info["width"], info["height"], info["orientation"]) for b in boxes]
    first, last = min(p[1] for p in places), max(p[3] for p in places)
    rows = _png_rows(read, last) if info["format"] == "PNG" else _tiff_rows(read, first, last)
    parts: list[list[np.ndarray]] = [[] for _ in boxes]
    for y, row in enumerate(rows):
        for part, (x1, y1, x2, y2) in zip(parts, places, strict=True):
            if y1 <= y < y2:
                part.append(row[x1:x2])
    return [turn(np.stack(p), info["orientation"]) for p in parts]


def png_bytes(pixels: np.ndarray, *extra: tuple[bytes, bytes]) -> bytes:
    """A PNG of [row, pixel, channel]; of grey with transparency the grey is kept, as colours. ``extra``: other chunks."""
    if pixels.shape[2] == 2:
        pixels = np.repeat(pixels[:, :, :1], 3, axis=2)
    height, width, channels = pixels.shape
    lines = np.zeros((height, 1 + width * channels), dtype=np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    return png_of(width, height, {1: 0, 3: 2, 4: 6}[channels], lines.tobytes(), *extra)


def png_of(width: int, height: int, color: int, lines: bytes, *extra: tuple[bytes, bytes], depth: int = 8) -> bytes:
    """A PNG of filtered lines."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"".join([PNG_SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)), *(chunk(*x) for x in extra), chunk(b"IDAT", zlib.compress(lines)), chunk(b"IEND", b"")])


CROP = "page_id string, path string, x1 long, y1 long, x2 long, y2 long, content binary, message string"
_CROP = pa.schema([("page_id", pa.string()), ("path", pa.string()), *((c, pa.int64()) for c in ("x1", "y1", "x2", "y2")), ("content", pa.binary()), ("message", pa.string())])


def _cut_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            boxes, made, message = [tuple(b[c] for c in ("x1", "y1", "x2", "y2")) for b in row["boxes"]], [], None
            try:
                with _opened(row["path"]) as f:
                    made = [png_bytes(p) for p in cut_out(_reader(f), boxes)]
            except (Unsupported, OSError, struct.error, zlib.error) as e:  # an issue of this image, not the job's
                message = f"{type(e).__name__}: {e}"
            rows = [dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) | {"page_id": row["page_id"], "path": row["path"], "content": made[i] if made else None, "message": message} for i, b in enumerate(boxes)]
            yield pa.RecordBatch.from_pylist(rows, schema=_CROP)


def crop_images(images: DataFrame, rectangles: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, path, x1..y2, content (a PNG) and message (why there is none) for each distinct rectangle of
    each image. ``images``: page_id, path; ``rectangles``: page_id and x1..y2 in pixels of the turned image;
    ``parts``: among how many tasks images are dealt, since Spark would leave so few bytes to one."""
    distinct = rectangles.where(has_extent(Box.of())).select("page_id", *(F.col(c).cast("long") for c in Box._fields)).distinct()
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "y2", "x1", "x2"))
    grouped = distinct.withColumn("part", F.floor((place - 1) / TOGETHER)).groupBy("page_id", "part").agg(F.sort_array(F.collect_list(F.struct(*Box._fields))).alias("boxes"))
    found = grouped.join(images.select("page_id", "path"), "page_id").select("page_id", "path", "boxes")
    return (found if parts is None else found.repartition(parts, "page_id")).mapInArrow(_cut_images, CROP)
