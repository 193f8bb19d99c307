import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box
from folioscope.sources import images


def exif(orientation, order="<"):
    return (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(f"{order}IHHHIHHI", 8, 1, images.ORIENTATION, 3, 1, orientation, 0, 0)


def seen(stored, orientation):
    """The turned image, pixel by pixel."""
    h, w = stored.shape[:2]
    place = {1: lambda x, y: (x, y), 2: lambda x, y: (w - 1 - x, y), 3: lambda x, y: (w - 1 - x, h - 1 - y), 4: lambda x, y: (x, h - 1 - y), 5: lambda x, y: (y, x), 6: lambda x, y: (y, h - 1 - x), 7: lambda x, y: (w - 1 - y, h - 1 - x), 8: lambda x, y: (w - 1 - y, x)}[orientation]
    tw, th = (w, h) if orientation < 5 else (h, w)
    return np.array([[stored[place(x, y)[::-1]] for x in range(tw)] for y in range(th)])


def filtered(pixels, kinds):
    """PNG lines of [row, pixel, channel] with the given filters in turn."""
    lines, step = pixels.reshape(len(pixels), -1).astype(int), pixels.shape[2]
    out, above = [], np.zeros(lines.shape[1], dtype=int)
    for y, line in enumerate(lines):
        kind = kinds[y % len(kinds)]
        left, corner = (np.concatenate([np.zeros(step, dtype=int), v[:-step]]) for v in (line, above))
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        out.append(bytes([kind]) + ((line - (0, left, above, (left + above) // 2, near)[kind]) % 256).astype(np.uint8).tobytes())
        above = line
    return b"".join(out)


def tiff(pixels, orientation=1, rows=3, compression=1, predictor=1, order=">"):
    """A TIFF whose directory is at its end."""
    h, w, c = pixels.shape
    body, offsets, counts = b"", [], []
    for y in range(0, h, rows):
        part = pixels[y : y + rows].astype(int)
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1) % 256
        data = part.astype(np.uint8).tobytes()
        data = zlib.compress(data) if compression != 1 else data
        offsets.append(8 + len(body))
        counts.append(len(data))
        body += data
    tags = {256: (4, [w]), 257: (3, [h]), 258: (3, [8] * c), 259: (3, [compression]), 262: (3, [1 if c == 1 else 2]), 273: (4, offsets), 274: (3, [orientation]), 277: (3, [c]), 278: (3, [rows]), 279: (4, counts), 317: (3, [predictor])}
    at, far, entries = 8 + len(body), b"", b""
    end = at + 2 + 12 * len(tags) + 4
    for tag, (form, values) in tags.items():
        code = {3: "H", 4: "I"}[form]
        data = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(data) > 4:
            data, far = struct.pack(f"{order}I", end + len(far)), far + data
        entries += struct.pack(f"{order}HHI", tag, form, len(values)) + data.ljust(4, b"\0")
    return (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(f"{order}I", at) + body + struct.pack(f"{order}H", len(tags)) + entries + bytes(4) + far


@pytest.mark.parametrize("orientation", range(1, 9))
def test_headers_and_crops_of_turned_images(orientation):
    rng = np.random.default_rng(orientation)
    boxes = [(0, 0, 3, 2), (2, 4, 7, 9), (5, 1, 6, 8), (0, 0, 11, 11)]
    for channels, color in ((1, 0), (3, 2), (4, 6)):
        stored = rng.integers(0, 256, (13, 11, channels), dtype=np.uint8)
        kinds = [images.png_of(11, 13, color, filtered(stored, (0, 1, 2, 3, 4)), (b"gAMA", b"1234"), (b"eXIf", exif(orientation))), images.png_bytes(stored, (b"eXIf", exif(orientation, ">")))]
        kinds += [tiff(stored, orientation), tiff(stored, orientation, 13, 8, 2, "<"), tiff(stored, orientation, 1, 32946)]
        whole = seen(stored, orientation)
        for content in kinds:
            info = images.header(images.of_bytes(content))
            assert (info["width"], info["height"], info["orientation"]) == (11, 13, orientation)
            for box, part in zip(boxes, images.cut_out(images.of_bytes(content), boxes), strict=True):
                assert (part == whole[box[1] : box[3], box[0] : box[2]]).all()
                again = images.cut_out(images.of_bytes(images.png_bytes(part)), [(0, 0, *part.shape[1::-1])])[0]
                assert (again == part).all()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", 8 + len(exif(orientation))) + b"Exif\0\0" + exif(orientation) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 30, 40, 3) + b"x" * 12
    assert images.header(images.of_bytes(jpeg)) == {"width": 40, "height": 30, "mode": "RGB", "format": "JPEG", "orientation": orientation}


def test_depths_and_palettes():
    rng = np.random.default_rng(0)
    for depth in (1, 2, 4):
        values = rng.integers(0, 1 << depth, (5, 13))
        packed = np.zeros((5, -(-13 * depth // 8)), dtype=np.uint8)
        for x in range(13):
            packed[:, x * depth // 8] |= (values[:, x] << (8 - depth - x * depth % 8)).astype(np.uint8)
        grey = images.png_of(13, 5, 0, filtered(packed[:, :, None], (0, 1, 4)), depth=depth)
        assert (images.cut_out(images.of_bytes(grey), [(1, 1, 12, 5)])[0][:, :, 0] == values[1:, 1:12] * (255 // ((1 << depth) - 1))).all()
        colors = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        indexed = images.png_of(13, 5, 3, filtered(packed[:, :, None], (2, 3)), (b"PLTE", colors.tobytes()), depth=depth)
        assert (images.cut_out(images.of_bytes(indexed), [(0, 0, 13, 5)])[0] == colors[values]).all()
    deep = rng.integers(0, 256, (4, 6, 6), dtype=np.uint8)
    assert (images.cut_out(images.of_bytes(images.png_of(6, 4, 2, filtered(deep, (4,)), depth=16)), [(0, 0, 6, 4)])[0] == deep[:, :, ::2]).all()
    both = rng.integers(0, 256, (4, 6, 2), dtype=np.uint8)
    part = images.cut_out(images.of_bytes(images.png_of(6, 4, 4, filtered(both, (1,)))), [(0, 0, 6, 4)])[0]
    assert (images.cut_out(images.of_bytes(images.png_bytes(part)), [(0, 0, 6, 4)])[0] == both[:, :, :1]).all()


def test_reads_are_few_and_short():
    stored = np.zeros((4000, 300, 1), dtype=np.uint8)
    content, asked = tiff(stored, 1, 10), []

    def read(at, n):
        asked.append(n)
        return content[at : at + n]

    images.header(read)
    assert sum(asked) < 2000
    asked.clear()
    images.cut_out(read, [(10, 3005, 200, 3010)])
    assert sum(asked) < 20_000  # of 1.2 million bytes


def test_crops_of_a_folder(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    stored = np.random.default_rng(1).integers(0, 256, (50, 40, 3), dtype=np.uint8)
    (folder / "p 1.png").write_bytes(images.png_bytes(stored, (b"eXIf", exif(6))))
    (folder / "p 1.tif").write_bytes(tiff(stored, 8))
    (folder / "q.jpg").write_bytes(b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 30, 40, 3) + b"x" * 12)
    (folder / "r.png").write_bytes(b"no image")
    found = images.read_images(spark, str(folder))
    assert sorted((r["page_id"], r["ord"], r["format"], r["orientation"]) for r in found.where("format is not null").collect()) == [("p 1", 0, "TIFF", 8), ("p 1", 1, "PNG", 6), ("q", 0, "JPEG", 1)]
    first = found.where("ord = 0")
    boxes = spark.createDataFrame([("p 1", 100.0, 100.0, 300.0, 300.0), ("p 1", 100.0, 100.0, 300.0, 300.0), ("p 1", 900.0, 900.0, 1000.0, 1000.0), ("q", 0.0, 0.0, 500.0, 500.0), *((("p 1", float(i), 0.0, float(i + 200), 1000.0)) for i in range(0, 800, 40))], "page_id string, x1 double, y1 double, x2 double, y2 double")
    places = boxes.join(first, "page_id").select("page_id", *images.crop_rectangle(Box.of(), F.col("width"), F.col("height"), F.col("orientation"), 3).columns())
    crops = {(r["page_id"], r["x1"], r["y1"], r["x2"], r["y2"]): r for r in images.crop_images(first, places).collect()}
    # 40 by 50 stored, 50 by 40 as seen; a box is scaled by the stored size and held within what is seen
    assert len(crops) == 23 and ("p 1", 1, 2, 15, 18) in crops and ("p 1", 33, 37, 43, 40) in crops
    for (page, x1, y1, x2, y2), r in crops.items():
        if page == "q":
            assert r["content"] is None and "Unsupported" in r["message"]
        else:
            assert (images.cut_out(images.of_bytes(bytes(r["content"])), [(0, 0, x2 - x1, y2 - y1)])[0] == seen(stored, 8)[y1:y2, x1:x2]).all()
