"""Identifiers, paths, model replies and data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import strip

#: Image types that a data URL may have, by suffix.
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
IMAGE_SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg")


def sha_id(value: Column, length: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def suffix(path: Column) -> Column:
    """The last suffix in lower case, without its dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def within_root(recorded: Column) -> Column:
    """A recorded input's path below the data root, or null if it leads out of it. A leading
    ../data/ is where notebooks stood."""
    inner = F.regexp_replace(recorded, r"^\.\./data/", "")
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & (p != "."))
    depth = F.transform(parts, lambda p: F.when(p == "..", -1).otherwise(1))
    lowest = F.aggregate(depth, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda a, d: F.struct((a["now"] + d).alias("now"), F.least(a["least"], a["now"] + d).alias("least")), lambda a: a["least"])
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.when(inner.startswith("/") | (lowest < 0) | (F.size(parts) == 0), F.lit(None)).otherwise(F.array_join(kept, "/"))


def region_of_crop(image: Column, page_id: Column) -> Column:
    """The region that an image under crops/<page>/ shows, for results that don't name it."""
    found = lambda i: F.regexp_extract(image, r"(?:^|/)crops/([^/]+)/([^/]+?)(?:\.[^./]+)?$", i)
    return F.when(found(1) == page_id, F.nullif(found(2), F.lit("")))


def reply_object(content: Column) -> Column:
    """The JSON object in a model's reply, with or without a fence around it, as a variant; null if
    there is none."""
    text = strip(content)
    opened = F.regexp_replace(text, r"^```[^\r\n]*(?:\r\n|\r|\n|$)", "")
    closed = F.regexp_replace(opened, r"(?U)(?:^|\r\n|\r|\n)[^\S\r\n]*```[^\S\r\n]*$", "")
    parsed = F.try_parse_json(F.when(text.startswith("```"), strip(closed)).otherwise(text))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def data_url(name: Column, content: Column) -> Column:
    """base64 data URL, in one line; null for other than PNG, JPEG and WebP."""
    kinds = F.create_map(*(F.lit(x) for pair in IMAGE_TYPES.items() for x in pair))
    return F.concat(F.lit("data:"), F.try_element_at(kinds, suffix(name)), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
