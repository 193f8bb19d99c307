"""Page layout XML (ALTO 4) as tables, a bad file as an issue.

A file is one row: read whole, parsed by an explicit schema in which every attribute is a string,
and cast afterwards, so one odd number can't change a file's types. What the format doesn't allow
turns the whole file into an issue and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.geometry import Box, normalize_box, normalize_polygon
from folioscope.functions.ids import stem
from folioscope.functions.labels import region_type
from folioscope.sources.paths import either, placed, unpacked
from folioscope.sources.records import OUTSIDE

# Fixed value: the format's namespace.
NAMESPACE = "http://www.loc.gov/standards/alto/ns-v4#"

_BOX = "_HPOS string, _VPOS string, _WIDTH string, _HEIGHT string"
_SHAPE = "Shape struct<Polygon: struct<_POINTS: string>>"


def _fields(flat: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.strip().split(" ", 1) for x in flat.split(", ")))


_LINE = f"struct<_ID: string, _BASELINE: string, _TAGREFS: string, {_fields(_BOX)}, {_SHAPE.replace(' ', ': ', 1)}, String: array<struct<_CONTENT: string, _WC: string>>>"
_BLOCK = f"struct<_ID: string, _TAGREFS: string, {_fields(_BOX)}, {_SHAPE.replace(' ', ': ', 1)}, TextLine: array<{_LINE}>>"
_TAGS = "Tag array<struct<_ID: string, _LABEL: string>>"
SCHEMA = (
    "Description struct<sourceImageInformation: struct<fileName: string>>, "
    f"Layout struct<Page: array<struct<_WIDTH: string, _HEIGHT: string, _PHYSICAL_IMG_NR: string, PrintSpace: array<struct<TextBlock: array<{_BLOCK}>>>>>>, "
    "_corrupt_record string"
)
#: Comments; the declaration of the format's namespace, by whatever prefix; and the parts of a file that hold tags.
_COMMENT = r"(?s)<!--.*?-->"
_DECLARED = rf"xmlns(?::[\w.-]+)?\s*=\s*[\"']\Q{NAMESPACE}\E[\"']"
_TAG_PARTS = r"(?s)<(?:[\w.-]+:)?Tags(?:\s+[^\s=<>/]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*\s*>.*?</(?:[\w.-]+:)?Tags\s*>"
_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "nullValue": "\u0000"}


def _numbers(text: Column) -> Column:
    """The numbers in a text, null for what is none."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def _of(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` has it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def points(text: Column) -> Column:
    """"x y x y ..." as an array of points."""

    def paired(n: Column) -> Column:
        pairs = F.when(F.size(n) >= 2, F.sequence(F.lit(0), (F.size(n) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(pairs, lambda i: F.struct(F.get(n, 2 * i).alias("x"), F.get(n, 2 * i + 1).alias("y")))

    return _of(_numbers(text), paired)


def points_sound(text: Column) -> Column:
    return text.isNull() | _of(_numbers(text), lambda n: (F.size(n) % 2 == 0) & F.forall(n, lambda x: x.isNotNull()))


def attribute_box(e: Column) -> Column:
    """A box from position and extent, null unless all four are there."""
    x, y, w, h = (e[k].try_cast("double") for k in ("_HPOS", "_VPOS", "_WIDTH", "_HEIGHT"))
    return F.when(x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull(), Box(x, y, x + w, y + h).as_struct())


def _box_sound(e: Column) -> Column:
    """All four attributes that are there are numbers."""
    ok = F.lit(True)
    for k in ("_HPOS", "_VPOS", "_WIDTH", "_HEIGHT"):
        ok = ok & (e[k].isNull() | e[k].try_cast("double").isNotNull())
    return ok


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def _line(e: Column) -> Column:
    strings = F.coalesce(e["String"], F.array().cast("array<struct<_CONTENT: string, _WC: string>>"))
    scores = F.filter(F.transform(strings, lambda s: s["_WC"].try_cast("double")), lambda x: x.isNotNull())
    zero = Box(*(F.lit(0.0) for _ in Box._fields)).as_struct()
    return F.struct(
        F.coalesce(e["_ID"], F.lit("")).alias("id"),
        F.array_join(F.filter(F.transform(strings, lambda s: s["_CONTENT"]), lambda x: x != ""), " ").alias("text"),
        F.coalesce(attribute_box(e), zero).alias("bbox"), points(e["Shape"]["Polygon"]["_POINTS"]).alias("polygon"), points(e["_BASELINE"]).alias("baseline"),
        _mean(scores).alias("confidence"), _tokens(e["_TAGREFS"]).alias("tagrefs"),
    )


def _sound(block: Column) -> Column:
    lines = F.coalesce(block["TextLine"], F.array().cast(f"array<{_LINE}>"))
    shapes = lambda e: points_sound(e["Shape"]["Polygon"]["_POINTS"]) & _box_sound(e)
    return shapes(block) & F.forall(lines, lambda e: shapes(e) & points_sound(e["_BASELINE"]))


def tags_of(xml: Column) -> Column:
    """ID and LABEL of every element in the tags of a file, whatever its name, in the file's order.

    The elements are given one name first, so that the parser keeps them in one list."""
    named = lambda part: F.regexp_replace(part, r"<(/?)[A-Za-z_:][^\s/>]*", "<$1Tag")
    lists = F.transform(F.regexp_extract_all(xml, F.lit(_TAG_PARTS), F.lit(0)), lambda part: F.from_xml(named(part), _TAGS, _OPTIONS)["Tag"])
    found = F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    return F.filter(found, lambda t: (t["_ID"] != "") & (t["_LABEL"] != ""))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once: a filter would otherwise be moved below it, and compute it for each mention."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _parsed_files(spark: SparkSession, path: str, root: str | None) -> DataFrame:
    """The XML files at ``path``, plain or compressed (*.xml.gz, named without that end), a row for each: path, page_id,
    message (null if it is sound), image, width, height, image_number, tags and blocks as they were parsed."""
    files = unpacked(placed(spark.read.text(path, wholetext=True, pathGlobFilter=either("xml")), root or path))
    parsed = _once(files, "d", F.from_xml("value", SCHEMA, _OPTIONS))
    parsed = _once(parsed, "plain", F.regexp_replace("value", _COMMENT, "")).select("path", "outside", "d", F.col("plain").rlike(_DECLARED).alias("v4"), tags_of(F.col("plain")).alias("tags"))
    page = F.get(F.col("d.Layout.Page"), F.lit(0))
    spaces = F.coalesce(page["PrintSpace"], F.array().cast(f"array<struct<TextBlock: array<{_BLOCK}>>>"))
    blocks = F.flatten(F.transform(spaces, lambda s: F.coalesce(s["TextBlock"], F.array().cast(f"array<{_BLOCK}>"))))
    size = lambda k: F.coalesce(page[k].try_cast("double").try_cast("int"), F.lit(0))
    rows = _once(parsed, "blocks", blocks).select("path", "outside", stem(F.col("path")).alias("page_id"), F.col("d._corrupt_record").isNotNull().alias("corrupt"), (page.isNotNull() & F.col("v4")).alias("paged"), F.col("d.Description.sourceImageInformation.fileName").alias("image"), size("_WIDTH").alias("width"), size("_HEIGHT").alias("height"), page["_PHYSICAL_IMG_NR"].try_cast("int").alias("image_number"), "blocks", "tags")
    flat = (F.col("width") == 0) | (F.col("height") == 0)
    message = F.when(F.col("outside"), OUTSIDE).when(F.col("corrupt"), "malformed XML").when(~F.coalesce("paged", F.lit(False)), "no page").when(~F.forall("blocks", _sound), "malformed numbers").when(flat & F.exists("blocks", lambda b: attribute_box(b).isNotNull()), "page without extent")
    return _once(rows, "message", message)


def layout_files(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """path, page_id, message, skipped (blocks without a box) and has_text (a line has any) of the XML files at ``path``."""
    none = lambda x, of: F.coalesce(x, F.array().cast(f"array<{of}>"))
    said = lambda e: F.exists(none(e["String"], "struct<_CONTENT: string, _WC: string>"), lambda x: F.coalesce(x["_CONTENT"] != "", F.lit(False)))
    skipped = F.size(F.filter("blocks", lambda b: attribute_box(b).isNull())).cast("long")
    return _parsed_files(spark, path, root).select("path", "page_id", "message", skipped.alias("skipped"), F.exists("blocks", lambda b: F.exists(none(b["TextLine"], _LINE), said)).alias("has_text"))


def parse_layout(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """The XML files at ``path``, each parsed once: a row for each block, or one for a file that has none or is
    bad (then with a message)."""
    rows = _parsed_files(spark, path, root)
    listed = F.posexplode_outer(F.when(F.col("message").isNull(), F.col("blocks"))).alias("block_ord", "b")
    good = rows.select("path", "page_id", "message", "image", "width", "height", "image_number", "tags", listed)
    refs = _tokens(F.col("b")["_TAGREFS"])
    labelled = F.transform(refs, lambda r: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("tags", lambda t: t["_ID"] == r), lambda t: t["_LABEL"])), -1))
    lines = F.coalesce(F.transform(F.col("b")["TextLine"], _line), F.array())
    return good.select(
        "path", "page_id", "message", "image", "width", "height", "image_number", "block_ord", F.coalesce(F.col("b")["_ID"], F.lit("")).alias("id"),
        F.get(F.filter(labelled, lambda x: x.isNotNull()), F.lit(0)).alias("block_type"), refs.alias("tagrefs"),
        attribute_box(F.col("b")).alias("bbox"), points(F.col("b")["Shape"]["Polygon"]["_POINTS"]).alias("polygon"), lines.alias("lines"),
    )


def blocks_and_issues(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks and the issues among the rows of ``parse_layout``."""
    blocks = parsed.where("message is null and block_ord is not null").drop("message")
    return blocks, parsed.where("message is not null").select("path", F.lit("layout").alias("stage"), "message")


def read_layout(spark: SparkSession, path: str, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, issues) of the XML files at ``path``; their paths are below ``root``, or ``path``.

    blocks: path, page_id, image, width, height, image_number, block_ord, id, block_type, tagrefs,
    bbox (nullable), polygon, lines. A file without blocks has no row."""
    return blocks_and_issues(parse_layout(spark, path, root))


def layout_regions(blocks: DataFrame, blank_lines: bool = False) -> DataFrame:
    """Blocks with a box as normalised regions: path, page_id, ord (within the file), id, region_type,
    x1..y2 (0 to 1000), polygon, confidence, text, alto_type.

    Text joins the lines that have any; with ``blank_lines`` all lines, if any has text, and of the
    blocks of a file that share an id the last one counts."""
    if blank_lines:
        last = F.max("block_ord").over(Window.partitionBy("path", "id"))
        blocks = blocks.withColumn("last", last).where("id = '' or block_ord = last").drop("last")
    texts = F.transform("lines", lambda x: x["text"])
    some = F.filter(texts, lambda x: x != "")
    box = normalize_box(Box.struct(F.col("bbox")), F.col("width"), F.col("height"))
    scores = F.filter(F.transform("lines", lambda x: x["confidence"]), lambda x: x.isNotNull())
    return blocks.where("bbox is not null").select(
        "path", "page_id", F.col("block_ord").alias("ord"), F.when(F.col("id") != "", F.col("id")).otherwise(F.concat(F.lit("alto-"), "block_ord")).alias("id"),
        region_type(F.col("block_type")).alias("region_type"), *box.columns(), normalize_polygon(F.col("polygon"), F.col("width"), F.col("height")).alias("polygon"),
        _mean(scores).alias("confidence"), F.when(F.size(some) > 0, F.array_join(texts if blank_lines else some, "\n")).alias("text"), F.col("block_type").alias("alto_type"),
    )
