"""The shared vocabulary of region types, and names of systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import strip

# The region vocabulary with its display labels, and other names for its types.
REGION_LABELS = {
    "main_text": "Main text",
    "marginal_text": "Marginal text",
    "stamp_or_seal": "Stamp or seal",
    "handwritten_annotation": "Handwritten annotation",
    "archival_mark": "Archival mark",
    "illustration": "Illustration",
    "unknown": "Unclassified region",
}
TYPE_ALIASES = {
    "main": "main_text", "text": "main_text", "body": "main_text", "body_text": "main_text",
    "commentary": "marginal_text", "margin": "marginal_text", "marginalia": "marginal_text",
    "stamp": "stamp_or_seal", "seal": "stamp_or_seal", "stamp_seal": "stamp_or_seal",
    "note": "handwritten_annotation", "annotation": "handwritten_annotation", "handwriting": "handwritten_annotation",
    "archive_mark": "archival_mark", "catalog_mark": "archival_mark", "cataloguing_mark": "archival_mark",
    "image": "illustration", "figure": "illustration",
}
# Models by their display names and by their folders, and the order in which systems are shown.
SYSTEM_NAMES = {"qwen3-vl-8b-instruct-mlx": "Qwen3-VL 8B", "qwen3-vl-30b-a3b-instruct-mlx": "Qwen3-VL 30B"}
MODEL_FOLDERS = {"qwen3-vl-8b": "qwen3-vl-8b-instruct-mlx", "qwen3-vl-30b": "qwen3-vl-30b-a3b-instruct-mlx"}
SYSTEM_ORDER = ("eScriptorium", "Qwen3-VL 8B", "Qwen3-VL 30B")
PAIRED_FAMILY = "Qwen3-VL"

REGION_TYPES = tuple(REGION_LABELS)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def region_type(value: Column) -> Column:
    """A label in the vocabulary: trimmed, in lower case, with underscores, by its alias; else unknown."""
    plain = F.translate(F.lower(strip(value)), "- ", "__")
    known = literal_map({t: t for t in REGION_TYPES} | TYPE_ALIASES)
    return F.coalesce(F.try_element_at(known, plain), F.lit("unknown"))


def display_label(value: Column) -> Column:
    """Labels outside the vocabulary pass as they are; none is unclassified."""
    shown = F.coalesce(F.try_element_at(literal_map(REGION_LABELS), value), value)
    return F.when(value.isNull() | (value == ""), F.lit(REGION_LABELS["unknown"])).otherwise(shown)


def system_name(model: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(SYSTEM_NAMES), model), model)


def system_rank(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, n in enumerate(SYSTEM_ORDER) for x in (n, i))), name), F.lit(len(SYSTEM_ORDER)))
