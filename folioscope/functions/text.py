"""Text distances and rates. Texts are compared as they are: no normalisation, code point by
code point, words split at Unicode white space."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: What separates words: Unicode white space and the four separators \x1C to \x1F.
SPACES = r"(?U)[\s\x1C-\x1F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda x: x != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of strings or lists, bit-parallel: a whole row of the table is two integers of as
    many bits as the longer one has items, and each item of the shorter one costs a few operations on them."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < min(end_a, end_b) and a[start] == b[start]:
        start += 1
    while min(end_a, end_b) > start and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    long, short = (a[start:end_a], b[start:end_b]) if end_a >= end_b else (b[start:end_b], a[start:end_a])
    found = len(long)
    if not short:
        return found
    places: dict = {}
    for i, x in enumerate(long):
        places[x] = places.get(x, 0) | 1 << i
    whole, last = (1 << found) - 1, 1 << (found - 1)
    up, down = whole, 0  # where the table rises and falls from an item of the longer one to the next
    for x in short:
        same = places.get(x, 0)
        level = same | down
        diagonal = (((same & up) + up) ^ up) | same
        rise, fall = down | (whole & ~(diagonal | up)), up & diagonal
        if rise & last:
            found += 1
        elif fall & last:
            found -= 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(level | rise)) & whole, rise & level & whole
    return found


#: Texts, or lists of words, that are Python objects at once; the rest of a batch stays in Arrow's form.
TOGETHER = 256


def _distances(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in pairs:
        found: list[int | None] = []
        for at in range(0, len(left), TOGETHER):
            some = zip(*(x.slice(at, TOGETHER).to_pylist() for x in (left, right)), strict=True)
            found += [None if a is None or b is None else distance(a, b) for a, b in some]
        yield pa.array(found, pa.int32())


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance between arrays of words."""
    return F.arrow_udf(_distances, IntegerType())(reference, hypothesis)


def char_distance(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance between texts, by code points. What ``levenshtein`` gives, in less than a third of its
    time on texts of some hundred characters."""
    return F.arrow_udf(_distances, IntegerType())(reference, hypothesis)


def _rate(errors: Column, length: Column, other: Column) -> Column:
    """Errors over the reference's length; with an empty reference 0.0 or, if the other isn't, 1.0."""
    return F.when(length == 0, F.when(other == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(errors.cast("double"), length.cast("double")))


def cer(reference: Column, hypothesis: Column) -> Column:
    return _rate(char_distance(reference, hypothesis), F.length(reference), F.length(hypothesis))


def wer(reference: Column, hypothesis: Column) -> Column:
    r, h = words(reference), words(hypothesis)
    return _rate(word_distance(r, h), F.size(r), F.size(h))


def htr_metrics(reference: Column, hypothesis: Column) -> Column:
    """char_errors, ref_chars, cer, word_errors, ref_words and wer in a struct."""
    r, h = words(reference), words(hypothesis)
    chars, in_words = char_distance(reference, hypothesis), word_distance(r, h)
    return F.struct(
        chars.cast("long").alias("char_errors"), F.length(reference).cast("long").alias("ref_chars"), _rate(chars, F.length(reference), F.length(hypothesis)).alias("cer"),
        in_words.cast("long").alias("word_errors"), F.size(r).cast("long").alias("ref_words"), _rate(in_words, F.size(r), F.size(h)).alias("wer"),
    )


@cache
def characters_of(*classes: str) -> str:
    """A pattern for one character of the given bidirectional classes, as ranges of code points; Java's and
    RE2's patterns both read it."""
    ranges: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.bidirectional(chr(code)) in classes:
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


RIGHT_TO_LEFT, STRONG = ("R", "AL"), ("L", "R", "AL")


def direction(text: Column | str) -> Column:
    """ltr, rtl or auto, by the first character with a strong direction."""
    first = F.regexp_extract(text, characters_of(*STRONG), 0)
    return F.when(first == "", "auto").when(first.rlike(characters_of(*RIGHT_TO_LEFT)), "rtl").when(first != "", "ltr")


def percent(rate: Column, missing: str = "Undefined") -> Column:
    return F.coalesce(F.format_string("%.1f%%", rate * 100), F.lit(missing))
