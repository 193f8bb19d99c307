"""Quality rules: how much of a text repeats itself.

Words become small integers (exactly, by a dictionary of the text), and rolling hashes of
several n-gram lengths run over them in numpy. For each length the characters of words inside
n-grams that occurred before in the text are measured against the characters of all words; so
are the characters of lines that occurred before. A text is rejected by its base rules or when
one of these shares is above its limit.

Defined results: a null or empty text has no words and fails the base rules; rows stay apart even
if repeated; a text of any length is measured whole, in memory proportional to that one text. The
64-bit rolling hash can take two different n-grams of one text for the same with a chance of about
(words of the text)^2 / 2^64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SPACE, TEXT_ROWS, files_for

#: Highest share of word characters inside repeated n-grams, by n (fixed values of the published
#: rules for massive web text), and the same for repeated lines and their count.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_CHARS_LIMIT, LINES_LIMIT = 0.20, 0.30
#: Base rules: fewest words, and percentage of words in 5-word windows found twice or more.
LEAST_WORDS, REPEAT_PERCENT, BASE_N = 10, 20, 5

_words = re.compile(r"[^\x20\x09-\x0D]+").findall
_symbols = re.compile(r"[#*$%&|<>]").findall
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

MEASURES = pa.struct(
    [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("dup_line_chars_share", pa.float64()), ("dup_lines_share", pa.float64()), ("ngram_shares", pa.list_(pa.float64()))]
)
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars_share double, dup_lines_share double, ngram_shares array<double>"


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the windows of n words that begin at ``at``."""
    edge = np.zeros(words + 1, dtype=np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, lengths: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> dict:
    text = text or ""
    words = _words(text)
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": len(_symbols(text)), "n_dup_lines": 0, "n_repeat_words": 0, "dup_line_chars_share": 0.0, "dup_lines_share": 0.0, "ngram_shares": [0.0] * len(lengths)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        again = [x for x in lines if x in seen or seen.add(x)]
        out["n_dup_lines"] = len(again)
        out["dup_lines_share"] = len(again) / len(lines)
        out["dup_line_chars_share"] = sum(map(len, again)) / sum(map(len, lines))
    if n_words <= BASE_N:
        return out
    number: dict[str, int] = {}
    x = (np.fromiter(map(number.setdefault, words, count(1)), dtype=np.uint64, count=n_words) * _FACTOR) ^ _STEP
    sizes = None
    h = np.zeros(n_words, dtype=np.uint64)
    at = np.arange(n_words)  # where windows begin that may still have an equal
    for n in range(1, max(lengths) + 1):
        if n_words < n:
            break
        h = h[: n_words - n + 1] * _STEP + x[n - 1 :]
        if n not in lengths and n != BASE_N:
            continue
        at = at[at <= n_words - n]
        key = h[at]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            break  # longer windows have no equal either
        later = np.zeros(len(at), dtype=bool)
        later[order[1:][same]] = True  # stable: the first in the text stays out
        twice = later.copy()
        twice[order[:-1][same]] = True
        if n == BASE_N:
            out["n_repeat_words"] = int(_covered(at[twice], n, n_words).sum())
        if n in lengths:
            if sizes is None:
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
            out["ngram_shares"][lengths.index(n)] = float(sizes[_covered(at[later], n, n_words)].sum() / word_chars)
        at = at[twice]
    return out


def measures(text: Column | str) -> Column:
    """A struct of what ``measure`` finds, for each text."""

    @F.arrow_udf(_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([measure(t.as_py()) for t in texts], type=MEASURES)

    return run(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def repeats_little(m: Column) -> Column:
    """The method's own verdict, apart from the base rules."""
    ok = (m["dup_line_chars_share"] <= LINE_CHARS_LIMIT) & (m["dup_lines_share"] <= LINES_LIMIT)
    for i, limit in enumerate(NGRAM_LIMITS.values()):
        ok = ok & (m["ngram_shares"][i] <= limit)
    return ok


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base measures, base_failed, kept, the shares."""
    m = F.col("m")
    rows = docs.select("doc_id", measures("text").alias("m"))
    return rows.select(
        "doc_id",
        *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(m).alias("base_failed"),
        (~base_failed(m) & repeats_little(m)).alias("kept"),
        m["dup_line_chars_share"].alias("dup_line_chars_share"),
        m["dup_lines_share"].alias("dup_lines_share"),
        m["ngram_shares"].alias("ngram_shares"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    whole = docs.select(F.struct("*").alias("row"), measures("text").alias("m"))
    kept = whole.where(~base_failed(F.col("m")) & repeats_little(F.col("m"))).select("row.*")
    return files_for(kept, docs.count(), TEXT_ROWS)
