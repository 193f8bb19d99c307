"""Line dedup by a segment-partition edit join.

Two lines are near-duplicates if their edit distance is at most two, and one more for every
``EDIT_CHARS`` characters of the shorter line, but no more than a tenth of it.
A line is split into one segment more than the edits it may have, so a near line that is no shorter
holds at least one of its segments whole, moved by no more than the edits. Segments are indexed, and
probed for among all substrings of the longer line, by one gram each: of the grams within a segment
that whose group is rarest in the corpus (then that of the smallest hash, then the first). Equal
substrings have the same such gram, so a line needs no key for each of its substrings: those of one
width have few grams among them. Pairs that share a gram at places and lengths that the edits allow
and beside which the same characters stand, where the shared segment has them, are verified by a
banded bit-parallel edit distance, many pairs at once. Near lines chain into
classes; of each class, and of each line that just repeats, the first occurrence (smallest id, then
line) stays.

Keys travel without texts, many to a row, by buckets of their hashes. A segment with more than
``CROWD`` lines to meet meets a few at first; what these links leave in different classes is
compared in a second round, so a group of copies doesn't make all its pairs and no pair is lost. Lines
of its key that none of a crowd could meet stay out of that round.

Lines are named by 54 bits of a hash and ten of their length; should two lines have the same, which a second hash shows, both
are left alone. Lines without a word are no lines here and always stay.

Defined results: a null or empty text has no lines; a null id comes after all others; of rows that
repeat, one keeps its lines; a text left without lines stays as a row. Other columns are ignored by
``line_report`` and kept by ``drop_lines``, where n_chars, if there is one, follows the text.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import MAP_BITS, SPACE, TEXT_ROWS, cut, files_for, name_map, on_map
from folioscope.llm.graph import components

EDIT_CHARS, SHORTEST = 40, 10
#: Lines to meet that make a crowd, and how many of these a segment meets at first. Pairs looked at together.
CROWD, FEW, TOGETHER = 32, 8, 1 << 18
#: So many times a crowd of lines of one key and of fitting lengths are a crowd, whether they could meet or not.
UNSIFTED = 64
#: Lines of half a cell of the second round, and pairs whose distances are taken together there.
CELL, COMPARED = 2000, 4096
#: Lines that a task remembers so as to emit each once, and texts that it splits together.
RECENT, SPLIT = 200_000, 256
#: Characters hashed at once, keys held before they go out, and characters of all texts for a bucket.
CHARS, HELD, BUCKET = 1 << 16, 1 << 19, 1 << 23
#: Bits of a place within the characters hashed at once, and the longest piece of a line among them.
PLACE_BITS, PIECE = 20, 1 << 19
#: Groups of grams that are counted, and of these in a block.
GROUPS, BLOCK = 1 << 16, 1 << 11
#: Rows of the distance matrix that are kept as bits of one number: distances up to BAND - 1.
BAND = 64
#: Of a key its hash within its bucket; of its line the name, the first place of the key and how far on its
#: last one is, the length, whether the key is of one of its own segments (1) that has _BESIDE characters before
#: the gram (2) and behind it (4), and what stands there: four bits each of a hash from 1 on, 0 for unknown.
_KEY = {"key": np.uint32, "line": np.int64, "first": np.uint32, "span": np.uint32, "size": np.uint32, "own": np.uint8, "beside": np.uint8}
#: Bits of a name that are of a hash; those above are of the length.
HASH_BITS = 54
Keys = dict[str, np.ndarray]
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Least lengths of the classes of lines whose segments are cut to one width, and characters of their grams.
_STARTS = (10, 20, 40, 80, 120, 160, 200, 240, 280, 320)
_GRAM = (5, 5, 8, 10, 12, 12, 12, 12, 12, 12)
#: Characters on either side of a gram that are compared, by its length; a segment has as many on one side at least,
#: but for the shortest lines.
_BESIDE = {5: 1, 8: 1, 10: 3, 12: 4}


def edits_of(length):
    """Edits that a line of that length (or lengths) may have."""
    return np.minimum(length // SHORTEST, 2 + length // EDIT_CHARS)


def _class_of(length: int) -> int:
    return bisect_right(_STARTS, length) - 1


def _shape(kind: int) -> tuple[int, int]:
    """Characters of a gram, and of a segment at least, for lines of that class."""
    return _GRAM[kind], _STARTS[kind] // int(edits_of(_STARTS[kind]) + 1)


@lru_cache(1 << 16)
def _kind(length: int) -> tuple[int, bool]:
    """The class of a line, and whether it may have a near line of the class below."""
    kind = _class_of(length)
    most = _STARTS[kind] - 1
    return kind, bool(length - most <= edits_of(most))


@lru_cache(1 << 16)
def _gram_of(length: int) -> int:
    """Characters of the grams of a line."""
    return _GRAM[_class_of(length)]


# Distances ----------------------------------------------------------------------------------------


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: a column of the matrix at a time, of it the rows
    about the diagonals that so few edits reach, their steps up and down as bits of two numbers."""
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the common prefix, by halves
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = sorted((a[: len(a) - low], b[: len(b) - low]), key=len)
    if len(b) <= edits:
        return True
    gap = score = len(b) - len(a)
    end = (edits - gap) // 2  # the bit of the last cell's diagonal; as many are below it as above the first cell's
    before = gap + end
    places: dict[str, int] = {}
    for i, ch in enumerate(a, before):
        places[ch] = places.get(ch, 0) | 1 << i
    mask = (1 << before + end + 1) - 1
    up, down = mask >> before << before, 0
    for j, ch in enumerate(b):
        same = places.get(ch, 0) >> j & mask
        flat = ((((same & up) + up) ^ up) | same | down) & mask
        plus, minus = down | (mask & ~(flat | up)), up & flat
        if j >= gap and not flat >> end & 1:
            score += 1
            if score > edits:
                return False
        flat >>= 1
        up, down = minus | (mask & ~(flat | plus)), flat & plus
    return True


def _matrix(texts: list[str], before: np.ndarray, width: int, fill: int, kind: type) -> np.ndarray:
    """Character codes, a row for each text, with ``before`` places in front; elsewhere a ``fill`` below the highest number."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), width), np.iinfo(kind).max - fill, dtype=kind)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    at = np.arange(len(texts)) * width + before - np.cumsum(sizes) + sizes
    out.reshape(-1)[np.arange(len(codes)) + np.repeat(at, sizes)] = codes
    return out


def banded(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """Edit distances of (shorter, longer) pairs, or of those above their limits (all below BAND) some
    number above it. An alignment of d edits leaves the diagonals of the first and the last cell by no more
    than half of what d is above the lengths' difference, so for each column of the matrix BAND rows are kept
    (half of them, if no limit needs more), as bits of two numbers for each pair (steps up and down from row to row);
    the distance is followed along the diagonal that ends in the last cell, where it never falls, so pairs above
    the limit leave."""
    short, long_ = [a for a, _ in pairs], [b for _, b in pairs]
    sizes = np.array([len(b) for b in long_])
    most = int(sizes.max(initial=0))
    band, kind = (BAND // 2, np.uint32) if limits.max(initial=0) < BAND // 2 else (BAND, np.uint64)
    gap = sizes - np.array([len(a) for a in short])
    out, score = gap.copy(), gap.copy()
    now = np.nonzero(gap <= limits)[0]
    if len(now) < len(pairs):
        short, long_, sizes, gap, score, limits = [short[i] for i in now], [long_[i] for i in now], sizes[now], gap[now], score[now], limits[now]
    before = band // 2 + gap // 2  # the bit of the first cell's diagonal
    chars = "".join((*short, *long_))
    highest = 0 if chars.isascii() else int(np.frombuffer(chars.encode("utf-32-le"), dtype="<u4").max())
    code = np.uint8 if highest < 0xFE else np.uint16 if highest < 0xFFFE else np.uint32
    rows = _matrix(short, before, most + 2 * band, 0, code)
    columns = np.ascontiguousarray(_matrix(long_, np.zeros(len(now), dtype=np.int64), most, 1, code).T)
    end = (before - gap).astype(kind)  # and of the last one's
    one = kind(1)
    up = np.full(len(now), ~kind(0), dtype=kind) << before.astype(kind)  # rows above the first have no steps
    down = np.zeros(len(now), dtype=kind)
    for j in range(most):
        if j % 16 == 15:
            stays = (score <= limits) & (sizes > j)
            if stays.sum() * 4 < len(now) * 3:
                out[now] = score
                now, rows, sizes, gap, end, up, down, score, limits = (x[stays] for x in (now, rows, sizes, gap, end, up, down, score, limits))
                columns = columns[:, stays]
                if not len(now):
                    break
        same = np.packbits((rows[:, j : j + band] == columns[j][:, None]).reshape(-1), bitorder="little").view(kind)
        flat = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(flat | up), flat & up
        score += (j >= gap) & (j < sizes) & ((flat >> end & one) == 0)
        flat >>= one
        up, down = minus | ~(flat | plus), flat & plus
    out[now] = score
    return out


# Keys ---------------------------------------------------------------------------------------------


def _joined(parts: list[Keys]) -> Keys:
    return {c: np.concatenate([np.empty(0, t), *(p[c] for p in parts)]) for c, t in _KEY.items()}


def _some(rows: Keys, at: np.ndarray) -> Keys:
    return {c: x[at] for c, x in rows.items()}


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each range, and all numbers of the ranges."""
    nth = np.repeat(np.arange(len(counts)), counts)
    return nth, np.arange(len(nth)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _rolled(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes (32 bits) of all grams of ``k`` characters."""
    return _mixed(_raw(codes, k))


def _raw(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all grams before their bits are mixed: those of half the length make up those of the whole."""
    h, n, steps = codes, 1, bin(k)[3:]
    for bit in steps:
        new = h[: len(h) - n] * np.uint32(pow(int(_STEP), n, 1 << 32))
        new += h[n:]
        h, n = new, 2 * n
        if bit == "1":
            new = h[:-1] * np.uint32(int(_STEP) & 0xFFFFFFFF)
            new += codes[n : n + len(new)]
            h, n = new, n + 1
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h


def _hash_at(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes (64 bits) of some grams."""
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        h *= _STEP
        h += codes.take(at + i)
    h = (h ^ (h >> np.uint64(31))) * _SPREAD
    h = (h ^ (h >> np.uint64(29))) * _STEP + np.uint64(k)
    return (h ^ (h >> np.uint64(32))) * _SPREAD


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4") + np.uint32(1)


def _group_of(h: np.ndarray) -> np.ndarray:
    return h >> np.uint32(16)


def _chosen(h: np.ndarray, k: int, width: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the gram, by (rank of the group, hash, place), of each substring of ``width`` characters: the
    first substring of each run that has one place, and the places."""
    v = (ranks.astype(np.uint32) << np.uint32(16)).take(_group_of(h))
    v |= h & np.uint32(0xFFFF)
    least, n, wanted = v, 1, width - k + 1
    while n < wanted:
        step = min(n, wanted - n)
        least = np.minimum(least[:-step], least[step:])
        n += step
    starts = np.ones(len(least), dtype=bool)
    starts[1:] = (least[1:] != least[:-1]) | (v[: len(least) - 1] == least[:-1])  # the gram before is out of reach, or a rarer one in it
    starts = np.nonzero(starts)[0]
    place = starts + wanted - 1
    seek = np.nonzero((starts == 0) | (least[starts] >= least[starts - 1]))[0]  # else it is the last gram
    place[seek] = starts[seek] + (np.lib.stride_tricks.sliding_window_view(v, wanted)[starts[seek]] == least[starts[seek], None]).argmax(axis=1)
    return starts, place


def _pieces(line: str) -> list[tuple[int, str]]:
    """A line, or parts of a very long one that overlap by more than a segment, with their starts."""
    if len(line) <= PIECE:
        return [(0, line)]
    return [(at, line[at : at + PIECE + EDIT_CHARS]) for at in range(0, len(line) - EDIT_CHARS, PIECE)]


def _keys(lines: list[tuple[int, int, int, str]], kind: int, lower: bool, ranks: np.ndarray) -> tuple[np.ndarray, Keys]:
    """Hashes (64 bits) and keys of pieces (name, length of the line, start, text) of one class's lines."""
    names, sizes, starts = (np.array(x, dtype=np.int64) for x in ([p[i] for p in lines] for i in range(3)))
    texts = [p[3] for p in lines]
    lengths = np.array([len(t) for t in texts])
    base = np.cumsum(lengths) - lengths
    codes = _codes(texts)
    k, width = _shape(kind)
    shapes = [(k, width)]
    if lower:
        below = _shape(kind - 1)
        shapes = [below] if below[0] == k else [*shapes, below]  # narrower substrings have all grams of wider ones
    parts = edits_of(sizes) + 1
    of, nth = _ranges(np.zeros(len(parts), dtype=np.int64), parts)
    segment = nth * sizes[of] // parts[of] - starts[of]
    inside = (segment >= 0) & (segment + width <= lengths[of])
    segment = segment[inside] + base[of[inside]]
    hashes, out = [], []
    for k_, width_ in shapes:
        h = _rolled(codes, k_)
        runs, place = _chosen(h, k_, width_, ranks)
        marked = np.zeros(len(codes), dtype=bool)
        marked[runs], marked[base[lengths >= width_]] = True, True  # a line's first substring begins a run too
        begins = np.nonzero(marked)[0]
        piece = np.searchsorted(base, begins, side="right") - 1
        inside = begins + width_ <= (base + lengths)[piece]  # substrings that don't run into the next piece
        begins, piece = begins[inside], piece[inside]
        at = place[np.searchsorted(runs, begins, side="right") - 1]
        own, near = np.zeros(len(codes), dtype=np.uint8), _BESIDE[k_]
        if k_ == k:
            if width_ != width:
                runs, place = _chosen(h, k, width, ranks)
            gram = place[np.searchsorted(runs, segment, side="right") - 1]
            own[gram] = 1 | (gram - segment >= near) << 1 | (segment + width - gram - k >= near) << 2
        key = _hash_at(codes, at, k_)
        follows = np.zeros(len(at), dtype=bool)  # a run of one gram is one key
        follows[1:] = (key[1:] == key[:-1]) & (piece[1:] == piece[:-1])
        first = np.nonzero(~follows)[0]
        last = np.append(first[1:], len(at))[: len(first)] - 1
        of = piece[first]
        rows = {"key": np.zeros(len(first)), "line": names[of], "first": at[first] + (starts - base)[of], "span": at[last] - at[first], "size": sizes[of]}
        rows["own"] = np.maximum.reduceat(own[at], first) if len(first) else np.zeros(0)
        # beyond the line's ends something else stands here, which no segment reaches; pieces of a line don't tell
        stands = _raw(codes, near)
        nibble = lambda i: ((_mixed(stands[np.clip(i, 0, len(stands) - 1)]) >> np.uint32(16)) % np.uint32(15) + np.uint32(1)).astype(np.uint8)  # noqa: E731, B023
        rows["beside"] = np.where(sizes[of] > PIECE, np.uint8(0), nibble(at[first] - near) | nibble(at[first] + k_) << np.uint8(4))
        hashes.append(key[first])
        out.append({c: rows[c].astype(t) for c, t in _KEY.items()})
    return np.concatenate(hashes), _joined(out)


def _names(lines: list[str]) -> np.ndarray:
    """Names of lines: a hash, and above it of the length."""
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], dtype=np.uint64)
    sizes = np.array([len(x) for x in lines], dtype=np.uint64)
    return (h & np.uint64((1 << HASH_BITS) - 1) | (sizes & np.uint64(1023)) << np.uint64(HASH_BITS)).view(np.int64)


def _split(texts: pa.Array) -> Iterator[list[list[str]]]:
    """The lines of texts, of some texts at a time."""
    for at in range(0, len(texts), SPLIT):
        yield [(x or "").split("\n") for x in texts.slice(at, SPLIT).to_pylist()]


def _signatures(buckets: int, ranks: np.ndarray):
    """bucket, keys: the keys of all lines, many to a row; each line once for a task while it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[int] = set()
        waiting: dict[tuple[int, bool], list] = {}
        chars: dict[tuple[int, bool], int] = {}
        held: list[tuple[np.ndarray, Keys]] = []

        def flush() -> pa.RecordBatch:
            h, rows = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in held)]), _joined([x for _, x in held])
            held.clear()
            low = np.uint64((1 << len(h).bit_length()) - 1)  # the last bits of a hash needn't be in order
            order = (np.sort(h & ~low | np.arange(len(h), dtype=np.uint64)) & low).astype(np.intp)
            h, rows = h.take(order), {c: x.take(order) for c, x in rows.items()}
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            rows["key"] = (h * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)  # what the bucket leaves of the hash
            edges = [*np.nonzero(np.diff(bucket, prepend=-1))[0].tolist(), len(h)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(_packed(rows, edges), pa.binary())], names=["bucket", "keys"])

        for batch in batches:
            for some in _split(batch.column("text")):
                lines = [x for split in some for x in split if len(x) >= SHORTEST and x.strip(SPACE)]
                for name, line in zip(_names(lines).tolist(), lines, strict=True):
                    if name in recent:
                        continue
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(name)
                    size = len(line)
                    group = _kind(size)
                    for start, piece in ((0, line),) if size <= PIECE else _pieces(line):
                        waiting.setdefault(group, []).append((name, size, start, piece))
                        chars[group] = chars.get(group, 0) + len(piece)
                        if chars[group] >= CHARS:
                            held.append(_keys(waiting.pop(group), *group, ranks))
                            chars[group] = 0
                            if sum(len(h) for h, _ in held) >= HELD:
                                yield flush()
        held += [_keys(pieces, *group, ranks) for group, pieces in waiting.items()]
        if sum(len(h) for h, _ in held):
            yield flush()

    return run


#: Bytes of a key: as they are, compressed one by one, and compressed together since they are nearly always 0.
_RAW = (("key", 0), ("key", 1), ("first", 0), ("beside", 0), *(("line", i) for i in range(8)))
_ALONE = (("key", 2), ("first", 1), ("own", 0))
_REST = (("key", 3), ("first", 2), ("first", 3), *((c, i) for c in ("span", "size") for i in range(4)))


def _told(line: np.ndarray) -> np.ndarray:
    """What names tell of lengths."""
    return (line >> np.int64(HASH_BITS) & np.int64(1023)).astype(np.uint32)


def _packed(rows: Keys, edges: list[int]) -> list[bytes]:
    """Parts of rows, each in order of its keys, those as differences; byte by byte, and compressed. Of a length
    only what the name doesn't have."""
    steps = np.diff(rows["key"], prepend=np.uint32(0))
    steps[edges[:-1]] = rows["key"][edges[:-1]]
    rows = rows | {"key": steps, "size": rows["size"] ^ _told(rows["line"])}
    of = {c: np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(steps), -1).T.copy() for c in _KEY}
    out = []
    for i, j in zip(edges, edges[1:]):  # noqa: RUF007
        parts = [b"".join(of[c][k, i:j].tobytes() for c, k in group) for group in (_RAW, *((x,) for x in _ALONE), _REST)]
        parts[1:] = [pa.compress(x, codec="zstd", asbytes=True) for x in parts[1:]]
        out.append(b"".join([(j - i).to_bytes(4, "little"), *(len(x).to_bytes(4, "little") for x in parts[1:]), *parts]))
    return out


def _unpacked(data: bytes) -> Keys:
    n, *sizes = np.frombuffer(data, dtype="<u4", count=2 + len(_ALONE)).tolist()
    at = 4 * (2 + len(_ALONE))
    of = {c: np.zeros((n, np.dtype(t).itemsize), dtype=np.uint8) for c, t in _KEY.items()}
    for group, size in zip((_RAW, *((x,) for x in _ALONE), _REST), (None, *sizes), strict=True):
        end = at + (n * len(group) if size is None else size)
        part = data[at:end] if size is None else pa.decompress(data[at:end], n * len(group), codec="zstd", asbytes=True)
        at = end
        for i, (c, k) in enumerate(group):
            of[c][:, k] = np.frombuffer(part, dtype=np.uint8, count=n, offset=i * n)
    rows = {c: of[c].reshape(-1).view(t) for c, t in _KEY.items()}
    rows["key"] = np.cumsum(rows["key"], dtype=np.uint32)
    rows["size"] ^= _told(rows["line"])
    return rows


# Pairs --------------------------------------------------------------------------------------------


def _shared(rows: Keys) -> Keys:
    """The rows of keys that several lines have, one of them of its own; in order of key, size and
    line, each line once for a key."""
    n = len(rows["key"])
    v = np.sort(rows["key"].astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64))
    key = (v >> np.uint64(32)).astype(np.uint32)
    starts = np.nonzero(np.append(True, key[1:] != key[:-1])[:n])[0]
    sizes = np.diff(starts, append=n)
    order = (v & np.uint64(0xFFFFFFFF)).astype(np.intp)[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    if not len(sizes):
        return _some(rows, order)
    starts, line = np.cumsum(sizes) - sizes, rows["line"][order]
    several = np.maximum.reduceat(rows["own"][order], starts) > 0
    several &= np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
    rows = _some(rows, order[np.repeat(several, sizes)])
    place = rows["key"].astype(np.uint64) << np.uint64(32) | rows["size"]
    order = np.lexsort((rows["line"], place))
    rows, place = _some(rows, order), place[order]
    at = np.nonzero(np.append(True, (place[1:] != place[:-1]) | (rows["line"][1:] != rows["line"][:-1]))[: len(place)])[0]
    if len(at) == len(place):
        return rows
    last = np.maximum.reduceat(rows["first"] + rows["span"], at)
    first, own, beside = np.minimum.reduceat(rows["first"], at), np.maximum.reduceat(rows["own"], at), np.maximum.reduceat(rows["beside"], at)
    return _some(rows, at) | {"first": first, "span": last - first, "own": own, "beside": beside}


def _compatible(rows: Keys, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the key's places and the lengths of lines ``a``, which has it of its own, and ``b``,
    no shorter, are those of lines within the edits: with s edits before a shared segment that shift
    it, and those behind it that make up the rest of the lengths' difference d, abs(s) + abs(d - s)
    are in the budget."""
    (size, first, span), (size_b, first_b, span_b) = ([rows[c][x].astype(np.int64) for c in ("size", "first", "span")] for x in (a, b))
    edits, longer, shift = edits_of(size), size_b - size, first_b - first
    ok = (2 * (shift + span_b) >= longer - edits) & (2 * (shift - span) <= longer + edits) & (a != b)
    # a segment brings along what stands beside its gram, where both have the gram in one known place
    (own, beside), (own_b, beside_b) = ([rows[c][x] for c in ("own", "beside")] for x in (a, b))
    unlike = np.where((span == 0) & (span_b == 0) & (beside > 0) & (beside_b > 0), beside ^ beside_b, np.uint8(0))
    fits = lambda own: (unlike & _OF_SEGMENT[own]) == 0
    other = (longer == 0) & (rows["line"][a] > rows["line"][b]) & (own_b > 0) & fits(own_b)  # the pair is found from b
    return ok & fits(own) & ~other


#: By what a key is of, the bits of what stands beside it that are of the segment.
_OF_SEGMENT = np.array([(15 if own & 2 else 0) | (240 if own & 4 else 0) for own in range(8)], dtype=np.uint8)


def _met(rows: Keys, crowd: int = CROWD) -> Iterator[tuple[np.ndarray, np.ndarray, Keys]]:
    """Names of pairs that meet, all of a segment or a few if it has a crowd to meet; and the rows of
    crowds: segments that have one, with all that they could meet."""
    most = min(crowd, FEW)
    rows = _shared(rows)
    at = rows["key"].astype(np.uint64) << np.uint64(32) | rows["size"]
    own = np.nonzero(rows["own"])[0]
    sizes = rows["size"][own].astype(np.int64)
    low = np.searchsorted(at, at[own])
    n = np.searchsorted(at, at[own] + edits_of(sizes).astype(np.uint64), side="right") - low
    # of a crowd each line meets those that follow it in order, so that links run through all of it
    unsifted, few = n > UNSIFTED * crowd, np.minimum(n, 4 * most)
    steps = np.bincount(low[unsifted], minlength=len(at) + 1) - np.bincount((low + n)[unsifted], minlength=len(at) + 1)
    in_crowd = np.cumsum(steps)[: len(at)] > 0
    low = np.where(unsifted, np.minimum(own, low + n - few), low)
    n = np.where(unsifted, few, n)
    ends, i = np.cumsum(n), 0
    while i < len(own):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + TOGETHER, side="right")))
        nth, b = _ranges(low[i:j], n[i:j])
        a = own[i:j][nth]
        ok = _compatible(rows, a, b)
        a, b, nth = a[ok], b[ok], nth[ok]
        crowded = np.bincount(nth, minlength=j - i) > crowd
        for x in (a, b):
            in_crowd[x[crowded[nth]]] = True
        meets = ~(crowded | unsifted[i:j])[nth] | (np.arange(len(nth)) - np.searchsorted(nth, nth) < most)
        a, b = a[meets], b[meets]
        yield rows["line"][a], rows["line"][b], _some(rows, a[:0])
        i = j
    if in_crowd.any():
        yield rows["line"][:0], rows["line"][:0], _some(rows, in_crowd)


def _pairs(crowd: int):
    """a, b: pairs of lines that meet; or a and key, without b: a line of a crowded key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            rows = _joined(held)
            held.clear()
            for a, b, more in _met(rows, crowd):
                if len(a):
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.nulls(int(new.sum()), pa.int64())], names=["a", "b", "key"])
                if len(more["key"]):
                    yield pa.RecordBatch.from_arrays([pa.array(more["line"]), pa.nulls(len(more["key"]), pa.int64()), pa.array((np.int64(now or 0) << 32) + more["key"].astype(np.int64))], names=["a", "b", "key"])

        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys"), strict=True):
                if bucket != now:
                    yield from solve()
                    now = bucket
                held.append(_unpacked(keys.as_py()))
        yield from solve()

    return run


def _fitting(root: np.ndarray, texts: list[str], earlier: tuple[np.ndarray, np.ndarray], sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a cell's lines, these in order of length, of unlike roots (and of unlike sides, if there are two)
    that share no ``earlier`` key (which line, and key) and may be near by their counts, each line counted once.
    Roots may change meanwhile."""
    two = len(np.unique(sides)) > 1
    of, keys = earlier
    _, keys, n = np.unique(keys, return_inverse=True, return_counts=True)
    of, keys = of[n[keys] > 1], keys[n[keys] > 1]
    _, keys = np.unique(keys, return_inverse=True)
    masks = np.zeros((len(texts), int(keys.max(initial=0)) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(masks, (of, keys // 64), np.uint64(1) << (keys % 64).astype(np.uint64))
    sizes = np.array([len(t) for t in texts])
    edits = edits_of(sizes)
    first = np.arange(len(texts)) + 1
    ends = np.cumsum(np.maximum(0, np.searchsorted(sizes, sizes + edits, side="right") - first))
    counts = np.diff(ends, prepend=0)
    bags, i = None, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 16), side="right")))
        nth, b = _ranges(first[i:j], counts[i:j])
        a = nth + i
        ok = root[a] != root[b]
        if two:
            ok &= sides[a] != sides[b]
        a, b = a[ok], b[ok]
        ok = ~(masks[a] & masks[b]).any(axis=1)
        a, b = a[ok], b[ok]
        if bags is None and len(a):
            bags = _all_bags(texts)
        for at in range(0, len(a), COMPARED):
            x, y = a[at : at + COMPARED], b[at : at + COMPARED]
            ok = (root[x] != root[y]) & (np.abs(bags[x] - bags[y]).sum(axis=1) <= 4 * edits[x])
            yield x[ok], y[ok]
        i = j


def crossed(cells: Iterable[tuple[np.ndarray, np.ndarray, list[str], tuple[np.ndarray, np.ndarray], np.ndarray]]) -> Iterator[list[tuple[int, int]]]:
    """Links between lines of unlike components (and of unlike sides, if there are two), as many as
    join these, of cells (lines, component, texts, earlier, sides). Lines that share an ``earlier`` key (which line,
    and key) meet there. Pairs of several cells are compared together, most cells having few of them."""
    waiting: list[tuple] = []

    def compare() -> list[tuple[int, int]]:
        near = iter(_edited([t for w in waiting for t in w[5]], [t for w in waiting for t in w[6]]).tolist())
        out = []
        for root, lines, other, a, b, *_ in waiting:
            for x, y, i, j, ok in zip(lines, other, a, b, near):  # noqa: B905
                if ok and root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    out.append((x, y))
        waiting.clear()
        return out

    n = 0
    for lines, component, texts, earlier, sides in cells:
        order = np.argsort([len(t) for t in texts], kind="stable")
        place = np.empty(len(order), dtype=np.intp)
        place[order] = np.arange(len(order))
        lines, texts = lines[order], [texts[i] for i in order]
        _, root = np.unique(component[order], return_inverse=True)
        for a, b in _fitting(root, texts, (place[earlier[0]], earlier[1]), sides[order]):
            if len(a):
                x, y = lines[a].tolist(), lines[b].tolist()
                a, b = a.tolist(), b.tolist()
                waiting.append((root, x, y, a, b, [texts[i] for i in a], [texts[i] for i in b]))
                n += len(a)
            if n >= COMPARED:
                yield compare()
                n = 0
    yield compare()


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: links within cells of crowded keys; the rows of a cell come together."""
    now, held = None, []

    def solve() -> Iterator[tuple]:
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        held.clear()
        if rows is not None and len(rows) > 1:
            keys = pc.list_flatten(rows["keys"]).to_numpy()
            of = np.repeat(np.arange(len(rows)), pc.list_value_length(rows["keys"]).to_numpy())
            before = keys < now[0]
            yield rows["a"].to_numpy(), rows["component"].to_numpy(), rows["text"].to_pylist(), (of[before], keys[before]), rows["side"].to_numpy()

    def cells() -> Iterator[tuple]:
        nonlocal now
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], axis=1)
            starts = [*np.nonzero((names[1:] != names[:-1]).any(axis=1))[0] + 1]
            for i, j in zip([0, *starts], [*starts, len(names)], strict=True):
                if i == j:
                    continue
                if (cell := tuple(names[i].tolist())) != now:
                    yield from solve()
                    now = cell
                held.append(batch.slice(i, j - i))
        yield from solve()

    for found in crossed(cells()):
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])


def _bags(lines: list[str]) -> np.ndarray:
    """Counts of pairs of characters by 128 groups: an edit changes a line's counts by 4 at most."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4")
    sizes = np.array([len(x) for x in lines])
    two = (codes[:-1] * np.uint32(37) + codes[1:] & np.uint32(127)).astype(np.int64) + np.repeat(np.arange(len(lines)) * 128, sizes)[:-1]
    inside = np.ones(len(two), dtype=bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    return np.bincount(two[inside], minlength=128 * len(lines)).reshape(-1, 128).astype(np.int16)


def _all_bags(lines: list[str]) -> np.ndarray:
    """``_bags`` of many lines, long ones by and by."""
    ends = np.cumsum([len(x) for x in lines])
    cuts = np.unique([*np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)), len(lines)])
    return np.concatenate([_bags(lines[i:j]) for i, j in zip([0, *cuts], cuts) if i < j])  # noqa: B905


def _edited(left: list[str], right: list[str]) -> np.ndarray:
    """Which pairs of lines, whose lengths differ by no more than the edits, are near by their edit distance."""
    near = np.zeros(len(left), dtype=bool)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
    edits = edits_of(sizes.min(axis=1))
    order = np.argsort(sizes.max(axis=1), kind="stable")
    for few in (order[edits[order] < BAND // 2], order[(edits[order] >= BAND // 2) & (edits[order] < BAND)]):
        for at in range(0, len(few), 2048):
            part = few[at : at + 2048]
            near[part] = banded([tuple(sorted((left[i], right[i]), key=len)) for i in part.tolist()], edits[part]) <= edits[part]
    for i in order[edits[order] >= BAND].tolist():
        near[i] = within(left[i], right[i], int(edits[i]))
    return near


def near_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """Which pairs of lines are near."""
    near = np.zeros(len(left), dtype=bool)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
    least, most = sizes.min(axis=1), sizes.max(axis=1)
    edits = edits_of(least)
    some = np.nonzero(most - least <= edits)[0]
    some = some[np.argsort(most[some], kind="stable")]
    fit = [some[:0]]
    for at in range(0, len(some), 2048):
        part = some[at : at + 2048]
        fit.append(part[np.abs(_bags([left[i] for i in part]) - _bags([right[i] for i in part])).sum(axis=1) <= 4 * edits[part]])
    some = np.concatenate(fit)
    near[some] = _edited([left[i] for i in some], [right[i] for i in some])
    return near


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = near_pairs(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


# Lines of documents -------------------------------------------------------------------------------

_NAMED = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("text_md5", pa.binary()), ("chars", pa.int64()), ("lines", pa.list_(pa.struct([("nth", pa.int32()), ("line", pa.int64()), ("check", pa.int64())]))), ("block", pa.int32()), ("grams", pa.binary())])
_NAMED_DDL = "doc_id long, uid long, text_md5 binary, chars long, lines array<struct<nth:int,line:long,check:long>>, block int, grams binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end some with a task's counts of grams by group, in blocks of these."""
    grams = np.zeros(GROUPS, dtype=np.int64)
    waiting: dict[int, list[str]] = {}
    chars: dict[int, int] = {}

    def count(k: int) -> None:
        h = _rolled(_codes(waiting.pop(k)), k)
        grams[:] += np.bincount(_group_of(h), minlength=GROUPS)
        chars[k] = 0

    for batch in batches:
        md5s, chars_, nths, ends = [], [], [], [0]
        names, checks = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for at in range(0, batch.num_rows, SPLIT):
            lines = []
            for text in batch.column("text").slice(at, SPLIT).to_pylist():
                md5s.append(None if text is None else hashlib.md5(text.encode()).digest())
                chars_.append(len(text or ""))
                for nth, line in enumerate((text or "").split("\n")):
                    if line.strip(SPACE):
                        nths.append(nth)
                        lines.append(line)
                ends.append(len(nths))
            names.append(_names(lines))
            checks.append(np.array([xxhash.xxh64_intdigest(x, 1) for x in lines], dtype=np.uint64))
            for line in lines:
                if (size := len(line)) < SHORTEST:
                    continue
                k = _gram_of(size)
                for _, piece in ((0, line),) if size <= PIECE else _pieces(line):
                    waiting.setdefault(k, []).append(piece)
                    chars[k] = chars.get(k, 0) + len(piece)
                    if chars[k] >= CHARS:
                        count(k)
        one = pa.StructArray.from_arrays([pa.array(nths, pa.int32()), pa.array(np.concatenate(names)), pa.array(np.concatenate(checks).view(np.int64))], fields=list(_NAMED.field("lines").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one, type=_NAMED.field("lines").type)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), pa.array(md5s, pa.binary()), pa.array(chars_, pa.int64()), lists, pa.nulls(len(md5s), pa.int32()), pa.nulls(len(md5s), pa.binary())], schema=_NAMED)
    for k in list(waiting):
        count(k)
    if grams.any():
        yield pa.RecordBatch.from_pylist([{"block": i, "grams": x.tobytes()} for i, x in enumerate(np.split(grams, GROUPS // BLOCK))], schema=_NAMED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a block of groups, from all rows of it that a task has."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, grams in zip(batch.column("block").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            sums[block] = sums.get(block, 0) + np.frombuffer(grams, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "grams"])


def _hashed(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """uid, doc_id, text_md5 and hashes (nth, line, check) of the lines with a word; and the rank of
    each group of grams by its count, the rarest first."""
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("uid"), "text")
    both = cut(rows.mapInArrow(_describe, _NAMED_DDL), "lines-names", docs.count(), TEXT_ROWS)
    counts = np.zeros(GROUPS, dtype=np.int64)
    grams = both.where("block is not null").select("block", "grams").mapInArrow(_summed, "block int, grams binary")
    for r in grams.repartition("block").mapInArrow(_summed, "block int, grams binary").collect():
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["grams"], dtype=np.int64)
    ranks = np.empty(GROUPS, dtype=np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(GROUPS, dtype=np.uint64)
    return both.where("uid is not null").drop("block", "grams"), ranks


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """line, text of the wanted lines. A map of their names, of a fixed size, keeps most others from
    leaving their task; the join keeps the rest out."""
    shared = name_map(wanted, "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = on_map(shared)
        recent: set[int] = set()
        for batch in batches:
            names, texts = [], []
            for some in _split(batch.column("text")):
                lines = [x for split in some for x in split if len(x) >= SHORTEST]
                found = _names(lines)
                for i in np.nonzero(asked[found % MAP_BITS])[0].tolist():
                    if (name := int(found[i])) not in recent:
                        if len(recent) >= RECENT:
                            recent.clear()
                        recent.add(name)
                        names.append(name)
                        texts.append(lines[i])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], names=["line", "text"])

    found = docs.select("text").mapInArrow(run, "line long, text string")
    return found.join(wanted.hint("shuffle_hash"), "line", "left_semi").dropDuplicates(["line"])


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    # a line has one row in texts; pairs needn't be sorted with theirs
    rows = pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("text_a")).hint("shuffle_hash"), "a").join(texts.select(F.col("line").alias("b"), F.col("text").alias("text_b")).hint("shuffle_hash"), "b")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(_near, "a long, b long")


def _crowd_links(crowds: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between lines of crowded keys that are in different classes so far; keys of more than
    CELL lines in cells."""
    lines = crowds.groupBy("a").agg(F.collect_list("key").alias("of"))  # no more keys than a line has characters
    rows = lines.join(classes.withColumnRenamed("node", "a"), "a", "left").select("a", F.coalesce("component", "a").alias("component"), F.explode("of").alias("key"))
    rows = cut(rows, "lines-crowds")
    several = rows.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    rows = cut(rows.join(several.where("least <> most").select("key", "parts"), "key"), "lines-crossed")
    each = rows.groupBy("a").agg(F.min("component").alias("component"), F.sort_array(F.collect_list(F.struct("key", "parts"))).alias("of"))
    each = each.join(texts.withColumnRenamed("line", "a"), "a").select("a", "component", "text", F.col("of.key").alias("keys"), F.explode("of").alias("k"))
    each = each.select("a", "component", "text", "keys", "k.*").withColumn("side", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    cells = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "a", "component", "keys", "text")
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cut(cells.mapInArrow(_crossed, "a long, b long"), "lines-more")


def near_lines(docs: DataFrame, ranks: np.ndarray, chars: int, n: int | None = None, crowd: int = CROWD) -> DataFrame:
    """line, component: names of lines with a near-duplicate, and the smallest name of their class.
    ``chars``: of all texts; ``n``: about how many lines there are; ``crowd``: of lines that a segment meets."""
    buckets = chars // BUCKET + 1
    keys = docs.select("text").mapInArrow(_signatures(buckets, ranks), "bucket int, keys binary")
    keys = keys.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = cut(keys.mapInArrow(_pairs(crowd), "a long, b long, key long"), "lines-met")
    pairs = cut(met.where("b is not null").select("a", "b").distinct(), "lines-pairs")
    crowds = met.where("b is null").select("key", "a")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("line")).union(crowds.select("a")).distinct()
    texts = cut(_texts(docs, wanted), "lines-texts", n, TEXT_ROWS)
    classes = cut(components(_links(pairs, texts), "lines-links", n), "lines-linked", n)
    if not crowds.isEmpty():
        more = _crowd_links(crowds, classes, texts)
        if not more.isEmpty():
            classes = components(more.union(classes), "lines-links", n)
    return classes.withColumnRenamed("node", "line")


def _removed(docs: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The named lines of all rows, and uid with the lines that go: nth, and where the first of
    its class is."""
    named, ranks = _hashed(docs)
    n, n_lines, chars = named.agg(F.count("*"), *(F.coalesce(F.sum(x), F.lit(0)) for x in (F.size("lines"), "chars"))).first()
    lines = named.select("uid", "doc_id", F.explode("lines").alias("x")).select("uid", "doc_id", "x.nth", "x.line", "x.check")
    facts = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("check").alias("c1"), F.max("check").alias("c2"))
    facts = facts.where("n > 1").select("line", F.expr("c1 = c2").alias("sound"))
    near = cut(near_lines(docs, ranks, chars, n_lines, crowd), "lines-classes", n_lines)
    # lines that neither repeat nor are near another one stay, and their places aren't looked at
    classes = facts.join(near, "line", "full").where("sound is null or sound").select("line", F.coalesce("component", "line").alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "nth")
    rows = cut(lines.select("line", "uid", "doc_id", "nth").join(classes.hint("shuffle_hash"), "line").select("component", "uid", place.alias("at")), "lines-repeated", n_lines)
    keep = rows.groupBy("component").agg(F.min("at").alias("first"))
    gone = rows.join(keep, "component").where("uid <> first.uid or at.nth <> first.nth")
    each = F.struct(F.col("at.nth").alias("nth"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.nth").alias("first_line"))
    return named, cut(gone.groupBy("uid").agg(F.sort_array(F.collect_list(each)).alias("removed")), "lines-removed", n)


_NONE = "array<struct<nth:int,first_doc_id:bigint,first_line:int>>"


def line_report(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines (with a word), n_removed, and for each
    line removed its place from 0 and the place of the first line of its class."""
    named, gone = _removed(docs, crowd)
    rows = named.select("uid", "doc_id", F.size("lines").cast("long").alias("n_lines")).join(gone, "uid", "left")
    removed = F.coalesce("removed", F.array().cast(_NONE))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` without the lines that go."""
    named, gone = _removed(docs, crowd)
    marked = named.select("uid", "doc_id", "text_md5").join(gone.select("uid", F.col("removed.nth").alias("removed")), "uid", "left")
    of_first = marked.groupBy("doc_id", "text_md5").agg(F.count("*").alias("times"), F.min_by("removed", "uid").alias("removed")).where("removed is not null or times > 1")
    of_first = cut(of_first.withColumnRenamed("doc_id", "id").withColumnRenamed("text_md5", "md5"), "lines-of-rows", named.count())
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.unhex(F.md5("text")).alias("text_md5"))
    rows = rows.join(of_first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_md5") == F.col("md5")), "left")
    rows = rows.select("row", "doc_id", "text", "text_md5", "removed", F.coalesce("times", F.lit(1)).alias("times"))
    text = lambda gone: F.array_join(F.filter(F.split("text", "\n"), gone), "\n")
    cleaned = rows.withColumn("new", F.when(F.col("removed").isNull(), F.col("text")).otherwise(text(lambda x, i: ~F.array_contains("removed", i))))
    if not of_first.where("times > 1").isEmpty():  # every later row of the same id and text repeats all lines
        again = rows.where("times > 1").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_md5").orderBy("doc_id")))
        first = F.when(F.col("removed").isNull(), F.col("text")).otherwise(text(lambda x, i: ~F.array_contains("removed", i)))
        again = again.withColumn("new", F.when(F.col("nth") == 1, first).otherwise(text(lambda x, i: ~x.rlike(r"[^\x20\x09-\x0D]")))).drop("nth")
        cleaned = cleaned.where("times = 1").unionByName(again)
    follow = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return files_for(cleaned.select(*(follow.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)), docs.count(), TEXT_ROWS)
