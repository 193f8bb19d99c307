"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of 0.75 or more.

Documents with the same words are one node. Shingles are hashed into groups, and a document's group
counts are a point; the overlap of two documents is at most the sum of the smaller counts. That bound
is used twice, and no pair that it admits is lost.

Over all documents, with as many groups as there are hashes: a document of n shingles needs three
quarters of them in common with a partner, so by the bound the two share one of their n / 4 + 1 first
coordinates in any order that holds for all. The order is by how rare the coordinate's coarse group is
in the corpus. Each goes along with the one before it in that order, and documents that share both have met at the
first: a pair meets once for each run of coordinates that it shares. Documents that meet, and whose sizes allow it, are compared by the
counts of GROUPS groups: pairs if a coordinate has up to CROWD documents, else by an R-tree of these,
of which as many pairs go on as connect them. What passes the bound chains into blocks.

Within a block the counts are the points of a packed R-tree; a pair of tree nodes is entered only if the summed minima of their largest coordinates reach the overlap that the similarity
asks for, the same bound holds for pairs of points, and the pairs left are verified on the shingle
sets. A pair in one component already is not verified again, so a group of copies costs about one
verification for each. Blocks of more than ``CELL`` nodes or ``CELL_SHINGLES`` shingles are split into
cells, each of two parts of the block, so no task holds more than two parts. Shingles are compared by
64-bit hashes.

Defined results: words are taken with A-Z in lower case; with fewer than five words the whole
sequence is the one shingle; a null text, or one without words, has an empty set and is linked with
nothing; rows that repeat are linked; null ids count for a component's smallest id only if it has
no other. Other columns are ignored by ``link`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import MAP_BITS, TEXT_ROWS, cut, files_for, name_map, on_map
from folioscope.llm.graph import components

SHINGLE, PERCENT = 5, 75
#: Groups of shingles (coordinates of a point; a power of two), entries of a tree node, nodes and shingles of half a cell.
GROUPS, FANOUT, CELL, CELL_SHINGLES = 2048, 16, 2000, 4_000_000
#: Documents with one key that make a crowd.
CROWD = 64
#: Rows of cells that a task should have at least.
CELL_ROWS = 1000
#: Coarse groups that are counted over the corpus; names that a task remembers; keys held before they go out, and for a bucket.
COARSE, RECENT, HELD, BUCKET = 1 << 16, 200_000, 1 << 19, 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_REMEMBERED = 200_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z, and the six white space characters


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a word sequence's shingles."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_hashes) > _REMEMBERED:
        _hashes.clear()
    x = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    h = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        h = h * _STEP + x[i : len(words) - width + 1 + i]
    h = (h ^ (h >> np.uint64(31))) * _SPREAD
    return np.unique(h ^ (h >> np.uint64(29)))


def first_keys(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of a set's shingles the first in the common order, as many as must hold one that it shares with
    any similar set, in that order."""
    n = len(s) - -(-PERCENT * len(s) // 100) + 1
    order = ranks[(s >> np.uint64(48)).astype(np.intp)] << np.uint64(48) | s & np.uint64((1 << 48) - 1)
    return np.sort(order if n >= len(s) else np.partition(order, n - 1)[:n])


_SETS = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("text_md5", pa.binary()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("name", pa.int64()), ("groups", pa.list_(pa.int64()))])
_SETS_DDL = "doc_id long, uid long, text_md5 binary, n_shingles long, digest binary, name long, groups array<long>"


def _name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end one with a task's counts of shingles by coarse group."""
    counts, held, n = np.zeros(COARSE, dtype=np.int64), [], 0

    def count() -> None:
        nonlocal n
        if held:
            counts[:] += np.bincount((np.concatenate(held) >> np.uint64(48)).astype(np.intp), minlength=COARSE)
        held.clear()
        n = 0

    for batch in batches:
        sizes, digests = [], []
        for text in batch.column("text"):
            words = words_of(text.as_py())
            s = shingles(words)
            sizes.append(len(s))
            digests.append(hashlib.md5(b" ".join(words)).digest() if words else None)
            held.append(s)
            n += len(s)
            if n >= HELD:
                count()
        names = [None if d is None else _name(d) for d in digests]
        own = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.int64()), pa.nulls(len(sizes), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), batch.column("text_md5"), *own], schema=_SETS)
    count()
    if counts.any():
        yield pa.RecordBatch.from_pylist([{"groups": counts.tolist()}], schema=_SETS)


def _before(h: np.ndarray, each: list[int]) -> np.ndarray:
    """For each key of documents with so many each the one before it; 0 for a document's first."""
    before = np.concatenate([np.zeros(1, dtype=np.uint64), h])[: len(h)]
    before[np.concatenate([[0], np.cumsum(each)])[:-1].astype(np.intp)] = 0
    return before


def _packed(h: np.ndarray, names: np.ndarray, sizes: np.ndarray, buckets: int, before: np.ndarray | None = None) -> pa.RecordBatch:
    """bucket, keys: hashes by bucket, many to a row, in order and as differences, with names, sizes and the
    hash before each in its document's order (0: none)."""
    order = np.argsort(h)
    before = np.zeros(len(h), dtype=np.uint64) if before is None else before[order]
    h, names, sizes = h[order], names[order], sizes[order].astype(np.uint32)
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    key = (h * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)  # what the bucket leaves of the hash
    edges = [*np.nonzero(np.diff(bucket, prepend=-1))[0].tolist(), len(h)]
    steps = np.diff(key, prepend=np.uint32(0))
    steps[edges[:-1]] = key[edges[:-1]]
    blobs = [(j - i).to_bytes(4, "little") + pa.compress(steps[i:j].tobytes() + sizes[i:j].tobytes() + names[i:j].tobytes() + before[i:j].tobytes(), codec="zstd", asbytes=True) for i, j in zip(edges, edges[1:])]  # noqa: RUF007
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "keys"])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    flat = pa.decompress(data[4:], 24 * n, codec="zstd", asbytes=True)
    steps, sizes = (np.frombuffer(flat, dtype=np.uint32, count=n, offset=4 * n * i) for i in range(2))
    return np.cumsum(steps, dtype=np.uint32), sizes, np.frombuffer(flat, dtype=np.int64, count=n, offset=8 * n), np.frombuffer(flat, dtype=np.uint64, count=n, offset=16 * n)


def _first_keys(buckets: int, ranks: np.ndarray):
    """The first keys of all documents; those of one word sequence once for a task while it is remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            each = [len(k) for k, *_ in held]
            h = np.concatenate([k for k, *_ in held]) * _STEP
            h = (h ^ (h >> np.uint64(32))) * _SPREAD
            out = _packed(h, np.repeat(np.array([x[1] for x in held], dtype=np.int64), each), np.repeat(np.array([x[2] for x in held]), each), buckets, _before(h, each))
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if not words or (name := _name(hashlib.md5(b" ".join(words)).digest())) in recent:
                    continue
                if len(recent) >= RECENT:
                    recent.clear()
                recent.add(name)
                s = shingles(words)
                held.append((first_keys(s, ranks), name, len(s)))
                n += len(held[-1][0])
                if n >= HELD:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return run


def meet(key: np.ndarray, size: np.ndarray, name: np.ndarray, before: np.ndarray, crowd: int) -> tuple[np.ndarray, ...]:
    """Names of pairs of documents that share a key and whose sizes allow a link; and key and name of
    the documents of keys that more than ``crowd`` have. Documents that share the key before, too, meet
    there and not again: so the pairs of near copies don't grow with the number of keys and buckets."""
    v = np.sort(key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
    same = (v[1:] >> np.uint64(32)) == (v[:-1] >> np.uint64(32))
    some = np.append(same, False) | np.append(False, same)
    at = (v & np.uint64(0xFFFFFFFF)).astype(np.intp)[some[: len(v)]]
    key, size, name, before = key[at], size[at].astype(np.int64), name[at], before[at]
    order = np.lexsort((name, key.astype(np.uint64) << np.uint64(32) | size.astype(np.uint64)))
    order = order[np.append(True, (key[order][1:] != key[order][:-1]) | (name[order][1:] != name[order][:-1]))[: len(order)]]
    key, size, name, before = key[order], size[order], name[order], before[order]
    starts = np.nonzero(np.append(True, key[1:] != key[:-1])[: len(key)])[0]
    n = np.diff(starts, append=len(key))
    a, b = [], []
    for k in np.unique(n[(n > 1) & (n <= crowd)]).tolist():  # all keys with so many documents together
        group = starts[n == k][:, None] + np.arange(k)
        i, j = np.triu_indices(k, 1)
        x, y = group[:, i].ravel(), group[:, j].ravel()
        ok = (100 * size[x] >= PERCENT * size[y]) & ((before[x] != before[y]) | (before[x] == 0))
        a.append(np.minimum(name[x[ok]], name[y[ok]]))
        b.append(np.maximum(name[x[ok]], name[y[ok]]))
    a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (a, b))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    crowded = np.repeat(n > crowd, n)
    return a[new], b[new], key[crowded].astype(np.int64), name[crowded]


def _meet(crowd: int):
    """a, b: pairs that meet; or a and key, without b: a document of a crowded key. The rows of a bucket come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            if held:
                a, b, key, name = meet(*(np.concatenate(x) for x in zip(*held, strict=True)), crowd)
                held.clear()
                columns = [np.append(a, name), pa.concat_arrays([pa.array(b), pa.nulls(len(key), pa.int64())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array((np.int64(now) << 32) + key)])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "key"])

        for batch in batches:
            for bucket, keys in zip(batch.column("bucket").to_pylist(), batch.column("keys"), strict=True):
                if bucket != now:
                    yield from solve()
                    now = bucket
                held.append(_unpacked(keys.as_py()))
        yield from solve()

    return run


def point(s: np.ndarray) -> bytes:
    """A set's counts by group, compressed; a count that is as high as it can be stands for any."""
    counts = np.minimum(np.bincount((s % np.uint64(GROUPS)).astype(np.intp), minlength=GROUPS), 0xFF)
    return pa.compress(counts.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def _points_in(column: pa.Array) -> np.ndarray:
    flat = b"".join(pa.decompress(x, GROUPS, codec="zstd", asbytes=True) for x in column.to_pylist())
    found = np.frombuffer(flat, dtype=np.uint8).reshape(-1, GROUPS).astype(np.int32)
    found[found == 0xFF] = 1 << 24
    return found


def _points(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, size, point of the documents of the wanted names."""
    shared = name_map(wanted, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, recent = on_map(shared), set()
        for batch in batches:
            found: list[tuple[int, int, bytes]] = []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if words and asked[(name := _name(hashlib.md5(b" ".join(words)).digest())) % MAP_BITS] and name not in recent:
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(name)
                    s = shingles(words)
                    found.append((name, len(s), point(s)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["a", "size", "point"])

    return docs.select("text").mapInArrow(run, "a long, size long, point binary").join(wanted.hint("shuffle_hash"), "a", "left_semi").dropDuplicates(["a"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that the bound admits."""
    for batch in batches:
        keep = []
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            overlap = np.minimum(_points_in(some.column("point")), _points_in(some.column("point_b"))).sum(axis=1, dtype=np.int64)
            keep.append(_enough(overlap, some.column("size").to_numpy() + some.column("size_b").to_numpy()))
        yield batch.select(["a", "b"]).filter(pa.array(np.concatenate([np.zeros(0, dtype=bool), *keep])))


def _crowd_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the documents of a crowded key (or of a cell of them) as many pairs that the bound admits as
    connect them; the rows of a cell come together."""
    now, held = None, []

    def solve() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held)
            held.clear()
            names, sizes = rows["a"].to_numpy(), rows["size"].to_numpy()
            root, out = np.arange(len(names)), []
            for i, j in CountTree(_points_in(rows["point"].combine_chunks()), sizes).pairs(root):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if root[x] != root[y]:
                        root[root == root[y]] = root[x]
                        out.append(sorted((int(names[x]), int(names[y]))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    for batch in batches:
        cells = np.stack([batch.column(c).to_numpy() for c in ("key", "low", "high")])
        edges = [0, *(np.nonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:]):  # noqa: RUF007
            if j > i:
                if (cell := tuple(cells[:, i].tolist())) != now:
                    yield from solve()
                    now = cell
                held.append(batch.slice(i, j - i).select(["a", "size", "point"]))
    yield from solve()


def _enough(overlap, sizes):
    """100 * overlap >= PERCENT * union, where sizes is the sum of both."""
    return (100 + PERCENT) * overlap >= PERCENT * sizes


class CountTree:
    """A packed R-tree over count vectors: boxes of FANOUT entries each, level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes))  # packed by size first, then by heaviest group
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes, self.sizes)]  # largest coordinates, smallest and largest size
        while len(self.levels[-1][0]) > FANOUT:
            most, low, high = self.levels[-1]
            at = np.arange(0, len(most), FANOUT)
            self.levels.append((np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def _children(self, level: int, box: int) -> slice:
        return slice(box * FANOUT, min(len(self.levels[level][0]), (box + 1) * FANOUT))

    def pairs(self, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index arrays (into the input) of pairs whose bound passes, leaf pair by leaf pair. ``root``:
        which points are connected, kept up to date by the caller; such pairs are left out."""
        top = len(self.levels) - 1
        stack = [(top, slice(0, len(self.levels[top][0])), slice(0, len(self.levels[top][0])))]
        while stack:
            level, a, b = stack.pop()
            most, low, high = self.levels[level]
            fits = (100 * high[a, None] >= PERCENT * low[None, b]) & (100 * high[None, b] >= PERCENT * low[a, None])
            i, j = np.nonzero(fits)
            i, j = i + a.start, j + b.start
            if a == b:
                i, j = i[i <= j], j[i <= j]
            if level == 0 and root is not None:
                apart = root[self.order[i]] != root[self.order[j]]
                i, j = i[apart], j[apart]
            bound = np.minimum(most[i], most[j]).sum(axis=1, dtype=np.int64)
            ok = _enough(bound, low[i] + low[j])
            i, j = i[ok], j[ok]
            if level == 0:
                i, j = i[i < j], j[i < j]
                if len(i):
                    yield self.order[i], self.order[j]
            else:
                stack += [(level - 1, self._children(level - 1, x), self._children(level - 1, y)) for x, y in zip(i.tolist(), j.tolist(), strict=True) if x <= y]


def spanning_links(sets: list[np.ndarray], sides: np.ndarray) -> list[int]:
    """For each set the first of its component, by links between sets (of unlike sides, if a cell
    has two; equal sides are another cell's)."""
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root.tolist()
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes) * GROUPS + (np.concatenate(sets) % np.uint64(GROUPS)).astype(np.int64)
    points = np.bincount(of, minlength=GROUPS * len(sets)).reshape(len(sets), GROUPS).astype(np.int32)
    two = len(set(sides.tolist())) > 1
    for i, j in CountTree(points, sizes).pairs(root):
        keep = root[i] != root[j]
        if two:
            keep &= sides[i] != sides[j]
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if root[x] != root[y]:
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if _enough(both, sizes[x] + sizes[y]):
                    a, b = sorted((root[x], root[y]))
                    root[root == b] = a
    return root.tolist()


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each cell; the rows of a cell come together."""
    cell, held = None, {}

    def solved() -> pa.RecordBatch:
        nodes = sorted(held)
        root = spanning_links([held[n][0] for n in nodes], np.array([held[n][1] for n in nodes]))
        linked = [(n, nodes[r], cell[1] != cell[2] or held[n][2]) for n, r in zip(nodes, root, strict=True) if nodes[r] != n]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "split"])

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["block"], row["low"], row["high"])
            if key != cell:
                if len(held) > 1:
                    yield solved()
                cell, held = key, {}
            words = words_of(row["text"])
            if hashlib.md5(b" ".join(words)).digest() == row["digest"]:  # a repeated id can bring another text
                held[row["node"]] = (shingles(words), row["side"], row["parts"] > 1)
    if len(held) > 1:
        yield solved()


def _nodes(info: DataFrame, n: int) -> DataFrame:
    some = info.where("n_shingles > 0").groupBy("digest")
    return cut(some.agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id"), F.min("name").alias("name"), F.min("n_shingles").alias("n_shingles"), F.min(F.struct("uid", "doc_id", "text_md5")).alias("at")), "join-nodes", n, 10 * TEXT_ROWS)


def _ties_of(crowds: DataFrame, points: DataFrame) -> DataFrame:
    """The ties of crowded keys; keys of more than CELL documents in cells."""
    parts = crowds.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    rows = crowds.join(parts, "key").join(points, "a").withColumn("side", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "a", "size", "point")
    cells = cells.repartition(crowds.count() // CELL_ROWS + 1, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cells.mapInArrow(_crowd_ties, "a long, b long")


def _links(docs: DataFrame, nodes: DataFrame, n: int, ranks: np.ndarray, crowd: int) -> DataFrame:
    """node, component, for all nodes with a link."""
    keys = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0] * (100 - PERCENT) // 100
    buckets = keys // BUCKET + 1
    packed = docs.select("text").mapInArrow(_first_keys(buckets, ranks), "bucket int, keys binary")
    packed = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    met = cut(packed.mapInArrow(_meet(crowd), "a long, b long, key long"), "join-met")
    pairs = cut(met.where("b is not null").select("a", "b").distinct(), "join-pairs")
    crowds = met.where("b is null").select("key", "a")
    points = cut(_points(docs, pairs.select(F.explode(F.array("a", "b")).alias("a")).union(crowds.select("a")).distinct()), "join-points")
    others = points.withColumnsRenamed({"a": "b", "size": "size_b", "point": "point_b"})
    admitted = pairs.join(points, "a").join(others, "b").mapInArrow(_bounded, "a long, b long")
    if not crowds.isEmpty():
        admitted = admitted.union(_ties_of(crowds, points))
    named = components(admitted, "join-ties").withColumnRenamed("node", "name").withColumnRenamed("component", "block")
    blocks = cut(named.join(nodes.select("name", "node", "n_shingles"), "name").select("node", "block", "n_shingles"), "join-blocks", n)
    size = blocks.count()
    parts = blocks.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / CELL, F.sum("n_shingles") / CELL_SHINGLES)).cast("int").alias("parts"))
    blocks = blocks.drop("n_shingles")
    member = blocks.join(parts, "block").join(nodes.select("node", "digest", "at"), "node")
    side = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    member = member.select("block", "parts", "node", "digest", F.col("at.doc_id").alias("id"), F.col("at.text_md5").alias("md5"), side.alias("side"))
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_md5"))
    texts = texts.join(member, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_md5") == F.col("md5")))
    cells = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("block", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "parts", "node", "digest", "text")
    cells = cells.repartition(size // CELL_ROWS + 1, "block", "low", "high").sortWithinPartitions("block", "low", "high")
    links = cut(cells.mapInArrow(_solve, "a long, b long, split boolean"), "join-links", n, TEXT_ROWS)
    whole = links.where("not split").select(F.col("a").alias("node"), F.col("b").alias("component"))
    whole = whole.union(whole.select("component", "component").distinct())
    split = links.where("split")
    return whole if split.isEmpty() else whole.union(components(split.select("a", "b"), "join-split", n))


def _described(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """All rows described, and the rank of each coarse group by its count, the rarest first."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.unhex(F.md5("text")).alias("text_md5"), F.monotonically_increasing_id().alias("uid"))
    both = cut(rows.mapInArrow(_describe, _SETS_DDL), "join-sets", docs.count(), TEXT_ROWS)
    counts = np.zeros(COARSE, dtype=np.int64)
    for r in both.where("groups is not null").select(F.posexplode("groups").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    ranks = np.empty(COARSE, dtype=np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(COARSE, dtype=np.uint64)
    return both.where("uid is not null").drop("groups"), ranks


def _grouped(docs: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """All rows described, and digest, component, least_id for all nodes."""
    info, ranks = _described(docs)
    n = info.count()
    nodes = _nodes(info, n)
    own = nodes.select("digest", "node", "least_id", "at")
    labels = _links(docs, nodes, n, ranks, crowd)
    labelled = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return info, cut(labelled, "join-labels", n)


def link(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    info, labelled = _grouped(docs, crowd)
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = labelled.join(least, "component").select("digest", "component_id")
    out = info.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the first of those with its
    smallest id. Rows without words all stay."""
    info, labelled = _grouped(docs, crowd)
    n = info.count()
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_md5")
    best = info.where("n_shingles > 0").join(labelled.select("digest", "component"), "digest").groupBy("component").agg(F.min(order).alias("best"))
    best = cut(best.select(F.col("best.doc_id").alias("best_id"), F.col("best.text_md5").alias("best_md5")), "join-kept", n)
    times = info.where("n_shingles > 0").groupBy("doc_id", "text_md5").agg(F.count("*").alias("n")).where("n > 1")
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.unhex(F.md5("text")).alias("text_md5"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    kept = rows.where("worded").join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_md5") == F.col("best_md5")), "left_semi")
    if not times.isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc_id", "text_md5").orderBy("doc_id"))
        kept = kept.withColumn("nth", nth).where("nth = 1")
    return files_for(kept.select("row.*").unionByName(rows.where("not worded").select("row.*")), n, TEXT_ROWS)


LINK_SQL = """WITH RECURSIVE w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
 both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(w.doc_id, m.least), w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) m ON m.node = w.doc_id"""
