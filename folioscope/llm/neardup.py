"""Near-duplicate vectors of one label by binary codes of randomly rotated vectors.

A unit vector o is turned by a random rotation; the signs of its coordinates, over the root of the
dimension, are a unit vector too, its code. Stored beside the code is how near both are, f = <code, o>.
For any other unit vector q (turned alike) s = <code, q> then tells about <o, q>:

- s / f is an estimate without bias, whose error is below ``EPSILON`` * sqrt((1 / f^2 - 1) / (d - 1)) but
  for a chance of 2 exp(-EPSILON^2 / 2), about 1e-14;
- the angles at the code give a bound that always holds: the angle between o and q is at least the
  difference of arccos(s) and arccos(f).

A pair whose bounds leave room for the threshold is computed again from the vectors in double
precision, and links by that alone. The second bound loses nothing; the first is the tighter one for
some hundred dimensions and more.

Equal vectors of a label are one node with a number of members. Nodes lie in blocks; each pair of a
label's blocks is a cell, a task's work of fixed size. A cell returns a row for each node that it links,
with the number of links and one tree of edges, never its pairs, so a group of near copies costs rows
in proportion to its size. Every pair of one label meets once: the time is quadratic in a label's
different vectors, as long as no bound between blocks is known.

Defined results: a vector that is null, empty, zero, or holds a null, NaN or infinity links with
nothing, and neither does a row without label or id (without an id: no component, kept); vectors of
other lengths don't link; rows that repeat id and vector are vectors of their own, linked with each
other; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import by_length, finite, matrix
from folioscope.llm.common import cut, with_facts
from folioscope.llm.graph import components

COSINE = 0.93
#: Standard deviations that an estimate may be off.
EPSILON = 8.0
#: Rows of a block at most, and numbers in it.
BLOCK, NUMBERS = 4096, 1 << 22
SLICE, PAIRS = 512, 1 << 15
#: What single precision may be off in <code, q>.
SLACK = 1e-5
SEED = 13

_NODE = "node long, label long, dims int, members long, vector array<double>, code binary, factor double"
_NODE_ARROW = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("dims", pa.int32()), ("members", pa.int64()), ("vector", pa.list_(pa.float64())), ("code", pa.binary()), ("factor", pa.float64())])
_FOUND = "node long, links long, root long"
_FOUND_ARROW = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their lengths; scaled by powers of two first, so that no square leaves the range."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of turned unit vectors, packed, and the factor of each code."""
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def bounds(factor: np.ndarray, dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest <code, q> with which <o, q> can be ``cosine`` or more."""
    at_code, reach = np.arccos(np.clip(factor, -1, 1)), np.arccos(cosine)
    certain = np.cos(np.minimum(at_code + reach, np.pi))
    error = EPSILON * np.sqrt(np.maximum(0, 1 / factor**2 - 1) / max(1, dims - 1))
    return np.maximum(certain, factor * (cosine - error)) - SLACK, np.cos(np.maximum(at_code - reach, 0)) + SLACK


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dims, part in by_length(batch):
            packed, factor = codes(units(matrix(part.column("vector"))) @ rotation(dims))
            columns = [part.column("node"), part.column("label"), pa.array(np.full(len(part), dims, dtype=np.int32)), part.column("members"), part.column("vector"), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(factor)]
            yield pa.RecordBatch.from_arrays(columns, schema=_NODE_ARROW)


def linked_pairs(vectors: np.ndarray, code: np.ndarray, factor: np.ndarray, others: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in the first, in the others) of all pairs of a cosine of at least ``cosine``, a slice at a
    time; if both are the same vectors, each pair once."""
    dims, turned = vectors.shape[1], (others @ rotation(vectors.shape[1])).astype(np.float32)
    least, most = (x.astype(np.float32)[:, None] for x in bounds(factor, dims, cosine))
    for start in range(0, len(vectors), SLICE):
        rows = slice(start, start + SLICE)
        signs = (np.unpackbits(code[rows], axis=1, count=dims).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dims))
        after = start if same else 0
        near = signs @ turned[after:].T
        a, b = np.nonzero((near >= least[rows]) & (near <= most[rows]))
        a, b = a + start, b + after
        if same:
            a, b = a[b > a], b[b > a]
        for k in range(0, len(a), PAIRS):
            x, y = vectors[a[k : k + PAIRS]], others[b[k : k + PAIRS]]
            good = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)) >= cosine
            if good.any():
                yield a[k : k + PAIRS][good], b[k : k + PAIRS][good]


def join_up(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives what the edges (a, b) join the smallest of its labels, in place; a label is a place."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _cell_links(cosine: float):
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        first, second = key[2].as_py(), key[3].as_py()
        block, node, members = (cell.column(c).to_numpy() for c in ("block", "node", "members"))
        vectors, factor = units(matrix(cell.column("vector"))), cell.column("factor").to_numpy()
        code = np.frombuffer(b"".join(cell.column("code").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        left, right = np.nonzero(block == first)[0], np.nonzero(block == second)[0]
        links, labels = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        for a, b in linked_pairs(vectors[left], code[left], factor[left], vectors[right], cosine, first == second):
            a, b = left[a], right[b]
            np.add.at(links, a, members[b])
            np.add.at(links, b, members[a])
            join_up(labels, a, b)
        at = np.nonzero(links)[0]
        return pa.Table.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[labels[at]])], schema=_FOUND_ARROW)

    return run


def _links(nodes: DataFrame, cosine: float) -> DataFrame:
    """node, links (other vectors) and root (another node that it is tied to, or itself), by cell."""
    sizes = nodes.groupBy("dims", "label").agg(F.count("*").alias("n"))
    rows = F.greatest(F.lit(256), F.least(F.lit(BLOCK), F.expr(f"{NUMBERS} div dims")))
    placed = with_facts(nodes, sizes, ["dims", "label"], F.xxhash64("node")).withColumn("blocks", F.ceil(F.col("n") / rows).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("n", "blocks", "other")
    return met.groupBy("dims", "label", "first", "second").applyInArrow(_cell_links(cosine), _FOUND)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = finite("vector") & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("vector", F.when(F.col("sound"), F.transform("vector", lambda x: x + 0.0)))
    rows = cut(rows, "neardup-rows")
    whole = rows.where("sound").groupBy("label", "vector").agg(F.count("*").alias("members"), F.min("vec_id").alias("least"))
    nodes = cut(whole.withColumn("node", F.monotonically_increasing_id()), "neardup-nodes")
    n = nodes.count()
    coded = cut(nodes.select("node", "label", "members", "vector").mapInArrow(_coded, _NODE), "neardup-codes", n)
    found = cut(_links(coded, cosine), "neardup-links")
    n_found = found.count()
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "neardup-components", n_found)
    both = nodes.join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    both = cut(both.select("label", "vector", "component", "least", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "neardup-nodes-linked", n)
    smallest = both.groupBy("component").agg(F.min("least").alias("component_id"))
    both = both.join(smallest, "component").select("label", "vector", "n_links", "component_id")
    linked = rows.where("sound").join(both, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


NEAR_SQL = """WITH RECURSIVE e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS v FROM embeddings),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
 reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
 found AS (SELECT e.vec_id, coalesce(k.n, 0) AS n_links, coalesce(m.least, e.vec_id) AS component_id FROM e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id LEFT JOIN (SELECT node, min(other) AS least FROM reach GROUP BY node) m ON m.node = e.vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM found"""
