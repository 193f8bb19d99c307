"""Hard negatives by bit-sliced integer products.

Components become integers, floor(256 x). Rows are taken apart into bit-planes, the sign first. After
each plane the products of anchors with what is known of the rows, and the sums of the anchors'
positive and negative components for what is not, give an interval for every score. It halves from
plane to plane, and a pair is dropped as soon as its interval can't qualify any more: for positives,
when enough others are certainly better; for negatives, when it misses all windows, or enough others
are certainly in each window and better. What is left when few pairs are is finished exactly.

Rows lie in blocks and anchors in groups; a block and a group make a cell, a task's work of fixed size.
Positives are sought in cells of one label, negatives in cells of all rows, with the anchor's windows (five
at most) beside it. A cell returns no more than k rows for each anchor and window, and the best of these
over all cells are found by a window function. Every anchor meets every row, since the result is exact.

Defined results: rows without id or label, with a null vector, or with a null, NaN or infinite component
take no part; only vectors of the anchor's length are compared; rows that repeat id, label and vector
are rows of their own (each may be a positive or negative of the others, and each is an anchor);
scores beyond a long count as the largest or smallest long; an anchor without other rows of its label
has no result; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.arrays import finite, matrix
from folioscope.llm.common import cut, with_facts

SCALE = 256
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK, GROUP, NUMBERS = 4096, 2048, 1 << 22
SLICE, PAIRS = 128, 1 << 15
LONG = (-(1 << 63), (1 << 63) - 1)

_BEST = "anchor long, of_score long, vec_id long, score long, copies long"
_BEST_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in _BEST.split(", ")])


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x): int64, or Python's integers where that is too small."""
    floors = np.floor(SCALE * vectors)
    if not floors.size or np.abs(floors).max() < 2.0**62:
        return floors.astype(np.int64)
    exact = [[int(SCALE) * n // d for n, d in (float(v).as_integer_ratio() for v in row)] for row in vectors]
    return np.array(exact, dtype=object).reshape(vectors.shape)


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, as a column; -inf where there are fewer."""
    m = values.shape[1]
    if m < k:
        return np.full((len(values), 1), -np.inf)
    at = m - k
    return (np.sort(values, axis=1) if values.dtype == object else np.partition(values, at, axis=1))[:, at : at + 1]


def best(k: int) -> Callable:
    """Keeps what may be among the k best."""

    def keep(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray) -> np.ndarray:
        return alive & (upper >= kth_largest(np.where(alive, lower, -np.inf), k))

    return keep


def within(low: np.ndarray, high: np.ndarray, k: int) -> Callable:
    """Keeps what may be among the k best of a window; low and high: [anchor, window]."""

    def keep(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray) -> np.ndarray:
        some = np.zeros(alive.shape, dtype=bool)
        for w in range(low.shape[1]):
            lo, hi = low[:, w : w + 1], high[:, w : w + 1]
            certain = alive & (lower >= lo) & (upper <= hi)
            enough = kth_largest(np.where(certain, lower, -np.inf), k)
            some |= (upper >= np.maximum(enough, lo)) & (lower <= hi)
        return alive & some

    return keep


def narrowed(anchors: np.ndarray, rows: np.ndarray, eligible: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors and rows, and scores, of all pairs that ``keep`` leaves."""
    dims = anchors.shape[1]
    size = lambda x: int(np.abs(x).max()) if x.size else 0
    plain = anchors.dtype != object and rows.dtype != object and dims * size(anchors) * max(1, size(rows)) < 1 << 52
    if plain:
        a, low, high = anchors.astype(np.float32 if dims * size(anchors) < 1 << 24 else np.float64), np.minimum(anchors, 0).sum(axis=1).astype(np.float64), np.maximum(anchors, 0).sum(axis=1).astype(np.float64)
        product, held = lambda plane: (a @ plane.astype(a.dtype).T).astype(np.float64), lambda x: x
    else:
        a, rows = anchors.astype(object), rows.astype(object)
        low, high = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
        product, held = lambda plane: a @ plane.T, lambda x: np.minimum(np.maximum(x, LONG[0]), LONG[1])
    low, high = np.reshape(low, (-1, 1)), np.reshape(high, (-1, 1))
    at, alive, partial, sign = np.arange(len(rows)), eligible, 0, size(rows).bit_length()
    for bit in range(sign, -1, -1):
        plane = rows[at] >> bit
        partial = partial + product(plane if bit == sign else plane & 1) * (1 << bit)
        rest = (1 << bit) - 1
        alive = keep(held(partial + rest * low), held(partial + rest * high), alive)
        if alive.sum() * 8 <= alive.size:
            break
        used = alive.any(axis=0)
        if used.sum() * 2 < len(used):
            at, alive, partial = at[used], alive[:, used], partial[:, used]
    ia, ix = np.nonzero(alive)
    known, left = partial[ia, ix], []
    for k in range(0, len(ia), PAIRS):
        part = slice(k, k + PAIRS)
        left.append((anchors[ia[part]] * (rows[at[ix[part]]] & rest)).sum(axis=1))
    scores = held(known + np.concatenate(left)) if left else np.zeros(0)
    return ia, at[ix], scores.astype(np.int64)


def first_of_each(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: by falling score, then by id."""
    order = np.lexsort((ids, ~scores, groups))  # ~ falls as the score rises, and can't overflow
    sorted_groups = groups[order]
    start = np.searchsorted(sorted_groups, sorted_groups, side="left")
    return order[np.arange(len(order)) - start < k]


def _sides(cell: pa.Table) -> tuple[dict, dict]:
    """Rows and anchors of a cell as arrays."""
    role, vectors = cell.column("role").to_numpy(), integers(matrix(cell.column("vector")))
    columns = {c: cell.column(c).to_numpy() for c in ("node", "vec_id", "label", "copies")}
    parts = []
    for r in (0, 1):
        at = np.nonzero(role == r)[0]
        parts.append({c: v[at] for c, v in columns.items()} | {"vector": vectors[at], "windows": [cell.column("windows")[i].as_py() or [] for i in at.tolist()] if r else None})
    return tuple(parts)


def _table(anchor: np.ndarray, of_score: np.ndarray, vec_id: np.ndarray, score: np.ndarray, copies: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (anchor, of_score, vec_id, score, copies)], schema=_BEST_ARROW)


def _positives_in_cell(k: int):
    def run(cell: pa.Table) -> pa.Table:
        rows, anchors = _sides(cell)
        out = [_BEST_ARROW.empty_table()]
        for start in range(0, len(anchors["node"]), SLICE):
            nodes = anchors["node"][start : start + SLICE]
            own = nodes[:, None] == rows["node"][None, :]
            ia, ix, scores = narrowed(anchors["vector"][start : start + SLICE], rows["vector"], ~own | (rows["copies"] > 1)[None, :], best(k))
            first = first_of_each(ia, scores, rows["vec_id"][ix], k)
            ia, ix, scores = ia[first], ix[first], scores[first]
            out.append(_table(nodes[ia], scores, rows["vec_id"][ix], scores, rows["copies"][ix] - own[ia, ix]))
        return pa.concat_tables(out)

    return run


def _negatives_in_cell(k: int):
    def run(cell: pa.Table) -> pa.Table:
        rows, anchors = _sides(cell)
        out = [_BEST_ARROW.empty_table()]
        for start in range(0, len(anchors["node"]), SLICE):
            part = slice(start, start + SLICE)
            nodes, windows = anchors["node"][part], anchors["windows"][part]
            widest = max(map(len, windows))
            low, high = np.ones((len(nodes), widest)), np.zeros((len(nodes), widest))
            if any(abs(p) > 1 << 50 for w in windows for p in w):
                low, high = low.astype(object), high.astype(object)
            for i, w in enumerate(windows):
                for j, p in enumerate(w):
                    low[i, j], high[i, j] = -(-LOW * p // 100), HIGH * p // 100
            eligible = anchors["label"][part][:, None] != rows["label"][None, :]
            ia, ix, scores = narrowed(anchors["vector"][part], rows["vector"], eligible, within(low, high, k))
            for w in range(widest):
                at = np.nonzero((scores >= low[ia, w]) & (scores <= high[ia, w]))[0]
                at = at[first_of_each(ia[at], scores[at], rows["vec_id"][ix[at]], k)]
                of_score = np.array([windows[i][w] for i in ia[at].tolist()], dtype=np.int64)
                out.append(_table(nodes[ia[at]], of_score, rows["vec_id"][ix[at]], scores[at], rows["copies"][ix[at]]))
        return pa.concat_tables(out)

    return run


def _cells(rows: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Rows (role 0) and anchors (role 1) by cell: the keys ``by``, block and group."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    asked = anchors.groupBy(*by).agg(F.count("*").alias("m"))
    at_most = F.greatest(F.lit(256), F.least(F.lit(BLOCK), F.expr(f"{NUMBERS} div greatest(1, dims)")))
    cells = sizes.join(asked, by).select(*by, F.ceil(F.col("n") / at_most).cast("int").alias("blocks"), F.ceil(F.col("m") / F.lit(GROUP)).cast("int").alias("groups"))
    salt = lambda of: F.pmod(F.xxhash64("node", F.lit(1)), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    met = lambda df: with_facts(df, cells, by, F.xxhash64("node"))
    left = met(rows.withColumn("windows", F.lit(None).cast("array<long>"))).withColumns({"role": F.lit(0), "block": salt("blocks")}).withColumn("group", every("groups"))
    right = met(anchors).withColumns({"role": F.lit(1), "group": salt("groups")}).withColumn("block", every("blocks"))
    columns = [*dict.fromkeys([*by, "block", "group", "role", "node", "vec_id", "label", "copies", "vector", "windows"])]
    return left.select(*columns).unionByName(right.select(*columns))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each key, by falling score and id, where a row counts as often as it has copies:
    with ``before`` (how many come before it) and ``times`` (how many of it are among the k)."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    rows = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    before = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    return rows.withColumn("times", F.least(F.col("copies"), k - F.col("before"))).drop("n", "copies")


def _repeated(times: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), times - 1))


def hard_negatives(vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of ``vectors``
    (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(finite("vector") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("vector", lambda x: x + 0.0).alias("vector"))
    rows = rows.groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("node"), "*", F.size("vector").alias("dims")), "negatives-rows")
    anchors = rows.where(F.col("vec_id") % every == 0)

    cells = _cells(rows, anchors.withColumn("windows", F.lit(None).cast("array<long>")), ["dims", "label"])
    near = cells.groupBy("dims", "label", "block", "group").applyInArrow(_positives_in_cell(positives), _BEST)
    liked = cut(_first(near, ["anchor"], positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("of_score"), "times"), "negatives-positives")

    # No more than ``positives`` scores for each anchor; a negative score has no window.
    windows = liked.where("of_score >= 0").groupBy(F.col("anchor").alias("node")).agg(F.sort_array(F.collect_set("of_score")).alias("windows"))
    asked = cut(anchors.join(windows, "node"), "negatives-anchors")
    found = _cells(rows, asked, ["dims"]).groupBy("dims", "block", "group").applyInArrow(_negatives_in_cell(negatives), _BEST)
    hard = _first(found, ["anchor", "of_score"], negatives).select("anchor", "of_score", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "before", "times")

    hard = hard.withColumn("nth", _repeated(F.col("times"))).withColumn("rank", (F.col("before") + F.col("nth") + 1).cast("int")).drop("times", "before", "nth")
    pairs = liked.join(asked.select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"), "copies"), "anchor").withColumn("nth", _repeated(F.col("times") * F.col("copies")))
    return pairs.join(hard, ["anchor", "of_score"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("of_score").alias("positive_score"), "negative_score")


NEGATIVES_SQL = """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 10"""
