"""Approximate nearest neighbours by a hash-prefix forest.

Vectors lie in blocks. Each block has a forest of trees; a tree is the sorted array of long hash
strings (signs of random projections) of the block's distinct vectors. A query descends every tree
to its longest matching prefix, then all trees ascend together, one bit at a time, and all vectors
under the prefixes reached become candidates until they are ``FRACTION`` of the block or more.
Candidates are compared exactly, in double precision, on the original vectors.

A block's share of candidates is fixed, so recall doesn't fall as blocks are added. Queries meet
blocks in cells of at most QUERIES and VECTORS rows, and a cell returns k rows for each query.

Defined results: a vector that is null, empty, zero, or holds a null, NaN or infinity takes no part,
and so do rows without an id; rows with the query's id are not its candidates; only vectors of the
query's length are; rows that repeat id and vector count once
(an id with several vectors asks with each and is answered with the best of all); equal vectors are reported by
ascending id; fewer candidates than k are all returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut

TREES, BITS, FRACTION = 24, 64, 0.6
VECTORS, QUERIES = 8192, 4096
SEED = 9


class Forest:
    def __init__(self, vectors: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.planes = rng.standard_normal((TREES, vectors.shape[1], BITS))
        self.n = len(vectors)
        hashes = self.hash(vectors)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def hash(self, vectors: np.ndarray) -> np.ndarray:
        """[tree, vector]: 64 signs as one number, the first the highest bit."""
        weights = np.left_shift(np.uint64(1), np.arange(BITS - 1, -1, -1, dtype=np.uint64))
        return np.stack([((vectors @ p > 0) * weights).sum(axis=1, dtype=np.uint64) for p in self.planes])

    def candidates(self, queries: np.ndarray, least: int):
        """For each query, a mask of its candidates."""
        asked = self.hash(queries)
        lows, highs = [], []
        for bits in range(BITS + 1):
            rest = np.uint64((1 << (BITS - bits)) - 1)
            lows.append(np.stack([np.searchsorted(s, q & ~rest, side="left") for s, q in zip(self.sorted, asked, strict=True)]))
            highs.append(np.stack([np.searchsorted(s, q | rest, side="right") for s, q in zip(self.sorted, asked, strict=True)]))
        lows, highs = np.stack(lows), np.stack(highs)  # [bits, tree, query]
        deepest = ((highs > lows) * np.arange(BITS + 1)[:, None, None]).max(axis=0)  # longest match by tree
        for q in range(len(queries)):
            mask = np.zeros(self.n, dtype=bool)
            for bits in range(int(deepest[:, q].max()), -1, -1):
                for t in range(TREES):
                    if deepest[t, q] >= bits:
                        mask[self.order[t, lows[bits, t, q] : highs[bits, t, q]]] = True
                if mask.sum() >= least:
                    break
            yield mask


def nearest_in_cell(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, fraction: float = FRACTION) -> pd.DataFrame:
    """The k nearest candidates of each query within one cell."""
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    by_group = np.lexsort((ids, group.ravel()))
    starts = np.searchsorted(group.ravel()[by_group], np.arange(len(distinct) + 1))
    lengths = np.sqrt((distinct * distinct).sum(axis=1))
    unit = distinct / lengths[:, None]
    out: list[tuple[int, int, float]] = []
    least = max(int(np.ceil(fraction * len(distinct))), k + 1)  # the query itself may be one
    for q_id, q, mask in zip(query_ids.tolist(), queries, Forest(unit).candidates(queries, least), strict=True):
        at = np.nonzero(mask)[0]
        rough = unit[at] @ (q / np.sqrt((q * q).sum()))
        if len(at) > k + 1:
            # one of those found may be the query's own
            at = at[rough >= np.partition(rough, len(at) - k - 1)[len(at) - k - 1] - 1e-9]
        score = (distinct[at] * q).sum(axis=1) / (lengths[at] * np.sqrt((q * q).sum()))
        found = []
        for i in np.argsort(-score, kind="stable"):
            members = ids[by_group[starts[at[i]] : starts[at[i] + 1]]][: k + 1]
            found += [(-score[i], v) for v in members.tolist() if v != q_id][:k]
        out += [(q_id, v, -s) for s, v in sorted(found)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    return rows.where(sound).distinct()


def search(vectors: DataFrame, every: int = 50, k: int = 5, fraction: float = FRACTION) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each vector whose id ``every`` divides."""
    rows = cut(usable(vectors).withColumn("dims", F.size("vector")), "ann-vectors")
    n = rows.count()
    asked = rows.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    blocks, groups = max(1, -(-n // VECTORS)), max(1, -(-n_asked // QUERIES))
    salt = F.xxhash64("vec_id", "vector")
    rows = rows.withColumn("block", F.pmod(salt, F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = asked.withColumn("group", F.pmod(salt, F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return nearest_in_cell(left["vec_id"].to_numpy(), np.stack(left["vector"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["vector"].to_numpy()), k, fraction)

    keys = ["dims", "block", "group"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(cell, "query_id long, vec_id long, score double").distinct()
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
