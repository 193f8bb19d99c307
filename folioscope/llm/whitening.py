"""Whitening of embeddings by a matrix-free block Lanczos iteration.

The covariance is never formed: each step sends a block of vectors to the executors, which return the
product with it, the sum of x (x' q) over all centred rows, by one pass over the fit list. The driver
holds no more than ``BASIS`` vectors of the embedding's length, and their products. A new block is
made orthogonal to the whole basis, twice; where directions are lost (a breakdown, as when the
block spans an invariant space) random ones take their place. The iteration ends when the residuals of all
components asked for are small against the largest eigenvalue, or the basis spans everything; a full
basis starts again from its best vectors.

Sums and distances from the mean are exact integers: n x - S, without division. Their squares give
the trace, and so the share that each component explains, without any other eigenvalue.

Where eigenvalues are equal to some digits, the components are as exact as the gap allows.

Defined results: rows with a null vector or a null, NaN or infinite component (also 256 times it) are left out; vectors of
each length are whitened on their own (no more than ``LENGTHS`` lengths); components without variance
(1e-13 of the largest or less) have no rows, and neither has a table without two different vectors; rows
without an id keep a null id; rows that repeat an id have rows of their own; a deviation beyond a long is
null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import finite, matrix
from folioscope.llm.common import cut

SCALE, COMPONENTS = 256, 4
#: Vectors of a block, and of a basis at most.
WIDTH, BASIS = 8, 256
#: A residual, against the largest eigenvalue, with which components count as found; one that will do
#: when it hasn't halved for so many steps; steps at most.
TOLERANCE, ENOUGH, PATIENCE, STEPS = 1e-14, 1e-11, 12, 2000
#: Rows whose products are summed at once.
CHUNK = 1 << 14
#: Points in a file at least, where there are few.
ROWS = 10_000
LENGTHS = 64
SEED = 12

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_RESULT_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


class Fit:
    """The exact sums of a fit list of whole numbers of one length, and distances from its mean."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.dims = n, sums, len(sums)
        #: n x - S is no larger than this; divided by ``scale`` it is about 1.
        self.bound = 2 * n * most
        self.scale = n << most.bit_length()

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S: int64, or Python's integers where that is too small."""
        if self.bound < 1 << 62:
            return self.n * x.astype(np.int64) - np.array(self.sums, dtype=np.int64)
        exact = np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
        return self.n * exact - np.array(self.sums, dtype=object)

    def scaled(self, centred: np.ndarray) -> np.ndarray:
        """Distances from the mean over a power of two, rounded once."""
        return (centred / self.scale).astype(np.float64)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sums of squares of n x - S, exact; null beyond a long."""
        if self.dims * self.bound**2 >= 1 << 63:
            centred = centred.astype(object)
        return [d if d < 1 << 63 else None for d in (centred * centred).sum(axis=1).tolist()]


def fit_of(points: DataFrame) -> Fit | None:
    """The sums of a fit list (x: array of double, whole numbers); none for an empty one."""
    v = F.col("v")
    each = points.select(F.posexplode("x").alias("at", "v")).groupBy("at")
    totals = sorted(each.agg(F.try_sum(v.try_cast("decimal(38,0)")).alias("s"), F.count(v.try_cast("decimal(38,0)")).alias("summed"), F.count("*").alias("n"), F.max(F.abs(v)).alias("most")).collect())
    if not totals:
        return None
    sums = [int(r["s"]) if r["s"] is not None and r["summed"] == r["n"] else None for r in totals]
    if None in sums:  # numbers of more than 38 digits: Python's integers, a row for each partition and place
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [0] * len(totals)
            for batch in batches:
                for row in matrix(batch.column("x")).tolist():
                    found = [a + int(b) for a, b in zip(found, row, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array([str(a) for a in found])], names=["at", "s"])

        sums = [0] * len(totals)
        for r in points.mapInArrow(run, "at int, s string").toLocalIterator():
            sums[r["at"]] += int(r["s"])
    return Fit(totals[0]["n"], sums, int(max(r["most"] for r in totals)))


def total(points: DataFrame, fit: Fit, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of`` (an array of doubles for a matrix of scaled distances) over a fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = of(fit.scaled(fit.centred(matrix(batch.column("x").slice(start, CHUNK))))).ravel()
                if whole is None:
                    whole, rest = part, np.zeros_like(part)
                    continue
                high = whole + part  # what is rounded off is kept apart
                back = high - whole
                rest += (whole - (high - back)) + (part - back)
                whole = high
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole + rest)], names=["at", "v"])

    rows = points.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(rows)])


def covariance_times(points: DataFrame, fit: Fit, q: np.ndarray) -> np.ndarray:
    """The covariance of the scaled points times a block of vectors, by one pass."""
    return total(points, fit, lambda x: x.T @ (x @ q)).reshape(q.shape) / fit.n


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors that, with ``basis``, span what ``block`` and ``basis`` span, orthogonal to both. For a
    vector that lies in the others' span (a breakdown) a random one takes its place (a restart)."""
    out = basis
    for v in block.T:
        if out.shape[1] == len(v):
            break
        while True:
            v = v / max(np.sqrt(v @ v), 1e-300)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            if (length := np.sqrt(v @ v)) > 1e-8:
                break
            v = rng.standard_normal(len(v))
        v = v / length
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.sqrt(v @ v)])
    return out[:, basis.shape[1] :]


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their vectors, of a symmetric matrix that is known by its products."""
    rng = np.random.default_rng(SEED)
    basis, images = np.zeros((dims, 0)), np.zeros((dims, 0))
    block, least, stalled = rng.standard_normal((dims, min(WIDTH, dims))), np.inf, 0
    for _ in range(STEPS):
        new = orthonormal(block, basis, rng)
        basis, images = np.column_stack([basis, new]), np.column_stack([images, times(new)])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors = basis @ turns
        residuals = images @ turns - vectors * values
        error = np.sqrt((residuals[:, :k] ** 2).sum(axis=0)).max() / max(values[0], 1e-300)
        stalled = stalled + 1 if error > least / 2 else 0
        least = min(least, error)
        if basis.shape[1] == dims or (basis.shape[1] >= k and (error <= TOLERANCE or (error <= ENOUGH and stalled >= PATIENCE))):
            return values[:k], vectors[:, :k]
        block = residuals[:, :WIDTH]
        if basis.shape[1] + WIDTH > BASIS:
            best = BASIS // 4
            basis, images = vectors[:, :best], images @ turns[:, :best]
    raise ValueError(f"no convergence after {STEPS} steps: a residual of {error}")


def _projected(fit: Fit, vectors: np.ndarray, values: np.ndarray, explained: np.ndarray, error: float):
    """Rows of the result for rows of vec_id and x."""
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), CHUNK):
                part = batch.slice(start, CHUNK)
                centred, rows = fit.centred(matrix(part.column("x"))), pa.array(np.repeat(np.arange(len(part)), k))
                white = fit.scaled(centred) @ vectors / np.sqrt(values)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(rows), fit.n)),
                    pa.array(fit.deviations(centred), pa.int64()).take(rows), pa.array(white.ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(rows), error)),
                ], schema=_RESULT_ARROW)

    return run


def _whitened(rows: DataFrame, points: DataFrame, components: int) -> DataFrame | None:
    fit = fit_of(points)
    if fit is None or fit.n < 2:
        return None
    values, vectors = leading(lambda q: covariance_times(points, fit, q), fit.dims, min(components, fit.dims))
    good = values > 1e-13 * max(values[0], 0)
    values, vectors, k = values[good], vectors[:, good], int(good.sum())
    if not k:
        return None

    def moments(x: np.ndarray) -> np.ndarray:
        """Sums of squared distances, of whitened values, and of their products."""
        w = x @ vectors / np.sqrt(values)
        return np.concatenate([[(x * x).sum()], w.sum(axis=0), (w.T @ w).ravel()])

    sums = total(points, fit, moments) / fit.n
    trace, mean, second = sums[0], sums[1 : k + 1], sums[k + 1 :].reshape(k, k)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return rows.mapInArrow(_projected(fit, vectors, values, values / trace, error), RESULT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of ``vectors`` (vec_id,
    embedding): a row for each row and component."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(finite("vector"))
    # from 2^44 on a product has no fraction
    whole = F.transform("vector", lambda v: F.when(F.abs(v) < 2.0**44, F.floor(SCALE * v).cast("double")).otherwise(SCALE * v) + 0.0)
    rows = cut(rows.select("vec_id", whole.alias("x"), F.size("vector").alias("dims")).where(finite("x")), "whitening-rows")
    lengths = sorted(rows.where("dims > 0").groupBy("dims").agg(F.count("*").alias("rows")).limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    out = rows.sparkSession.createDataFrame([], RESULT)
    for dims, n in lengths:
        own = rows.where(F.col("dims") == dims)
        points = cut(own.select("x").distinct(), "whitening-points", n, ROWS)
        if (part := _whitened(own.select("vec_id", "x"), points, components)) is not None:
            out = out.unionByName(part)
    return out
