"""Vectors in tables as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & sound, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists that all have one length, as a matrix with a row for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_length(batch: pa.RecordBatch, column: str = "vector"):
    """(dims, part of the batch) for each length of its vectors."""
    lengths = pc.list_value_length(batch.column(column))
    for dims in pc.unique(lengths).to_pylist():
        yield dims, batch.filter(pc.equal(lengths, dims))
