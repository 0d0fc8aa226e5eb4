"""Vectors as numpy matrices inside tasks, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    big = F.lit(float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < big)), F.lit(False))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length together: their positions in the column and their values, of the values' own type."""
    starts = np.asarray(lists.offsets)
    sizes, values = np.diff(starts), lists.flatten().to_numpy(zero_copy_only=False)
    starts = starts[:-1] - starts[0]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, values[starts[at][:, None] + np.arange(size)[None, :]]


def list_array(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32), pa.array(np.ascontiguousarray(matrix).ravel()))
