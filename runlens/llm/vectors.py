"""Columns of vectors as matrices, and bounded samples of rows chosen by hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sample that is fitted on the driver has at most about so many numbers.
SAMPLE_NUMBERS = 1 << 21


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: type = np.float64) -> np.ndarray:
    """One row per list; shorter lists are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets)) if len(column) else np.empty(0, np.int64)
    values = np.asarray(column.flatten()).astype(kind)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def sample(frame: DataFrame, n: int, width: int, seed: int, name: str, most: int = SAMPLE_NUMBERS) -> pa.Table:
    """About ``most / width`` of the ``n`` rows, or all, by hash of column ``name`` and in its order."""
    share = min(1.0, most / max(1, width) / max(1, n))
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col(name)), F.lit(1 << 32)) < round(share * (1 << 32))
    return frame.where(chosen).toArrow().sort_by(name)
