"""Vectors of Arrow list columns as integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values beyond the range of a long count as its ends.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def by_length(batch: pa.RecordBatch, vector: str) -> dict[int, np.ndarray]:
    """Rows of a batch by the length of their vectors."""
    sizes = batch.column(vector).value_lengths().to_numpy(zero_copy_only=False)
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def floors(batch: pa.RecordBatch, vector: str, rows: np.ndarray, length: int, scale: float) -> np.ndarray:
    """floor(scale * entry) of vectors of one length, as long."""
    flat = batch.column(vector).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale).reshape(len(rows), length)
    big = np.abs(x) >= 2.0**63
    if not big.any():
        return x.astype(np.int64)
    out = np.where(big, 0.0, x).astype(np.int64)
    out[big & (x > 0)], out[big & (x < 0)] = MOST, LEAST
    return out
