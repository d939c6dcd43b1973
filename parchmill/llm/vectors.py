"""Shared reading of embedding tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame) -> DataFrame:
    """``id, v`` with one row per id: vectors without nulls, of numbers below 1e18 in absolute value, one of them at least above 1e-18
    (beyond these, single precision cannot hold a vector's length). Of several vectors of one id the least stays."""
    v = F.col("embedding").cast("array<float>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e18)))
    rows = table.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: F.abs(x) > F.lit(1e-18)))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def plain(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are all of one length, as they are."""
    count = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(count, -1) if count else np.empty((0, 0), np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of such a column."""
    return unit(plain(column))


def unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def by_dimension(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch cut by the length of its vectors."""
    import pyarrow.compute as pc

    sizes = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        yield batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64))
