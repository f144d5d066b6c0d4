"""Vectors as Arrow batches: validity, blocks of rows as one binary value each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite() -> Column:
    return F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a non-null id and a vector without null or non-finite components."""
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite())


def dimension(vectors: DataFrame) -> int:
    """The greatest length; shorter vectors are filled up with zeros."""
    return vectors.agg(F.max(F.size("embedding"))).first()[0] or 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column as a dense matrix of doubles."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    if (lengths == dim).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values[offsets[0] : offsets[-1]]
    return out


def blob(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def blocks_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Regroup a partition's batches into blocks of ``size`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= size:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield whole.slice(0, size).combine_chunks().to_batches()[0]
            held = whole.slice(size).to_batches()
            rows -= size
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
