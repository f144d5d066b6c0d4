"""Ordered folds over groups: Spark partitions and sorts, Python only walks the rows.

Rows are hash-partitioned by key and sorted within partitions by Spark's
spilling sort; one Python pass per partition then sees every group as a
contiguous run of Arrow batches. Many small groups share a batch, a large group
spans many, and no group is ever materialised for the sake of grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postern.session import python_partitions

BATCH = 8_192


def column_values(column: pa.Array) -> list:
    """A column as Python values; texts, bytes, numbers and lists of them by the whole column, not value by value."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count and pa.types.is_list(kind):
        flat, edges = column_values(column.flatten()), column.offsets.to_numpy() - column.offsets[0].as_py()
        return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return column.to_pylist()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema)], schema=schema)


def equal_runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of the runs of equal keys in a batch; keys are compared once a run, by the changes of whole columns."""
    names, n = batch.schema.names, batch.num_rows
    columns = [column_values(c) for c in batch.columns]
    changed = np.zeros(n - 1, dtype=bool)
    for k in keys:
        column = batch.column(k)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        if column.null_count:
            null = column.is_null().to_numpy(zero_copy_only=False)
            differs = pc.fill_null(differs, False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
        else:
            differs = differs.to_numpy(zero_copy_only=False)
        changed |= differs
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), n]
    owners = [columns[names.index(k)] for k in keys]
    for a, b in zip(edges[:-1], edges[1:]):
        rows = (dict(zip(names, values)) for values in zip(*[c[a:b] for c in columns]))
        yield tuple(c[a] for c in owners), rows


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterable[tuple]], ddl: str, placed: bool = False) -> DataFrame:
    """``fold(rows of one group, in order) -> output tuples`` (without the keys, which are prefixed). ``placed``: every group is in one partition already."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (found for batch in batches if batch.num_rows for found in equal_runs(batch, keys))
        pending = next(runs, None)
        out: list[tuple] = []
        while pending is not None:
            key = pending[0]
            following: list = [None]

            def group(first=pending, key=key, following=following):
                yield from first[1]
                for found in runs:
                    if found[0] != key:
                        following[0] = found
                        return
                    yield from found[1]

            members = group()
            for values in fold(members):
                out.append((*key, *values))
                if len(out) >= BATCH:
                    yield batch_of(out, schema)
                    out = []
            for _ in members:  # a fold may stop early
                pass
            pending = following[0]
        if out:
            yield batch_of(out, schema)

    together = df if placed else df.repartition(python_partitions(df.sparkSession), *keys)
    return together.sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)
