"""Shared helpers of the corpus operators: tables, written intermediate results, ragged arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.session import shared_folder


_MADE: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share."""
    folder = shared_folder(spark)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{folder}/llm/{name}-{uuid.uuid4().hex}"
    if _MADE.get() is not None:
        _MADE.get().append((path, None))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files: their result is a table, nothing reads its shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def discarded(df: DataFrame) -> None:
    """Deletes an intermediate table that ``written`` made, once everything that reads it is written itself."""
    files = df.inputFiles()
    if files:
        _delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[tuple[str, str | None]]]:
    """Folders (and their table names) made inside, in order; those still listed at the end are deleted.

    For work that ends with a written result: what it went through is not read again.
    """
    made: list[tuple[str, str | None]] = []
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)
        for path, label in made:
            if label:
                spark.sql(f"DROP TABLE IF EXISTS {label}")
            _delete(spark, path)


def kept(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of ``build``; the tables it went through are deleted, its own is left to whoever called."""
    with intermediates(spark) as made:
        out = written(build(), name)
        own = made.pop()
    if _MADE.get() is not None:
        _MADE.get().append(own)
    return out


def block_count(spark: SparkSession) -> int:
    """Blocks for a shuffle whose groups are handled whole: follows the session's shuffle partitions, which follow the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def text_slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of an Arrow batch with about ``limit`` bytes of text each (a longer text is a slice of its own).

    Yields the rows, the text bytes of the slice, and the offsets of its rows in them; a null text is empty.
    """
    text = batch.column("text")
    text = text.fill_null("" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def binary_view(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array over contiguous bytes, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Written once, split by ``key``: later joins and cogroups on it move only their other side."""
    spark = df.sparkSession
    label, path = f"llm_{name}_{uuid.uuid4().hex}", new_folder(spark, name)
    if _MADE.get() is not None:
        _MADE.get()[-1] = (path, label)
    with _shuffles_dropped(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(label)
    return spark.table(label)


def input_blocks(docs: DataFrame) -> int:
    """How many blocks a table is worked on in: follows its input splits, and the session's shuffle partitions where those are more."""
    return max(docs.select("doc_id").rdd.getNumPartitions(), block_count(docs.sparkSession))


def text_blocks(docs: DataFrame, block_bytes: int) -> int:
    """Blocks of about so many bytes of text: follows the texts themselves, not splits or settings, which may be compressed or coarse."""
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(input_blocks(docs), -(-total // block_bytes))


def most_frequent(counted: DataFrame, n: str, at_most: int) -> DataFrame:
    """The rows of largest ``n`` (a count), at most so many: all from a threshold on.

    The threshold comes from the numbers of rows in each eighth of a power of two, so
    the driver sees some hundred rows at any size. Rows just below it are left out
    together, never some of several equal ones.
    """
    step = F.floor(F.log2(n) * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counted.groupBy(step).agg(F.count("*")).collect()), reverse=True)
    least, total = None, 0
    for level, rows in sizes:
        total += rows
        if total > at_most:
            break
        least = level
    return counted.where(F.lit(False) if least is None else step >= least)
