"""Operator 1: exact top-k inner products over length-sorted vectors.

Vectors are turned into integers, laid out by descending length in blocks, and
rotated by the singular basis of the whole table (from its Gram matrix, a sum over
all partitions of dim x dim numbers). A first pass scores the queries against the
``HEAD`` longest vectors, which gives each query a lower bound. Then every query
block meets only the blocks whose greatest length can reach that bound, and
inside a block Cauchy-Schwarz bounds the part of the product beyond the first
rotated coordinates; what may still reach the bound is scored exactly in integers.

Defined cases: vectors that are null or hold null or non-finite components take no
part; shorter vectors are filled up with zeros; rows that repeat an id are
candidates for every other id; ties go to the smaller id; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.llm.common import written
from postern.llm.vectors import blob, blocks_of, dimension, matrix, usable

HEAD = 4096
QUERY_BLOCK, BLOCK, STEP, LEADING = 512, 4096, 1024, 16
EXACT = float(1 << 53)


def integers(vectors: DataFrame, dim: int, scale: float) -> DataFrame:
    """vec_id, v binary (int64 components), length double."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(scale * matrix(batch.column("embedding"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([blob(r, "<i8") for r in v], pa.binary()), pa.array(np.sqrt((v * v).sum(axis=1)))], ["vec_id", "v", "length"]
            )

    return usable(vectors).mapInArrow(turn, "vec_id bigint, v binary, length double")


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Singular basis of all rows, leading direction first; only dim x dim sums reach the driver."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = unpack(batch.column("v"), dim)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], ["cell", "x"])

    cells = rows.select("v").mapInArrow(gram, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    g = np.zeros(dim * dim)
    for cell, x in cells:
        g[cell] = x
    _, basis = np.linalg.eigh(g.reshape(dim, dim))
    return basis[:, ::-1].copy()


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), dim).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; doubles hold them as long as every partial sum is below 2**53."""
    if len(a) and len(b) and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def packed(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Blocks of rows as they lie in their partition: ids and vectors as binary, longest and shortest length, least bound."""
    has_bound = "bound" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, size):
            length = block.column("length").to_numpy()
            bound = block.column("bound").to_numpy() if has_bound else np.zeros(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([blob(block.column("vec_id").to_numpy(), "<i8")], pa.binary()), pa.array([b"".join(block.column("v").to_pylist())], pa.binary()), pa.array([length.max()]), pa.array([bound.min()]), pa.array([blob(bound, "<f8")], pa.binary())],
                ["ids", "vs", "longest", "least_bound", "bounds"],
            )

    return rows.mapInArrow(pack, "ids binary, vs binary, longest double, least_bound double, bounds binary")


def best_of(q_ids, q, c_ids, c, bound, k, basis):
    """Per query the k best of one block, by (score descending, id ascending): (query row, candidate row, score) arrays."""
    order = np.argsort(-np.einsum("ij,ij->i", c, c), kind="stable")
    c_ids, c = c_ids[order], c[order]
    lead = min(LEADING, c.shape[1])
    qr, cr = q @ basis, c @ basis
    q_len, c_len = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    q_rest, c_rest = np.sqrt((qr[:, lead:] ** 2).sum(axis=1)), np.sqrt((cr[:, lead:] ** 2).sum(axis=1))
    bound = bound.copy()
    kept: list[tuple] = []
    slack = 1e-9 * (1 + q_len * (c_len[0] if len(c_len) else 0))
    best = np.full((len(q), k), -np.inf)
    for a in range(0, len(c), STEP):
        rows = np.flatnonzero(q_len * c_len[a] + slack >= bound)
        if not len(rows):
            break
        part = slice(a, a + STEP)
        upper = qr[rows, :lead] @ cr[part, :lead].T + q_rest[rows, None] * c_rest[None, part]
        may = (upper + slack[rows, None] >= bound[rows, None]) & (q_ids[rows, None] != c_ids[None, part])
        columns = np.flatnonzero(may.any(axis=0))
        if not len(columns):
            continue
        exact = products(q[rows], c[part][columns])
        may = may[:, columns]
        scored = np.where(may, exact.astype(np.float64), -np.inf)
        best[rows] = -np.sort(-np.concatenate([best[rows], scored], axis=1), axis=1)[:, :k]
        bound[rows] = np.maximum(bound[rows], best[rows, k - 1])
        r, m = np.nonzero(may & (scored >= bound[rows, None]))
        kept.append((rows[r], a + columns[m], exact[r, m]))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, column, score = (np.concatenate(x) for x in zip(*kept, strict=True))
    take = np.lexsort((c_ids[column], -score, row))
    row, column, score = row[take], column[take], score[take]
    first = np.concatenate([[True], row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    keep = place < k
    return row[keep], c_ids[column[keep]], score[keep]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest integer product for each row of ``queries``."""
    spark = vectors.sparkSession
    good = usable(vectors)
    dim = max(dimension(good), dimension(usable(queries)), 1)
    rows = written(integers(vectors, dim, scale), "vectors")
    basis = rotation(rows, dim)
    longest = rows.orderBy(F.desc("length"), "vec_id").limit(HEAD).collect()
    head = (np.array([r.vec_id for r in longest], dtype=np.int64), np.frombuffer(b"".join(r.v for r in longest), dtype="<i8").reshape(-1, dim).astype(np.float64))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column("vec_id").to_numpy(), unpack(batch.column("v"), dim)
            out = np.full(len(ids), -np.inf)
            for a in range(0, len(ids), QUERY_BLOCK):
                part = slice(a, a + QUERY_BLOCK)
                row, _, score = best_of(ids[part], q[part], *head, np.full(len(ids[part]), -np.inf), k, basis)
                full = np.bincount(row, minlength=len(ids[part])) == k
                low = np.full(len(ids[part]), np.inf)
                np.minimum.at(low, row, score.astype(np.float64))
                out[part] = np.where(full, low, -np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "bound"])

    n = rows.count()
    partitions = max(1, -(-n // (4 * BLOCK)))
    asked = integers(queries, dim, scale).mapInArrow(bound, "vec_id bigint, v binary, length double, bound double")
    q_blocks = packed(asked.repartition(max(1, partitions // 8)).sortWithinPartitions(F.desc("length"), "vec_id"), dim, QUERY_BLOCK)
    laid = rows.repartitionByRange(partitions, F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    c_blocks = written(packed(laid, dim, BLOCK).drop("bounds", "least_bound"), "vector-blocks")
    q_blocks = written(q_blocks, "query-blocks").select(*[F.col(c).alias(f"q_{c}") for c in q_blocks.columns])
    # the stated query set, in blocks, against the blocks that can reach its bounds
    meet = q_blocks.join(c_blocks, F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("q_least_bound"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), dtype=kind)  # noqa: B023, E731
                q_ids, c_ids = get("q_ids", "<i8"), get("ids", "<i8")
                q, c = get("q_vs", "<i8").reshape(-1, dim).astype(np.float64), get("vs", "<i8").reshape(-1, dim).astype(np.float64)
                row, found, value = best_of(q_ids, q, c_ids, c, get("q_bounds", "<f8"), k, basis)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(found), pa.array(value)], ["query_id", "vec_id", "score"])

    spread = max(spark.sparkContext.defaultParallelism, partitions)
    scored = meet.repartition(spread).mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
