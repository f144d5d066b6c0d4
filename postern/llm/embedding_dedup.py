"""Operator 3: near-duplicate vectors by int8 tile products with rigorous bounds.

Equal vectors are one class. Class vectors are scaled to unit length, ordered by
pivot so that blocks are narrow, and cut into blocks. A pair of blocks is a tile
unless the angle between their centres minus their radii already exceeds the
threshold's angle. In a tile the int8 codes are multiplied (exact in float32);
with the quantisation error of each vector the true cosine is bounded, and only
pairs that may reach the threshold are recomputed in double precision. A tile
gives link counts and the least node of each of its components, never its pairs.
A tile reads its two blocks from the written blocks, so the bodies of blocks are
never shuffled: what lies on disk grows with the vectors, only the arithmetic
with their pairs.

Defined cases: null, zero and non-finite vectors link with nothing and keep
themselves, and so do rows with a null id; shorter vectors are filled up with
zeros; every row is a vector of its own, also where rows repeat an id: its links
follow from its own vector only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from postern.llm.common import discarded, written
from postern.llm.components import components
from postern.llm.vectors import blob, blocks_of, dimension, finite, matrix, usable

BLOCK, STEP, PIVOTS = 4096, 512, 64


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, and an upper bound of the length of what they leave out."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return code.astype(np.int8), scale, error


def tile_links(a, b, same: bool, threshold: float):
    """Row and column numbers of linked pairs of two blocks, piece by piece. a, b: (raw, codes, scale, error)."""
    raw_a, code_a, scale_a, error_a = a
    raw_b, code_b, scale_b, error_b = b
    codes_b = code_b.astype(np.float32).T
    norm_a, norm_b = np.sqrt((raw_a * raw_a).sum(axis=1)), np.sqrt((raw_b * raw_b).sum(axis=1))
    for start in range(0, len(raw_a), STEP):
        part = slice(start, start + STEP)
        product = code_a[part].astype(np.float32) @ codes_b  # integers below 2**24: exact
        # a pair can reach the threshold only if the product reaches this value
        need = (threshold - 1e-9 - (error_a[part, None] * (1 + error_b) + error_b)) / (scale_a[part, None] * scale_b)
        row, column = np.nonzero(product >= need)
        row = row + start
        if same:
            row, column = row[column > row], column[column > row]
        for k in range(0, len(row), 200_000):
            r, c = row[k : k + 200_000], column[k : k + 200_000]
            cosine = np.einsum("ij,ij->i", raw_a[r], raw_b[c]) / (norm_a[r] * norm_b[c])
            good = cosine >= threshold
            yield r[good], c[good]


def takes_part() -> Column:
    """Rows whose vectors can link; never null."""
    return F.coalesce(F.col("vec_id").cast("bigint").isNotNull() & finite() & F.exists("embedding", lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    A class has a number of its own (``node``), as different vectors may carry one id.
    """
    good = usable(vectors.where(takes_part()))
    dim = max(dimension(good), 1)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == FloatType() else "<f8"  # stored as given, computed in double precision
    doubles = lambda stored: np.frombuffer(stored, dtype=kind).reshape(-1, dim).astype(np.float64)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("embedding"), dim) + 0.0  # one zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([blob(r, kind) for r in v], pa.binary())], ["vec_id", "v"])

    members = written(good.mapInArrow(flatten, "vec_id bigint, v binary"), "vectors")
    classes = members.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    pivots = unit_rows(doubles(b"".join(bytes(r.v) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(PIVOTS).select("v").collect())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            cosine = unit_rows(doubles(b"".join(batch.column("v").to_pylist()))) @ pivots.T
            node = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(cosine.argmax(axis=1)), pa.array(-cosine.max(axis=1))], [*batch.schema.names, "node", "pivot", "distance"])

    # numbers follow the order of rows in a task; they hold once written
    placed = written(classes.mapInArrow(place, "v binary, rep bigint, copies bigint, node bigint, pivot bigint, distance double"), "classes")
    partitions = max(1, placed.count() // (2 * BLOCK))
    numbered = written(members.join(placed.select("v", "node"), "v").select("vec_id", "node"), "nodes")
    discarded(members)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, block in enumerate(blocks_of(batches, BLOCK)):
            raw = b"".join(block.column("v").to_pylist())
            unit = unit_rows(doubles(raw))
            centre = unit.sum(axis=0)
            centre = centre / max(np.sqrt(centre @ centre), 1e-300)
            radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max()) if centre @ centre > 0.5 else 4.0
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([centre.tolist()]), pa.array([radius]), *(pa.array([x], pa.binary()) for x in (raw, blob(block.column("node").to_numpy(), "<i8"), blob(block.column("copies").to_numpy(), "<i8")))],
                ["block", "centre", "radius", "raw", "node", "copies"],
            )

    laid = placed.repartitionByRange(partitions, "pivot", "distance", "rep").sortWithinPartitions("pivot", "distance", "rep")
    blocks = written(laid.mapInArrow(pack, "block bigint, centre array<double>, radius double, raw binary, node binary, copies binary"), "vector-blocks")
    # which tiles can hold a link: centres and radii only
    other = blocks.select(*[F.col(c).alias(f"o_{c}") for c in blocks.columns])
    cosine = F.aggregate(F.zip_with("centre", "o_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    reach = F.acos(F.lit(threshold)) + F.col("radius") + F.col("o_radius") + 1e-6
    # of the two orders of a pair one is taken, by parity, so that the tasks (i, j) and (j, i) share its tiles
    place_sum = sum((F.col(c) + F.shiftright(c, 32) for c in ("block", "o_block")), F.lit(0))
    once = (F.col("block") == F.col("o_block")) | ((F.col("block") < F.col("o_block")) == (place_sum % 2 == 0)) & (F.col("block") != F.col("o_block"))
    # each task reads one split of the blocks against another; without the hint a join on numbers would shuffle a block once a tile
    pair = blocks.hint("shuffle_replicate_nl").join(other, once & (F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) <= reach)).drop("centre", "o_centre", "radius", "o_radius")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, tuple] = {}  # the blocks of the last tiles: neighbouring tiles share one

        def side(batch: pa.RecordBatch, r: int, p: str) -> tuple:
            number = batch.column(p + "block")[r].as_py()
            if number not in ready:
                if len(ready) >= 8:
                    del ready[next(iter(ready))]
                raw = doubles(batch.column(p + "raw")[r].as_py())
                ready[number] = (raw, *quantise(unit_rows(raw)))
            return ready[number]

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: np.frombuffer(batch.column(name)[r].as_py(), dtype="<i8")  # noqa: B023, E731
                same = batch.column("block")[r].as_py() == batch.column("o_block")[r].as_py()
                node_a, node_b, copies_a, copies_b = get("node"), get("o_node"), get("copies"), get("o_copies")
                ids = node_a if same else np.concatenate([node_a, node_b])
                shift = 0 if same else len(node_a)
                copies = copies_a if same else np.concatenate([copies_a, copies_b])
                n_links = np.zeros(len(ids), np.int64)
                label = ids.copy()
                for row, column in tile_links(side(batch, r, ""), side(batch, r, "o_"), same, threshold):
                    column = column + shift
                    n_links += np.bincount(row, copies[column], len(ids)).astype(np.int64) + np.bincount(column, copies[row], len(ids)).astype(np.int64)
                    label = joined(label, row, column)
                linked = np.flatnonzero(n_links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(n_links[linked]), pa.array(label[linked])], ["node", "n", "low"])

    found = written(pair.mapInArrow(multiply, "node bigint, n bigint, low bigint"), "tile-links")
    discarded(blocks)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    group = components(found.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component_id", "root")
    named = placed.select("node", "rep", "copies").join(counts, "node", "left").join(group, "node", "left")
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    classed = named.join(least, "root", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
    )
    linked = numbered.join(classed, "node").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~takes_part()).select(F.col("vec_id").cast("bigint").alias("vec_id")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def unit_rows(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, keepdims=True)  # first scaled down, so that no square overflows
    v = v / top
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def joined(label: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Labels after these links. Links whose ends agree already are left out; whole labels move, so earlier links stay true."""
    while True:
        a, b = label[row], label[column]
        open_ = a != b
        if not open_.any():
            return label
        row, column, a, b = row[open_], column[open_], a[open_], b[open_]
        names, place = np.unique(label, return_inverse=True)
        target = np.arange(len(names))
        np.minimum.at(target, place[row], place[column])
        np.minimum.at(target, place[column], place[row])
        while (target[target] != target).any():
            target = target[target]
        label = names[target[place]]
