"""Operator 11: shards of near equal bytes by histogram sort.

Rows are ordered by key: digest of the text, doc_id, row number, so that equal
texts stand together. The splitters between shards are found by counting, never by
moving rows: in each round every partition counts bytes and rows between candidate
keys, the counts are summed, and new candidates are laid only where a splitter is
still open. Then every row moves once, to the piece of its shard.

The splitter of shard k is the group edge (of equal texts) nearest to k/shards of
all bytes, where that is within ``TOLERANCE`` of a shard; else the nearest row edge,
so a large group of copies is divided and a small one stays together. Ties take
the lower edge. Each shard is moved and sorted as several pieces, whose own
splitters only have to come within a tenth of a piece; a piece is one task.

Defined cases: a null text has no bytes and counts as an empty one; a null doc_id
stands with the least number; rows alike in text and doc_id are ordered by where
they were read; a text larger than a shard leaves neighbouring shards empty; an
empty table gives no rows. All columns are carried in the struct ``doc``, so names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postern.llm.common import input_blocks, written

TOLERANCE = (1, 200)  # of a shard: how far a group edge may be from the target
PIECE_TOLERANCE = 10  # a piece may end a tenth of its size away from its target
MOST_PIECES = 16_384  # bounds the candidate keys of a round; a piece is sorted with spilling
DIGEST, WIDTH = 16, 32  # bytes of a key: digest of the text, all


@dataclass
class Span:
    """Rows between two candidate keys: bytes and rows before and in it, its least and greatest key, open targets."""

    bytes_before: int
    rows_before: int
    size: int
    rows: int
    low: bytes
    high: bytes
    targets: list = field(default_factory=list)


@dataclass(frozen=True)
class Splitter:
    key: bytes
    rows_before: int
    between_shards: bool


def candidates(span: Span, parts: int) -> list[bytes]:
    """Evenly spaced keys in (low, high]; whole digests while the span has more than one."""
    width = DIGEST if span.low[:DIGEST] != span.high[:DIGEST] else WIDTH
    a, b = int.from_bytes(span.low[:width]), int.from_bytes(span.high[:width])
    points = sorted({a - (a - b) * i // parts for i in range(1, parts + 1)} - {a})
    return [p.to_bytes(width) + bytes(WIDTH - width) for p in points]


def key_after(key: bytes, width: int) -> bytes | None:
    """The least key above all that begin with these ``width`` bytes."""
    value = int.from_bytes(key[:width]) + 1
    return value.to_bytes(width) + bytes(WIDTH - width) if value < 256**width else None


def histogram(keys: DataFrame, probes: list[bytes], wanted: set[int]) -> dict[int, tuple[int, int, bytes, bytes]]:
    """Exact bytes, rows, least and greatest key of each wanted bucket between the probes, counted where the rows lie."""
    edges = np.array(probes, dtype=f"S{WIDTH}")
    open_ = np.zeros(len(probes) + 1, bool)
    open_[list(wanted)] = True

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=f"S{WIDTH}")
            size = batch.column("size").to_numpy()
            bucket = np.searchsorted(edges, key, side="right")
            mine = np.flatnonzero(open_[bucket])
            if not len(mine):
                continue
            mine = mine[np.argsort(key[mine], kind="stable")]
            bucket, size, key = bucket[mine], size[mine], key[mine]
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            end = np.append(begin[1:], len(bucket))
            whole = lambda at: pa.array([bytes(k).ljust(WIDTH, b"\0") for k in key[at]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(np.add.reduceat(size, begin)), pa.array(end - begin), whole(begin), whole(end - 1)], ["bucket", "size", "rows", "low", "high"])

    part = keys.mapInArrow(count, "bucket bigint, size bigint, rows bigint, low binary, high binary")
    found = part.groupBy("bucket").agg(F.sum("size"), F.sum("rows"), F.min("low"), F.max("high"))
    return {r[0]: (r[1], r[2], bytes(r[3]), bytes(r[4])) for r in found.collect()}  # one row for each candidate at most


def near(span: Span, target: Fraction) -> bool:
    """True if the lower edge of the span is the nearer one."""
    return target - span.bytes_before <= span.bytes_before + span.size - target


def settle(span: Span, target: Fraction, exact: bool, slack: Fraction, below: bytes) -> Splitter | None | bool:
    """The splitter of a target inside ``span`` (whose lower edge is the key ``below``); None: beyond all keys; False: still open."""
    left, right = target - span.bytes_before, span.bytes_before + span.size - target
    one_row, one_text = span.rows == 1, span.low[:DIGEST] == span.high[:DIGEST]
    whole_group = one_text and below[DIGEST:] == bytes(WIDTH - DIGEST)
    if not exact and left <= slack:
        return Splitter(below, span.rows_before, False)
    if exact and not one_row and not (whole_group and min(left, right) <= slack):
        return False
    if not exact and not one_row and right > slack:
        return False
    if near(span, target):
        return Splitter(below, span.rows_before, exact)
    after = key_after(span.high, DIGEST if exact and whole_group and min(left, right) <= slack else WIDTH)
    return Splitter(after, span.rows_before + span.rows, exact) if after else None


def splitters(keys: DataFrame, shards: int, pieces: int, tolerance: tuple[int, int] = TOLERANCE, fan: int = 64) -> list[Splitter]:
    """Splitters between ``shards`` shards, and between the pieces they are moved in, by rounds of counting."""
    whole = keys.agg(F.sum("size"), F.count("*"), F.min("key"), F.max("key")).first()
    if not whole[1]:
        return []
    total, each = whole[0], max(1, pieces // shards)
    slack = Fraction(total * tolerance[0], shards * tolerance[1]), Fraction(total, shards * each * PIECE_TOLERANCE)
    targets = [(Fraction(total * j, shards * each), j % each == 0) for j in range(1, shards * each)]
    done: list[Splitter] = []
    waiting = [(Span(0, 0, whole[0], whole[1], bytes(whole[2]), bytes(whole[3]), targets), bytes(WIDTH))]
    while waiting:
        waiting.sort(key=lambda x: x[1])
        probes, wanted, owner = [], set(), []
        for span, below in waiting:
            own = [below, *candidates(span, max(fan, 4 * len(span.targets)))]
            wanted |= set(range(len(probes) + 1, len(probes) + len(own) + 1))
            owner.append((span, range(len(probes) + 1, len(probes) + len(own) + 1)))
            probes += own
        # keys beyond a span's greatest belong to no candidate of it; its last bucket is cut at the next span's lower edge or above
        ends = [key_after(span.high, WIDTH) for span, _ in waiting]
        fenced = sorted(set(probes) | {e for e in ends if e})
        place = {k: n + 1 for n, k in enumerate(fenced)}
        counted = histogram(keys, fenced, {place[probes[n - 1]] for n in wanted})
        waiting = []
        for span, numbers in owner:
            bytes_before, rows_before, left = span.bytes_before, span.rows_before, list(span.targets)
            for n in numbers:
                below = probes[n - 1]
                size, rows, low, high = counted.get(place[below], (0, 0, b"", b""))
                part = Span(bytes_before, rows_before, size, rows, low, high)
                while left and rows and left[0][0] < bytes_before + size:
                    target, exact = left.pop(0)
                    found = settle(part, target, exact, slack[0] if exact else slack[1], below)
                    if found is False:
                        part.targets.append((target, exact))
                    elif found:
                        done.append(found)
                if part.targets:
                    waiting.append((part, below))
                bytes_before, rows_before = bytes_before + size, rows_before + rows
    return sorted(done, key=lambda s: (s.key, not s.between_shards))


def keyed(docs: DataFrame) -> DataFrame:
    """The rows as the struct ``doc``, their key and size; written once, so that row numbers stay as they are."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))
    packed = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    key = F.concat(F.unhex(F.md5(text)), packed(number), packed(F.monotonically_increasing_id()))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("key"), (F.octet_length(text).cast("bigint") + 1).alias("size"))


def shard(docs: DataFrame, shards: int = 16, tolerance: tuple[int, int] = TOLERANCE) -> DataFrame:
    """doc (all columns), size (bytes of the text and one), shard, slot (from 0, in key order); one exchange of the rows."""
    pieces = min(MOST_PIECES, -(-input_blocks(docs) // shards) * shards)
    laid = written(keyed(docs), "keyed")
    cuts = splitters(laid.select("key", "size"), shards, pieces, tolerance)
    edges = np.array([c.key for c in cuts], dtype=f"S{WIDTH}")

    def piece_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, np.frombuffer(b"".join(key), dtype=f"S{WIDTH}"), side="right").astype(np.int32))

    shard_of, first_row, start = [0], 0, [0]
    for cut in cuts:
        shard_of.append(shard_of[-1] + cut.between_shards)
        first_row = cut.rows_before if cut.between_shards else first_row
        start.append(cut.rows_before - first_row)
    piece = F.pandas_udf(piece_of, "int")("key") if cuts else F.lit(0)
    moved = laid.withColumn("piece", piece).repartitionById(len(cuts) + 1, F.col("piece"))
    at = F.row_number().over(Window.partitionBy("piece").orderBy("key")) - 1
    return moved.select(
        "doc", "size", F.element_at(F.lit(shard_of), F.col("piece") + 1).cast("int").alias("shard"), (F.element_at(F.lit(start), F.col("piece") + 1).cast("bigint") + at).cast("bigint").alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; the files of a shard follow one another by slot."""
    sharded.select("doc.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)
