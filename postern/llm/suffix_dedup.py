"""Operator 8: removal of later copies of long passages by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller doc_id. Text is laid down once, split into blocks; every
later step moves only short messages to its block:

1. Content-defined chunks, each with the LENGTH - 1 bytes after it, are compared by
   128-bit digest: all starts inside a chunk that an earlier document has too are
   matched, and only the first document of a chunk goes on. Large groups of copies
   end here, as a partial aggregate.
2. In what is left, each window of LENGTH bytes is represented by the SEED-byte
   string in it with the least hash, so equal windows have equal seeds. Distinct
   seeds of each block are compared; seeds that only one document has are dropped.
3. The surroundings of shared seeds meet by seed. There a suffix array over them is
   built, with common prefix lengths; previous and next smaller document numbers
   in suffix order give the longest previous factor of every position, and those of
   at least LENGTH bytes are matched. Equal surroundings of a block go there once.

Matches never rest on a seed's hash alone; chunk digests are the only hashes trusted.

Defined cases: null text is empty; texts below LENGTH bytes stay; rows with a null
doc_id stay whole and are no earlier document; rows that repeat a doc_id are not
earlier than one another; an empty table gives no rows. Where removal cuts a
UTF-8 character, the text form leaves the rest of that character out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import binary_view, bucketed, ragged, text_blocks, written
from postern.llm.words import mixed

LENGTH, SEED = 50, 24
REACH = LENGTH - SEED + 1  # seeds in a window
CHUNK_BITS, CHUNK_WINDOW, CHUNK_APART = 9, 16, 32
BLOCK_BYTES = 2 << 20  # text of a block, on average; there are two blocks to a bucket
STRETCH = 1 << 20  # seeds are chosen for so many starts at once


def words_at(data: np.ndarray, shift: int, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each position + shift on as one number (zeros beyond the end)."""
    padded = np.concatenate([data[shift:], np.zeros(8 + min(shift, len(data)), np.uint8)])
    return np.ndarray((len(data),), dtype=kind, buffer=padded, strides=(1,)).astype(np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values from a position on (fewer at the end)."""
    done, size = values, 1
    while size < width:
        step = min(size, width - size)
        done = np.minimum(done, np.concatenate([done[step:], np.full(min(step, len(done)), np.iinfo(np.uint64).max, np.uint64)]))
        size += step
    return done


class Block:
    """The texts of one block, in the order of their row numbers."""

    def __init__(self, texts: pa.Table):
        order = np.argsort(texts["row"].to_numpy(), kind="stable")
        texts = texts.take(pa.array(order)).combine_chunks()
        self.table = texts
        self.row = texts["row"].to_numpy()
        ids = texts["doc_id"]
        self.named = ~ids.is_null().to_numpy()
        self.doc = ids.fill_null(0).to_numpy()
        text = texts["text"].combine_chunks().cast(pa.large_binary())
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        whole = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
        self.data = whole[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]

    def marked(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, more: int = 0) -> np.ndarray:
        """Which bytes lie in the given ranges of rows, each lengthened by ``more``."""
        at = self.offsets[np.searchsorted(self.row, rows)]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, at + starts, 1)
        np.add.at(change, at + ends + more, -1)
        return np.cumsum(change[:-1]) > 0

    def place(self, at: np.ndarray) -> np.ndarray:
        """Text number of each byte position."""
        return np.searchsorted(self.offsets, at, side="right") - 1


def chunks(block: Block):
    """Chunk starts and ends of possible match starts, as positions in the block."""
    first, last = block.offsets[:-1], block.offsets[1:] - (LENGTH - 1)
    good = (last > first) & block.named
    if not good.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = mixed(words_at(block.data, 0) * np.uint64(0x9E3779B97F4A7C15) + words_at(block.data, 8))
    low = np.flatnonzero(value < np.uint64(1 << (64 - CHUNK_BITS)))
    # strictly least of those just before it, so that periodic text is not cut at every period
    low = low[low >= CHUNK_APART]
    before = np.stack([value[low - k] for k in range(1, CHUNK_APART + 1)]).min(axis=0) if len(low) else low.astype(np.uint64)
    cut = low[value[low] < before] + CHUNK_WINDOW // 2
    inside = block.place(cut)
    cut, inside = cut[inside < len(first)], inside[inside < len(first)]
    ok = good[inside] & (cut > first[inside]) & (cut < last[inside])
    start = np.unique(np.concatenate([first[good], cut[ok]]))
    end = np.append(start[1:], len(block.data))
    return start, np.minimum(end, last[block.place(start)])


def chunk_rows(texts: pa.Table) -> pa.Table:
    block = Block(texts)
    start, end = chunks(block)
    owner = block.place(start)
    raw = block.data.tobytes()
    digest = [hashlib.blake2b(raw[a : b + LENGTH - 1], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return pa.table({
        "digest": pa.array(digest, pa.binary()), "block": pa.array(np.full(len(start), texts["block"][0].as_py(), np.int32)), "row": pa.array(block.row[owner]),
        "doc": pa.array(block.doc[owner]), "s": pa.array((start - block.offsets[owner]).astype(np.int32)), "e": pa.array((end - block.offsets[owner]).astype(np.int32)),
    })


def seeds(block: Block, wanted: np.ndarray):
    """Seeds of the windows that start at ``wanted`` bytes: (hash of 40 bits, position, first and last window start)."""
    starts = np.flatnonzero(wanted)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    # a stretch at a time; the place in it breaks ties towards the left, and it is read a window further
    out_hash, out_at, out_first, out_last = [], [], [], []
    for a in range(0, len(block.data), STRETCH):
        own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, a + STRETCH)]
        if not len(own):
            continue
        data = block.data[a : a + STRETCH + 2 * LENGTH]
        value = mixed((words_at(data, 0) * np.uint64(0x9E3779B97F4A7C15) + words_at(data, 8)) * np.uint64(0xC2B2AE3D27D4EB4F) + words_at(data, 16))[: STRETCH + LENGTH]
        value >>= np.uint64(24)
        value <<= np.uint64(24)
        value |= np.arange(len(value), dtype=np.uint64)
        least = sliding_min(value, REACH)[own - a]
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64) + a
        change = np.concatenate([[True], (at[1:] != at[:-1]) | (own[1:] != own[:-1] + 1)])
        begin = np.flatnonzero(change)
        out_hash.append((least[begin] >> np.uint64(24)).astype(np.int64))
        out_at.append(at[begin])
        out_first.append(own[begin])
        out_last.append(own[np.append(begin[1:], len(own)) - 1])
    return tuple(np.concatenate(x) for x in (out_hash, out_at, out_first, out_last))


def split_hash(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of a seed; equal rests of different seeds only cost work."""
    again = mixed(value.astype(np.uint64))
    return ((again >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), (again & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def seed_messages(texts: pa.Table, ranges: pa.Table, buckets: int) -> pa.Table:
    """Distinct seeds of a block for each bucket, and which of them two documents of the block have."""
    block = Block(texts)
    number = texts["block"][0].as_py() if texts.num_rows else 0
    value, _, first, _ = seeds(block, block.marked(ranges["row"].to_numpy(), ranges["s"].to_numpy(), ranges["e"].to_numpy())) if texts.num_rows else (np.zeros(0, np.int64),) * 4
    bucket, rest = split_hash(value, buckets)
    doc = block.doc[block.place(first)]
    order = np.lexsort((doc, rest, bucket))
    bucket, rest, doc = bucket[order], rest[order], doc[order]
    new = np.concatenate([[True], (rest[1:] != rest[:-1]) | (bucket[1:] != bucket[:-1])]) if len(rest) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    several = np.zeros(len(begin), bool)
    if len(begin):
        several = doc[np.append(begin[1:], len(doc)) - 1] != doc[begin]
    bucket, rest = bucket[begin], rest[begin]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edge))
    return pa.table({
        "bucket": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(full), number, np.int32)),
        "rest": pa.array([rest[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary()), "several": pa.array([np.packbits(several[edge[k] : edge[k + 1]]).tobytes() for k in full], pa.binary()),
    })


def shared_seeds(messages: pa.Table) -> pa.Table:
    """For each block the seeds of this bucket that more than one document has."""
    rests = [np.frombuffer(x, np.uint32) for x in messages["rest"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(r)].astype(bool) for x, r in zip(messages["several"].to_pylist(), rests, strict=True)]
    rest, flag = np.concatenate(rests), np.concatenate(flags)
    order = np.argsort(rest, kind="stable")
    ordered = rest[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(ordered)))
    shared = (size > 1) | np.logical_or.reduceat(flag[order], begin)
    keep = np.zeros(len(rest), bool)
    keep[order] = np.repeat(shared, size)
    edge = np.cumsum([0, *map(len, rests)])
    out = [(b, rest[edge[k] : edge[k + 1]][keep[edge[k] : edge[k + 1]]].tobytes()) for k, b in enumerate(messages["block"].to_pylist())]
    out = [x for x in out if x[1]]
    return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([messages["bucket"][0].as_py()] * len(out), pa.int32()), "rest": pa.array([x[1] for x in out], pa.binary())})


SURROUNDINGS = "bucket int, doc bigint, block int, row bigint, s int, e int, bytes binary"


def surroundings(texts: pa.Table, notes: pa.Table, buckets: int) -> pa.Table:
    """Surroundings of shared seeds by bucket; with bucket -1, starts already matched by an earlier document of the block."""
    block = Block(texts)
    is_range = notes["rest"].is_null().to_numpy()
    ranges, shared = notes.filter(pa.array(is_range)), notes.filter(pa.array(~is_range))
    number = notes["block"][0].as_py() if notes.num_rows else 0
    nothing = (np.zeros(0, np.int64),) * 4
    if texts.num_rows and ranges.num_rows and shared.num_rows:
        value, _, first, last = seeds(block, block.marked(ranges["row"].to_numpy(), ranges["s"].to_numpy(), ranges["e"].to_numpy()))
    else:
        value, _, first, last = nothing
    bucket, rest = split_hash(value, buckets)
    known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(r, np.uint32).astype(np.uint64) for b, r in zip(shared["bucket"].to_pylist(), shared["rest"].to_pylist(), strict=True)] or [np.zeros(0, np.uint64)]))
    key = (bucket.astype(np.uint64) << np.uint64(32)) | rest.astype(np.uint64)
    if len(known):
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[at] == key
    else:
        hit = np.zeros(len(key), bool)
    bucket, first, last = bucket[hit], first[hit], last[hit]
    size = last - first + LENGTH
    owner = block.place(first)
    doc = block.doc[owner]
    local = first - block.offsets[owner]
    laid = block.data[ragged(first, size)] if len(first) else np.zeros(0, np.uint8)
    column = binary_view(laid, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
    code = column.dictionary_encode().indices.to_numpy() if len(first) else np.zeros(0, np.int64)
    least = np.full(int(code.max()) + 1 if len(code) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    later = doc > least[code] if len(code) else np.zeros(0, bool)
    out = pa.table({
        "bucket": pa.array(np.where(later, -1, bucket).astype(np.int32)), "doc": pa.array(doc), "block": pa.array(np.full(len(first), number, np.int32)), "row": pa.array(block.row[owner]),
        "s": pa.array(local.astype(np.int32)), "e": pa.array((last - first + local + 1).astype(np.int32)), "bytes": column.cast(pa.binary()),
    })
    return out if not later.any() else out.set_column(6, "bytes", pa.array([None if x else y for x, y in zip(later, out["bytes"].to_pylist(), strict=True)], pa.binary()))


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes, and the common prefix length (at most depth) with the one before."""
    keys = []
    for k in range(0, depth, 8):
        word = words_at(data, k, ">u8")[starts]
        if depth - k < 8:
            word = (word >> np.uint64(8 * (8 - depth + k))) << np.uint64(8 * (8 - depth + k))
        keys.append(word)
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(starts), np.int64)
    open_ = np.arange(1, len(starts))
    for k, word in enumerate(keys):
        differ = word[order[open_]] ^ word[order[open_ - 1]]
        same = differ == 0
        byte = np.zeros(len(open_), np.int64)  # equal leading bytes of the word
        still = ~same
        for b in range(8):
            still = still & ((differ >> np.uint64(56 - 8 * b)) & np.uint64(0xFF) == 0)
            byte += still
        common[open_] = np.minimum(8 * k + np.where(same, 8, byte), depth)
        open_ = open_[same]
    return order, common


def previous_smaller(value: np.ndarray, common: np.ndarray, enough: int) -> np.ndarray:
    """Common prefix length with the nearest previous suffix of a smaller value, 0 where it is below ``enough``.

    Pointers leap over what is known not to be smaller, all positions at once.
    """
    n = len(value)
    pointer = np.arange(-1, n - 1)
    least = common.copy()
    least[:1] = 0
    while True:
        active = np.flatnonzero((pointer >= 0) & (least >= enough))
        active = active[value[pointer[active]] >= value[active]]
        if not len(active):
            break
        over = pointer[active]
        new_pointer, new_least = pointer[over], np.minimum(least[active], least[over])
        pointer[active], least[active] = new_pointer, new_least
    return np.where((pointer >= 0) & (least >= enough), least, 0)


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, doc: np.ndarray, enough: int = LENGTH) -> np.ndarray:
    """For each start the longest prefix (at most ``enough``; 0 below it) that also starts in a document with a smaller number."""
    order, common = suffix_order(data, starts, enough)
    value = doc[order]
    before = previous_smaller(value, common, enough)
    after = previous_smaller(value[::-1], np.concatenate([[0], common[:0:-1]]), enough)[::-1]
    out = np.zeros(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def matched(context: pa.Table) -> pa.Table:
    """Ranges of matched starts among the surroundings of one bucket."""
    text = context["bytes"].combine_chunks().cast(pa.large_binary())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    count = np.diff(offsets) - LENGTH + 1
    starts = ragged(offsets[:-1], count)
    owner = np.repeat(np.arange(len(count)), count)
    long = longest_previous_factor(data, starts, context["doc"].to_numpy()[owner]) >= LENGTH
    # runs of matched starts in each surrounding
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin = np.flatnonzero(long & (edge | ~np.concatenate([[False], long[:-1]])))
    end = np.flatnonzero(long & np.concatenate([edge[1:] | ~long[1:], [True]]))
    own = owner[begin]
    shift = context["s"].to_numpy()[own] - offsets[own]
    return pa.table({
        "block": context["block"].take(pa.array(own)), "row": context["row"].take(pa.array(own)), "s": pa.array((starts[begin] + shift).astype(np.int32)), "e": pa.array((starts[end] + shift + 1).astype(np.int32)),
    })


def cleaned(texts: pa.Table, ranges: pa.Table, text_form: bool) -> pa.Table:
    """Texts of a block without the bytes covered from the matched starts."""
    block = Block(texts)
    gone = block.marked(ranges["row"].to_numpy(), ranges["s"].to_numpy(), ranges["e"].to_numpy(), LENGTH - 1) if ranges.num_rows else np.zeros(len(block.data), bool)
    total = np.concatenate([[0], np.cumsum(gone)])
    edge = gone & ~np.concatenate([[False], gone[:-1]])
    inner = block.offsets[:-1][np.diff(block.offsets) > 0]
    edge[inner] = gone[inner]  # a run does not go on from one text to the next
    runs = np.concatenate([[0], np.cumsum(edge)])
    a, b = block.offsets[:-1], block.offsets[1:]
    removed, spans = total[b] - total[a], runs[b] - runs[a]
    kept = block.data[~gone].tobytes()
    ka, kb = a - total[a], b - total[b]
    own = [kept[x:y] for x, y in zip(ka.tolist(), kb.tolist(), strict=True)]
    columns = {"row": pa.array(block.row), "doc_id": block.table["doc_id"], "n_bytes": pa.array(b - a), "n_removed": pa.array(removed), "n_spans": pa.array(spans)}
    if text_form:
        kept = pa.array([x.decode("utf-8", "ignore") for x in own], pa.string())
        return pa.table(columns | {"kept": kept, "rest": block.table["rest"]})
    return pa.table(columns | {"kept": pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string())})


def remove_repeats(docs: DataFrame, text_form: bool = False) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept (the remaining text, or its SHA-256) of each row.

    The text form also carries the other columns, in the struct ``rest``.
    """
    n = text_blocks(docs, 2 * BLOCK_BYTES)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    carried = [c for c in docs.columns if c != "text"] if text_form else []
    laid = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *([F.struct(*carried, F.col("text").isNull().alias("_no_text")).alias("rest")] if text_form else [])
    ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(2 * n)).cast("int"))
    texts = bucketed(laid, "block", n, "texts")
    by_block = texts.select("row", "block", "doc_id", "text").groupBy("block")
    found = written(by_block.applyInArrow(chunk_rows, "digest binary, block int, row bigint, doc bigint, s int, e int"), "chunks")
    first = found.groupBy("digest").agg(F.min("doc").alias("first"))
    placed = written(found.join(first, "digest").select("block", "row", "s", "e", (F.col("doc") > F.col("first")).alias("later")), "chunk-ranges")
    earlier = placed.where("NOT later").select("block", "row", "s", "e")
    messages = by_block.cogroup(earlier.groupBy("block")).applyInArrow(lambda t, r: seed_messages(t, r, n), "bucket int, block int, rest binary, several binary")
    shared = messages.groupBy("bucket").applyInArrow(shared_seeds, "block int, bucket int, rest binary")
    none = lambda kind: F.lit(None).cast(kind)
    notes = earlier.select("block", "row", "s", "e", none("int").alias("bucket"), none("binary").alias("rest")).union(
        shared.select("block", none("bigint"), none("int"), none("int"), "bucket", "rest")
    )
    around = written(by_block.cogroup(notes.groupBy("block")).applyInArrow(lambda t, m: surroundings(t, m, n), SURROUNDINGS), "surroundings")
    by_suffix = around.where("bucket >= 0").groupBy("bucket").applyInArrow(matched, "block int, row bigint, s int, e int")
    ranges = placed.where("later").drop("later").union(around.where("bucket < 0").select("block", "row", "s", "e")).union(by_suffix)
    schema = "row bigint, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept string"
    if text_form:
        schema += f", rest {texts.schema['rest'].dataType.simpleString()}"
        by_block = texts.groupBy("block")
    return by_block.cogroup(ranges.groupBy("block")).applyInArrow(lambda t, r: cleaned(t, r, text_form), schema)


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """All columns of the documents, their texts without later copies; n_chars follows the text."""
    done = remove_repeats(docs, text_form=True)
    changed = F.col("n_removed") > 0
    columns = []
    for c in docs.columns:
        value = F.col("rest").getField(c) if c != "text" else F.when(F.col("rest").getField("_no_text"), None).otherwise(F.col("kept"))
        if c == "n_chars":
            value = F.when(changed, F.length("kept").cast("bigint")).otherwise(value)
        columns.append(value.alias(c))
    return done.select(*columns)
