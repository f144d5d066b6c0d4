"""Operator 13: spelling variants by dense prefix-suffix tiling.

Words of whole texts are counted where they lie and summed. Two words differ by a
single edit exactly if the lengths of their common prefix and suffix together
reach the longer length minus one; then the longer half is shared, so one of them
is at least half the longer length. Words are therefore brought together by the
longer length and their first or last half. Sorted by that key they form tiles:
padded code-point matrices, compared block pair by block pair. A pair that both
halves bring together counts at its first half only. Keys with more words than a
tile are split by hash into blocks, and each pair of blocks is a tile of its own.
Tiles give sums for each word, never pairs.

Forms are followed to their roots by doubling: each round joins the roots so far
with themselves.

Defined cases: a null text has no words; a null doc_id deletes nothing; repeated
rows count again; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import binary_view, block_count, text_slices, written
from postern.llm.words import LOWER, runs

TILE, BLOCK = 1024, 256  # words of a key that stay together; side of a compared matrix
CELLS = 4 << 20  # code points compared at once: very long words get smaller blocks
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
LONG = 64
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, carried on from the checksum of what stands before it."""
    state = before ^ np.uint32(0xFFFFFFFF)
    live = np.flatnonzero(size <= LONG)
    step = 0
    while len(live):
        byte = data[start[live] + step]
        state[live] = CRC[(state[live] ^ byte) & 0xFF] ^ (state[live] >> np.uint32(8))
        step += 1
        live = live[size[live] > step]
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(before[k]))
    return out


def word_counts(docs: DataFrame, every: int = 199, shortest: int = 6) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least ``shortest`` code points, summed over all whole texts.

    A run loses one code point where ``every`` divides the checksum of its document and itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                data = LOWER[data]
                wide = data == 0xC3  # leads a letter from U+00C0 to U+00FF
                inside = LETTER[data] | wide
                inside[1:] |= wide[:-1]
                start, end, first = runs(inside, offsets)
                many = np.concatenate([[0], np.cumsum(wide)])
                points = end - start - (many[end] - many[start])
                keep = points >= shortest
                if not keep.any():
                    continue
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[keep]
                letters = data[inside][np.repeat(keep, end - start)]
                size, points = (end - start)[keep], points[keep]
                bounds = np.concatenate([[0], np.cumsum(size)])
                ids = rows.column("doc_id").to_pylist()
                lead = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)
                named = np.array([i is not None for i in ids])[owner]
                check = checksums(letters, bounds[:-1], size, lead[owner])
                hit = named & (check % np.uint32(every) == 0)
                cut = []
                for k in np.flatnonzero(hit).tolist():
                    word = letters[bounds[k] : bounds[k + 1]].tobytes().decode()
                    at = int(check[k]) % len(word)
                    if len(word) > shortest:
                        cut.append(word[:at] + word[at + 1 :])
                coded = binary_view(letters, bounds).dictionary_encode()
                n = np.bincount(coded.indices.to_numpy()[~hit], minlength=len(coded.dictionary))
                whole = coded.dictionary.cast(pa.string()).filter(pa.array(n > 0))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([whole, pa.array(cut, pa.string())]), pa.array(np.concatenate([n[n > 0], np.ones(len(cut), np.int64)]))], ["word", "n"])

    counted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def matrix(words: list[str], width: int) -> np.ndarray:
    """Code points of each word, padded with zeros."""
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    return points.astype(np.uint8) if points.max() < 256 else points


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal code points before the first difference, along the last axis (distinct words differ somewhere)."""
    return np.argmax(a != b, axis=-1)


def close_pairs(words: list[str], key: np.ndarray, side: np.ndarray, longer: np.ndarray, first_half: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows of one key that are a single edit apart.

    Rows are sorted by ``key``; where ``split``, only rows of different ``side`` meet.
    """
    size = np.array([len(w) for w in words])
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = 0
    blocks = []
    while begin < len(words):  # a block is as wide as its longest word
        end = min(begin + BLOCK, len(words))
        side_ = max(8, int((CELLS // int(size[begin:end].max())) ** 0.5))
        end = min(end, begin + side_)
        blocks.append((begin, end))
        begin = end
    forward, backward = {}, {}

    def both(k: int, width: int):
        if (k, width) not in forward:
            a, b = blocks[k]
            forward[k, width], backward[k, width] = matrix(words[a:b], width), matrix([w[::-1] for w in words[a:b]], width)
        return forward[k, width], backward[k, width]

    for p, (a, b) in enumerate(blocks):
        for q in range(p, len(blocks)):
            c, d = blocks[q]
            if key[c] > key[b - 1]:
                break
            width = int(max(size[a:b].max(), size[c:d].max()))
            (x, x_back), (y, y_back) = both(p, width), both(q, width)
            if p != q and key[a] == key[b - 1] == key[c] == key[d - 1]:
                i, j = np.divmod(np.arange((b - a) * (d - c)), d - c)
                prefix, suffix = shared(x[:, None], y[None]).ravel(), shared(x_back[:, None], y_back[None]).ravel()
            else:
                i, j = np.nonzero((key[a:b, None] == key[None, c:d]) & (np.arange(a, b)[:, None] < np.arange(c, d)[None]))
                prefix, suffix = shared(x[i], y[j]), shared(x_back[i], y_back[j])
            i, j = i + a, j + c
            top = np.maximum(size[i], size[j])
            good = (prefix + suffix >= top - 1) & (top == longer[i]) & (~split[i] | (side[i] != side[j]))
            good &= first_half[i] | (prefix < longer[i] // 2)
            found_i.append(i[good])
            found_j.append(j[good])
        for k in [k for k in forward if k[0] < p]:
            del forward[k], backward[k]
    return np.concatenate(found_i), np.concatenate(found_j)


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best (struct of -n and word: the near word of largest n, ties to the smaller) of every word with a near one."""
    spark = words.sparkSession
    size = F.char_length("word")
    keys = F.array(*[
        F.struct((size + more).cast("int").alias("longer"), F.lit(first).alias("first_half"), (F.substring(F.col("word"), F.lit(1), F.floor((size + more) / 2).cast("int")) if first else F.right(F.col("word"), F.floor((size + more) / 2).cast("int"))).alias("half"))
        for more in (0, 1) for first in (True, False)
    ])
    rows = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")
    key = ["longer", "first_half", "half"]
    several = rows.groupBy(*key).agg(F.count("*").alias("members"), F.min(F.char_length("word")).alias("least"), F.max(F.char_length("word")).alias("most")).where("members > 1 AND most = longer")
    split = rows.join(several.select(*key, F.ceil(F.col("members") / tile).cast("int").alias("parts")), key)
    split = split.withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "word", "n")
    order = [*key, "low", "high"]
    dealt = split.repartition(block_count(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])]).combine_chunks()
            last = table.num_rows - 1
            tail = [table.column(c)[last].as_py() for c in order]
            cut = last
            while cut > 0 and [table.column(c)[cut - 1].as_py() for c in order] == tail:  # a key has few rows: its blocks are split
                cut -= 1
            waiting = table.slice(cut)
            yield from tiles(table.slice(0, cut))
        if waiting is not None:
            yield from tiles(waiting)

    part = dealt.mapInArrow(run, "word string, near bigint, best_n bigint, best_word string")
    return part.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct(F.col("best_n"), F.col("best_word"))).alias("best"))


def tiles(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each word with near ones in its keys: their number, and the best as (-n, word)."""
    if table.num_rows < 2:
        return
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    longer, low, high, own = (table.column(c).to_numpy() for c in ("longer", "low", "high", "own"))
    first_half = np.array(table.column("first_half").to_pylist(), dtype=bool)
    half = table.column("half").combine_chunks().dictionary_encode()
    half = (half.chunk(0) if isinstance(half, pa.ChunkedArray) else half).indices.to_numpy()
    change = np.concatenate([[False], (longer[1:] != longer[:-1]) | (first_half[1:] != first_half[:-1]) | (half[1:] != half[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    i, j = close_pairs(words, np.cumsum(change), own, longer, first_half, low != high)
    if not len(i):
        return
    this, that = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((np.array([w.encode() for w in words]), -n))] = np.arange(len(words))
    order = np.lexsort((rank[that], this))
    this, that = this[order], that[order]
    begin = np.flatnonzero(np.concatenate([[True], this[1:] != this[:-1]]))
    best = that[begin]
    yield pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in this[begin]]), pa.array(np.diff(np.append(begin, len(this)))), pa.array(-n[best]), pa.array([words[k] for k in best])], ["word", "near", "best_n", "best_word"]
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Each round doubles the steps taken; forms lead to ever more frequent words."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found


def variants(docs: DataFrame, least: int = 5, factor: int = 5, every: int = 199, shortest: int = 6, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs at least ``least`` times."""
    words = written(word_counts(docs, every, shortest).where(F.col("n") >= least), "words")
    joined = words.join(near_words(words, tile), "word", "left")
    form_n = -F.col("best.best_n")
    good = form_n >= factor * F.col("n")
    near = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.best_word")).alias("form"), F.when(good, form_n).alias("form_n")), "near-words")
    last = roots(near.where("form IS NOT NULL"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
