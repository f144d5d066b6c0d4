"""Operator 12: ranked lexical search over document tries, by branch and bound.

The terms of the items restrict every document to a short vector of (term, count).
Sorted by falling document frequency, such vectors share their beginnings: sorted
documents form a trie, built over stretches of the sorted rows. Each node keeps the
greatest count of every term below it, and the least ``m`` (the length term of the
score); with them the score of no document below can be exceeded, since a term's
part grows with its count and falls with ``m``. For each item the trie is walked
depth first, best bound first, and a node is left aside whose bound cannot enter
the item's best ``k``.

Rows are dealt by range over (vector, doc_id), so copies of one document are split
too. Items are taken in blocks of bounded text (``ITEM_BYTES``): only a block's terms
are sent to the tasks; further blocks are further passes.

Defined cases: a null or empty text has no terms and is in no result; a null doc_id
stands behind all others of equal score; each of several rows with one doc_id ranks
for itself, and so does each of several items with one id; items without terms, or
with terms that no document has, give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postern.llm.common import binary_view, block_count, ragged, text_slices, written
from postern.llm.words import LOWER, runs

ITEM_BYTES = 256 << 10  # text of the items of one pass: bounds what is sent to tasks
TRIE_ROWS, LEAF_ROWS = 8192, 64
TERM = np.ones(256, dtype=bool)
TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    start, end, _ = runs(TERM[data], np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms and counts (packed, by term number) of every document with a term."""
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                data = LOWER[data]
                inside = TERM[data]
                start, end, first = runs(inside, offsets)
                if not len(start):
                    continue
                coded = binary_view(data[inside], np.concatenate([[0], np.cumsum(end - start)])).dictionary_encode()
                known = np.array([vocabulary.get(w, -1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
                term = known[coded.indices.to_numpy()]
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                pair, count = np.unique(owner[term >= 0] * width + term[term >= 0], return_counts=True)
                n = np.diff(first)
                bounds = np.searchsorted(pair, np.arange(len(n) + 1) * width) * 4
                packed = lambda x: binary_view(np.frombuffer(x.astype("<u4").tobytes() or b"\0", np.uint8), bounds).cast(pa.binary())
                whole = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), packed(pair % width), packed(count)], ["doc_id", "n", "terms", "counts"])
                yield whole.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, terms binary, counts binary")


def document_frequencies(vectors: DataFrame, width: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4"), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    df = np.zeros(width, np.int64)
    for term, n in vectors.select("terms").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df")).collect():  # a row for each term of the block
        df[term] = n
    return df


def paths(vectors: DataFrame, place: np.ndarray, documents: int, length: int) -> DataFrame:
    """Vectors by falling document frequency: doc_id, m, path (big-endian places, so bytes sort as paths do), counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(t) // 4 for t in batch.column("terms").to_pylist()], dtype=np.int64)
            term = place[np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4")]
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((term, owner))
            count = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<u4")[order]
            bounds = np.concatenate([[0], np.cumsum(size)]) * 4
            packed = lambda x, kind: binary_view(np.frombuffer(x.astype(kind).tobytes() or b"\0", np.uint8), bounds).cast(pa.binary())
            m = [75 + 25 * n * documents // length for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(m, pa.int64()), packed(term[order], ">u4"), packed(count, "<u4")], ["doc_id", "m", "path", "counts"])

    return vectors.where(F.length("terms") > 0).mapInArrow(run, "doc_id bigint, m bigint, path binary, counts binary")


def part(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the score before its weight; grows with the count, falls with m."""
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


class Trie:
    """The trie over documents sorted by path; nodes of at most ``LEAF_ROWS`` rows are leaves."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, path: list[bytes], counts: list[bytes], width: int):
        self.doc = doc
        size = np.array([len(p) // 4 for p in path], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.term = np.frombuffer(b"".join(path), ">u4").astype(np.int64)
        count = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
        self.part = part(count, np.repeat(m, size))
        self.shared = self._shared(size)
        self.size = size
        self.nodes: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow()
        greatest = np.zeros((len(self.nodes), width), np.int64)
        least_m, self.least_doc = np.zeros(len(self.nodes), np.int64), np.zeros(len(self.nodes), np.int64)
        for k in range(len(self.nodes) - 1, -1, -1):  # children stand behind their parent
            a, b = self.nodes[k]
            if self.children[k]:
                greatest[k] = greatest[self.children[k]].max(axis=0)
                least_m[k], self.least_doc[k] = least_m[self.children[k]].min(), self.least_doc[self.children[k]].min()
            else:
                np.maximum.at(greatest[k], self.term[self.start[a] : self.start[b]], count[self.start[a] : self.start[b]])
                least_m[k], self.least_doc[k] = m[a:b].min(), doc[a:b].min()
        self.most = part(greatest, least_m[:, None])

    def _shared(self, size: np.ndarray) -> np.ndarray:
        """Terms at the beginning of each path that it shares with the path before."""
        step = np.arange(len(self.term)) - np.repeat(self.start[:-1], size)
        before = np.repeat(np.concatenate([[0], self.start[:-2]]), size) + step
        limit = np.repeat(np.concatenate([[0], size[:-1]]), size)
        same = (step < limit) & (self.term[np.minimum(before, len(self.term) - 1)] == self.term)
        return np.minimum(np.minimum.reduceat(np.where(same, len(self.term), step), self.start[:-1]), size)

    def _grow(self) -> None:
        """Nodes of shared beginnings, top down; small neighbouring branches share a leaf."""
        open_ = [(0, len(self.size), -1)]
        while open_:
            a, b, parent = open_.pop()
            number = len(self.nodes)
            self.nodes.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(number)
            if b - a <= LEAF_ROWS:
                continue
            inner = self.shared[a + 1 : b]
            cuts = a + 1 + np.flatnonzero(inner == inner.min())
            edges = [a, *cuts.tolist(), b] if inner.min() < self.size[a] or len(cuts) < b - a - 1 else [*range(a, b, LEAF_ROWS), b]
            begin = edges[0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high - begin > LEAF_ROWS and low > begin:
                    open_.append((begin, low, number))
                    begin = low
            open_.append((begin, b, number))

    def search(self, terms: np.ndarray, weights: np.ndarray, spread: np.ndarray, best: Best) -> None:
        """Depth first for one item; ``spread``: its weights over all terms."""
        bound = self.most[:, terms] @ weights
        open_ = [0]
        while open_:
            node = open_.pop()
            if not best.admits(bound[node], self.least_doc[node]):
                continue
            if self.children[node]:
                open_ += sorted(self.children[node], key=bound.__getitem__)
                continue
            a, b = self.nodes[node]
            low, high = self.start[a], self.start[b]
            best.offer(np.add.reduceat(spread[self.term[low:high]] * self.part[low:high], self.start[a:b] - low), self.doc[a:b])


class Best:
    """The best k of an item so far: by score, then by smaller doc_id."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def admits(self, score: int, doc: int) -> bool:
        return score > 0 and (len(self.score) < self.k or score > self.score[-1] or (score == self.score[-1] and doc < self.doc[-1]))

    def offer(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score > 0 if len(self.score) < self.k else (score > self.score[-1]) | ((score == self.score[-1]) & (doc < self.doc[-1]))
        if good.any():
            score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score, self.doc = score[order], doc[order]


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """Best k of every item of one block: (item, doc_id, score)."""
    spark = docs.sparkSession
    asked = [Counter(terms_of(text)) for _, text in items]
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*asked)))}
    vectors = written(term_vectors(docs, vocabulary), "term-vectors")
    documents, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(vectors, len(vocabulary))
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()]
    questions = []
    for n, own in enumerate(asked):
        found = sorted((int(place[vocabulary[t]]), weight[vocabulary[t]] * times) for t, times in own.items() if df[vocabulary[t]])
        if found:
            questions.append((n, np.array([p for p, _ in found]), np.array([w for _, w in found], dtype=np.int64)))
    width = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in questions]
        for table in stretches(batches, TRIE_ROWS):
            trie = Trie(table.column("doc_id").fill_null(NO_ID).to_numpy(), table.column("m").to_numpy(), table.column("path").to_pylist(), table.column("counts").to_pylist(), width)
            spread = np.zeros(width, np.int64)
            for (_, terms, weights), own in zip(questions, best, strict=True):
                spread[terms] = weights
                trie.search(terms, weights, spread, own)
                spread[terms] = 0
        item = np.repeat(np.array([q[0] for q in questions], dtype=np.int64), [len(b.score) for b in best])
        doc, score = (np.concatenate([getattr(b, x) for b in best] or [np.zeros(0, np.int64)]) for x in ("doc", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=doc == NO_ID), pa.array(score)], ["item", "doc_id", "score"])

    dealt = paths(vectors, place, documents, max(length, 1)).repartitionByRange(block_count(spark), "path", "doc_id").sortWithinPartitions("path", "doc_id")
    return dealt.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches of a task again, in tables of about ``rows`` rows."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            waiting.append(batch.slice(at, rows))
            if sum(b.num_rows for b in waiting) >= rows:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting = []
    if waiting and any(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks()


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of every item."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES)
    kind = asked.schema["item_id"].dataType.simpleString()
    results = []
    for block in range(blocks):
        own = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).where("text IS NOT NULL").collect()]
        if any(terms_of(text) for _, text in own):
            found = _search_block(docs, own, k)
            ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
            names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(own)], f"item bigint, item_id {kind}")
            results.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.union, results) if results else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
