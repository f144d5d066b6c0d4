"""Operator 5: a hidden Markov language model over all documents.

One pass splits the whole texts into words and writes, for each slice of text,
its distinct words (as rows) and the documents as codes into them; so the corpus
counts, and the way back from a count to the documents, move distinct words of
slices and never tokens. The most frequent words are symbols of their own, all
others share symbols by their first and last bytes, so the model's size is
bounded while every word keeps its own corpus count: P(word | state) is
P(symbol | state) times the word's part of its symbol. Words not seen in training
are one symbol whose probability is the share of words seen once.

Baum-Welch: every partition runs forward and backward over its documents and
gives expected counts per symbol, summed by Spark; the start is a mixture of word
distributions, fitted the same way to all of them. The score is the scaled forward
recursion over the whole text.

Defined cases: null text is empty (the end token alone); a null doc_id counts as
the empty text in the fold; repeated rows are documents of their own; without
training documents every word is unknown; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import discarded, ragged, text_slices, written
from postern.llm.words import coded_words, mixed, split_words, word_hashes

STATES, TOP_WORDS, CLASSES, ROUNDS = 8, 8192, 4096, 3
SEGMENT = 256  # longest sequence in training; scores run over whole texts
START_ROUNDS = 12
ROWS = 256  # documents counted at once in training
WAVE = 4_000_000  # tokens scored side by side
UNKNOWN = TOP_WORDS + CLASSES
END_HASH = 0
SYMBOL_BITS = 14
SLICE = 4 << 20
FOLD = "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 5 = 1"


CODEC = "zstd"
SLICE_ROW = "slice bigint, doc_id array<bigint>, held_out array<boolean>, size array<int>, codes binary, hash array<bigint>, kind array<smallint>, n array<int>"


def planes(codes: np.ndarray) -> bytes:
    """Codes below 2**24 as a plane of low halves and a plane of high bytes, compressed."""
    return pa.compress(codes.astype("<u2").tobytes() + (codes >> 16).astype("u1").tobytes(), CODEC, asbytes=True)


def unplaned(raw: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(raw, 3 * n, CODEC, asbytes=True)
    return np.frombuffer(raw, "<u2", n).astype(np.int64) | (np.frombuffer(raw, "u1", n, 2 * n).astype(np.int64) << 16)


def sliced(docs: DataFrame) -> DataFrame:
    """One row for each slice of text: its documents as codes, and its distinct words (hash, kind, training count) by code."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, offsets in text_slices(batch, SLICE):
                flat, bounds, first = split_words(data, offsets)
                codes, words, starts = coded_words(flat, bounds)
                size = np.diff(starts)
                end = len(size)  # the code of the end token
                held = rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                trained = np.repeat(~held, np.diff(first))
                n = np.append(np.bincount(codes[trained], minlength=end), (~held).sum())
                hashes = word_hashes(words, starts)
                hashes[hashes == END_HASH] = 1
                padded = np.concatenate([[0], words, [0, 0]]).astype(np.uint64)
                kind = mixed(padded[starts[:-1] + 1] << np.uint64(16) | padded[starts[1:]] << np.uint64(8) | padded[starts[1:] - (size > 1)]) % np.uint64(CLASSES)
                ended = np.insert(codes.astype(np.int64), first[1:], end)  # the end token behind each text
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), one(rows.column("doc_id"), pa.int64()), one(held, pa.bool_()), one((np.diff(first) + 1).astype(np.int32), pa.int32()), pa.array([planes(ended)], pa.binary()),
                     one(np.append(hashes.view(np.int64), END_HASH), pa.int64()), one(np.append(kind.astype(np.int16), 0).astype(np.int16), pa.int16()), one(n.astype(np.int32), pa.int32())],
                    ["slice", "doc_id", "held_out", "size", "codes", "hash", "kind", "n"],
                )
                number += 1

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(FOLD).alias("held_out"), "text")
    return written(narrow.mapInArrow(cut, SLICE_ROW), "slices")


def vocabulary(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words of slices with slice and code, corpus counts and kind of every word)."""
    counts = cut.select(F.explode(F.arrays_zip("hash", "kind", "n")).alias("w")).select("w.hash", "w.kind", F.col("w.n").cast("bigint").alias("n"))
    totals = written(counts.groupBy("hash").agg(F.sum("n").alias("c"), F.min("kind").cast("int").alias("kind")), "word-counts")
    return cut.select("slice", F.posexplode("hash").alias("code", "hash")), totals


class Corpus:
    """Sizes of the training corpus, and the mass of every symbol."""

    def __init__(self, totals: DataFrame):
        known = totals.where("c > 0")
        self.n, self.v, self.once = (int(x or 0) for x in known.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0))).first())
        # at most TOP_WORDS rows, the size of the model
        top = known.orderBy(F.desc("c"), "hash").limit(TOP_WORDS).select("hash", "c").collect()
        self.top = {r.hash: k for k, r in enumerate(top)}
        self.below = self.n + 0.5 * (self.v + 1)
        mass = np.zeros(UNKNOWN + 1)
        for k, r in enumerate(top):
            mass[k] = (r.c + 0.5) / self.below
        share = known.groupBy("kind").agg(F.sum(F.col("c") + 0.5).alias("m")).collect()  # at most CLASSES rows
        own = np.zeros(CLASSES)
        for r in share:
            own[r.kind] = r.m
        for r in known.join(F.broadcast(totals.sparkSession.createDataFrame([(h,) for h in self.top] or [(None,)], "hash bigint")), "hash").groupBy("kind").agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
            own[r.kind] -= r.m
        mass[TOP_WORDS:UNKNOWN] = np.maximum(own, 0) / self.below
        mass[UNKNOWN] = 0.5 / self.below
        self.mass = mass
        self.unknown = min(max(self.once, 0.5) / max(self.n, 1), 0.5)


def symbols(cut: DataFrame, local: DataFrame, totals: DataFrame, corpus: Corpus) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, within (log10 parts of words in their symbols), symbols binary."""
    tops = F.broadcast(totals.sparkSession.createDataFrame(list(corpus.top.items()) or [(None, None)], "hash bigint, place int"))
    counted = totals.join(tops, "hash", "left").select("hash", "c", F.when(F.col("c") == 0, UNKNOWN).otherwise(F.coalesce("place", TOP_WORDS + F.col("kind"))).cast("int").alias("symbol"))
    # the count above the symbol in one number: the way back moves as little as it can
    packed = (F.shiftleft("c", SYMBOL_BITS) + F.col("symbol")).alias("packed")
    back = local.join(counted.select("hash", packed), "hash").select("slice", "code", "packed")
    mass, below, unknown = corpus.mass, corpus.below, corpus.unknown

    def put(key, words: pa.Table, texts: pa.Table) -> pa.Table:
        packed = np.zeros(words.num_rows, np.int64)
        packed[words["code"].to_numpy()] = words["packed"].to_numpy()
        c, symbol = packed >> SYMBOL_BITS, packed & ((1 << SYMBOL_BITS) - 1)
        base = np.log10((c + 0.5) / below)
        shared = (symbol >= TOP_WORDS) & (symbol < UNKNOWN)
        part = np.where(shared, base - np.log10(np.maximum(mass[symbol], 1e-300)), 0.0)
        size = texts["size"].combine_chunks().flatten().to_numpy().astype(np.int64)  # a slice is one row
        flat = unplaned(texts["codes"][0].as_py(), int(size.sum())) if texts.num_rows else np.zeros(0, np.int64)
        at = np.cumsum(size) - size
        total = lambda x: np.add.reduceat(x[flat], at) if len(at) else np.zeros(0)
        out = symbol[flat].astype("<u2")
        return pa.table({
            "doc_id": texts["doc_id"].combine_chunks().flatten(), "held_out": texts["held_out"].combine_chunks().flatten(), "n_tokens": pa.array(size), "n_known": pa.array(total((c > 0).astype(np.int64)).astype(np.int64)),
            "base_score": pa.array(total(base)), "within": pa.array(total(part)), "symbols": pa.array([out[a : a + n].tobytes() for a, n in zip(at, size, strict=True)], pa.binary()),
        })

    texts = cut.select(F.col("slice").alias("text_slice"), "doc_id", "held_out", "size", "codes")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, within double, symbols binary"
    return written(back.groupBy("slice").cogroup(texts.groupBy("text_slice")).applyInArrow(put, schema), "symbols")


class Model:
    """Start, transition and emission probabilities; the unknown symbol is as likely in every state."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emissions: np.ndarray, corpus: Corpus):
        """From counts: start (K), moves (K, K), emissions (symbols, K); smoothed towards the corpus."""
        known = corpus.mass.copy()
        known[UNKNOWN] = 0
        known = known / known.sum() if known.sum() else np.full(len(known), 1 / UNKNOWN) * (np.arange(len(known)) < UNKNOWN)
        emissions = emissions.copy()
        emissions[UNKNOWN] = 0
        e = (emissions + 50 * known[:, None]) / (emissions.sum(axis=0) + 50)
        e = 0.999 * e + 0.001 * known[:, None]
        e *= 1 - corpus.unknown
        e[UNKNOWN] = corpus.unknown
        self.e = e
        self.start = (start + 1) / (start + 1).sum()
        self.moves = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)

    def log10_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scaled forward recursion, many texts side by side, longest first."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([texts[k] for k in order]) if len(texts) else np.zeros(0, np.uint16)
        at = np.cumsum(size[order]) - size[order]
        live = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), side="right")
        log = np.zeros(len(texts))
        alpha = np.tile(self.start, (len(texts), 1))
        for t, n in enumerate(live.tolist()):
            alpha = alpha[:n] if t == 0 else alpha[:n] @ self.moves
            alpha = alpha * self.e[flat[at[:n] + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            log[:n] += np.log10(scale)
        out = np.empty(len(texts))
        out[order] = log
        return out

    def counts(self, symbol: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected start, move and emission counts of sequences (rows of ``symbol``, filled to one length)."""
        n, length = symbol.shape
        k = len(self.start)
        inside = np.arange(length) < size[:, None]
        emit = np.where(inside[:, :, None], self.e[symbol], 1.0)
        alpha = np.empty((length, n, k))
        scale = np.ones((length, n))
        now = np.tile(self.start, (n, 1)) * emit[:, 0]
        for t in range(length):
            if t:
                now = (alpha[t - 1] @ self.moves) * emit[:, t]
            s = now.sum(axis=1)
            alpha[t], scale[t] = now / s[:, None], s
        beta = np.ones((n, k))
        moves = np.zeros((k, k))
        gamma = np.empty((length, n, k))
        for t in range(length - 1, -1, -1):
            g = alpha[t] * beta
            gamma[t] = g / g.sum(axis=1, keepdims=True)
            if t:
                ahead = emit[:, t] * beta / scale[t][:, None]
                ahead[~inside[:, t]] = 0
                moves += alpha[t - 1].T @ ahead
                back = ahead @ self.moves.T
                beta = np.where(inside[:, t][:, None], back, 1.0)
        moves *= self.moves
        rows = inside.T
        places = symbol.T[rows]
        emissions = np.stack([np.bincount(places, gamma[:, :, j][rows], UNKNOWN + 1) for j in range(k)], axis=1)
        return gamma[0][first].sum(axis=0), moves, emissions


def segments(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut to at most SEGMENT symbols: a filled matrix, their lengths, and whether a segment begins its text."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.concatenate(texts)
    n = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), n)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    begin = (np.cumsum(size) - size)[owner] + number * SEGMENT
    length = np.minimum(size[owner] - number * SEGMENT, SEGMENT)
    out = np.zeros((len(begin), int(length.max())), dtype=np.int64)
    column = ragged(np.zeros(len(length), np.int64), length)
    out[np.repeat(np.arange(len(length)), length), column] = flat[ragged(begin, length)]
    return out, length, number == 0


def mixture_start(training: DataFrame, corpus: Corpus, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First counts: a mixture of word distributions over all training documents, and states that tend to stay.

    Every round weighs each whole document by the distributions of the round before; in
    the first, a document's weights are drawn from its own symbols, so they do not depend on partitions.
    """
    known = corpus.mass + 1e-12
    emissions, belong = np.zeros((UNKNOWN + 1, states)), np.zeros(states)
    for number in range(START_ROUNDS):
        e = np.log((emissions + 20 * known[:, None]) / (emissions.sum(axis=0) + 20))
        shared = training.sparkSession.sparkContext.broadcast((e, np.log(belong + 1)) if number else None)

        def weigh(texts: list[np.ndarray], shared=shared) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            size = np.array([len(t) for t in texts], dtype=np.int64)
            flat = np.concatenate(texts).astype(np.int64)
            if shared.value is None:
                weights = np.stack([np.random.default_rng([3, zlib.crc32(t.tobytes())]).dirichlet(np.full(states, 0.3)) for t in texts])
            else:
                e, prior = shared.value
                fit = np.add.reduceat(e[flat], np.cumsum(size) - size) + prior  # the end token is in every text
                weights = np.exp(0.05 * (fit - fit.max(axis=1, keepdims=True)))
                weights /= weights.sum(axis=1, keepdims=True)
            yield weights.sum(axis=0), np.zeros((states, states)), np.stack([np.bincount(flat, np.repeat(weights[:, j], size), UNKNOWN + 1) for j in range(states)], axis=1)

        belong, _, emissions = summed(training, weigh, states)
    return np.ones(states), np.eye(states) * 50 + 1, emissions


def summed(training: DataFrame, counts: Callable[[list[np.ndarray]], Iterator[tuple]], states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, move and emission counts of all training documents: a sum over partitions, by symbol."""
    columns = [f"s{j}" for j in range(states)]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((UNKNOWN + 1, states))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                for s, m, e in counts([np.frombuffer(t, "<u2") for t in batch.column("symbols").slice(k, ROWS).to_pylist()]):
                    start, moves, emissions = start + s, moves + m, emissions + e
        used = np.flatnonzero(emissions.any(axis=1))
        table = np.concatenate([emissions[used], start[None], moves])
        key = np.concatenate([used, [-1], -2 - np.arange(states)])
        yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.ascontiguousarray(table[:, j])) for j in range(states))], ["symbol", *columns])

    sums = training.mapInArrow(expect, "symbol bigint, " + ", ".join(f"{c} double" for c in columns)).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns])
    start, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((UNKNOWN + 1, states))
    for row in sums.collect():  # one row for each symbol of the model
        values = np.array(row[1:])
        if row.symbol >= 0:
            emissions[row.symbol] = values
        elif row.symbol == -1:
            start = values
        else:
            moves[-2 - row.symbol] = values
    return start, moves, emissions


def learn(coded: DataFrame, corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training documents, from a mixture over all of them."""
    training = coded.where("NOT held_out").select("symbols")
    model = Model(*mixture_start(training, corpus, states), corpus)
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)

        def expected(texts: list[np.ndarray], shared=shared) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rows, size, first = segments(texts)
            for a in range(0, len(rows), 1024):
                part = slice(a, a + 1024)
                yield shared.value.counts(rows[part], size[part], first[part])

        model = Model(*summed(training, expected, states), corpus)
    return model


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    cut = sliced(docs)
    local, totals = vocabulary(cut)
    corpus = Corpus(totals)
    coded = symbols(cut, local, totals, corpus)
    discarded(cut)  # the symbols are all that later rounds read
    model = docs.sparkSession.sparkContext.broadcast(learn(coded, corpus, states, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        held: list[pa.RecordBatch] = []
        tokens = 0

        def give():
            whole = pa.Table.from_batches(held)
            value = own.log10_likelihood([np.frombuffer(t, "<u2") for t in whole["symbols"].to_pylist()]) + whole["within"].to_numpy()
            yield from whole.drop_columns(["symbols", "within"]).append_column("score", pa.array(value)).combine_chunks().to_batches()

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                held.append(batch.slice(k, 256))
                tokens += int(held[-1].column("n_tokens").to_numpy().sum())
                if tokens >= WAVE:
                    yield from give()
                    held, tokens = [], 0
        if held:
            yield from give()

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = coded.mapInArrow(run, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.n).cast("bigint").alias("train_tokens"), "base_score", "score")
