"""Operator 10: BPE encoding and decoding over a minimal acyclic transducer lexicon.

Pre-tokens of a whole batch are found with array operations and dictionary
encoded, so each distinct pre-token of a batch is encoded once. Frequent words of
the corpus are compiled into a minimal acyclic automaton whose transitions carry
partial outputs: their sum along a word is its number, which addresses its ids.
The automaton is broadcast as one flat file image (its size is bounded by
``LEXICON_WORDS``), laid down once per worker and memory-mapped. Words outside
are merged exactly by rank, many words per array step.

Defined cases: a null text is empty; an empty text has no ids; the vocabulary's
added tokens are recognised in the text as the library does; bytes that are not
UTF-8 decode to U+FFFD; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import binary_view, most_frequent, ragged, text_slices, written

LEXICON_WORDS = 65_536
PUNCTUATION, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """Class of every code point, as the library's own expressions see it."""
    from tokenizers import Regex, pre_tokenizers

    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "." for c in range(0x110000))
    table = np.zeros(0x110000, dtype=np.uint8)
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        rest = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for _, (start, end) in rest.pre_tokenize_str(points):
            table[start:end] = value
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pre-tokens (they tile the text), and per text the number of its first one."""
    raw = data.tobytes()
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _classes()[points]
    n = len(points)
    if n == len(raw):
        at = None
        breaks = offsets
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # a byte that is no UTF-8
        at = np.concatenate([[0], np.cumsum(width)])
        breaks = np.searchsorted(at, offsets)
    first = np.zeros(n + 1, dtype=bool)  # a piece of text begins here; an added token is a piece
    first[breaks] = True
    inside: list[tuple[int, int]] = []
    for token in added:
        here = raw.find(token)
        while here >= 0:
            row = int(np.searchsorted(offsets, here, side="right")) - 1
            if here + len(token) <= offsets[row + 1]:
                pair = (here, here + len(token)) if at is None else (int(np.searchsorted(at, here)), int(np.searchsorted(at, here + len(token))))
                first[list(pair)] = True
                inside.append(pair)
            here = raw.find(token, here + len(token))
    last = first[1:]  # the piece ends after this character
    first = first[:-1]
    space = kind == SPACE
    before = np.concatenate([[False], (points[:-1] == 0x20)]) & ~first
    changes = np.concatenate([[True], kind[1:] != kind[:-1]]) | first
    start = changes & ~(before & ~space)
    start |= space & ~last & np.concatenate([~space[1:], [False]])
    quote = np.flatnonzero((points == 0x27) & changes & ~before & ~last & np.concatenate([kind[1:] == LETTER, [False]]))
    if len(quote):
        one = points[quote + 1]
        two = np.where(last[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[np.minimum(quote + size, n - 1)[quote + size < n]] = True
    for a, b in inside:
        start[a] = True
        start[a + 1 : b] = False
    begins = np.flatnonzero(start)
    rows = np.searchsorted(begins, breaks)
    begins = np.append(begins, n)
    return (begins if at is None else at[begins]).astype(np.int64), rows


class Vocabulary:
    """Byte-level vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocabulary = spec["model"]["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*vocabulary.values(), *self.added.values())
        self.first = np.zeros(256, np.int64)
        pieces = [b""] * self.size
        for token, number in vocabulary.items():
            pieces[number] = bytes(self.letters[c] for c in token)
            if len(token) == 1:
                self.first[self.letters[token]] = number
        for token, number in self.added.items():
            pieces[number] = token
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.piece_start = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self._hash_pairs()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash_pairs(self) -> None:
        """Open addressing table from a pair of ids to its rank."""
        self.bits = max(8, int(np.ceil(np.log2(max(len(self.left), 1) * 4))))
        key = self.left * self.size + self.right
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.ranks = np.full((1 << self.bits) + 64, len(key), dtype=np.int64)
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            while self.keys[slot] not in (-1, k):
                slot += 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = k, rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        slot = self._slot(key)
        found = self.keys[slot]
        result = np.where(found == key, self.ranks[slot], len(self.left))
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] += 1
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            result[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return result

    def merge_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merges of many words: (ids of all words, number of ids per word)."""
        counts = np.zeros(len(lengths), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, 32, 64):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for part in np.array_split(rows, max(1, len(rows) // 20_000)):
                if len(part):
                    ids, size = self._merge_matrix(data, starts[part], lengths[part], high)
                    counts[part] = size
                    parts.append((part, ids, size))
        for row in np.flatnonzero(lengths > low):
            ids = np.array(self._merge_long(data[starts[row] : starts[row] + lengths[row]]), dtype=np.int64)
            counts[row] = len(ids)
            parts.append((np.array([row]), ids, counts[row : row + 1]))
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.int64)
        for rows, ids, size in parts:
            out[ragged(begin[rows], size)] = ids
        return out, counts

    def _merge_matrix(self, data, starts, lengths, width):
        nothing = len(self.left)
        column = np.arange(width)
        filled = column < lengths[:, None]
        token = np.where(filled, self.first[data[np.minimum(starts[:, None] + column, len(data) - 1)]], -1)
        size = lengths.copy()
        rank = np.full((len(starts), width), nothing, dtype=np.int64)
        pair = filled[:, 1:]
        rank[:, :-1][pair] = self.rank(token[:, :-1][pair], token[:, 1:][pair])
        active = np.arange(len(starts))
        work, work_rank = token, rank
        while len(active):
            at = np.argmin(work_rank, axis=1)
            best = work_rank[np.arange(len(at)), at]
            more = best < nothing
            if not more.all():
                token[active[~more]] = work[~more]
                active, work, work_rank, at, best = active[more], work[more], work_rank[more], at[more], best[more]
                if not len(active):
                    break
            row = np.arange(len(at))
            work[row, at] = self.merged[best]
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            work = np.take_along_axis(work, shift, axis=1)
            work_rank = np.take_along_axis(work_rank, shift, axis=1)
            size[active] -= 1
            left = size[active]
            work[row, left] = -1
            work_rank[row, left] = nothing
            work_rank[row, at] = nothing
            follow = np.flatnonzero(at + 1 < left)
            work_rank[follow, at[follow]] = self.rank(work[follow, at[follow]], work[follow, at[follow] + 1])
            lead = np.flatnonzero(at > 0)
            work_rank[lead, at[lead] - 1] = self.rank(work[lead, at[lead] - 1], work[lead, at[lead]])
        return token[column < size[:, None]], size

    @property
    def rank_of(self) -> dict:
        if not hasattr(self, "_rank_of"):
            self._rank_of = {}
            for rank, pair in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
                self._rank_of.setdefault(pair, rank)
        return self._rank_of

    def _merge_long(self, word: np.ndarray) -> list[int]:
        """One long word by a heap of adjacent pairs: n log n."""
        token = self.first[word].tolist()
        n = len(token)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := self.rank_of.get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.rank_of.get((token[k], token[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, token[k], token[after[k]]))
        return [t for t in token if t >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        return self.piece_bytes[ragged(self.piece_start[ids], self.piece_start[ids + 1] - self.piece_start[ids])]


class Lexicon:
    """Minimal acyclic transducer from words to id sequences, as flat arrays in one image."""

    FIELDS = ("base", "final", "check", "target", "output", "id_start", "ids")

    @staticmethod
    def compile(words: list[bytes], id_start: np.ndarray, ids: np.ndarray) -> bytes:
        """``words`` sorted and distinct; word k has ids[id_start[k]:id_start[k + 1]]."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, state), ...))

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]
        previous = b""
        for word in words:
            common = len(os.path.commonprefix([previous, word]))
            while len(path) > common + 1:
                node = path.pop()
                path[-1][1].append((previous[len(path) - 1], close(node)))
            path.extend([False, []] for _ in range(len(word) - common))
            path[-1][0] = True
            previous = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], close(node)))
        root = close(path[0])
        below: list[int] = []  # words from each state; targets have smaller numbers
        for final, arcs in states:
            below.append(int(final) + sum(below[t] for _, t in arcs))
        base = np.zeros(len(states), np.int64)
        room = 256 + sum(len(a) for _, a in states) * 2
        taken = bytearray(room + 512)
        check = np.full(room + 512, -1, np.int64)
        target, output = np.zeros(room + 512, np.int64), np.zeros(room + 512, np.int64)
        free = wide = top = 256  # first open slot; where states with several arcs are tried; end of the used slots
        for state in sorted(range(len(states)), key=lambda s: -len(states[s][1])):
            final, arcs = states[state]
            if not arcs:
                continue
            while taken[free]:
                free += 1
            here = free - arcs[0][0] if len(arcs) == 1 else wide
            tries = 0
            while any(taken[here + b] for b, _ in arcs):
                here, tries = here + 1, tries + 1
                if tries == 64:
                    here = wide = max(top - 32, 256)
            top = max(top, here + arcs[-1][0] + 1)
            if top + 1024 > len(taken):
                more = len(taken)
                taken.extend(bytes(more))
                check = np.concatenate([check, np.full(more, -1, np.int64)])
                target, output = np.concatenate([target, np.zeros(more, np.int64)]), np.concatenate([output, np.zeros(more, np.int64)])
            base[state], skipped = here, int(final)
            for byte, to in arcs:
                taken[here + byte] = 1
                check[here + byte], target[here + byte], output[here + byte] = state, to, skipped
                skipped += below[to]
        used = max((k for k, t in enumerate(taken) if t), default=0) + 257
        arrays = [base, np.array([f for f, _ in states], np.int64), check[:used], target[:used], output[:used], np.asarray(id_start, np.int64), np.asarray(ids, np.int64)]
        head = np.array([root, *map(len, arrays)], dtype=np.int64)
        return head.tobytes() + b"".join(a.astype(np.int32).tobytes() for a in arrays)

    def __init__(self, image: bytes):
        """Lay the image down in the worker's own temp folder and map it; the file has no name any more afterwards."""
        with tempfile.TemporaryFile() as file:
            file.write(image)
            file.flush()
            mapped = np.memmap(file, dtype=np.uint8, mode="r")
        head = mapped[: 8 * (1 + len(self.FIELDS))].view(np.int64)
        self.root, here = int(head[0]), 8 * (1 + len(self.FIELDS))
        for field, size in zip(self.FIELDS, head[1:], strict=True):
            setattr(self, field, mapped[here : here + 4 * int(size)].view(np.int32))
            here += 4 * int(size)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each word, or -1: all words walk the automaton side by side."""
        number = np.full(len(starts), -1, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        live = order
        state = np.full(len(live), self.root, dtype=np.int32)
        total = np.zeros(len(live), dtype=np.int64)
        step = 0
        while len(live):
            ended = lengths[live] == step
            if ended.any():
                done = ended & (self.final[state] == 1)
                number[live[done]] = total[done]
                live, state, total = live[~ended], state[~ended], total[~ended]
            slot = self.base[state] + data[starts[live] + step]
            good = self.check[slot] == state
            slot, live, total = slot[good], live[good], total[good]
            state = self.target[slot]
            total = total + self.output[slot]
            step += 1
        return number


class Encoder:
    """Encodes batches: the lexicon first, exact merges for the rest."""

    def __init__(self, path: str, image: bytes | None = None):
        self.vocabulary = Vocabulary(path)
        self.lexicon = Lexicon(image) if image else None

    def encode_types(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids per word)."""
        number = self.lexicon.find(data, starts, lengths) if self.lexicon else np.full(len(starts), -1)
        known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        counts = np.zeros(len(starts), dtype=np.int64)
        merged, counts[unseen] = self.vocabulary.merge_words(data, starts[unseen], lengths[unseen])
        if len(known):
            begin = self.lexicon.id_start[number[known]].astype(np.int64)
            counts[known] = self.lexicon.id_start[number[known] + 1] - begin
        ids = np.zeros(int(counts.sum()), dtype=np.int64)
        at = np.cumsum(counts) - counts
        ids[ragged(at[unseen], counts[unseen])] = merged
        if len(known):
            ids[ragged(at[known], counts[known])] = self.lexicon.ids[ragged(begin, counts[known])]
        for k, token in self._added(data, starts, lengths):
            ids[at[k] : at[k] + counts[k]] = -1
            ids[at[k]] = token
        if len(self.vocabulary.added):
            keep = ids >= 0
            if not keep.all():
                counts = np.add.reduceat(keep, at).astype(np.int64)
                ids = ids[keep]
        return ids, counts

    def _added(self, data, starts, lengths):
        for token, number in self.vocabulary.added.items():
            for k in np.flatnonzero(lengths == len(token)):
                if data[starts[k] : starts[k] + lengths[k]].tobytes() == token:
                    yield k, number

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        return encode_with(self.encode_types, tuple(self.vocabulary.added), data, offsets)


def encode_with(encode_types, added, data, offsets):
    """Encode every distinct pre-token of a batch once and lay the ids out text by text."""
    bounds, rows = pretokens(data, offsets, added)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    coded = binary_view(data, bounds).dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    start = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
    type_ids, counts = encode_types(np.frombuffer(words.buffers()[2], dtype=np.uint8), start[:-1], np.diff(start))
    begin = np.cumsum(counts) - counts
    sizes = counts[codes]
    ids = type_ids[ragged(begin[codes], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ids, ends[rows]


SLICE = 2 << 20  # text worked on at once: finding pre-tokens takes some thirty bytes for each
PENDING = 1 << 18  # distinct words of slices that a task adds up before it hands them on


@cache
def added_tokens(path: str) -> tuple[bytes, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"].encode() for t in json.load(file)["added_tokens"])


def word_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(word binary, n): pre-token counts over all whole texts, summed over slices of a task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = added_tokens(vocabulary_path)
        waiting: list[pa.Table] = []

        def summed() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(waiting).group_by("word").aggregate([("n", "sum")])
            yield from whole.rename_columns({"n_sum": "n"}).select(["word", "n"]).to_batches()

        for batch in batches:
            for _, data, offsets in text_slices(batch, SLICE):
                bounds, _ = pretokens(data, offsets, added)
                if len(bounds) > 1:
                    coded = binary_view(data, bounds).dictionary_encode()
                    n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    waiting.append(pa.table({"word": coded.dictionary.cast(pa.binary()), "n": n}))
                    if sum(t.num_rows for t in waiting) >= PENDING:
                        yield from summed()
                        waiting = []
        if waiting:
            yield from summed()

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON_WORDS) -> bytes:
    """Image of the lexicon of the most frequent words, at most ``size`` (a bound of the model; it decides cost, never ids)."""
    counted = written(word_counts(docs, vocabulary_path).where(F.length("word") <= 64), "pretokens")
    vocabulary = Vocabulary(vocabulary_path)
    words = sorted(bytes(r[0]) for r in most_frequent(counted, "n", size).select("word").collect())
    words = [w for w in words if w not in vocabulary.added]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    data = np.frombuffer(b"".join(words) or b"\0", dtype=np.uint8)
    ids, counts = vocabulary.merge_words(data, np.cumsum(lengths) - lengths, lengths)
    return Lexicon.compile(words, np.concatenate([[0], np.cumsum(counts)]), ids)


def encode_documents(docs: DataFrame, vocabulary_path: str, lexicon_size: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids binary (little-endian uint32), decoded text, per document."""
    return _encode(docs, vocabulary_path, lexicon_size, digest=False)


def encode_digests(docs: DataFrame, vocabulary_path: str, lexicon_size: int = LEXICON_WORDS, carried: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what encode_documents gives; and the bigint column ``carried`` as it is."""
    return _encode(docs, vocabulary_path, lexicon_size, digest=True, carried=carried)


def _encode(docs: DataFrame, vocabulary_path: str, lexicon_size: int, digest: bool, carried: str | None = None) -> DataFrame:
    image = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, vocabulary_path, lexicon_size))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "doc_id bigint, n_tokens bigint, ids binary, decoded string"
    also = [carried] if carried else []
    schema += "".join(f", {c} bigint" for c in also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_path, image)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, SLICE):
                ids, bounds = encoder.encode_batch(data, offsets)
                small = ids.astype("<u4")
                decoded = encoder.vocabulary.decode(ids)
                size = np.concatenate([[0], np.cumsum(encoder.vocabulary.piece_start[ids + 1] - encoder.vocabulary.piece_start[ids])])[bounds]
                first, second = [], []
                for k in range(len(offsets) - 1):
                    own = small[bounds[k] : bounds[k + 1]].tobytes()
                    text = decoded[size[k] : size[k + 1]].tobytes().decode("utf-8", "replace")
                    first.append(hashlib.sha256(own).hexdigest() if digest else own)
                    second.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(first, pa.string() if digest else pa.binary()), pa.array(second, pa.string()), *(rows.column(c) for c in also)], schema_names(schema))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *also).mapInArrow(run, schema)


_ENCODERS: dict = {}


def _encoder(vocabulary_path: str, image) -> Encoder:
    """One encoder per worker process and lexicon."""
    key = (vocabulary_path, image.id if hasattr(image, "id") else id(image))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary_path, image.value)
    return _ENCODERS[key]


def schema_names(schema: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in schema.split(",")]
