"""Operator 7: token ids as Arrow files of fixed-size-list batches.

Documents are range partitioned by doc_id; every partition writes one Arrow IPC
file in the shared folder. A row of a file is one sequence of ``LENGTH`` ids with
a mask of equal length, so sequence k of a batch is a plain slice of the mapped
buffer. Ids run on from document to document (each ends with the end id); only
the last sequence of a file is padded, with a false mask. An index table names
the file and position of every document.

A file is written under a name of its own and moved into place, so a repeated or
speculative task replaces it with the same bytes.

Defined cases: null text is empty (its document has the end id alone); equal
doc_ids are ordered by text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.llm.bpe import LETTER, _classes, encode_with
from postern.llm.common import new_folder, ragged, text_slices, written

LENGTH = 2048
BATCH_SEQUENCES = 256
END_ID = 0
CACHED_WORDS = 600_000
BATCH_WORDS = 4096
RUN_WORDS = 64  # words that are encoded as one text


def lettered(texts: list[str]) -> np.ndarray:
    """Which texts are one space and letters, as the library's own expressions see them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    good = _classes()[points] == LETTER
    good[starts[sizes > 0]] = points[starts[sizes > 0]] == 0x20
    wrong = np.concatenate([[0], np.cumsum(~good)])
    return (sizes > 1) & (wrong[starts + sizes] == wrong[starts])


class LibraryEncoder:
    """Words through the tokenizers library; a bounded memory of words seen by this worker.

    Words of one space and letters are handed over in runs: the library's own
    pre-tokens part them again, and the ids of a run are told apart by the bytes they
    stand for. All other words, and runs whose ids do not end where words do, go one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores; the library's threads would wait for one another
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = tuple(t.encode() for t in added)
        self.in_runs = not any(all(c == " " or c.isalpha() for c in t) for t in added)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)  # bytes of an id
        for token, k in vocabulary.items():
            self.width[k] = len(token)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.ids, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_types(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        words = [raw[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > CACHED_WORDS:
            self.forget()
            new = words
        if new:
            self._learn(new)
        at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        counts = self.count[at]
        return self.ids[ragged(self.begin[at], counts)], counts

    def _learn(self, new: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in new]
        joined = lettered(texts) if self.in_runs else np.zeros(len(texts), bool)
        run, single = np.flatnonzero(joined), np.flatnonzero(~joined)
        ids, counts = [], np.zeros(len(new), np.int64)
        order = []
        for k in range(0, len(run), BATCH_WORDS):
            part = run[k : k + BATCH_WORDS]
            ends = np.cumsum([len(new[i]) for i in part.tolist()])
            parts = [part[j : j + RUN_WORDS] for j in range(0, len(part), RUN_WORDS)]
            flat = np.concatenate([np.array(e, np.uint32) for e in self._encoded(["".join([texts[i] for i in p.tolist()]) for p in parts])])
            reached = np.cumsum(self.width[flat])
            last = np.searchsorted(reached, ends)
            if not len(flat) or reached[-1] != ends[-1] or (reached[last] != ends).any():
                single = np.concatenate([single, part])
                continue
            counts[part] = np.diff(last, prepend=-1)
            ids.append(flat)
            order.append(part)
        for k in range(0, len(single), BATCH_WORDS):
            part = single[k : k + BATCH_WORDS]
            each = self._encoded([texts[i] for i in part.tolist()])
            counts[part] = list(map(len, each))
            ids.append(np.array([i for e in each for i in e], np.uint32))
            order.append(part)
        order = np.concatenate(order)
        self.seen.update(zip([new[i] for i in order.tolist()], range(len(self.seen), len(self.seen) + len(new))))
        ends = len(self.ids) + np.cumsum(counts[order])
        self.begin = np.concatenate([self.begin, ends - counts[order]])
        self.count = np.concatenate([self.count, counts[order]])
        self.ids = np.concatenate([self.ids, *ids])

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return encode_with(self.encode_types, self.added, data, offsets)

    @property
    def id_type(self) -> np.dtype:
        return np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


_LIBRARY: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryEncoder(path)
    return _LIBRARY[path]


class SequenceWriter:
    """Cuts a run of ids into sequences of one length and writes them batch by batch."""

    def __init__(self, sink, id_type: np.dtype, length: int):
        self.length, self.id_type = length, id_type
        self.schema = pa.schema({"ids": pa.list_(pa.from_numpy_dtype(id_type), length), "mask": pa.list_(pa.bool_(), length)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.rest = np.zeros(0, id_type)

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids])
        step = self.length * BATCH_SEQUENCES
        while len(self.rest) >= step:
            self._batch(self.rest[:step], step)
            self.rest = self.rest[step:]

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))

    def close(self) -> None:
        if len(self.rest):
            real = len(self.rest)
            self._batch(np.concatenate([self.rest, np.zeros(-real % self.length, self.id_type)]), real)
        self.out.close()


def write_token_files(docs: DataFrame, vocabulary_path: str, partitions: int, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write the files; returns the index: doc_id, part, file, at (ids before it in its file), n_tokens."""
    folder = new_folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, writer, at = None, None, 0
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                if encoder is None:
                    encoder = library_encoder(vocabulary_path)
                    store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                    store.create_dir(path, recursive=True)
                    trial = f"{path}/.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(trial)
                    writer = SequenceWriter(sink, encoder.id_type, length)
                ids, bounds = encoder.encode_batch(data, offsets)
                ends = bounds[1:] + np.arange(1, len(bounds))  # with the end ids
                laid = np.full(int(ends[-1]), end_id, dtype=encoder.id_type)
                inside = np.ones(len(laid), dtype=bool)
                inside[ends - 1] = False
                laid[inside] = ids
                writer.add(laid)
                sizes = np.diff(bounds) + 1
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes)], ["doc_id", "part", "at", "n_tokens"]
                )
                at += int(ends[-1])
        if writer:
            writer.close()
            sink.close()
            store.move(trial, f"{path}/part-{part:06d}.arrow")

    laid = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    index = written(laid.mapInArrow(write, "doc_id bigint, part int, at bigint, n_tokens bigint"), "token-index")
    return index.withColumn("file", F.format_string(f"{folder.replace('%', '%%')}/part-%06d.arrow", "part"))


def read_token_files(index: DataFrame) -> DataFrame:
    """Ids of every document, sliced out of the mapped files: doc_id, part, at, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, list] = ("", [])
        for batch in batches:
            crc = []
            for file, at, n in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                if opened[0] != file:
                    opened = (file, open_sequences(file))
                value = 0
                for ids in token_range(opened[1], at, n):
                    value = zlib.crc32(ids.astype("<u4").tobytes(), value)
                crc.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "at", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    by_file = index.repartition("part").sortWithinPartitions("part", "at")
    return by_file.mapInArrow(read, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")


def open_sequences(file: str) -> list[np.ndarray]:
    """The id buffers of a file's batches; a local file is mapped, not read."""
    store, path = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
    source = pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)
    reader = pa.ipc.open_file(source)
    return [reader.get_batch(k).column("ids").flatten().to_numpy() for k in range(reader.num_record_batches)]


def token_range(batches: list[np.ndarray], at: int, n: int) -> Iterator[np.ndarray]:
    """Views of ids [at, at + n); every batch but the last has the same size."""
    size = len(batches[0])
    while n:
        k, inside = divmod(at, size)
        part = batches[k][inside : inside + n]
        yield part
        at, n = at + len(part), n - len(part)


def token_digests(docs: DataFrame, vocabulary_path: str, partitions: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files written and read back."""
    index = write_token_files(docs, vocabulary_path, partitions)
    # one row per file: its ids, and the ids of all files before it
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = files.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return read_token_files(index).join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
