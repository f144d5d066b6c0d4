"""Words of whole texts as array operations over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from postern.llm.common import binary_view

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MARKS = np.zeros(256, dtype=bool)  # ASCII punctuation
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(data: np.ndarray, offsets: np.ndarray, dropped: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words: their bytes without what lies between, word offsets, and the first word of each text.

    ``dropped``: bytes taken out of words first; words with nothing left are no words.
    """
    data = LOWER[data]
    space = SPACES[data]
    keep = ~space if dropped is None else ~(space | dropped[data])
    if not keep.any():
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    # the number of spaces and text starts before a byte tells its word
    cut = space.astype(np.int32)
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    np.add.at(cut, inner, 1)
    group = np.cumsum(cut, dtype=np.int32)[keep]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    kept = np.concatenate([[0], np.cumsum(keep)])  # kept bytes before a byte
    first = np.searchsorted(begins, kept[offsets])
    return data[keep], np.append(begins, len(group)).astype(np.int64), first


def coded_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch: (code of every word, bytes of the distinct words, their offsets)."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    coded = binary_view(data, bounds).dictionary_encode()
    words = coded.dictionary
    return coded.indices.to_numpy(), np.frombuffer(words.buffers()[2], dtype=np.uint8), np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: two rounds over eight bytes at a time, length included."""
    lengths = np.diff(bounds)
    out = mixed(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    step = 0
    live = np.arange(len(out))
    while True:
        live = live[lengths[live] > step]
        if not len(live):
            return out
        at = bounds[:-1][live] + step
        left = np.minimum(lengths[live] - step, 8)
        value = np.zeros(len(live), np.uint64)
        for k in range(8):
            value |= np.where(left > k, padded[at + k], 0).astype(np.uint64) << np.uint64(8 * k)
        out[live] = mixed(out[live] * np.uint64(0x9DDFEA08EB382D69) + mixed(value + np.uint64(step + 1)))
        step += 8


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes within each text: starts, ends, and the first run of each text."""
    edge = np.zeros(len(inside) + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    begin = inside & np.concatenate([[True], ~inside[:-1]])[: len(inside)]
    begin |= inside & edge[:-1]
    end = inside & np.concatenate([~inside[1:], [True]])[: len(inside)]
    end |= inside & edge[1:]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)
