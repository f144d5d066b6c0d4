"""Operator 9: a bidirectional gated recurrent network with attention pooling over word and character inputs.

Each word of a window brings what its characters and the word itself tell: learned
vectors for the word and its character trigrams, and log-odds of the word and of
its character n-grams from the labelled sample. Gates run over the window in both
directions, attention pools their states, a logistic unit gives the window's
score. A document's score is that of its highest window; windows start at every
word, so a passage counts alike wherever it lies in the text.

The network is trained in numpy on at most ``TRAIN_TOXIC`` toxic and
``TRAIN_CLEAN`` other labelled documents (by hash order of doc_id), in one task;
while it learns, a document sees log-odds of the other folds only. Windows of toxic documents
are not labelled one by one: training takes the highest-scoring window of a toxic
document as toxic, and random and highest windows of others as clean, and
chooses them anew in each round.

Defined cases: null and empty texts are one window without words; without
labelled rows of both kinds every score is 0; labels that contradict one another
count as toxic; null doc_ids are kept, are never trained on and count as held out: no.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postern.llm.common import ragged, text_slices
from postern.llm.words import MARKS, coded_words, mixed, split_words, word_hashes

TRAIN_TOXIC, TRAIN_CLEAN = 2_000, 4_000
WINDOW, STRIDE = 16, 12  # the stride only where a few windows are to cover a text; scores and training take every start
HIDDEN, WORD_DIM, CHAR_DIM = 8, 4, 4
ODDS_BITS, WORD_BITS, CHAR_BITS = 18, 13, 12
FIXED = 4  # log-odds inputs
ROUNDS, EPOCHS, BATCH, RATE = 3, 4, 96, 0.02
RATES = {"word": 0.0005, "char": 0.0005}  # learned vectors follow slowly: a small sample must not be learned by heart
FOLDS, LEAST_STEPS = 4, 280
THRESHOLD = 0.7


class Types:
    """Distinct words of a batch with their hashes and character n-grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        flat, bounds, self.first = split_words(data, offsets, MARKS)
        self.codes, words, starts = coded_words(flat, bounds)
        lengths = np.diff(starts)
        self.n = len(lengths)
        self.word = word_hashes(words, starts)
        # words between marks: ^word$
        size = lengths + 2
        begin = np.cumsum(size) - size
        marked = np.full(int(size.sum()), 2, dtype=np.uint64)
        marked[begin + size - 1] = 3
        inside = np.ones(len(marked), dtype=bool)
        inside[begin], inside[begin + size - 1] = False, False
        marked[inside] = words[: int(lengths.sum())]
        left = np.repeat(begin + size, size) - np.arange(len(marked))  # bytes to the end of the word
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # (hash, words' offsets) for n = 3, 5
        padded = np.concatenate([marked, np.zeros(8, np.uint64)])
        for n in (3, 5):
            value = np.zeros(len(marked), np.uint64)
            for k in range(n):
                value |= padded[k : k + len(marked)] << np.uint64(8 * k)
            good = left >= n
            count = np.concatenate([[0], np.cumsum(good)])
            self.grams.append((mixed(value[good] + np.uint64(n)), count[np.append(begin, len(marked))] if len(begin) else np.zeros(1, np.int64)))


def reduced(ufunc, values: np.ndarray, offsets: np.ndarray, empty: float) -> np.ndarray:
    """ufunc over each range of values; ``empty`` for empty ranges."""
    n = len(offsets) - 1
    out = np.full((n, *values.shape[1:]), empty, dtype=values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = ufunc.reduceat(values, offsets[:-1][full], axis=0)
    return out


def slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def presence(hits: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """(2, slots): in how many clean and toxic documents each slot occurs."""
    out = np.zeros((2, 1 << ODDS_BITS), dtype=np.float32)
    for slots, label in zip(hits, labels, strict=True):
        out[label, slots] += 1
    return out


def odds_table(seen: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Log-odds of each slot, shrunk towards 0 where it is rare."""
    odds = np.log((seen[1] + 0.5) / (toxic + 1)) - np.log((seen[0] + 0.5) / (clean + 1))
    n = seen.sum(axis=0)
    return (odds * n / (n + 4)).astype(np.float32)


class Network:
    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        width = FIXED + WORD_DIM + CHAR_DIM
        small = lambda *shape, by=0.1: (draw.standard_normal(shape) * by).astype(np.float32)
        self.word_odds, self.gram_odds = word_odds, gram_odds
        self.p = {
            "word": small(1 << WORD_BITS, WORD_DIM, by=0.01), "char": small(1 << CHAR_BITS, CHAR_DIM, by=0.01),
            "attend": small(2 * HIDDEN), "out": small(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32) - 1,
        }
        for side in "fb":
            self.p[f"w{side}"] = small(width, 3 * HIDDEN, by=0.3)
            self.p[f"u{side}"] = small(HIDDEN, 3 * HIDDEN, by=0.2)
            self.p[f"c{side}"] = np.zeros(3 * HIDDEN, np.float32)

    def inputs(self, types: Types) -> np.ndarray:
        """Input vector of each distinct word; the last row is the absent word."""
        x = np.zeros((types.n + 1, FIXED + WORD_DIM + CHAR_DIM), dtype=np.float32)
        if not types.n:
            return x
        (tri, tri_at), (five, five_at) = types.grams
        tri_odds, five_odds = self.gram_odds[slot(tri, ODDS_BITS)], self.gram_odds[slot(five, ODDS_BITS)]
        x[:-1, 0] = self.word_odds[slot(types.word, ODDS_BITS)]
        x[:-1, 1] = reduced(np.maximum, tri_odds, tri_at, 0)
        x[:-1, 2] = reduced(np.maximum, five_odds, five_at, 0)
        x[:-1, 3] = reduced(np.add, five_odds, five_at, 0) / np.maximum(np.diff(five_at), 1)
        x[:-1, FIXED : FIXED + WORD_DIM] = self.p["word"][slot(types.word, WORD_BITS)]
        x[:-1, FIXED + WORD_DIM :] = reduced(np.add, self.p["char"][slot(tri, CHAR_BITS)], tri_at, 0) / np.maximum(np.diff(tri_at), 1)[:, None]
        return x

    def _run(self, projected: np.ndarray, codes: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States (time, window, hidden) of one direction; absent words (the last code) leave the state as it is."""
        u, h_size = self.p[f"u{side}"], HIDDEN
        n, length = codes.shape
        states = np.empty((length, n, h_size), dtype=np.float32)
        h = np.zeros((n, h_size), dtype=np.float32)
        absent = len(projected) - 1
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            now = codes[:, t]
            a = projected[now]
            hu = h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * h_size] + hu[:, : 2 * h_size])))
            z, r = zr[:, :h_size], zr[:, h_size:]
            new = 2 / (1 + np.exp(-2 * (a[:, 2 * h_size :] + r * hu[:, 2 * h_size :]))) - 1
            after = new + z * (h - new)
            gone = now == absent
            if gone.any():
                after[gone] = h[gone]
            if keep is not None:
                keep.append((t, h, z, r, new, hu[:, 2 * h_size :], gone))
            states[t] = h = after
        return states

    def forward(self, x: np.ndarray, codes: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Score of each window (rows of word codes)."""
        keep_f, keep_b = ([], []) if cache is not None else (None, None)
        both = [self._run(x @ self.p[f"w{s}"] + self.p[f"c{s}"], codes, s, k) for s, k in (("f", keep_f), ("b", keep_b))]
        a, o = self.p["attend"], self.p["out"]
        energy = both[0] @ a[:HIDDEN] + both[1] @ a[HIDDEN:]
        present = codes.T != len(x) - 1
        weight = np.exp(np.clip(energy, -30, 30)) * present
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        value = both[0] @ o[:HIDDEN] + both[1] @ o[HIDDEN:]
        score = 1 / (1 + np.exp(-np.clip((weight * value).sum(axis=0) + self.p["bias"][0], -30, 30)))
        if cache is not None:
            cache.update(keep={"f": keep_f, "b": keep_b}, both=both, weight=weight, value=value)
        return score

    def gradients(self, types: Types, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        x, cache = self.inputs(types), {}
        score = self.forward(x, codes, cache)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = ((score - target) / len(target)).astype(np.float32)
        weight, value, both = cache["weight"], cache["value"], cache["both"]
        g["bias"][0] = d.sum()
        dvalue = weight * d
        denergy = weight * (value - (weight * value).sum(axis=0)) * d
        dx = np.zeros_like(x)
        for k, side in enumerate("fb"):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            g["out"][part] = np.einsum("tn,tnh->h", dvalue, both[k])
            g["attend"][part] = np.einsum("tn,tnh->h", denergy, both[k])
            dstates = dvalue[:, :, None] * self.p["out"][part] + denergy[:, :, None] * self.p["attend"][part]
            u = self.p[f"u{side}"]
            carry = np.zeros_like(both[k][0])
            for t, h, z, r, new, hn, gone in reversed(cache["keep"][side]):
                dh = dstates[t] + carry
                dz = dh * (h - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * hn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                da[gone], dhu[gone] = 0, 0
                carry = np.where(gone[:, None], dh, dh * z + dhu @ u.T)
                g[f"u{side}"] += h.T @ dhu
                g[f"c{side}"] += da.sum(axis=0)
                g[f"w{side}"] += x[codes[:, t]].T @ da
                np.add.at(dx, codes[:, t], da @ self.p[f"w{side}"].T)
        dx = dx[:-1]
        np.add.at(g["word"], slot(types.word, WORD_BITS), dx[:, FIXED : FIXED + WORD_DIM])
        tri, at = types.grams[0]
        per = dx[:, FIXED + WORD_DIM :] / np.maximum(np.diff(at), 1)[:, None]
        np.add.at(g["char"], slot(tri, CHAR_BITS), np.repeat(per, np.diff(at), axis=0))
        return g

    def sliding(self, x: np.ndarray, stream: np.ndarray, step: int = 2048) -> np.ndarray:
        """Score of the window at each position of ``stream``: what ``forward`` gives, with words projected once and columns for windows."""
        n = max(0, len(stream) - WINDOW + 1)
        out = np.empty(n, dtype=np.float32)
        absent, sides = len(x) - 1, []
        for k, side in enumerate("fb"):
            part = slice(k * HIDDEN, (k + 1) * HIDDEN)
            projected = np.ascontiguousarray((x @ self.p[f"w{side}"] + self.p[f"c{side}"]).T)
            projected[:HIDDEN, absent] = 100  # the gate keeps the state
            sides.append((projected, np.ascontiguousarray(np.concatenate([self.p[f"u{side}"].T, self.p["attend"][None, part], self.p["out"][None, part]]))))
        one = np.float32(1)
        for begin in range(0, n, step):
            size = min(step, n - begin)
            words = stream[begin : begin + size + WINDOW - 1]
            energy, value = np.zeros((WINDOW, size), np.float32), np.zeros((WINDOW, size), np.float32)
            for side, (projected, u) in zip("fb", sides, strict=True):
                a = np.take(projected, words, axis=1)
                h = np.zeros((HIDDEN, size), np.float32)
                hu = np.zeros((len(u), size), np.float32)
                zr, new = np.empty((2 * HIDDEN, size), np.float32), np.empty((HIDDEN, size), np.float32)
                z, r = zr[:HIDDEN], zr[HIDDEN:]
                for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
                    np.add(a[: 2 * HIDDEN, t : t + size], hu[: 2 * HIDDEN], out=zr)
                    np.negative(zr, out=zr)
                    np.exp(zr, out=zr)
                    zr += one
                    np.reciprocal(zr, out=zr)
                    np.multiply(r, hu[2 * HIDDEN : 3 * HIDDEN], out=new)
                    new += a[2 * HIDDEN :, t : t + size]
                    np.tanh(new, out=new)
                    h -= new
                    h *= z
                    h += new
                    np.matmul(u, h, out=hu)
                    energy[t] += hu[-2]
                    value[t] += hu[-1]
            np.clip(energy, -30, 30, out=energy)
            np.exp(energy, out=energy)
            if (words == absent).any():
                energy *= np.lib.stride_tricks.sliding_window_view(words != absent, WINDOW).T
            value *= energy
            total = value.sum(axis=0) / np.maximum(energy.sum(axis=0), 1e-9) + self.p["bias"][0]
            out[begin : begin + size] = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return out

    def score_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text its score, and the number of its highest window."""
        types = Types(data, offsets)
        stream, starts, owner, number = all_windows(types)
        score = self.sliding(self.inputs(types), stream)[starts]
        best = highest(score, owner)
        return score[best], number[best]


def all_windows(types: Types) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts one after another, short ones filled to a window; where every window starts in them; its text; its number in the text."""
    count = np.diff(types.first)
    size = np.maximum(count, WINDOW)
    begin = np.cumsum(size) - size
    stream = np.full(int(size.sum()), types.n, dtype=np.int64)
    stream[ragged(begin, count)] = types.codes
    owner = np.repeat(np.arange(len(size)), size - WINDOW + 1)
    number = ragged(np.zeros(len(size), np.int64), size - WINDOW + 1)
    return stream, begin[owner] + number, owner, number


def highest(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first of the highest windows of each text; windows of a text lie together."""
    if not len(score):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    hit = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(score)))))
    return hit[np.unique(owner[hit], return_index=True)[1]]


def windows(types: Types) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words in windows that cover every text; its text; its number in the text. Each text has one at least."""
    count = np.diff(types.first)
    n = 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(count)), n)
    number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (types.first[:-1][owner] + number * STRIDE)[:, None] + np.arange(WINDOW)
    inside = at < types.first[1:][owner][:, None]
    codes = np.append(types.codes, types.n)[np.where(inside, at, len(types.codes))]
    return codes, owner, number


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def train(texts: list[str | None], labels: np.ndarray) -> Network | None:
    """A network from labelled texts, None without two of each kind.

    Log-odds come from all texts in the end; while the network learns, a text sees those of the other folds.
    """
    labels = np.asarray(labels, dtype=np.int64)
    if min(labels.sum(), (1 - labels).sum()) < 2:
        return None
    fold = np.zeros(len(labels), dtype=np.int64)
    for kind in (0, 1):
        rows = np.flatnonzero(labels == kind)
        fold[rows] = np.arange(len(rows)) % FOLDS
    parts = []  # of each fold: texts' labels, presence of words and n-grams
    for k in range(FOLDS):
        rows = np.flatnonzero(fold == k)
        word_hits, gram_hits = [], []
        for row in rows:
            types = Types(*packed([texts[row]]))
            word_hits.append(np.unique(slot(types.word, ODDS_BITS)))
            gram_hits.append(np.unique(slot(np.concatenate([g for g, _ in types.grams]), ODDS_BITS)))
        parts.append((rows, presence(word_hits, labels[rows]), presence(gram_hits, labels[rows])))
    words, grams = sum(p[1] for p in parts), sum(p[2] for p in parts)
    toxic, clean = int(labels.sum()), int((1 - labels).sum())
    network = Network(odds_table(words, clean, toxic), odds_table(grams, clean, toxic))
    final = network.word_odds, network.gram_odds
    folds = []
    for rows, own_words, own_grams in parts:
        t = int(labels[rows].sum())
        odds = odds_table(words - own_words, clean - len(rows) + t, toxic - t), odds_table(grams - own_grams, clean - len(rows) + t, toxic - t)
        types = Types(*packed([texts[k] for k in rows]))
        folds.append((odds, types, *all_windows(types), labels[rows]))
    del parts
    draw = np.random.default_rng(11)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    for turn in range(ROUNDS):
        batches = []
        for k, (odds, types, stream, starts, owner, _, target) in enumerate(folds):
            network.word_odds, network.gram_odds = odds
            x = network.inputs(types)
            if turn == 0:  # the first choice of windows is by the highest log-odds, then by their sum
                word = x[:, :FIXED].max(axis=1)[stream]
                most = word[: len(word) - WINDOW + 1].copy()
                for a in range(1, WINDOW):
                    np.maximum(most, word[a : a + len(most)], out=most)
                score = (most + 1e-3 * np.convolve(word, np.ones(WINDOW), "valid"))[starts]
            else:
                score = network.sliding(x, stream)[starts]
            top = highest(score, owner)
            bad, good = top[target[owner[top]] == 1], top[target[owner[top]] == 0]
            others = np.flatnonzero(target[owner] == 0)
            good = np.concatenate([good, draw.choice(others, min(len(others), 2 * len(good)), replace=False)])
            bad = np.tile(bad, max(1, len(good) // (4 * max(len(bad), 1))))
            chosen = np.concatenate([bad, good])
            goal = (np.arange(len(chosen)) < len(bad)).astype(np.float32)
            need = EPOCHS * max(1, len(chosen) // BATCH)
            for _ in range(max(need, LEAST_STEPS // FOLDS)):
                rows = draw.integers(0, len(chosen), BATCH)
                batches.append((k, starts[chosen[rows]], goal[rows]))
        for at in draw.permutation(len(batches)):
            k, begin, goal = batches[at]
            odds, types, stream = folds[k][:3]
            network.word_odds, network.gram_odds = odds
            codes = stream[begin[:, None] + np.arange(WINDOW)]
            used, local = np.unique(codes, return_inverse=True)
            part = TypesView(types, used[used < types.n])
            local = np.where(codes == types.n, part.n, local.reshape(codes.shape))
            step += 1
            for name, grad in network.gradients(part, local, goal).items():
                m, v = moment[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                network.p[name] -= RATES.get(name, RATE) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    network.word_odds, network.gram_odds = final
    return network


class TypesView:
    """Some of a batch's distinct words."""

    def __init__(self, types: Types, used: np.ndarray):
        self.n, self.word = len(used), types.word[used]
        self.grams = []
        for values, at in types.grams:
            size = np.diff(at)[used]
            place = np.repeat(at[:-1][used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            self.grams.append((values[place], np.concatenate([[0], np.cumsum(size)])))


def remainder(doc_id, by: int):
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """The trained network, pickled; learns only from labels whose crc32(doc_id) mod 3 is not 1."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder(F.col("doc_id"), 3) != 1)
    own = own.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = own.where("toxic = 1").orderBy(*order).limit(TRAIN_TOXIC).union(own.where("toxic = 0").orderBy(*order).limit(TRAIN_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").coalesce(1).sortWithinPartitions("doc_id", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        network = train(whole["text"].to_pylist(), whole["toxic"].to_numpy()) if whole else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    found = rows.mapInArrow(learn, "network binary").first()
    return bytes(found[0]) if found else pickle.dumps(None)


def score(docs: DataFrame, network: bytes) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 2 << 20):
                value = own.score_texts(data, offsets)[0] if own else np.zeros(rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(value.astype(np.float64))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, network: bytes) -> DataFrame:
    """The documents (all columns) whose score is below the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(model.value)
        for batch in batches:
            for rows, data, offsets in text_slices(batch, 2 << 20):
                value = own.score_texts(data, offsets)[0] if own else np.zeros(rows.num_rows)
                yield rows.filter(pa.array(value < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
