"""Operator 2: Jaccard join of word n-grams by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct word n-grams. Equal sets
are one class; only the classes are compared. All tokens have one global order:
tokens outside the list of frequent ones first, by hash, then the frequent ones by
hash. Linked sets of n tokens miss at most t = floor((1 - threshold) * n) of each
other's, so they share what their prefixes are built for:

* a rare token of a prefix is indexed alone;
* frequent tokens are dealt to groups by hash, and indexed as pairs within a group:
  m tokens of a group count for m - 1 only, and the prefix is extended until its
  tokens count for t + 1.

Groups depend on the size class of the set; a set near a class boundary is indexed
in both classes. Sets of fewer than 16 tokens use single tokens only. Frequent are
the tokens that ``FREQUENT_FROM`` sets hold, or more where there are over ``FREQUENT``
of those; tasks get them as bits at the tokens' low ends. Which tokens count as
frequent, some by a shared bit, is the same for all sets and decides cost only.
An entry of a rare token has few members, so it costs few pairs at any size.

Candidates are verified exactly (sizes and parity bitmaps rule out most of the
others before whole sets are compared), without all pairs of a group: in each index entry
the members meet the entry's centres only, and only where their components
differ; entries whose members are one component are done. Rounds take ever more
centres until every pair of an entry is linked through its component or verified.

Defined cases: null and empty texts have no tokens and link with nothing; a text
with fewer words than n has its whole sequence as one token; null doc_ids link with
nothing and keep a null component; rows that repeat a doc_id are one node; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from postern.llm.common import bucketed, input_blocks, kept, most_frequent, text_slices, written
from postern.llm.components import components
from postern.llm.words import coded_words, mixed, split_words, word_hashes

FREQUENT, FREQUENT_FROM = 1 << 24, 8
SMALL_CLASS = 4  # sets below 2**4 tokens
GROUP = 4  # tokens of a set in each group, on average
SPARE = 4
BITS = 2048
STEP = 16  # how many times the centres of the round before


def token_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    flat, bounds, first = split_words(data, offsets)
    codes, words, starts = coded_words(flat, bounds)
    word = word_hashes(words, starts)[codes] if len(codes) else np.zeros(0, np.uint64)
    gram = word
    for k in range(1, n):
        gram = mixed(gram[: max(len(word) - k, 0)] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(gram[a : b - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in word[a:b]:
                whole = mixed(whole * np.uint64(0xC2B2AE3D27D4EB4F) + w)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def missing(n: int, threshold: tuple[int, int]) -> int:
    """How many of n tokens a linked set may lack."""
    part, whole = threshold
    return n - -(-part * n // whole)


def size_class(n: int) -> int:
    return int(n).bit_length() - 1


def class_salt(c: int) -> np.uint64:
    return np.uint64((c + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)


def signatures(tokens: np.ndarray, frequent: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Index keys of a set. ``tokens`` sorted by hash, ``frequent`` as bits."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    part, whole = threshold
    classes = {size_class(-(-part * n // whole)), size_class(n), size_class(whole * n // part)}
    need = missing(n, threshold) + 1
    common = listed(tokens, frequent)
    out = []
    for c in classes:
        salt = class_salt(c)
        if c < SMALL_CLASS:  # single tokens, rare ones first
            chosen = np.concatenate([tokens[~common], tokens[common]])[:need]
            out.append(mixed(chosen + salt))
            continue
        rare = tokens[~common][:need]
        out.append(mixed(rare + salt))
        rest = need - len(rare)
        if rest > 0:
            often = tokens[common]
            group = (mixed(often + salt) % np.uint64(max((1 << c) // GROUP, 1))).astype(np.int64)
            order = np.argsort(group, kind="stable")
            ordered = group[order]
            new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            counts = np.zeros(len(often), np.int64)
            counts[order] = ~new  # the first of a group counts for nothing
            length = int(np.searchsorted(np.cumsum(counts), rest)) + 1
            often, group = often[:length], group[:length]
            order = np.argsort(group, kind="stable")
            often, group = often[order], group[order]
            for gap in range(1, len(often)):
                pairs = np.flatnonzero(group[gap:] == group[:-gap])
                if not len(pairs):
                    break
                out.append(mixed(mixed(often[pairs] + salt) * np.uint64(0x9DDFEA08EB382D69) + often[pairs + gap]))
    return distinct(np.concatenate(out))


def listed(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which tokens have their bit set."""
    if not len(frequent):
        return np.zeros(len(tokens), bool)
    at = tokens & np.uint64(len(frequent) * 64 - 1)
    return (frequent[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def parity_bits(tokens: np.ndarray) -> bytes:
    """BITS bits, each the parity of the tokens that fall on it: two sets differ in at least as many tokens as bits."""
    return np.packbits(np.bincount((mixed(tokens) >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def described(texts: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """row, doc_id, n_shingles, digest of the set, its least tokens (where prefixes come from), its parity bits."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                sizes, digests, heads, bits = [], [], [], []
                for tokens in token_sets(data, offsets, n):
                    need = missing(len(tokens), threshold) + 1
                    sizes.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    heads.append(tokens[: need + need // 4 + SPARE].view(np.int64))
                    bits.append(parity_bits(tokens))
                ends = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
                head = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), head, pa.array(bits, pa.binary())], ["row", "doc_id", "n_shingles", "digest", "head", "bits"])

    return written(texts.mapInArrow(describe, "row bigint, doc_id bigint, n_shingles bigint, digest binary, head array<bigint>, bits binary"), "sets")


def frequent_bits(classes: DataFrame) -> np.ndarray:
    """The frequent ones of the tokens that may be in a prefix, as bits: eight a token, 16 MB at most."""
    counted = classes.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    chosen = written(most_frequent(counted, "n", FREQUENT), "frequent")
    count = chosen.count()
    if not count:
        return np.zeros(0, np.uint64)
    size = max(64, 1 << (8 * count - 1).bit_length()) if count < FREQUENT else 8 * FREQUENT
    at = chosen.select(F.col("token").bitwiseAND(F.lit(size - 1)).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def index_rows(texts: DataFrame, classes: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """(key, rep, size) of every class. Heads suffice unless frequent tokens use them up; those sets are built from their texts again."""
    frequent = texts.sparkSession.sparkContext.broadcast(frequent_bits(classes))

    def short(tokens: np.ndarray, size: int) -> bool:
        """Whether the head holds fewer rare tokens than a prefix needs."""
        if len(tokens) == size or not len(frequent.value):
            return False
        return int((~listed(tokens, frequent.value)).sum()) <= missing(size, threshold)

    def from_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sizes, reps = batch.column("head"), batch.column("n_shingles").to_numpy(), batch.column("rep").to_numpy()
            keys, owners, again = [], [], []
            for k, size in enumerate(sizes.tolist()):
                tokens = heads[k].values.to_numpy().view(np.uint64)
                if short(tokens, size):
                    again.append(k)
                    continue
                own = signatures_of_head(tokens, size, frequent.value, threshold)
                keys.append(own.view(np.int64))
                owners.append(np.full(len(own), k))
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            owner = np.concatenate([*owners, again]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, np.zeros(len(again), np.int64)])), pa.array(reps[owner]), pa.array(sizes[owner]), pa.array(np.arange(len(owner)) >= len(key))], ["key", "rep", "size", "again"]
            )

    def from_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                for tokens, rep in zip(token_sets(data, offsets, n), rows.column("row").to_pylist(), strict=True):
                    own = signatures(tokens, frequent.value, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), rep)), pa.array(np.full(len(own), len(tokens)))], ["key", "rep", "size"])

    first = written(classes.where("n_shingles > 0").mapInArrow(from_heads, "key bigint, rep bigint, size bigint, again boolean"), "index")
    again = texts.join(first.where("again").select(F.col("rep").alias("row")), "row", "left_semi").select("row", "doc_id", "text")
    keys = first.where("NOT again").drop("again").union(written(again.mapInArrow(from_texts, "key bigint, rep bigint, size bigint"), "index"))
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return written(keys.join(several, "key"), "index")


def signatures_of_head(head: np.ndarray, size: int, frequent: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """Index keys of a set of ``size`` tokens whose least tokens hold its whole prefix of rare ones."""
    if len(head) == size:
        return signatures(head, frequent, threshold)
    part, whole = threshold
    need = missing(size, threshold) + 1
    head = head[~listed(head, frequent)]
    classes = {size_class(-(-part * size // whole)), size_class(size), size_class(whole * size // part)}
    return distinct(np.concatenate([mixed(head[:need] + class_salt(c)) for c in classes]))


def likely(pairs: DataFrame, bits: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs that sizes and parity bits do not rule out."""
    part, whole = threshold

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            bits_a, bits_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bits_a", "bits_b"))
            apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=1, dtype=np.int64)
            good = (whole * np.minimum(size_a, size_b) >= part * np.maximum(size_a, size_b)) & (apart * (whole + part) <= (size_a + size_b) * (whole - part))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    side = lambda x: bits.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = pairs.join(side("b").select("b", "n_b", "bits_b"), "b").join(side("a"), "a")
    return near.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(test, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """The linked ones of (a, b), from the whole sets."""
    part, whole = threshold

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array([t.tobytes() for t in token_sets(data, offsets, n)], pa.binary())], ["rep", "tokens"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shorter, longer = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(longer, shorter), len(longer) - 1)
                both = int((longer[at] == shorter).sum())
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    sets = written(texts.join(wanted, "row", "left_semi").select("row", "text").mapInArrow(build, "rep bigint, tokens binary"), "tokens")
    with_b = pairs.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    with_both = with_b.join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    return with_both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(test, "a bigint, b bigint")


def class_links(texts: DataFrame, classes: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between classes that join all that are linked, directly or not."""
    index = index_rows(texts, classes, n, threshold)
    links = texts.sparkSession.createDataFrame([], "a bigint, b bigint")
    if index.isEmpty():
        return links
    bits = classes.select("rep", "n_shingles", "bits")
    part, whole = threshold
    near = F.lit(whole) * F.least("size", "size_a") >= F.lit(part) * F.greatest("size", "size_a")
    checked = None
    group = components(links)
    centres = 1
    active = index.withColumn("component", F.col("rep"))
    as_centre = [F.col("rep").alias("a"), F.col("component").alias("other"), F.col("size").alias("size_a")]
    while True:
        if centres == 1:
            centre = active.groupBy("key").agg(F.min_by(F.struct(*as_centre), "rep").alias("c")).select("key", "c.*")
        else:
            place = F.row_number().over(W.partitionBy("key").orderBy("rep"))
            centre = active.withColumn("place", place).where(F.col("place") <= centres).select("key", *as_centre)
        pairs = active.join(centre, "key").where("rep > a AND component <> other").where(near).select("a", F.col("rep").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        checked = pairs if checked is None else checked.union(pairs)
        close = written(likely(pairs, bits, threshold), "pairs")
        if not close.isEmpty():
            links = written(links.union(verified(close, texts, n, threshold)), "links")
            group = components(links)
        # the centres have met all members of their entries
        left = active.drop("component").join(centre.select("key", F.col("a").alias("rep")), ["key", "rep"], "left_anti")
        left = left.join(group.withColumnRenamed("node", "rep").withColumnRenamed("component_id", "component"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("component"))
        open_ = left.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        active = written(left.join(open_, "key", "left_semi"), "index")
        if active.isEmpty():
            return links
        centres *= STEP


def near_duplicates(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; threshold as a fraction."""
    laid = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = bucketed(laid, "row", input_blocks(docs), "texts")
    whole = described(texts, n, threshold)
    # one row for each distinct set: the row of its least doc_id stands for it
    named = whole.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "n_shingles", "head", "bits")).alias("x"))
    classes = written(classes.select("digest", F.col("x.doc_id").alias("least"), F.col("x.row").alias("rep"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.head").alias("head"), F.col("x.bits").alias("bits")), "classes")
    found = class_links(texts, classes, n, threshold)
    names = classes.select("rep", "least")
    between = found.join(names.withColumnRenamed("rep", "a").withColumnRenamed("least", "x"), "a").join(names.withColumnRenamed("rep", "b").withColumnRenamed("least", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    inside = named.select("doc_id", "digest").join(classes.select("digest", "least"), "digest").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    group = components(between.union(inside))
    return whole.select("doc_id", "n_shingles").join(group, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents without those that are not the least of their group."""
    gone = kept(docs.sparkSession, lambda: near_duplicates(docs, n, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id").cast("bigint") == F.col("gone_id"), "left_anti")
