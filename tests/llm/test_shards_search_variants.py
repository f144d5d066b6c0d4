"""Sharding, ranked search and spelling variants against brute force, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from postern.llm import lexical_search, sharding, variants

SCHEMA = "doc_id bigint, text string, key string, size string, shard string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "s", "h", "n") for i, t in rows], SCHEMA)


# sharding


def shard_by_hand(rows, shards, tolerance):
    """(doc_id, text) -> list of (row, shard, slot), ties in any order."""
    order = sorted(range(len(rows)), key=lambda r: (hashlib.md5((rows[r][1] or "").encode()).digest(), -(2**63) if rows[r][0] is None else rows[r][0]))
    sizes = [len((rows[r][1] or "").encode()) + 1 for r in order]
    edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    group = [hashlib.md5((rows[r][1] or "").encode()).digest() for r in order]
    cuts = []
    for k in range(1, shards):
        target = Fraction(k * edges[-1], shards)
        at = max(n for n in range(len(order)) if edges[n] <= target)
        low, high = edges[group.index(group[at])], edges[len(group) - group[::-1].index(group[at])]
        if min(abs(low - target), abs(high - target)) > Fraction(tolerance[0] * edges[-1], tolerance[1] * shards):
            low, high = edges[at], edges[at + 1]
        cuts.append(low if target - low <= high - target else high)
    out, slots = [], Counter()
    for n, r in enumerate(order):
        shard = sum(c <= edges[n] for c in cuts)
        out.append((rows[r][0], rows[r][1] or "", sizes[n], shard, slots[shard]))
        slots[shard] += 1
    return Counter(out)


def documents(count, draw):
    rows = [(k, " ".join(f"w{x}" for x in draw.integers(0, 50, draw.integers(1, 60)))) for k in range(count)]
    rows += [(1000 + k, "the same text of a third of all rows") for k in range(count // 2)]
    return rows + [(None, None), (None, "no number"), (7, None), (7, ""), (8, "é😀" * 400), *[(9, "one row, often")] * 40]


@pytest.mark.parametrize("tolerance", [(1, 200), (1, 4), (0, 1)])
def test_shards(spark, tolerance):
    rows = documents(200, np.random.default_rng(3))
    got = sharding.shard(frame(spark, rows).repartition(5), 7, tolerance).selectExpr("doc.doc_id", "coalesce(doc.text, '')", "size", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == shard_by_hand(rows, 7, tolerance)


def test_shard_edges(spark):
    big = [(1, "a" * 50_000), (2, "b"), (3, "c")]
    got = sharding.shard(frame(spark, big), 4).selectExpr("doc.doc_id", "coalesce(doc.text, '')", "size", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == shard_by_hand(big, 4, (1, 200))
    assert sharding.shard(frame(spark, []), 4).count() == 0
    alone = sharding.shard(frame(spark, [(5, None)]), 16).collect()
    assert [(r.size, r.slot) for r in alone] == [(1, 0)] and alone[0].doc.key == "k"


def test_small_groups_stay_together_and_large_ones_are_split(spark):
    rows = [(k, f"text {k // 3} of three copies") for k in range(900)] + [(2000 + k, "copy") for k in range(4000)]
    shards = defaultdict(set)
    sizes = Counter()
    for r in sharding.shard(frame(spark, rows), 8, (1, 100)).select("doc.text", "size", "shard").collect():
        shards[r.text].add(r.shard)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for t, s in shards.items() if t != "copy") and len(shards["copy"]) > 2
    assert max(sizes.values()) - min(sizes.values()) <= sum(sizes.values()) / 8 * 0.021


def test_written_shards(spark, tmp_path):
    sharding.write_shards(sharding.shard(frame(spark, documents(50, np.random.default_rng(1))), 3), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {"_shard", "_slot", "doc_id", "shard"} <= set(back.columns) and back.count() == 50 + 25 + 45


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rank_by_hand(rows, items, k):
    docs = [(i, Counter(w), len(w)) for i, t in rows if (w := TERM.findall(lowered(t)))]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item, text in items:
        asked = Counter(TERM.findall(lowered(text)))
        scores = []
        for i, c, size in docs:
            m = 75 + 25 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out.update((item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k]))
    return out


@pytest.mark.parametrize("leaf, trie", [(64, 8192), (3, 50)])
def test_search(spark, monkeypatch, leaf, trie):
    monkeypatch.setattr(lexical_search, "LEAF_ROWS", leaf)
    monkeypatch.setattr(lexical_search, "TRIE_ROWS", trie)
    draw = np.random.default_rng(7)
    word = lambda: f"w{int(draw.zipf(1.4)) % 80}"
    rows = [(k, " ".join(word() for _ in range(draw.integers(1, 60)))) for k in range(300)]
    rows += [(1000 + k, "W1 w2, w3; straße w5") for k in range(120)] + [(None, "w1 w2"), (None, None), (5, "w1 w2"), (5, "w1 w2"), (6, ""), (7, " .,;"), (8, "w1 " * 5000)]
    items = [(1, "w1 w2 w3 w2"), (2, "straße STRASSE"), (3, "nowhere"), (4, None), (5, ""), (6, " ".join(f"w{k}" for k in range(80))), (6, "w9 w9 w9"), (7, "w70")]
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, rank int")
    got = lexical_search.search(frame(spark, rows).repartition(4), asked, 20)
    assert Counter(map(tuple, got.collect())) == rank_by_hand(rows, items, 20)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 40)  # several passes
    assert Counter(map(tuple, lexical_search.search(frame(spark, rows), asked, 4).collect())) == rank_by_hand(rows, items, 4)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert lexical_search.search(frame(spark, []), items).count() == 0
    assert lexical_search.search(frame(spark, [(1, "w1")]), items.where("item_id > 1")).count() == 0
    assert lexical_search.search(frame(spark, [(1, None), (2, "")]), items).count() == 0


def test_trie_bounds_hold_and_prune():
    draw = np.random.default_rng(11)
    docs = sorted((bytes(np.array(sorted(set((draw.zipf(1.3, 12) % 40).tolist())), ">u4").tobytes()), k) for k in range(3000))
    counts = [np.ones(len(p) // 4, "<u4").tobytes() for p, _ in docs]
    trie = lexical_search.Trie(np.array([k for _, k in docs]), np.full(3000, 100), [p for p, _ in docs], counts, 40)
    terms, weights = np.array([3, 30, 39]), np.array([10, 500, 900])
    spread = np.zeros(40, np.int64)
    spread[terms] = weights
    exact = np.add.reduceat(spread[trie.term] * trie.part, trie.start[:-1])
    bound = trie.most[:, terms] @ weights
    assert all(bound[n] >= exact[a:b].max() for n, (a, b) in enumerate(trie.nodes))
    covered = sorted(node for node, children in zip(trie.nodes, trie.children, strict=True) if not children)
    assert covered[0][0] == 0 and covered[-1][1] == 3000 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    seen = []

    class Counting(lexical_search.Best):
        def offer(self, score, doc):
            seen.append(len(score))
            super().offer(score, doc)

    best = Counting(5)
    trie.search(terms, weights, spread, best)
    order = np.lexsort((trie.doc, -exact))[:5]
    assert best.doc.tolist() == trie.doc[order].tolist() and sum(seen) < 2400


# spelling variants


def edits_apart(a, b):
    """One inserted, deleted or replaced code point between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    return any((b[:k] + b[k + 1 :] == a) if len(b) > len(a) else (a[:k] == b[:k] and a[k + 1 :] == b[k + 1 :]) for k in range(len(b)))


def variants_by_hand(rows, every):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)):
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [x for x in n if edits_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        if others and n[best := min(others, key=lambda x: (-n[x], x))] >= 5 * n[w]:
            form[w] = best
    out = Counter()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[(w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))] += 1
    return out


@pytest.mark.parametrize("tile, block", [(1024, 256), (8, 5)])
def test_variants(spark, monkeypatch, tile, block):
    monkeypatch.setattr(variants, "BLOCK", block)
    draw = np.random.default_rng(13)
    base = ["".join(draw.choice(list("abcdé"), draw.integers(6, 10))) for _ in range(60)] + ["stem" + "".join(draw.choice(list("ab"), 5)) for _ in range(60)]
    weights = np.array([1 / (k + 1) for k in range(len(base))])
    words = draw.choice(base, 30_000, p=weights / weights.sum())
    rows = []
    for k in range(0, len(words), 100):
        own = list(words[k : k + 100])
        for _ in range(12):  # misspellings
            at = int(draw.integers(0, 100))
            cut = int(draw.integers(0, len(own[at])))
            own[at] = own[at][:cut] + str(draw.choice(["", "z", "é"])) + own[at][cut + int(draw.integers(0, 2)) :]
        rows.append((k, " ".join(own)))
    rows += [(None, "Straßen " * 6), (3, None), (4, ""), (5, "ß×÷ÀÿÀ " * 5), (6, ("q" * 300 + " ") * 5 + ("q" * 299 + " ") * 40), (7, "x" * 100_000), (8, "12345 日本語日本語日本語 " * 9), (9, "short words " * 7), (10, "abcdefgh " * 200 + "abcdefgx " * 30 + "abcdefyx " * 5)]
    rows += rows[:3]
    got = variants.variants(frame(spark, rows).repartition(4), every=19, tile=tile)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = variants_by_hand(rows, 19)
    assert Counter(map(tuple, got.collect())) == expected
    assert sum(1 for r in expected if r[1]) > 50 and any(r[2] != r[1] and r[1] for r in expected)


def test_variants_of_nothing(spark):
    assert variants.variants(frame(spark, [])).count() == 0
    assert variants.variants(frame(spark, [(1, None), (2, "rare words only")])).count() == 0
