"""Every corpus operator against brute force or a round trip, on a small table with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from postern.llm import bpe, embedding_dedup, hmm, html_text, mixing, ngram_join, suffix_dedup, token_files, topk, toxicity  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, block string, position string"


def sentence(k: int, n: int) -> str:
    return " ".join(f"w{(k * 7919 + j * 104729) % 997}{'aeiou'[j % 5]}" for j in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = sentence(1, 120)
    shared = sentence(77, 14)
    rows: list[tuple[int | None, str | None]] = [(None, base), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two"), (6, "one two"), (7, base), (8, base), (9, base + " tail"), (10, "x" + base)]
    rows += [(11 + k, f"{sentence(100 + k, 30)} {shared} {sentence(200 + k, 25)}") for k in range(6)]
    rows += [(17, "ab" * 3000), (18, "ab" * 2000), (19, "é" * 60 + " don't <|endoftext|> 😀   x"), (20, sentence(9, 4000)), (20, sentence(9, 4000)), (20, "another text of the same number")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 4 else f"s{(i or 0) % 3 and 1}", len(t or ""), "r", "b", "p") for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def test_top_k_and_near_duplicate_vectors(spark):
    draw = np.random.default_rng(1)
    v = draw.standard_normal((300, 8))
    v[50:80] = v[49] + 0.02 * draw.standard_normal((30, 8))
    v[100:110] = v[99]
    rows = [(k, [float(np.float32(x)) for x in r], 0) for k, r in enumerate(v)] + [(400, None, 0), (401, [None] * 8, 0), (402, [math.nan] * 8, 0), (403, [math.inf] * 8, 0), (404, [0.0] * 8, 0), (405, [], 0)]
    schema = "vec_id bigint, embedding array<float>, label int"
    table = spark.createDataFrame(rows, schema)
    own = np.array([r[1] for r in rows[:300]])
    whole = np.vstack([np.floor(256 * own), np.zeros((2, 8))]).astype(np.int64)
    ids = np.array([*range(300), 404, 405])
    expected = set()
    for q in range(0, 300, 50):
        s = whole @ whole[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:5]
        expected |= {(q, n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)}
    got = topk.top_k(table, table.where("vec_id % 50 = 0 AND vec_id < 300"), k=5)
    assert {tuple(r) for r in got.collect()} == expected
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    root = roots(list(zip(*np.nonzero(close), strict=True)), range(300))
    result = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, 0.9).collect()}
    assert len(result) == len(rows) and close.sum() > 800
    for k in range(300):
        assert (result[k].n_links, result[k].component_id, result[k].kept) == (close[k].sum(), root[k], root[k] == k)
    assert all((result[k].n_links, result[k].component_id, result[k].kept) == (0, k, True) for k in range(400, 406))
    empty = spark.createDataFrame([], schema)
    assert topk.top_k(empty, empty, k=5).count() == 0 and embedding_dedup.near_duplicates(empty, 0.9).count() == 0


def test_rows_that_repeat_a_vector_id(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.999, 0.001]
    rows = [(1, a), (1, b), (1, None), (1, [0.0, 0.0]), (2, c), (2, c), (3, b), (None, a), (4, [math.nan, 1.0]), (0, [0.0, 0.999])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS node", "'x' AS v", "2 AS kept")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table, 0.9).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (1, 2, 0, False), (3, 2, 0, False), (0, 2, 0, True), (1, 0, 1, True), (1, 0, 1, True), (None, 0, None, True), (4, 0, 4, True)], key=str)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("often", [32, 2])
def test_ngram_join(docs, nothing, monkeypatch, often):
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", often)  # 2: prefixes of copies are built from token pairs
    own = [(i, shingles(t, 3)) for i, t in texts()]
    links = [(a, b) for a, x in own for b, y in own if a is not None and b is not None and a < b and x and 100 * len(x & y) >= 90 * len(x | y)]
    root = roots(links, [i for i, _ in own])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 3, (90, 100)).collect())
    assert got == Counter((i, len(s), root[i]) for i, s in own)
    assert len(links) >= 4
    if often == 32:
        kept = ngram_join.one_of_each_group(docs, 3, (90, 100))
        assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in own if root[i] == i)
        assert ngram_join.near_duplicates(nothing).count() == 0


def test_suffix_dedup(docs, nothing):
    first, expected = {}, Counter()
    for i, t in sorted(texts(), key=lambda x: (x[0] is None, x[0] or 0)):
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                first.setdefault(b[p : p + 50], i)
    kept_text = {}
    for i, t in texts():
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        expected[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
        kept_text.setdefault(i, []).append(None if t is None else kept.decode("utf-8", "ignore"))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == expected
    done = suffix_dedup.documents_without_repeats(docs)
    assert done.columns == docs.columns
    by_id = {}
    for r in done.collect():
        by_id.setdefault(r.doc_id, []).append(r.text)
    assert {k: sorted(v, key=str) for k, v in by_id.items()} == {k: sorted(v, key=str) for k, v in kept_text.items()}
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_longest_previous_factor_counts_smaller_documents_only():
    text = [b"abcdefgh" * 8, b"zz" + b"abcdefgh" * 8, b"q" * 60]
    data = np.frombuffer(b"".join(text), np.uint8)
    starts = np.array([0, 64 + 2, 64 + 66])
    assert suffix_dedup.longest_previous_factor(data, starts, np.array([0, 1, 2])).tolist() == [0, 50, 0]
    assert suffix_dedup.longest_previous_factor(data, starts, np.array([1, 0, 2])).tolist() == [50, 0, 0]


def test_encoding_equals_the_library(docs, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in texts()}
    expected = Counter((i, len(ids[t]), np.array(ids[t], "<u4").tobytes(), library.decode(ids[t], skip_special_tokens=False)) for i, t in texts())
    for size in (0, 40):
        got = bpe.encode_documents(docs, PATH, lexicon_size=size).collect()
        assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == expected
    assert bpe.encode_digests(nothing, PATH).count() == 0
    files = token_files.token_digests(docs, PATH, 3)
    start, rows = 0, Counter()
    for i, t in sorted(texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        rows[(i, start, len(ids[t]) + 1, zlib.crc32(np.array([*ids[t], 0], "<u4").tobytes()))] += 1
        start += len(ids[t]) + 1
    assert Counter(tuple(r) for r in files.collect()) == rows
    assert token_files.token_digests(nothing, PATH, 3).count() == 0


def test_lexicon_finds_its_words_only():
    words = sorted({b"", b"a", b"ab", b"abc", b"b", b"bc", b"xbc", b"\xff\x00"} - {b""})
    lexicon = bpe.Lexicon(bpe.Lexicon.compile(words, np.arange(len(words) + 1), np.arange(len(words))))
    asked = [*words, b"c", b"abcd", b"x", b"xb"]
    lengths = np.array([len(w) for w in asked])
    found = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert found.tolist() == [*range(len(words)), -1, -1, -1, -1]


def test_language_model(docs, nothing):
    rows = {r.doc_id: r for r in hmm.score_documents(docs, states=2, rounds=1).where("doc_id IS NOT NULL AND doc_id <> 20").collect()}
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]) for i, t in texts()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, ws in words if not held(i) for w in ws)
    n = sum(count.values())
    for i, ws in words:
        if i not in (None, 20):
            base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (len(count) + 1))) for w in ws)
            assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (held(i), len(ws), sum(count[w] > 0 for w in ws), n)
            assert rows[i].base_score == pytest.approx(base) and rows[i].score < 0
    assert hmm.score_documents(nothing, rounds=1).count() == 0


def test_forward_recursion_sums_over_all_state_paths():
    corpus = type("C", (), {"mass": np.full(hmm.UNKNOWN + 1, 1 / (hmm.UNKNOWN + 1)), "unknown": 0.1})()
    draw = np.random.default_rng(0)
    model = hmm.Model(draw.random(2), draw.random((2, 2)) * 9, draw.random((hmm.UNKNOWN + 1, 2)), corpus)
    assert model.e.sum(axis=0) == pytest.approx([1, 1])
    seen = np.array([3, 5, hmm.UNKNOWN, 3], np.uint16)
    total = 0.0
    for path in np.ndindex(*(2,) * len(seen)):
        p = model.start[path[0]] * model.e[seen[0], path[0]]
        for a, b, s in zip(path, path[1:], seen[1:], strict=False):
            p *= model.moves[a, b] * model.e[s, b]
        total += p
    assert model.log10_likelihood([seen, seen[:1]])[0] == pytest.approx(math.log10(total))


def test_mixing_stays_within_a_block_of_the_shares(spark, nothing):
    rows = [(k, ("big", "mid", None)[(k % 10 > 5) + (k % 10 > 8)]) for k in range(600)] + [(None, "mid"), (5, "big")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string").repartition(4)
    got = mixing.mix(docs, block=2, resolution=16).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    share = {r.source: r.a for r in mixing.shares(docs, resolution=16).collect()}
    length = sum(share.values())
    turns = sorted({(r.slot, r.source or "") for r in got})
    last = min(max(s for s, o in turns if o == name) for name in share)
    for t in range(last + 1):
        for name, a in share.items():
            assert abs(sum(s <= t and o == name for s, o in turns) - (t + 1) * a / length) < 1
    weighted = mixing.shares(docs, spark.createDataFrame([("big", 1.0), ("mid", 3.0), ("", None)], "source string, weight double"), 16)
    assert {r.source: r.a for r in weighted.collect()} == {"big": 4, "mid": 12, "": 1}
    odd = mixing.shares(docs, spark.createDataFrame([("big", math.inf), ("mid", 3.0), ("", math.nan)], "source string, weight double"), 16)
    assert {r.source: r.a for r in odd.collect()} == {"big": 1, "mid": 16, "": 1}
    clashing = docs.selectExpr("*", "'p' AS position", "'s' AS Slot", "'l' AS length", "'t' AS turn", "'g' AS given", "'d' AS mix_document", "'x' AS `a.b`", "'m' AS mix_position")
    again = mixing.mix(clashing, block=2, resolution=16)
    assert sorted(c.lower() for c in again.columns) == sorted({c.lower() for c in clashing.columns} | set(mixing.RESULT))
    assert Counter((r.doc_id, r.source, r.position) for r in again.collect()) == Counter((r.doc_id, r.source, r.position) for r in got)
    assert {(r.length, r.turn, r.given, r.mix_document, r["a.b"]) for r in again.collect()} == {("l", "t", "g", "d", "x")}
    kept = mixing.mixed_documents(clashing, 2, position="mix_position", resolution=16)
    assert sorted(kept.columns) == sorted(clashing.columns) and sorted(r.mix_position for r in kept.collect()) == list(range(len(rows)))
    assert {(r.position, r.Slot) for r in kept.collect()} == {("p", "s")}
    assert mixing.mix(nothing).count() == 0
    assert mixing.mixed_documents(nothing, 2).columns == nothing.columns


def test_page_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=x>Home</a> Site</header><nav><ul><li><a href=a>A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>  text&nbsp;here<p>Second<div class="ad">Buy now</div>
<script>var t="</p>";</script><p>Third &#233;</article><section id=comments><p>Nice one indeed, I liked it a lot and will come back</section><aside>More</aside><form>Name <input></form><footer>End"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (5, "u", "<div><p>" + "plain words without any article " * 8 + "</p></div>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "Head & line\n\nFirst bold text here\n\nSecond\n\nThird é"
    assert got[1].n_chars == len(got[1].text) and [got[k].text for k in (2, 3, None)] == ["", "", ""]
    assert got[5].text == ("plain words without any article " * 8).strip()


def main_text(page):
    found = html_text.blocks(page)
    kept = html_text.tree().predict(html_text.features(found)) >= 0.5 if found else []
    return [b[0] for b, k in zip(found, kept, strict=True) if k]


PARAGRAPH = "a plain sentence of the article that goes on for a while without any link in it, as they do " * 3


def test_article_blocks_stay_whatever_their_neighbours():
    inner = [f"<p>one {PARAGRAPH}</p>", f"<p>two {PARAGRAPH}</p>", "<h2 id='related-work'>Related work</h2>", "<ul><li class=item-menu><a href=x>a link</a></li></ul>", "<p>Short.</p>", "<p><a href=y>only a link here</a></p>"]
    plain = ["one " + PARAGRAPH.strip(), "two " + PARAGRAPH.strip(), "Related work", "a link", "Short.", "only a link here"]
    for order in itertools.permutations(range(len(inner)), 3):
        for before, after in itertools.product(("", "<nav><a href=z>Home</a></nav>", "<header>Name of the site</header>"), ("", "<nav><a href=z>Up</a></nav>", "<footer>" + PARAGRAPH + "</footer>")):
            for wrapper in ("", "<div class='layout with-sidebar'>", "<div class='page header-fixed'>"):
                page = f"<body>{before}{wrapper}<article>{''.join(inner[k] for k in order)}</article>{'</div>' * bool(wrapper)}{after}"
                assert main_text(page) == [plain[k] for k in order]


def test_names_of_page_furniture():
    gone = ["<p class='advert'>Buy</p>", "<div id='site-header'>Name</div>", "<div class='ad-banner2'>Buy</div>", "<section id=comments><article>I liked it</article></section>", "<span class=ad>Buy</span>", "<div class='cookie-notice'>" + PARAGRAPH + "</div>"]
    for g in gone:
        assert main_text(f"<article><p>{PARAGRAPH}</p>{g}<p>End</article>") == [PARAGRAPH.strip(), "End"]
    for kept in ("<section id='search-results'>Found</section>", "<h2 class='menu'>Found</h2>", "<div class='social-science'>Found</div>", "<td class=notice>Found</td>"):
        assert main_text(f"<article><p>{PARAGRAPH}</p>{kept}</article>") == [PARAGRAPH.strip(), "Found"]
    # without an article element the neighbours decide
    assert main_text(f"<div><h1>Title</h1><p>{PARAGRAPH}</p></div>") == ["Title", PARAGRAPH.strip()]
    links = "<p>" + "<a href=x>some words of a link</a> " * 12 + "</p>"
    assert main_text(f"<div>{links}<h3>More</h3>{links}</div>") == []


def test_broken_pages_take_linear_time():
    for broken in ("<a '", "<a ", "<a '>'", "<button>", "<select>", "<head>", "<!--", "<div></x>", "<div class=ad><article>"):
        started = time.process_time()
        html_text.blocks(broken * (1_000_000 // len(broken)))
        assert time.process_time() - started < 10, broken
    assert main_text("<article><p>1 < 2 and a <b title='x > y'>bold</b> word, <i title='open>it</i> ends") == ["1 < 2 and a bold word, it ends"]
    assert main_text("<p>" + PARAGRAPH + " a <b") == [PARAGRAPH.strip() + " a <b"]


def test_toxicity_learns_and_rejects(spark, docs, nothing):
    draw = np.random.default_rng(4)
    plain = [f"w{k}" for k in range(300)]
    rows, marks = [], []
    for k in range(240):
        words = list(draw.choice(plain, 60))
        if k % 4 == 0:
            for at in draw.choice(60, 3, replace=False):
                words[at] = ("idiot", "moron", "scum")[at % 3]
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(k % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    network = toxicity.fit(table, labels)
    got = {r.doc_id: r for r in toxicity.score(table, network).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k in got if got[k].held_out} == set(held)
    assert sum(got[k].predicted == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    odd = toxicity.score(docs, network).collect()
    assert len(odd) == len(texts()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.without_toxic(docs, network).columns == docs.columns
    untrained = toxicity.fit(nothing, spark.createDataFrame([], labels.schema))
    assert pickle.loads(untrained) is None and {r.score for r in toxicity.score(docs, untrained).collect()} == {0.0}
    assert toxicity.score(nothing, network).count() == 0


def test_windows_cover_every_word(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 32)
    monkeypatch.setattr(toxicity, "STRIDE", 24)
    types = toxicity.Types(*toxicity.packed([" ".join(f"w{k}" for k in range(100)), "", "a"]))
    codes, owner, number = toxicity.windows(types)
    assert owner.tolist() == [0, 0, 0, 0, 1, 2] and number.tolist() == [0, 1, 2, 3, 0, 0]
    assert set(codes[:4].ravel()) - {types.n} == set(types.codes[:100])


def test_toxic_passage_counts_alike_at_every_offset():
    zero = np.zeros(1 << toxicity.ODDS_BITS, np.float32)
    network, h = toxicity.Network(zero.copy(), zero), toxicity.HIDDEN
    network.word_odds[toxicity.slot(toxicity.Types(*toxicity.packed(["scum"])).word, toxicity.ODDS_BITS)] = 4
    for side in "fb":  # states say whether the word is the bad one, attention is even: a score for the part of bad words
        network.p[f"w{side}"][:], network.p[f"u{side}"][:] = 0, 0
        network.p[f"w{side}"][0, 2 * h :], network.p[f"c{side}"][:h] = 5, -30
    network.p["attend"][:], network.p["out"][:], network.p["bias"][:] = 0, 20 / (2 * h), -20 * 19 / 32
    moved = [" ".join(["calm"] * (60 + k) + ["scum"] * 22 + ["calm"] * (180 - k)) for k in range(24)]
    score = network.score_texts(*toxicity.packed([*moved, " ".join(["calm"] * 90)]))[0]
    assert (score[:24] >= toxicity.THRESHOLD).all() and np.ptp(score[:24]) < 1e-4 and score[24] < 0.01


def test_sliding_windows_equal_single_windows(monkeypatch):
    monkeypatch.setattr(toxicity, "WINDOW", 32)
    draw = np.random.default_rng(8)
    network = toxicity.Network(*draw.standard_normal((2, 1 << toxicity.ODDS_BITS)).astype(np.float32))
    types = toxicity.Types(*toxicity.packed([" ".join(f"w{k}" for k in draw.integers(0, 200, 90)), "", "a b", " ".join(["c"] * 40)]))
    x, (stream, starts, owner, number) = network.inputs(types), toxicity.all_windows(types)
    assert np.bincount(owner).tolist() == [59, 1, 1, 9]
    single = network.forward(x, stream[starts[:, None] + np.arange(toxicity.WINDOW)])
    assert np.allclose(network.sliding(x, stream, 16)[starts], single, atol=1e-5)


def test_pipeline_rows_show_the_mix(spark, tmp_path, monkeypatch):
    rows = [(k, f"{sentence(k, 40)} {k}", "src0" if k % 5 == 0 else f"src{1 + k % 2}") for k in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("mixing", "bpe")])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(200)) and sorted(r.mix_position for r in got) == list(range(200))
    source = {k: s for k, _, s in rows}
    head = Counter(source[r.doc_id] for r in got if r.mix_position < 48)  # six blocks of eight, four of them the heavy source
    assert abs(head["src0"] - 32) <= 8 and head["src1"] and head["src2"]
