"""Operator 6: main text of web pages from flat text blocks.

The markup of a page is walked once: block-level tags cut the text into flat
blocks, each with its words, the share of them inside links, and what encloses
it. With the word count and link density of its neighbours a block is classified
by a decision tree, which is trained here on a small labelled table: typical
blocks, each between every pair of typical neighbours, so that being the first,
the last or next to links decides only where it should. Kept blocks are joined
in page order.

Names (class, id, role) mark page furniture only as whole names: every part of
the name is a word for furniture or for a place on the page ("site-header", not
"related-work" or "with-sidebar"), on elements that divide a page and on
paragraphs, never on headings, list items or table cells.

Defined cases: null html is empty; a page without text gives the empty text;
unclosed elements end with what encloses them, and an article ends page furniture
left open before it; raw-text elements left open run to the end of the page; a
quote that opens in a tag and never ends is no quote; "<" before a letter
without any later ">" is text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "in_article", "in_furniture")

# Typical neighbours (words, link density): none, a link, link lists, a label, a short sentence, paragraphs.
NEIGHBOURS = ((0, 0.0), (1, 1.0), (12, 0.9), (45, 0.8), (150, 0.7), (2, 0.0), (8, 0.1), (45, 0.0), (150, 0.05))
# Labelled blocks (words, link density, in an article, in furniture, label): 1 is main text, 0 is not, None is text next to a paragraph only.
BLOCKS = (
    # in an article: headings, list items, linked lines, paragraphs of any length
    (1, 0.0, 1, 0, 1), (1, 1.0, 1, 0, 1), (4, 1.0, 1, 0, 1), (8, 0.0, 1, 0, 1), (12, 0.5, 1, 0, 1), (30, 1.0, 1, 0, 1), (60, 0.1, 1, 0, 1), (400, 0.0, 1, 0, 1),
    # page furniture, wherever it lies: menus, headers, footers, sidebars, notices, adverts, forms, comments
    (1, 1.0, 0, 1, 0), (1, 0.0, 0, 1, 0), (8, 0.0, 0, 1, 0), (12, 0.6, 0, 1, 0), (60, 0.0, 0, 1, 0), (400, 0.05, 0, 1, 0),
    (1, 1.0, 1, 1, 0), (1, 0.0, 1, 1, 0), (9, 0.0, 1, 1, 0), (40, 0.0, 1, 1, 0), (150, 0.0, 1, 1, 0), (400, 0.0, 1, 1, 0),
    # no article element: paragraphs, headings and short lines, links
    (16, 0.0, 0, 0, 1), (20, 0.2, 0, 0, 1), (45, 0.05, 0, 0, 1), (60, 0.3, 0, 0, 1), (150, 0.0, 0, 0, 1), (400, 0.1, 0, 0, 1),
    (1, 0.0, 0, 0, None), (4, 0.0, 0, 0, None), (8, 0.1, 0, 0, None), (10, 0.2, 0, 0, None),
    (1, 1.0, 0, 0, 0), (5, 0.8, 0, 0, 0), (12, 0.6, 0, 0, 0), (25, 0.7, 0, 0, 0), (60, 0.9, 0, 0, 0), (200, 0.8, 0, 0, 0),
)


def labelled() -> np.ndarray:
    """One row (features, label) for every block of the table between every pair of neighbours."""
    long = lambda n: n[0] >= 20 and n[1] < 0.33
    return np.array([
        (words, density, *before, *after, article, furniture, (long(before) or long(after)) if label is None else label)
        for words, density, article, furniture, label in BLOCKS for before in NEIGHBOURS for after in NEIGHBOURS
    ], dtype=float)


ATTRIBUTES = re.compile(r"(?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+>")
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style title noscript template textarea select option button iframe object svg math canvas audio video head".split())
RAW = frozenset("script style title textarea noscript template iframe svg".split())
FURNITURE = frozenset("nav header footer aside form dialog menu".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side-bar aside header masthead "
    "footer cookie cookies consent notice notices alert gdpr newsletter subscribe subscription signup login search share sharing social related recommended comment comments respond replies "
    "disqus pagination pager popup modal overlay toolbar widget complementary contentinfo skip".split()
)
PLACE_NAMES = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer wrapper wrap container box bar block list area item items section row panel unit slot inline text "
    "link links button buttons content body form".split()
)
NAMED = frozenset("div section aside ul ol dl table figure center p".split()) | INLINE  # elements whose names count
ARTICLE = frozenset(("article", "main"))


def is_furniture(attributes: str) -> bool:
    """Whether a whole name of the element says so."""
    for groups in NAMES.findall(attributes):
        for name in " ".join(groups).lower().split():
            parts = {p.rstrip("0123456789") for p in re.split(r"[-_]+", name)} - {""}
            if name in FURNITURE_NAMES or (parts & FURNITURE_NAMES and parts <= FURNITURE_NAMES | PLACE_NAMES):
                return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each tag in one forward scan; comments and declarations have the empty name.

    The caller may send a place to go on from. A search that found nothing is never made again.
    """
    at, last = 0, len(page)
    final = page.rfind(">")
    quotes = {q: page.rfind(q) for q in "'\""}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            ends = [m.end() for m in [re.compile(r"--!?>").search(page, start + 4)] if m]
            found = (start, ends[0] if ends else last, False, "", "")
        elif page.startswith(("<!", "<?"), start):
            found = (start, page.find(">", start) + 1 or last, False, "", "")
        elif start > final:
            return
        elif name := TAG_NAME.match(page, start + 1):
            single = page.find("'", name.end()) if quotes["'"] > name.end() else -1
            double = page.find('"', name.end()) if quotes['"'] > name.end() else -1
            end = page.find(">", name.end()) + 1
            if -1 < min((q for q in (single, double) if q >= 0), default=-1) < end:  # a quote may hold the first ">"
                whole = ATTRIBUTES.match(page, name.end())
                end = whole.end() if whole else end
            found = (start, end, bool(name.group(1)), name.group(2).lower(), page[name.end() : end - 1])
        else:
            at = start + 1
            continue
        at = (yield found) or found[1]


def blocks(page: str) -> list[tuple[str, int, float, bool, bool]]:
    """(text, words, link density, in an article, in page furniture) of each flat block."""
    out: list[tuple[str, int, float, bool, bool]] = []
    parts: list[str] = []  # of the open block, and those of them inside links
    linked: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements and what they are: "", "article", "furniture", "named" (furniture by name)
    opened: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    unclosed: set[str] = set()  # raw elements without any later end
    link = paragraph = False
    at = 0

    def close() -> None:
        nonlocal paragraph
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                inside = len(entities.unescape("".join(linked)).split())
                words = text.count(" ") + 1
                out.append((text, words, min(1.0, inside / words), kinds["article"] > 0, paragraph or kinds["furniture"] + kinds["named"] > 0))
            parts.clear()
            linked.clear()
        paragraph = False

    def push(name: str, kind: str) -> None:
        stack.append((name, kind))
        opened[name] += 1
        kinds[kind] += 1

    def pop() -> str:
        name, kind = stack.pop()
        opened[name] -= 1
        kinds[kind] -= 1
        return name

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if link:
                linked.append(text)

    scan, skip = tags(page), None
    while True:
        try:
            start, end, closing, name, attributes = scan.send(skip)
        except StopIteration:
            break
        add(page[at:start])
        at, skip = end, None
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                link = not closing
                linked.append(" ")
            elif name == "br":
                parts.append(" ")
            if closing:
                if stack and stack[-1] == (name, "named"):
                    close()
                    pop()
                continue
            if name in ("a", "br", "img", "wbr") or not is_furniture(attributes):
                continue
        close()
        if name in SKIPPED and not closing:
            if name == "head":
                after = re.compile(r"</head\s*>|<body\b", re.I).search(page, at) if "head" not in unclosed else None
                if after:
                    at = skip = after.end() if after.group().startswith("</") else after.start()
                else:
                    unclosed.add("head")
            elif name != "option" and name not in unclosed:
                after = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
                if after:
                    at = skip = after.end()
                elif name in RAW:
                    return out
                else:
                    unclosed.add(name)
            continue
        if name == "p":
            paragraph = not closing and is_furniture(attributes)
            continue
        if name in VOID:
            continue
        if closing:
            link = False
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if name in ARTICLE:
            kind = "article"
            if kinds["furniture"] and not kinds["article"] and not kinds["named"]:  # furniture left open before it
                kept = [s for s in stack if s[1] != "furniture"]
                stack.clear(), opened.clear(), kinds.clear()
                for s in kept:
                    push(*s)
            if kinds["furniture"] or kinds["named"] or any(n in ("comment", "comments") for groups in NAMES.findall(attributes) for n in " ".join(groups).lower().split()):
                kind = "furniture"
        elif name in FURNITURE:
            kind = "" if name == "header" and kinds["article"] else "furniture"
        else:
            kind = "named" if name in NAMED and is_furniture(attributes) else ""
        push(name, kind)
    add(page[at:])
    close()
    return out


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.value = float(y.mean())
        self.feature = None
        if depth == 0 or self.value in (0.0, 1.0):
            return
        best = (self._impurity(y) * len(y) - 1e-9, None, None)
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= cut
                cost = self._impurity(y[low]) * low.sum() + self._impurity(y[~low]) * (~low).sum()
                if cost < best[0]:
                    best = (cost, feature, cut)
        if best[1] is not None:
            _, self.feature, self.cut = best
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None or not len(x):
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


@cache
def tree() -> Tree:
    table = labelled()
    return Tree(table[:, :-1], table[:, -1])


def features(found: list[tuple[str, int, float, bool, bool]]) -> np.ndarray:
    words = np.array([b[1] for b in found], dtype=float)
    density = np.array([b[2] for b in found])
    shift = lambda v, by: np.concatenate([[0.0], v[:-1]]) if by < 0 else np.concatenate([v[1:], [0.0]])
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), [b[3] for b in found], [b[4] for b in found]])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for start in range(0, batch.num_rows, 256):
                found = [blocks(page) if page else [] for page in column.slice(start, 256).to_pylist()]
                rows = [features(b) for b in found if b]
                kept = tree().predict(np.concatenate(rows)) >= 0.5 if rows else np.zeros(0, bool)
                texts, at = [], 0
                for page in found:
                    texts.append("\n\n".join(b[0] for b, k in zip(page, kept[at : at + len(page)], strict=True) if k))
                    at += len(page)
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
