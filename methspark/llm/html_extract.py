"""Main text of HTML pages: gradient-boosted trees over DOM-node features, decoded down the tree.

Every element is judged by features of its tag, its attribute tokens and those of its ancestors, its depth, its siblings, and
the density of text, links, blocks and punctuation in its subtree. The trees give the log-odds that it belongs to
the main text. Decoding then picks, for the whole page at once, the most likely labelling without contradictions: an
element is out (with all below it), in (each child in or out), or passed through (not main text itself; children of any kind), so nothing
below a menu is ever main text and an advert within an article can go. It is one pass up and one pass down the tree.

The classifier is trained here, on the driver, on pages from ``html_training``: ``TRAIN_PAGES`` of them, whatever the input.
Pages are judged one by one, in batches; nothing is exchanged.

Defined results: a null or empty page, and one in which nothing is judged main text, gives an empty text. Character references are
decoded; white space within a block becomes one space; blocks are joined by two line feeds. Rows without an id are judged
as well; repeated rows get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .dom import BLOCK, HIDDEN, Tree, parse
from .html_training import PageMaker

TRAIN_PAGES = 1200
#: Nodes judged together.
BATCH_NODES = 20_000
JOINT = "\n\n"

_GROUPS = [
    {"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"section"}, {"div", "center", "td", "th"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"},
    {"ul", "ol", "dl"}, {"li", "dd", "dt"}, {"a"}, {"table", "tbody", "tr", "thead"}, {"form", "input", "button", "select", "option", "label", "textarea", "fieldset", "legend"},
    {"figure", "figcaption", "img"}, {"blockquote", "pre"}, {"html", "body", "#root"}, set(HIDDEN),
]
_GROUP_OF = {tag: k for k, tags in enumerate(_GROUPS) for tag in tags}
_KINDS = [
    {"content", "article", "post", "entry", "story", "main", "text", "body", "blog", "copy"},
    {"nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager"},
    {"header", "masthead", "top", "branding", "logo"},
    {"footer", "bottom", "copyright", "colophon", "foot", "legal"},
    {"sidebar", "side", "widget", "related", "recommended", "recent", "rail", "aside", "more", "trending", "popular"},
    {"ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "sponsor", "adslot"},
    {"comment", "comments", "responses", "response", "discussion", "disqus", "reply", "replies"},
    {"cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "alert", "overlay", "newsletter", "subscribe", "privacy"},
    {"form", "search", "login", "contact", "signup"},
    {"share", "social", "sharing", "toolbar", "author", "user", "tags", "links"},
]
_KIND_OF = {word: k for k, words in enumerate(_KINDS) for word in words}
_INHERITED = (0, 1, 2, 3, 4, 14, 18)  # tag groups looked for above a node
_PUNCTUATION = str.maketrans("", "", ".,;:!?")
FEATURES = len(_GROUPS) + 1 + len(_KINDS) + len(_INHERITED) + len(_KINDS) + 2 + 14


def features(tree: Tree) -> np.ndarray:
    """A row for each node of the tree."""
    n = len(tree.tags)
    own, total, anchor, blocks, punct, words, paragraphs, first = ([0] * n for _ in range(8))
    tags, parents = tree.tags, tree.parents
    seen = 0
    first = [-1] * n
    for node, text in tree.items:
        stripped = text.strip()
        if not stripped or tags[node] in HIDDEN:
            continue
        size = len(stripped)
        own[node] += size
        punct[node] += size - len(stripped.translate(_PUNCTUATION))
        words[node] += stripped.count(" ") + 1
        if first[node] < 0:
            first[node] = seen
        seen += size
    depth, index, children, group = [0] * n, [0] * n, [0] * n, [_GROUP_OF.get(t, len(_GROUPS)) for t in tags]
    same: dict[tuple[int, str], int] = {}
    kinds: list[set[int]] = []
    above_groups: list[frozenset] = []
    above_kinds: list[frozenset] = []
    for k in range(n):
        kinds.append({_KIND_OF[t] for t in tree.tokens[k] if t in _KIND_OF})
        up = parents[k]
        if up < 0:
            above_groups.append(frozenset())
            above_kinds.append(frozenset())
            continue
        depth[k], index[k] = depth[up] + 1, children[up]
        children[up] += 1
        same[up, tags[k]] = same.get((up, tags[k]), 0) + 1
        above_groups.append(above_groups[up] if group[up] in above_groups[up] else above_groups[up] | {group[up]})
        above_kinds.append(above_kinds[up] if kinds[up] <= above_kinds[up] else above_kinds[up] | kinds[up])
    for k in range(n - 1, 0, -1):
        up = parents[k]
        total[k] += own[k]
        if tags[k] == "a":
            anchor[k] = total[k]
        if tags[k] == "p":
            paragraphs[k] += 1
        if tags[k] in BLOCK:
            blocks[k] += 1
        for part in (total, anchor, blocks, punct, words, paragraphs):
            part[up] += part[k]
        if first[k] >= 0 and (first[up] < 0 or first[k] < first[up]):
            first[up] = first[k]
    total[0] += own[0]
    out = np.zeros((n, FEATURES), dtype=np.float32)
    whole, log = max(1, total[0]), math.log1p
    boxed = [float(0 in group), float(any(0 in x for x in kinds))]  # whether the page marks a main text, by a tag or a name
    g, base = len(_GROUPS) + 1, len(_GROUPS) + 1 + len(_KINDS)
    for k in range(n):
        row = out[k]
        row[group[k]] = 1
        for x in kinds[k]:
            row[g + x] = 1
        for j, x in enumerate(_INHERITED):
            if x in above_groups[k]:
                row[base + j] = 1
        for x in above_kinds[k]:
            row[base + len(_INHERITED) + x] = 1
        row[-16:-14] = boxed
        up = parents[k]
        size = total[k]
        row[-14:] = (
            log(own[k]), log(size), anchor[k] / (size + 1), size / whole, depth[k], index[k], children[up] if up >= 0 else 1, same.get((up, tags[k]), 1),
            log(paragraphs[k]), log(blocks[k]), punct[k] / (size + 1), size / (blocks[k] + 1), max(0, first[k]) / whole, size / (total[up] + 1) if up >= 0 else 1,
        )
    return out


def decode(tree: Tree, log_odds: np.ndarray) -> list[bool]:
    """The most likely labelling in which out means out below as well, and in never stands above passed through."""
    n = len(tree.tags)
    inside = (-np.logaddexp(0.0, -log_odds)).tolist()
    outside = (-np.logaddexp(0.0, log_odds)).tolist()
    out, within, passed = list(outside), list(inside), list(outside)
    for k in range(n - 1, 0, -1):
        up = tree.parents[k]
        out[up] += out[k]
        within[up] += max(within[k], out[k])
        passed[up] += max(within[k], out[k], passed[k])
    chosen = [False] * n
    state = ["pass"] * n
    for k in range(1, n):
        above = state[tree.parents[k]]
        if above == "out":
            state[k] = "out"
        elif above == "in":
            state[k] = "in" if within[k] > out[k] else "out"
        else:
            best = max(within[k], out[k], passed[k])
            state[k] = "out" if best == out[k] else "in" if best == within[k] else "pass"
        chosen[k] = state[k] == "in"
    return chosen


def text_of(tree: Tree, chosen: list[bool]) -> str:
    """The text of the chosen nodes; one block for each run of text within one block element."""
    holder: list[int] = [0] * len(tree.tags)
    for k in range(1, len(tree.tags)):
        holder[k] = k if tree.tags[k] in BLOCK else holder[tree.parents[k]]
    blocks: list[list[str]] = []
    last = -1
    for node, text in tree.items:
        if not chosen[node] or tree.tags[node] in HIDDEN:
            continue
        if holder[node] != last:
            if not text.strip():
                continue
            blocks.append([])
            last = holder[node]
        blocks[-1].append(text)
    return JOINT.join(t for b in blocks if (t := " ".join("".join(b).split())))


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 5) -> BoostedTrees:
    """The classifier, from invented pages; nodes without a text below teach nothing."""
    rows, labels = [], []
    for k in range(pages):
        tree = parse(PageMaker(seed * 1_000_003 + k).page())
        x = features(tree)
        for node, truth in enumerate(tree.truth):
            if truth is not None and x[node, -13] > 0:
                rows.append(x[node])
                labels.append(float(truth))
    return BoostedTrees().fit(np.array(rows), np.array(labels))


def extract_all(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page."""
    out: list[str] = []
    trees: list[Tree] = []
    parts: list[np.ndarray] = []

    def finish() -> None:
        if trees:
            scores, at = model.scores(np.concatenate(parts)), 0
            for tree in trees:
                out.append(text_of(tree, decode(tree, scores[at : at + len(tree.tags)])))
                at += len(tree.tags)
            trees.clear()
            parts.clear()

    held = 0
    for page in pages:
        tree = parse(page or "")
        trees.append(tree)
        parts.append(features(tree))
        held += len(tree.tags)
        if held >= BATCH_NODES:
            finish()
            held = 0
    finish()
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every row."""
    rows = pages.select(id_col, url_col, F.col(html_col).alias("_html"))
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                texts = extract_all(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
