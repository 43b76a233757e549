"""Main-text extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

Each block node gets features of its subtree (text, tag and link density), its tag and attribute tokens, depth,
place and siblings. The trees give the log-odds that a node holds main text. Decoding picks the labels of the
whole page together: a node may only be kept under a kept ancestor, and the sum of log-likelihoods over the tree is
largest among such choices, so no ancestor contradicts a descendant.

The trees are fitted on ``PAGES`` generated pages with known main text (see ``pagemaker``), on the driver, in a
few seconds, whatever the input's size. Every page is read whole inside the tasks.

Defined results: null or blank html gives an empty text; pages without any main block give an empty text; markup
that never closes is closed at the page's end; elements may be nested to any depth; repeated rows are each returned; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from functools import cache, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted, fit
from .common import table
from .dom import parse
from .pagemaker import MARK, Maker
from .toxicity import lazily

#: Generated pages, their seed, hash places of attribute tokens, nodes that go through the trees at a time.
PAGES, SEED, TOKENS, NODES = 500, 3, 192, 4096
TAGS = {t: k for k, t in enumerate("root run p h1 h2 h3 h4 li ul ol dl table tr td div section article main aside nav header footer form button label select figure figcaption blockquote pre hr dialog menu fieldset option summary".split())}
DENSE = 24
WIDTH = DENSE + 3 * len(TAGS) + 2 * TOKENS


class Columns:
    """The features of a page's nodes. Sums over subtrees come from one pass backwards, as children follow their parents;
    ``rows`` makes the matrix of some nodes and some columns, so that a page of any size is never one dense matrix."""

    def __init__(self, nodes):
        self.nodes, n = nodes, len(nodes)
        size, links, tags, paras, fields, words, marks, own = (np.zeros(n) for _ in range(8))
        rank, before = np.zeros(n), np.full(n, -1)
        depth, parent, kids = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        for k, node in enumerate(nodes):
            t = node.parts
            own[k] = size[k] = len(t)
            links[k], tags[k], paras[k], fields[k] = node.links, 1, node.tag == "p" and len(t) > 0, node.fields
            words[k], marks[k] = t.count(" ") + bool(t), t.count(".") + t.count(",") + t.count("!") + t.count("?")
            depth[k], parent[k], kids[k] = node.depth, max(node.parent, 0), len(node.kids)
            for r, kid in enumerate(node.kids):
                rank[kid], before[kid] = r, node.kids[r - 1] if r else -1
        start = np.concatenate([[0], np.cumsum(own)[:-1]])
        for k in range(n - 1, 0, -1):
            p = parent[k]
            for a in (size, links, tags, paras, fields, words, marks):
                a[p] += a[k]
        total, s, q, siblings = max(size[0], 1), size, np.maximum(size[parent], 1), kids[parent]
        self.parent = parent
        self.dense = np.stack([
            depth, np.log1p(s), np.log1p(own), s / total, s / q, s / tags, np.minimum(links / np.maximum(s, 1), 2), links[parent] / q,
            np.log1p(tags), np.log1p(paras), paras / tags, fields, s / np.maximum(words, 1), marks / np.maximum(words, 1), start / total, np.arange(n) / n,
            rank, siblings, rank / np.maximum(siblings, 1), np.where(before >= 0, np.log1p(size[before]), -1),
            np.log1p(paras[parent]), paras[parent] / max(paras[0], 1), np.full(n, np.log1p(total)), kids,
        ], 1).astype(np.float32)

    def rows(self, first: int, last: int, place: np.ndarray) -> np.ndarray:
        """Nodes ``first`` to ``last``; place: the column of each feature in the matrix, or -1."""
        x = np.zeros((last - first, place.max(initial=-1) + 1), np.float32)
        here = place[:DENSE]
        x[:, here[here >= 0]] = self.dense[first:last, here >= 0]
        nodes, rows, cols = self.nodes, [], []
        for k in range(first, last):
            p = self.parent[k]
            at = DENSE
            mine = []
            for tag in (nodes[k].tag, nodes[p].tag, nodes[self.parent[p]].tag):
                mine.append(at + TAGS.get(tag, TAGS["div"]))
                at += len(TAGS)
            mine += [at + _token(w) for w in nodes[k].tokens]
            mine += [at + TOKENS + _token(w) for w in nodes[p].tokens]
            rows += [k - first] * len(mine)
            cols += mine
        cols = place[np.array(cols, np.int64)]
        on = cols >= 0
        x[np.array(rows, np.int64)[on], cols[on]] = 1
        return x


@lru_cache(100_000)
def _token(word: str) -> int:
    return crc32(word.encode()) % TOKENS


def decode(nodes, odds: np.ndarray) -> np.ndarray:
    """The most likely labels under which no kept node has a dropped ancestor. odds: log-odds of each node."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    keep, drop = yes.copy(), no.copy()
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = np.zeros(n, bool)
    kept[0] = True
    for k in range(1, n):
        kept[k] = kept[nodes[k].parent] and keep[k] > drop[k]
    return kept


@cache
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """The trees, over the columns that vary in the generated pages (the others are never split on): ``model.place`` has
    the place of each of these in the matrix, and -1 for the others."""
    xs, ys = [], []
    every = np.arange(WIDTH)
    for k in range(pages):
        nodes = parse(Maker(seed * 1_000_003 + k).page())
        y = np.array([MARK in node.parts for node in nodes], float)
        for node in nodes:
            node.parts = node.parts.replace(MARK, "")
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
        xs.append(Columns(nodes).rows(1, len(nodes), every))
        ys.append(y[1:])
    x, y = np.concatenate(xs), np.concatenate(ys)
    used = np.flatnonzero((x != x[0]).sum(0) >= 12)
    model = fit(x[:, used], y, (used < DENSE).sum())
    split = np.unique(model.feature)
    model.place = np.full(WIDTH, -1)
    model.place[used[split]] = np.arange(len(split))
    model.feature = np.searchsorted(split, model.feature)
    return model


class Extractor:
    def __init__(self, model: Boosted):
        self.model = model

    def scorer(self):
        return self.some

    def some(self, pages: list[str]) -> list[str]:
        """The main texts of pages, whose nodes go through the trees together, about ``NODES`` at a time."""
        out, held, count = [], [], 0
        for page in pages:
            held.append(parse(page))
            count += len(held[-1])
            if count >= NODES:
                out += self.texts(held)
                held, count = [], 0
        return out + self.texts(held)

    def one(self, page: str) -> str:
        return self.some([page])[0]

    def odds(self, parsed) -> np.ndarray:
        """The log-odds of the pages' nodes, from matrices of at most ``NODES`` rows."""
        blocks, count, out = [], 0, []

        def through() -> None:
            if blocks:
                out.append(self.model.margin(np.concatenate(blocks)))
                blocks.clear()

        for nodes in parsed:
            columns = Columns(nodes)
            for k in range(0, len(nodes), NODES):
                rows = columns.rows(k, min(k + NODES, len(nodes)), self.model.place)
                if count + len(rows) > NODES:
                    through()
                    count = 0
                blocks.append(rows)
                count += len(rows)
        through()
        return np.concatenate(out) if out else np.zeros(0)

    def texts(self, parsed) -> list[str]:
        odds, out, at = self.odds(parsed), [], 0
        for nodes in parsed:
            kept = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            out.append("\n".join(node.parts for node, k in zip(nodes, kept, strict=True) if k and node.parts))
        return out


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    extract = lazily(Extractor(model or trained()))

    def run(batches):
        for batch in batches:
            html = [h or "" for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(extract(html), pa.string())], names=["page_id", "url", "text"])

    out = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1_extract(spark, sf_dir) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
