"""A lenient HTML reader: block elements as a flat tree of nodes with their own text, for main-text extraction.

Inline tags carry no structure here, so an unclosed ``<b>`` cannot swallow the page. A block with child blocks
keeps each run of its own text as a child of its own, so every text belongs to exactly one leaf.

Reading takes time in proportion to the page, however broken it is: the next ``>`` is looked for once, a tag whose quotes
never close ends at it, and after ``MISSES`` such tags quotes hide no ``>`` in the rest of the page; open elements are
found by their tag's own stack of places.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

#: Tags with unclosed quotes after which quotes hide no ``>`` any more.
MISSES = 16
#: Elements that are blocks, that hold raw text, and that never hold children.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript iframe template svg xmp noembed noframes object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open element of the value, up to the next container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
HOLDS = frozenset("ul ol dl table div article section main aside nav body blockquote form fieldset select td th header footer".split())

#: Of these a slash at the end means that they are empty if no end tag follows; the others never close themselves.
MAY_BE_EMPTY = RAW - frozenset("script style title textarea xmp noembed noframes".split())

_MARKUP = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>?)", re.S)
_NAME = r"<(?P<e>/?)(?P<n>[a-zA-Z][^\s/>]*+)"
_QUOTED = re.compile(_NAME + r"(?P<a>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_PLAIN = re.compile(_NAME + r"(?P<a>[^>]*+)>", re.S)
#: A slash that ends a tag and is no part of a value without quotes.
_EMPTY = re.compile(r"(?:^|[\s\"'])/\s*$|^/$")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """tag, parent (index or -1), attribute tokens, own text pieces, child indexes, links: code points inside links."""

    __slots__ = ("depth", "fields", "kids", "links", "parent", "parts", "tag", "tokens")

    def __init__(self, tag, parent, tokens, depth):
        self.tag, self.parent, self.tokens, self.depth, self.parts, self.kids, self.links, self.fields = tag, parent, tokens, depth, [], [], 0, 0


def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and the like, singular, at most in their order."""
    if "=" not in attributes:
        return ()
    return tuple(w.lower().rstrip("s") for m in _ATTR.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or ""))


def tidy(pieces: list[str]) -> str:
    """Decoded text with every run of white space as one space, trimmed."""
    return " ".join(html.unescape("".join(pieces)).split())


def parse(page: str) -> list[Node]:
    """The page's block nodes in page order, the root first; every leaf's ``parts`` is its tidy text."""
    nodes = [Node("root", -1, (), 0)]
    stack, at, in_link, size = [0], 0, False, len(page)
    low, gt, misses, endless = None, -1, 0, set()
    open_at = defaultdict(list)  # the places in the stack of each tag's open blocks

    def shut_from(k: int) -> None:
        for i in reversed(stack[k:]):
            open_at[nodes[i].tag].pop()
        del stack[k:]

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=-1)

    def text(piece: str) -> None:
        if not piece:
            return
        top = nodes[stack[-1]]
        if top.kids:  # text beside child blocks becomes a leaf of its own
            last = nodes[top.kids[-1]]
            if last.tag != "run" or top.kids[-1] != len(nodes) - 1:
                if not piece.strip():
                    return
                nodes.append(Node("run", stack[-1], (), top.depth + 1))
                top.kids.append(len(nodes) - 1)
            top = nodes[-1]
        top.parts.append(piece)
        if in_link:
            top.links += len(piece.strip())

    def open_block(tag: str, tokens) -> None:
        top = nodes[stack[-1]]
        if top.parts and not top.kids:  # its text so far becomes a leaf
            if "".join(top.parts).strip():
                nodes.append(run := Node("run", stack[-1], (), top.depth + 1))
                run.parts, run.links = top.parts, top.links
                top.kids.append(len(nodes) - 1)
            top.parts, top.links = [], 0
        nodes.append(Node(tag, stack[-1], tokens, top.depth + 1))
        top.kids.append(len(nodes) - 1)
        open_at[tag].append(len(stack))
        stack.append(len(nodes) - 1)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = _MARKUP.match(page, lt).end()
            continue
        if gt < lt:
            gt = page.find(">", lt)
            gt = size if gt < 0 else gt
        m = None
        if gt < size:
            if misses < MISSES and not (m := _QUOTED.match(page, lt)):
                misses += _PLAIN.match(page, lt) is not None
            m = m or _PLAIN.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        name, closing = m["n"].lower(), m["e"]
        if name in RAW:
            if not closing:
                if low is None:
                    low = page.lower()
                    if len(low) != size:  # a capital whose small form is longer
                        low = "".join(c.lower() if c.isascii() else c for c in page)
                empty = name in MAY_BE_EMPTY and _EMPTY.search(m["a"])
                if empty and name == "svg":
                    continue
                end = -1 if name in endless else low.find(f"</{name}", at)
                if end < 0:
                    endless.add(name)
                if empty and end < 0:
                    continue
                if end < 0:
                    at = size
                else:
                    shut = page.find(">", end)
                    at = size if shut < 0 else shut + 1
            continue
        if name == "head" and not closing:
            in_link = False
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            text(" ")
        elif name in ("input", "img"):
            nodes[stack[-1]].fields += name == "input"
        elif name in BLOCKS:
            in_link = False
            if name in ("hr", "html", "body"):
                if name == "hr" and not closing:
                    open_block("hr", ())
                    shut_from(len(stack) - 1)
                continue
            if closing:
                if open_at[name]:
                    shut_from(open_at[name][-1])
                continue
            shut = CLOSES.get(name)
            if nodes[stack[-1]].tag == "p":
                shut_from(len(stack) - 1)
            if shut and (k := innermost(shut)) > 0:
                cells = ("td", "th") if name in ("tr", "tbody", "tfoot", "thead") else ()
                if k >= innermost(HOLDS.difference(cells)):
                    shut_from(k)
            open_block(name, attribute_tokens(m["a"] or ""))
    for node in nodes:
        node.parts = "" if node.kids else tidy(node.parts)
    return nodes
