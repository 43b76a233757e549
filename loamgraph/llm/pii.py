"""Personal data by fixed patterns and a skip-chain conditional random field.

The base spans (e-mail and IP addresses, card and phone numbers) come from fixed patterns, read in one pass over the whole
text. They are evidence in a field over the document's tokens (``skipchain``): tokens with a digit, an ``@`` or a
written-out ``(at)`` or ``[.]``, and those beside such a sign; all other tokens are certain to be no personal data and
need no node. Neighbours share chain potentials, tokens that repeat or share their last seven digits share skip
potentials however far apart they stand, so a number that tells nothing by itself takes the label that a like one has
elsewhere in the document. A token links to the next like one, so a token repeated n times has n - 1 edges.

What the field marks beyond the base (numbers without a plus that stand elsewhere with it, cards side by side,
written-out addresses) is trimmed and checked: cards by length and Luhn sum, IP parts by range, phones by digits. Added
spans never overlap base ones.

The field is fitted on ``MADE`` generated documents, as the corpus has no labels of such spans; they hold base forms,
disguised forms, repeated numbers and numbers that are no personal data. It does not depend on the corpus.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are found
alike; an empty table gives an empty result; ``spans`` looks at no extra columns, ``redacted`` keeps them. A text's
tokens are one graph; graphs are worked through ``NODES`` nodes or one text at a time.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .skipchain import Field, Graph, fit

#: In the order of results.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
GROUP = np.array([0, 1, 1, 2, 2, 3, 3, 4, 4])
NODES, MADE = 20_000, 500

#: The base patterns. Possessive, and from the start of a run only, so that no text takes quadratic time.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_AT, _DOT = r"[\[({<](?:at|AT|@)[\])}>]", r"[\[({<](?:dot|DOT|\.)[\])}>]"
_SIGN = re.compile(rf"[0-9@]|{_AT}|{_DOT}")
_SPELT = re.compile(rf"{_AT}|{_DOT}")
_SPELT_AT = re.compile(rf"\s*{_AT}\s*")
_SPELT_DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:\s*(?:\.|{_DOT})\s*[A-Za-z0-9-]++)++")
_SPELT_IP = re.compile(rf"(?<![0-9])[0-9]++(?:(?:\.|{_DOT})[0-9]++){{3}}")
_SPACE = re.compile(r"\s")
_NUMERIC = re.compile(r"[0-9 ().+/_-]*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def numerals(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = at = found.end() if found else at + 1
        if found:
            yield start, found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in the order of kinds and starts."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := numerals(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(numerals(m[0])) <= 15]
    return out


# Tokens and their features


def tokens(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, word before, whether the token before stands right before) of the tokens that are nodes."""
    out, done = [], 0

    def add(start: int, end: int, before: str) -> None:
        out.append((start, end, before.lower().strip(".,:;!?#\"'"), bool(out) and not text[out[-1][1] : start].strip()))

    while m := _SIGN.search(text, done):
        gap = text[done : m.start()]
        words = gap.split()
        joined = bool(words) and not gap[-1:].isspace()  # the sign stands inside a word
        start = m.start() - len(words.pop()) if joined else m.start()
        end = stop.start() if (stop := _SPACE.search(text, m.end())) else len(text)
        spelt = _SPELT.search(text, start, end)
        before = words[-1] if words else ""
        if spelt and words:  # the word beside a written-out sign is a node, too
            at = text.rindex(before, done, start)
            add(at, at + len(before), words[-2] if len(words) > 1 else "")
        add(start, end, before)
        done = end
        if spelt:
            rest = text[done : done + 200].split(None, 1)
            if rest and not _SIGN.search(rest[0]) and text[done : done + 1].isspace():
                at = text.index(rest[0], done)
                stop = _SPACE.search(text, at)
                add(at, stop.start() if stop else len(text), text[start:end])
                done = out[-1][1]
    return out


CUES = ({"mail", "email", "e-mail", "contact", "write"}, {"ip", "host", "server", "node"}, {"card", "visa", "payment", "mastercard"}, {"tel", "phone", "call", "mobile", "fax", "number", "dial"})
STEP = (1, 2, 3, 4, 5, 7, 8, 10, 11, 16, 20)
SHAPES = ("3-4", "3-3-4", "(3)", "1-3-3-4", "4-4-4-4", "4")


def traits(word: str, before: str) -> list[str]:
    """Names of what holds for a token."""
    digits = numerals(word)
    bare = word.strip(".,;:!?\"'*#&%$<>")
    groups = "-".join(str(len(x)) for x in re.split(r"[^0-9]+", bare) if x)
    out = ["any", f"digits {sum(len(digits) >= s for s in STEP)}"]
    letters = sum(c.isalpha() for c in word)
    tests = {
        "plus": bare[:1] == "+", "paren": bare[:1] == "(", "dash": "-" in bare, "dot": "." in bare, "slash": "/" in bare, "colon": ":" in bare, "@": "@" in word,
        "letters": letters > 0, "only letters": letters == len(bare) > 0, "luhn": 16 <= len(digits) <= 19 and luhn(digits) and letters == 0, "hex": letters > 0 and len(digits) > 3 and all(c in "0123456789abcdefABCDEF" for c in bare.split("=")[-1]),
        "spelt at": bool(re.search(_AT, word)), "spelt dot": bool(re.search(_DOT, word)), "spelt only": bool(_SPELT.fullmatch(bare)),
        "spelt ip": bool(_SPELT_IP.fullmatch(bare)) and bool(re.search(_DOT, bare)), "year": bool(re.fullmatch(r"(?:19|20)[0-9]{2}", bare)), "clock": bool(re.fullmatch(r"[0-9]{1,2}:[0-9]{2}", bare)), "money": word[:1] in "$€£" or bare[-1:] == "%",
    }
    out += [k for k, v in tests.items() if v]
    if letters == 0 and (bare[:1] == "(" and groups == "3" or groups in SHAPES):
        out.append("shape (3)" if bare[:1] == "(" and groups == "3" else f"shape {groups}")
    return out + [f"cue {KINDS[k]}" for k, words in enumerate(CUES) if before in words]


NAMES = {n: k for k, n in enumerate([
    "any", *(f"digits {k}" for k in range(len(STEP) + 1)), "plus", "paren", "dash", "dot", "slash", "colon", "@", "letters", "only letters", "luhn", "hex", "spelt at", "spelt dot", "spelt only", "spelt ip",
    "year", "clock", "money", *(f"shape {s}" for s in SHAPES), *(f"cue {k}" for k in KINDS),
])}
#: A token's own traits, then those of the tokens right before and right after it.
FEATURES = 3 * len(NAMES)


class Batch:
    """Documents on their way into one graph."""

    def __init__(self):
        self.x, self.edges, self.first, self.known, self.tokens, self.docs = [], [], [], [], [], []

    def add(self, doc: int, text: str, found: list[tuple[int, int, int]]) -> None:
        base, at, number = len(self.x), {}, ""
        here = tokens(text)
        spans, k = sorted((a, b, kind) for kind, a, b in found), 0
        own = []
        for n, (a, b, before, beside) in enumerate(here):
            node, word = base + n, text[a:b]
            own.append([NAMES[t] for t in traits(word, before)])
            self.first.append(not beside)
            if beside:
                self.edges.append((node - 1, node, 0))
            digits = numerals(word)
            keys = [(1, word.strip(".,;:!?()\"'").lower())] if len(digits) >= 3 else []
            plain = bool(digits) and bool(_NUMERIC.fullmatch(word.strip(".,;:!?\"'*#&%$")))
            number = (number if plain and beside else "") + digits if plain else ""  # of all numeric tokens up to here
            number = number[-19:]
            last_of_run = not (n + 1 < len(here) and here[n + 1][3] and _NUMERIC.fullmatch(text[here[n + 1][0] : here[n + 1][1]].strip(".,;:!?\"'*#&%$")))
            if len(number) >= 7 and last_of_run:
                keys.append((2, number[-7:]))
            linked = set()
            for key in keys:
                last = at.get(key)
                if last is not None and last not in linked and (last < node - 1 or not beside):
                    self.edges.append((last, node, key[0]))
                    linked.add(last)
                at[key] = node
            while k < len(spans) and spans[k][1] <= a:
                k += 1
            label = -1
            if k < len(spans) and spans[k][0] < b:
                label = 1 + 2 * spans[k][2] + (spans[k][0] < a)
            self.known.append(label)
        for n, mine in enumerate(own):
            row = np.zeros(FEATURES, bool)
            row[mine] = True
            if not self.first[base + n]:
                row[[len(NAMES) + t for t in own[n - 1]]] = True
            if n + 1 < len(own) and here[n + 1][3]:
                row[[2 * len(NAMES) + t for t in own[n + 1]]] = True
            self.x.append(row)
        self.tokens += here
        self.docs.append((doc, text, found, base, len(self.x)))

    def graph(self) -> Graph:
        e = np.array(self.edges, np.int64).reshape(-1, 3)
        return Graph(np.array(self.x, np.float64).reshape(-1, FEATURES), e[:, 0], e[:, 1], e[:, 2], np.array(self.first, bool), np.array(self.known, np.int64))

    def spans(self, field: Field) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(document, its added spans)."""
        labels = field.labels(self.graph())
        for doc, text, found, base, end in self.docs:
            runs = []
            for n in range(base, end):
                y, (a, b, _, beside) = int(labels[n]), self.tokens[n]
                if y == 0 or self.known[n] >= 0:
                    continue
                kind, inside = (y - 1) // 2, y % 2 == 0
                if inside and beside and runs and runs[-1][3] == n - 1 and runs[-1][0] == kind:
                    runs[-1][2:] = [b, n]
                else:
                    runs.append([kind, a, b, n])
            added = [s for kind, a, b, _ in runs if (s := confirmed(text, kind, a, b))]
            taken = sorted((a, b) for _, a, b in found)
            at, clear = 0, []
            for s in sorted(added, key=lambda s: s[1]):
                while at < len(taken) and taken[at][1] <= s[1]:
                    at += 1
                if at == len(taken) or taken[at][0] >= s[2]:
                    clear.append(s)
            yield doc, clear


def confirmed(text: str, kind: int, a: int, b: int) -> tuple[int, int, int] | None:
    """The span of a kind inside text[a:b], trimmed, if what it holds can be of that kind."""
    part = text[a:b]
    if kind == 0:
        if not (m := _SPELT_AT.search(part)):
            return None
        start = len(part[: m.start()].rstrip(LOCAL))
        domain = _SPELT_DOMAIN.match(part, m.end())
        return (0, a + start, a + domain.end()) if domain and start < m.start() else None
    if kind == 1:
        m = _SPELT_IP.search(part)
        return (1, a + m.start(), a + m.end()) if m and all(map(small, re.findall("[0-9]+", m[0]))) else None
    places = [k for k, c in enumerate(part) if "0" <= c <= "9"]
    if not places:
        return None
    start, end = places[0], places[-1] + 1
    if start and part[start - 1] in "+(":
        start -= 1
    inner, digits = part[start:end], numerals(part)
    if not _NUMERIC.fullmatch(inner):
        return None
    if kind == 2:
        return (2, a + start, a + end) if 16 <= len(digits) <= 19 and luhn(digits) else None
    return (3, a + start, a + end) if 7 <= len(digits) <= 15 else None


# Documents to learn from


def made(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated text and its spans, (kind, start, end)."""
    parts, spans, size = [], [], 0

    def put(text: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            spans.append((kind, size, size + len(text)))
        parts.append(text + " ")
        size += len(text) + 1

    word = lambda: "".join(r.choice(["an", "ti", "er", "on", "la", "que", "sch", "st", "mi", "ou"]) for _ in range(r.randint(1, 4)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def filler(least=1) -> None:
        for _ in range(r.randint(least, 8)):
            put(word() + r.choice(["", "", "", ",", "."]))

    def card() -> str:
        d = r.choice("3456") + digits(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def phone() -> tuple[str, str, str]:
        return digits(3), digits(3), digits(4)

    def loose(p) -> str:
        return r.choice([f"({p[0]}) {p[1]}-{p[2]}", f"{p[0]}-{p[1]}-{p[2]}", f"{p[0]}.{p[1]}.{p[2]}", f"{p[0]} {p[1]} {p[2]}", f"1-{p[0]}-{p[1]}-{p[2]}", "".join(p)])

    def full(p) -> str:
        return r.choice([f"+1 ({p[0]}) {p[1]}-{p[2]}", f"+1 {p[0]} {p[1]} {p[2]}", f"+1-{p[0]}-{p[1]}-{p[2]}"])

    def name() -> str:
        return r.choice([word() + "." + word(), word() + digits(2), word()])

    def number() -> str:
        return r.choice([
            lambda: str(r.randint(0, 999)), lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"2{digits(3)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
            lambda: f"${r.randint(1, 999)}.{digits(2)}", lambda: f"{r.randint(0, 23)}:{digits(2)}", lambda: f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 40]))),
            lambda: digits(r.choice([5, 8, 10, 12, 16, 20])), lambda: loose(phone()), lambda: f"{r.randint(1, 100)}%", lambda: word() + digits(2), lambda: " ".join(digits(r.choice([3, 4])) for _ in range(r.randint(2, 9))),
        ])()

    filler()
    for _ in range(r.randint(1, 7)):
        what = r.random()
        if what < 0.35:
            value = number()
            for _ in range(r.choice([1, 1, 2])):  # numbers repeat, too
                put(value)
                filler()
        elif what < 0.65:
            p = phone()
            forms = r.choice([[full(p)], [full(p), loose(p)], [loose(p), full(p)], [full(p), loose(p), loose(p)], [loose(p)], [loose(p)], [loose(p)], [loose(p), loose(p)]])
            certain = any(f[0] == "+" for f in forms)
            named = -1 if certain or r.random() < 0.7 else r.randrange(len(forms))
            for n, f in enumerate(forms):  # one with a plus or a name makes all of them phone numbers
                if n == named:
                    put(r.choice(sorted(CUES[3])) + r.choice(["", ":"]))
                put(f, 3 if certain or named >= 0 else None)
                filler()
        elif what < 0.8:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("@", "."), ("[@]", "[.]")])
            put(f"{name()}{at}{word()}{dot}{r.choice(['com', 'org', 'example.com'])}", 0)
            filler()
        elif what < 0.9:
            many = r.choice([1, 1, 2, 3])
            for _ in range(many):
                put(card() if many > 1 else r.choice([card(), re.sub(r"(....)(?=.)", r"\1" + r.choice(["-", ".", " "]), card())]), 2)
            filler()
        else:
            put(r.choice([".", "[.]", "(.)", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4)), 1)
            filler()
    return "".join(parts), spans


@cache
def field(seed: int = 5) -> Field:
    """The fitted field; the same in every process."""
    r, batch, labels = random.Random(seed), Batch(), []
    for k in range(MADE):
        text, spans = made(r)
        batch.add(k, text, base_spans(text))
        for a, b, _, _ in batch.tokens[len(labels) :]:
            mine = next(((kind, s) for kind, s, e in spans if s < b and a < e), None)
            labels.append(0 if mine is None else 1 + 2 * mine[0] + (mine[1] < a))
    y, n = np.array(labels), len(LABELS)
    graph = batch.graph()
    y = np.where(graph.known >= 0, graph.known, y)
    follows = np.ones((n, n), bool)
    for k in range(2, n, 2):
        follows[:, k] = False
        follows[[k - 1, k], k] = True
    empty = Field(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((2, 5, 5)), GROUP, np.arange(n) % 2 == 1, follows)
    empty.opening[0] = True
    return fit(graph, y, empty)


# Over tables


def found(texts: list[str], model: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, whether of the base) of each text, in the order of kinds and starts."""
    out, batch = [], Batch()

    def flush() -> None:
        nonlocal batch
        for doc, added in batch.spans(model):
            out[doc] = sorted(out[doc] + [(*s, False) for s in added])
        batch = Batch()

    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append([(*s, True) for s in base])
        if _SIGN.search(text):
            batch.add(k, text, base)
            if len(batch.x) >= NODES:
                flush()
    flush()
    return out


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"


def listed(rows: list[list[tuple[int, int, int, bool]]]) -> pa.Array:
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in row] for row in rows], pa.list_(item))


def spans(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """(doc_id, spans) of every row of docs(doc_id, text)."""
    model = model or field()

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.record_batch([part.column(0), listed(found([t.as_py() or "" for t in part.column(1)], model))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, with each span's text replaced by its kind in angle brackets; of
    overlapping spans the first in the text, and of those the longest, counts."""
    model = model or field()

    def clear(text: str, marks: list[tuple[int, int, int, bool]]) -> str:
        out, done = [], 0
        for a, b, kind in sorted((a, -b, kind) for kind, a, b, _ in marks):
            if a >= done:
                out += [text[done:a], f"<{KINDS[kind].upper()}>"]
                done = -b
        return "".join(out) + text[done:]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            marks = found([t or "" for t in texts], model)
            new = [t and clear(t, m) for t, m in zip(texts, marks, strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digests(found_: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda s: F.array_join(F.transform(s, line), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    many = [of(k) for k in KINDS]
    return found_.select("doc_id", *many, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_pii(spark, sf_dir) -> DataFrame:
    return digests(spans(table(spark, sf_dir, "documents")))
