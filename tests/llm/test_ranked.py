"""Ranked lexical search: against a plain reading of the contract, with small segments, ranges and windows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import ranked

SMALL = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def brute(docs, queries, k=10):
    held = [(i, t) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    out, first = [], {}
    for item, text in queries:
        first[item] = min([x for x in (first.get(item), text) if x is not None], default=None)
    for item, text in first.items():
        asked, scored = Counter(terms(text)), []
        for i, t in held:
            tf, m = Counter(t), 25 + 75 * len(t) * n // total
            if s := sum(q * w[x] * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x, q in asked.items() if x in tf):
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def got(spark, docs, queries, parts=4):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(parts)
    index = ranked.build(df)
    return sorted(map(tuple, ranked.search(index, spark.createDataFrame(queries, "item_id long, text string")).collect()), key=repr)


def corpus(r, n, words=400):
    share = 1 / np.arange(1, words + 1)
    share /= share.sum()
    return [(int(k), " ".join(f"w{x}" for x in r.choice(words, int(r.integers(1, 60)), p=share))) for k in range(n)]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_rows(spark, monkeypatch, broadcast):
    for name, value in (("DOCUMENTS", 150), ("RANGE", 8), ("WINDOW", 2), ("SHORT", 4), ("QUERIES", 3), ("BROADCAST", broadcast)):
        monkeypatch.setattr(ranked, name, value)
    r = np.random.default_rng(5)
    docs = corpus(r, 700) + [(900, None), (901, ""), (902, " ,.!"), (5, "w1 w1 W2"), (5, "w1 w1 W2"), (None, "w1 w2 w399 é語"), (None, "w3"), (903, "É é語 " * 9), (904, "w7 " * 5000)]
    docs += [(k, "w1 w2 same text") for k in range(1000, 1040)]
    queries = [(k, t) for k, t in corpus(r, 12)] + [(20, "W1 w1 w2"), (21, None), (22, "nowhere"), (23, "é語 w399"), (24, "same"), (24, "text w5"), (None, "w2 w3")]
    assert got(spark, docs, queries) == brute(docs, queries)
    assert got(spark, docs[:0], queries) == []
    assert got(spark, docs[700:703], queries) == []


def test_most_ranges_are_skipped(monkeypatch):
    """One query's best ten of a segment equal the full sum, and the thresholds leave most ranges unseen."""
    r = np.random.default_rng(8)
    segment = ranked.Segment()
    docs = []
    for k in range(16_000):
        docs.append((k, " ".join(f"w{x}" for x in r.integers(0, 60, 40)) + (" rare other" if k % 3001 == 7 else "")))
        segment.add(*docs[-1])
    rows = segment.rows(0).to_pylist()
    n = np.frombuffer(rows[0]["tfs"], "<i8")
    of = lambda x: ranked.norms(x, len(docs), int(n.sum()))
    ranges = -(-len(docs) // ranked.RANGE)
    asked = {"rare": 2, "other": 1, "w1": 1, "w2": 1}
    lists = [(ranked.Postings({**x, "w": 9000 if x["term"] in ("rare", "other") else 300}, of(n), ranges, of), asked[x["term"]]) for x in rows if x["term"] in asked]
    place, score, seen = ranked.best(lists, len(docs), 5)
    full = np.zeros(len(docs), np.int64)
    for p, times in lists:
        full[p.docs] += times * p.gains()
    want = np.lexsort((np.arange(len(docs)), -full))[:5]
    assert place.tolist() == want.tolist() and score.tolist() == full[want].tolist()
    assert sum(p.long for p, _ in lists) == 2 and seen <= ranges // 10


def test_large_products_stay_exact():
    n = np.array([10**9, 3], np.int64)
    assert ranked.norms(n, 10**10, 10**12).tolist() == [25 + 75 * 10**9 * 10**10 // 10**12, 27]
