"""Near-duplicates and packing against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import near, packing


def brute(docs, percent=85):
    sets = {}
    for k, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def corpus(groups=12, seed=1):
    """Families of edited copies at many distances, exact copies, short and blank texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([20, 60, 200]))]
        for _ in range(r.randint(1, 14)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["one two", "one two", "One Two", "three", "", "   ", None, "a b c d", "a b c d e"]
    r.shuffle(out)
    return list(enumerate(out))


def check(spark, docs):
    got = {r.doc_id: r for r in near.near(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute(docs)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_components_match_brute_force(spark):
    check(spark, corpus())


def test_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "PILOTS", 2)
    check(spark, corpus(5, seed=3))


def test_texts_around_a_common_passage(spark, monkeypatch):
    """120 shared and 60 own words: nothing links but the planted copies, and no block of texts is compared with another."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(120)]
    docs = [" ".join(shared + [word() for _ in range(60)]) for _ in range(700)]
    docs += [t + " end" for t in docs[:40]] + [t.replace(" ", "  ") for t in docs[:5]]
    tags = []
    monkeypatch.setattr(near, "written", lambda df, tag, *a, plain=near.written: (tags.append(tag), plain(df, tag, *a))[1])
    rows = near.near(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in rows} == {k: k if k < 700 else k - 700 if k < 740 else k - 740 for k in range(745)}
    assert "refined" in tags and "links-across" not in tags


def test_hung_runs_are_connected():
    r = np.random.default_rng(7)
    base = [r.integers(0, 2**63, 400).astype(np.uint64) for _ in range(3)]
    sets = [np.unique(np.concatenate([b[:380], r.integers(0, 2**63, 20).astype(np.uint64)])) for b in base for _ in range(5)]
    keys = np.array([1] * 15)
    a, b = near.hung(keys, np.arange(15), np.array([float(len(x)) for x in sets]), near.sketches(sets))
    assert {x // 5 for x in a} == {0, 1, 2} and all(x // 5 == y // 5 for x, y in zip(a, b, strict=True)) and len(a) == 12


def test_edges_of_the_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 3), (9, "a b c d e f", 4)], "doc_id long, text string, n int")
    got = near.near(df).collect()
    assert len(got) == 4
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (7, 7, True), (9, 7, False)}
    stay = near.deduplicated(df)
    assert stay.columns == df.columns and sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 7]
    assert near.near(df.where("false")).count() == 0


@pytest.mark.parametrize("swap", [False, True])
def test_repeated_id_with_other_texts(spark, swap):
    r = random.Random(9)
    a, b = (" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(200)) for _ in range(2))
    a, b = sorted((a, b), reverse=swap)
    docs = [(3, b + " x"), (5, a), (5, b), (7, a + " y"), (None, a)]
    stay = {(x.doc_id, x.text) for x in near.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # the first text of 5 in order is a, or b when swapped; a document of either family stays
    assert stay == ({(3, b + " x"), (7, a + " y"), (None, a)} if swap else {(3, b + " x"), (5, a), (None, a)})


def test_likelihood_estimate_is_close():
    r = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.85, 0.95):
        n = 3000
        common = int(2 * n * j / (1 + j))
        errors = []
        for _ in range(12):
            pool = r.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - common :])
            s = near.sketches([a, b])
            errors.append(near.estimate(s[:1], s[1:], np.array([float(n)]), np.array([float(len(b))]))[0] - j)
        assert abs(np.mean(errors)) < 0.05


def test_sketches_merge():
    r = np.random.default_rng(3)
    a, b = (np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (7, 900))
    both = near.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(both[0], both[1]) == both[2]).all()


def test_chunks_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    of, table = Tokenizer.from_file(path), packing.Chunks(path)
    r = random.Random(3)
    sign = "abcXYZ éÉßΣσİıñ012'’.,!|<>_-=\n\t\x0b\x1c\x1f\x85\xa0 　́̈가각漢字ǅ😀%$#@"
    cases = ["".join(r.choice(sign) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|> a", "a<|startoftext|>b", "it's we'll don't", "", " "]
    for text, raw in zip(cases, table.ids(cases), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == of.encode(text, add_special_tokens=False).ids, repr(text)


def test_pack_is_whole_and_tight(spark):
    r = random.Random(5)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gamma,"]) for _ in range(r.choice([0, 3, r.randint(1, 90), r.randint(100, 900)])))) for k in range(400)] + [(5, "again"), (None, None), (401, "long " * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = packing.pieces(df, with_ids=True)
    ids = {}
    for x in found.collect():
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        ids.setdefault((x.doc_id, x.piece), []).append(x.start)
    rows = packing.pack(packing.pieces(df), items=64).collect()
    assert {x.sequences_bound for x in rows} == {packing.bound(np.array([x.length for x in rows]), packing.LENGTH)}
    assert len(rows) == sum(len(v) for v in ids.values())
    places = {}
    for x in rows:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    total = sum(x.length for x in rows)
    assert len(places) <= 1.02 * -(-total // packing.LENGTH) + 1
    assert packing.pack(packing.pieces(df.where("false"))).count() == 0


def test_bounds_hold_against_exhaustive_packing():
    r = random.Random(8)

    def least(sizes, length):
        best = [len(sizes)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] >= sizes[k]:
                    bins[i] -= sizes[k]
                    go(k + 1, bins)
                    bins[i] += sizes[k]
            go(k + 1, [*bins, length - sizes[k]])

        go(0, [])
        return best[0]

    for _ in range(150):
        s = np.array([r.randint(1, 12) for _ in range(r.randint(1, 8))])
        bins, offsets, n = packing.best_fit(s, 12)
        assert packing.bound(s, 12) <= least(sorted(s.tolist(), reverse=True), 12) <= n
        assert np.bincount(bins, s).max() <= 12
