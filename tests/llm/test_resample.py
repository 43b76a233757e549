"""Importance resampling: CRCs of spans against zlib, all rows against a plain reading of the contract."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import resample
from loamgraph.llm.common import table
from loamgraph.llm.queries import QUERIES

SMALL = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target):
    def count(texts):
        out = [0] * 10000
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % 10000] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


def test_spans_equal_zlib():
    r = np.random.default_rng(3)
    data = np.frombuffer(r.bytes(400_000), np.uint8)
    starts = r.integers(0, 200_000, 400)
    lengths = np.r_[np.arange(1, 200), r.integers(1, 200_000, 201)]
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert resample.crc_spans(data, starts, lengths).tolist() == want


def test_rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows = QUERIES["op13_resample"](spark, sf).collect()
    assert sorted(map(tuple, rows), key=repr) == brute(docs, [r.text for r in table(spark, sf, "benchmark").collect()])
    assert sum(r["rank"] is not None for r in rows) > 10


def test_odd_rows(spark):
    words = "Über élan 42 the The THE a\x00b c_d word " * 4
    docs = [(k, words + str(k % 3), 1) for k in range(40)] + [(5, words + "2", 1), (None, words, 1), (None, "x", 1), (90, None, 1), (91, "", 1), (92, " \t!", 1), (93, "q" * 5000 + " " + words, 1), (94, "語" * 3000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, weight int").repartition(3)
    target = spark.createDataFrame([(1, "the word élan"), (2, None)], "item_id long, text string")
    want = brute([d[:2] for d in docs], ["the word élan", None])
    assert sorted(map(tuple, resample.resample(df, target).collect()), key=repr) == want
    assert resample.resample(df.where("false"), target).count() == 0
    none = sorted(map(tuple, resample.resample(df, target.where("false")).collect()), key=repr)
    assert none == brute([d[:2] for d in docs], [])


def test_draw_follows_the_target(spark):
    near, far = "alpha beta gamma delta " * 6, "one two three four " * 6
    df = spark.createDataFrame([(k, near if k % 4 == 0 else far) for k in range(400)], "doc_id long, text string")
    rows = resample.resample(df, spark.createDataFrame([(near * 20,)], "text string")).where("rank is not null").collect()
    assert len(rows) == 100 and sum(r.doc_id % 4 == 0 for r in rows) > 85
