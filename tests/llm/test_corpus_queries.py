"""Every registered corpus query over whole tables: against its SQL, or against a brute-force reading of its contract."""

import base64
import glob
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import media, near, packing, quality, toxicity
from loamgraph.llm.common import table
from loamgraph.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(got.columns)
    at = [got.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize(("name", "module", "kind", "cut"), [("op2_toxicity", toxicity, "toxic", 0.5), ("op4_quality", quality, "quality", 0.3)])
def test_classifiers(name, module, kind, cut, spark, sf, docs):
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in rows)
    model = module.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    for r in rows[::29]:  # each score one by one, from the model's weights
        x = [int(t) for t in module.terms(docs[r.doc_id])]
        if kind == "toxic":
            i = np.flatnonzero(np.isin(model.inputs, x))
            z = model.w0 + model.w[i].sum() + sum(float(model.v[a] @ model.v[b]) for n, a in enumerate(i) for b in i[:n])
        else:
            i = np.flatnonzero(np.isin(model.grams, x))
            norm = math.sqrt(sum(model.ratio[k] ** 2 for k in i)) or 1.0
            z = model.scale * (model.bias + sum(model.weight[k] for k in i) / norm) + model.shift
        assert abs(r.score - 1 / (1 + math.exp(-min(max(z, -35), 35)))) < 1e-6
    label = {r.doc_id: r[kind] for r in table(spark, sf, "labels").collect()}
    out = [r for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert out and sum(r.predicted == label[r.doc_id] for r in out) / len(out) > 0.8


@pytest.mark.parametrize(("name", "kind", "rare"), [("op2_toxicity", "toxic", 1), ("op4_quality", "quality", 0)])
def test_the_rare_class_is_found(name, kind, rare, spark, sf):
    """Recall and precision of toxic and of poor held-out texts, at the next scale, where there are some of them."""
    large = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    if not os.path.isdir(large):
        pytest.skip("no larger tables")
    label = {r.doc_id: r[kind] for r in table(spark, large, "labels").collect()}
    out = [r for r in QUERIES[name](spark, large).collect() if r.held_out and label.get(r.doc_id) is not None]
    there, said = ({r.doc_id for r in out if x(r) == rare} for x in (lambda r: label[r.doc_id], lambda r: r.predicted))
    assert len(there) >= 5 and len(there & said) >= 0.6 * len(there) and len(there & said) >= 0.9 * len(said)


def test_packing(spark, sf, docs):
    """Every piece's ids, start and length from the plain tokenizer; sequences without gaps, none over the length, and as
    many as the bound allows but for a few in a hundred."""
    from tokenizers import Tokenizer

    of = Tokenizer.from_file(packing.default_tokenizer())
    want, sizes = {}, []
    for k, text in docs.items():
        ids = [*of.encode(text, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[k, p] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            sizes.append(len(part))
    rows = QUERIES["op3_packing"](spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    least = packing.bound(np.array(sizes), 2048)
    assert {r.sequences_bound for r in rows} == {least} and least <= len(places) <= 1.03 * least + 1


def test_near(spark, sf, docs):
    from test_near_and_packing import brute

    rows = QUERIES["op6_near"](spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(sorted(docs.items()), near.PERCENT)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_warc_rows(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    for r in QUERIES["op9_warc"](spark, sf).collect():
        raw = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[raw] == r.page_id else ("revisit", first[raw]))


def test_media_rows(spark, sf, docs):
    """Digests, sizes and the feature of every text, computed once more without the operator's readers."""
    rows = QUERIES["op10_media"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        image = media.png(padded)
        x = list(padded)
        mean = sum(x) / len(x)
        cells = [sum(x[k * len(x) // 64 : (k + 1) * len(x) // 64]) / max(1, (k + 1) * len(x) // 64 - k * len(x) // 64) for k in range(64)]
        bits = "".join("1" if c > sum(cells) / 64 else "0" for c in cells)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        assert r.feature == f"{len(x) // 64}:{mean:.4f}:{math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)):.4f}:{x.count(0) / len(x):.4f}:{int(bits, 2):016x}"


def test_extract_rows(spark, sf):
    pages = {r.page_id: (r.url, r.html or "") for r in table(spark, sf, "pages").collect()}
    rows = QUERIES["op1_extract"](spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id][0] and r.n_chars == len(r.text)
        assert all(line == " ".join(line.split()) and line for line in r.text.split("\n")) or r.text == ""
        assert not re.search(r"</?(?:p|div|script|style|nav)\b", r.text)
