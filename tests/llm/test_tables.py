"""Chat, mixing, search, WARC and media: brute force, exact round trips, odd inputs."""

import base64
import hashlib
import io
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import chat, media, mixing, search, warc
from loamgraph.llm.common import components, prefixed, scratch, shared_dir, store


def test_chat_keeps_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    say = lambda c, *t: [(c, k, r, x, "extra") for k, (r, x) in enumerate(t)]
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", None)
    rows = say(1, a) + say(2, a, b) + say(3, a, b, c) + say(4, a, b, c) + say(5, a, ("assistant", "no")) + say(6, b) + say(7, ("user", ""), a) + say(None, c, c, c, c)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    assert {(r.conv_id, r.n_turns, r.copies) for r in chat.maximal(df).collect()} == {(3, 3, 2), (5, 2, 1), (6, 1, 1), (7, 2, 1), (None, 4, 1)}
    got = chat.rendered(df).where("conv_id = 3").orderBy("part").collect()
    assert "".join(r.rendered for r in got) == "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\n\n" and len(got) == 2
    assert chat.rendered(df.where("false")).count() == 0


def test_chat_blocks_are_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    r = np.random.default_rng(2)
    word = lambda: (None, "", "a", "b" * 250, "b" * 249 + "a", "é")[r.integers(0, 6)]
    rows = [(None, None if k % 3 else int(k % 5), ("user", None, "bot")[r.integers(0, 3)], word()) for k in range(90)]
    rows += [(7, 1, "user", "again")] * 37 + [(7, None, "user", None)] * 3 + [(8, None, "user", None)] * 3 + [(9, 10**9, "user", "late"), (9, 5, "user", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    low = lambda x: (x is not None, x if isinstance(x, int) else (x or "").encode())
    want = {}
    for c, many in ((None, 90), (7, 40), (9, 2)):  # 8 is a prefix of 7
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (low(x[1]), low(x[2]), low(x[3])))
        for k in range(0, many, 4):
            want[c, k // 4] = (many, 1, len(mine[k : k + 4]), "".join(f"<|{x[2] or ''}|>\n{x[3] or ''}\n" for x in mine[k : k + 4]))
    got = {(x.conv_id, x.part): (x.n_turns, x.copies, x.n_lines, x.rendered) for x in chat.rendered(df).collect()}
    assert got == want


def plain_targets(sizes, weights=(3, 1, 2)):
    """Water-filling by repeated clamping."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(keys)}
    target, free, left = {}, set(keys), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing_targets_and_repeats(spark):
    r = np.random.default_rng(1)
    docs = [(int(k), str(r.choice(["a", "b", "é", "z"], p=[0.7, 0.1, 0.1, 0.1])), "w " * int(r.integers(0, 60)), 1) for k in range(1500)] + [(2000, None, "x y z", 1), (2000, None, "x y z", 1), (2001, "b", None, 1), (None, "a", "  ", 1), (2002, "q", "word " * 3000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, size int")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, s, t, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    for s in sizes:
        mine = [x for x in rows if x.source == s]
        assert mine[0].source_size == sizes[s] and abs(mine[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert all(x.taken <= 2 * x.size for x in mine)
        if s in ("a", "b", "é", "z"):
            assert abs(sum(x.taken for x in mine) - want[s]) <= 60
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    whole = mixing.mixed(df)
    assert whole.columns == df.columns
    assert sum(len((x.text or "").split()) for x in whole.collect()) == sum(x.taken for x in rows)
    assert mixing.mix(df.where("false")).count() == 0


def test_mixing_rows_without_or_with_equal_ids(spark):
    """Sources of null or repeated ids come within one document of their targets, whatever the partitions."""
    same = [(None, "a", "one two three four five")] * 6000 + [(7, "c", f"w {'x ' * (k % 5)}") for k in range(300)] * 2
    docs = [(k, "b", "one two three") for k in range(3000)] + same + [(9, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mix(df).collect()
    assert len(rows) == len(docs)
    sizes = {"a": 30_000, "b": 9000, "c": sum(len(t.split()) for _, s, t in docs if s == "c"), None: 0}
    for s, want in plain_targets(sizes).items():
        mine = [x for x in rows if x.source == s]
        assert abs(sum(x.taken for x in mine) - want) <= 6 and all(x.taken <= 2 * x.size for x in mine)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(9, "text")).collect()))
    whole = mixing.mixed(df.withColumn("n", F.length("text")).withColumn("j", F.lit(1)))
    assert sum(len((x.text or "").split()) for x in whole.collect()) == sum(x.taken for x in rows)
    assert whole.columns == ["doc_id", "source", "text", "n", "j"]


def test_mixing_with_more_sources_than_are_sent(spark, monkeypatch):
    docs = [(k, f"s{k % 50}", "w " * (k % 17)) for k in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    sent = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted(map(str, mixing.mix(df).collect())) == sent


def test_running_sums_over_ranges(spark):
    r = np.random.default_rng(5)
    rows = [(k, None if k % 7 == 0 else int(r.integers(0, 3)), int(r.integers(0, 9))) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, g int, n long")
    got = {x.id: (x.a, x.b) for x in prefixed(df, ["g", "id"], {"a": "n", "b": "1"}, ("g",)).collect()}
    want, run = {}, {}
    for k, g, n in rows:
        want[k] = run.get(g, (0, 0))
        run[g] = (want[k][0] + n, want[k][1] + 1)
    assert got == want


def test_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(search, "CANDIDATES", 64)
    monkeypatch.setattr(search, "QUERIES", 8)
    monkeypatch.setattr(search, "BYTES", 60 * 40 * 8)
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (700, 40))
    v[100:160] = v[0]
    rows = [(int(k), [float(x) for x in v[k]], "e") for k in range(700)] + [(800, None, ""), (801, [1.0, None], ""), (850, [float("nan")], ""), (802, [], ""), (803, [2.0, 3.0], ""), (None, [1.0], ""), (50, [0.5] * 40, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = search.search(df, df.where("vec_id % 50 = 0")).collect()
    floor = [(k, np.pad(np.floor(256 * np.array(x, float)), (0, 40 - len(x)))) for k, x, _ in rows if k is not None and x and all(y is not None and np.isfinite(y) for y in x)]
    first = {}
    for k, x in floor:
        if k % 50 == 0 and (k not in first or list(x) < list(first[k])):
            first[k] = x
    for q, x in first.items():
        want = sorted(((-int(x @ y), k) for k, y in floor if k != q))[:5]
        assert [(-g.score, g.vec_id) for g in sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])] == want
    assert {g.query_id for g in got} == set(first)
    assert search.search(df.where("false"), df.where("false")).count() == 0


def test_search_beyond_doubles():
    q, c = np.array([[2.0**40], [3.0]]), np.array([[2.0**21, 2.0**20], [5.0, 7.0]])
    got = search.top(np.array([1]), q, np.array([2, 3]), c, 5, np.array([-np.inf]))
    assert got[2].tolist() == [2**61 + 15, 2**60 + 21]


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é b", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "u\r\nX: y", None, 0), (4, "u", "", 0), (5, "u", "é" * 90_000 + "\r\n\r\nWARC/1.1\r\n", 0), (None, "u", "<p>x</p>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first int")
    got = {r.page_id: r for r in warc.round_trip(df, scratch(spark, "t")).collect()}
    for k, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[k].payload_bytes == len(raw) and got[k].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), None: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None)}
    assert got[1].target_uri == "http://a/%C3%A9%20b"
    apart = warc.round_trip(df, scratch(spark, "t"), min_bytes=9).collect()
    assert all(r.record_type == "response" for r in apart)
    assert warc.round_trip(df.where("false"), scratch(spark, "t")).count() == 0


def test_warc_keeps_the_source_until_all_is_written(spark, monkeypatch):
    from pyarrow.fs import FileSelector

    out = scratch(spark, "t")
    fs, base = store(f"{out}/monolithic")
    held = lambda: len(fs.get_file_info(FileSelector(base, allow_not_found=True)))
    seen = {}

    def noted(df, tag, plain=warc.written):
        got = plain(df, tag)
        seen[tag] = held()
        return got

    monkeypatch.setattr(warc, "written", noted)
    df = spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in range(40)], "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(df, out)
    assert seen["warc-done"] == seen["warc-files"] > 0 and held() == 0
    assert got.count() == 40


def test_warc_reads_any_gzip_layout():
    recs = [warc.record(k, "u", b"p" * k, None) for k in range(50)]
    one = zlib.compressobj(6, wbits=31)
    single = one.compress(b"".join(recs)) + one.flush()
    members = b"".join((z := zlib.compressobj(6, wbits=31)).compress(x) + z.flush() for x in recs)
    for raw in (single, members):
        assert list(warc.split_records(warc.inflate(io.BytesIO(raw), 97))) == recs


def test_media_round_trip(spark):
    rows = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "é" * 70_001, 0), (5, "x" * 64, 0), (6, "abc", 0), (6, "abc", 0), (None, "q", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    out = scratch(spark, "media")
    got = media.media(df, out, shard_bytes=2048).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, text, _ in rows:
        raw = (text or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = by[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.width, r.height, r.bit_depth) == (64, len(padded) // 64, 8)
    same = [r.asDict() | {"doc_id": 0} for r in got if r.doc_id in (1, 6)]
    assert all(x == same[0] for x in same)
    fs, base = store(out)
    names = []
    for f in fs.get_file_info(__import__("pyarrow").fs.FileSelector(base)):
        with fs.open_input_stream(f.path) as s, tarfile.open(fileobj=io.BytesIO(s.read())) as t:
            names += [(m.name, media.samples(t.extractfile(m).read())) for m in t]
    assert all(hashlib.sha256(p).hexdigest() == n.removesuffix(".png") for n, p in names)
    head = media.features(media.addresses(media.store_media(df, scratch(spark, "m2"))), "file:///nowhere", whole=False)
    assert "height" in head.columns
    assert media.media(df.where("false"), scratch(spark, "m3")).count() == 0


def test_components(spark):
    r = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {x.id: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_mixing_keeps_rows_that_differ_in_any_column(spark):
    """Rows of one id that differ in microseconds, in a map or in the sign of zero each come as often as the mix takes them."""
    at = "timestamp'2024-01-01 00:00:00.00000{}'"
    rows = [f"(7, 'a b c d', 'x', {at.format(k)}, map('k', {m}), {z})" for k, m, z in ((1, 1, "0.0D"), (2, 1, "0.0D"), (1, 2, "0.0D"), (1, 1, "1.0D"))] + ["(8, 'one two', 'y', null, null, null)"]
    df = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(doc_id, text, source, ts, m, z)")
    taken = sorted(r.repeats for r in mixing.mix(df).where("source = 'x'").collect())
    got = mixing.mixed(df).where("source = 'x'").selectExpr("ts", "m['k'] AS k", "z").collect()
    each = {}
    for r in got:
        each[tuple(r)] = each.get(tuple(r), 0) + 1
    assert sorted(each.values()) == [t for t in taken if t] and len(each) == sum(t > 0 for t in taken)
