"""Small hand-built graphs: mutations, invariants, change capture, text functions, files and streams."""

import struct

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.functions.spans import flat, patched
from loamgraph.operators import changes, mutations, recursive
from loamgraph.operators import search as S
from loamgraph.schema import violations
from loamgraph.sources import files
from loamgraph.streaming import access


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_parse_uri(spark):
    got = frame(spark, [(" Core://A/b/ ",), ("plain/x",), ("my_dom://",)], "u string").select(T.domain_of(F.col("u")).alias("d"), T.path_of(F.col("u")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("core", "A/b"), ("core", "plain/x"), ("my_dom", "")]


def test_search_tokens(spark):
    got = frame(spark, [("project://graph_memory/arch GraphService 记忆",)], "t string").select(T.search_tokens(F.col("t")).alias("k")).first().k
    assert got == ["project", "graph_memory", "arch", "GraphService", "记忆"]


@pytest.mark.parametrize(("off", "want"), [("+1d", "2024-02-01"), ("-1m", "2023-12-31"), ("+1m", None), ("1Y", "2025-01-31"), ("x", None)])
def test_shifted_day(spark, off, want):
    day = frame(spark, [("2024-01-31", off)], "d string, o string").select(T.shifted_day(F.col("d").cast("date"), F.col("o")).cast("string").alias("x")).first().x
    assert day == want


def test_version_chain_and_purge(spark):
    m = frame(spark, [(1, "n", "v1", True, 2), (2, "n", "v2", True, 3), (3, "n", "v3", False, None)], "id long, node_uuid string, content string, deprecated boolean, migrated_to long")
    ends = {r.id: r.target for r in recursive.ends(m.select("id", F.col("migrated_to").alias("next"))).collect()}
    assert ends == {1: 3, 2: 3, 3: 3}
    left = mutations.purge(m, frame(spark, [(2,)], "id long")).collect()
    assert {(r.id, r.migrated_to) for r in left} == {(1, 3), (3, None)}
    back = {(r.id, r.deprecated, r.migrated_to) for r in mutations.rollback_to(m, frame(spark, [(1,)], "id long")).collect()}
    assert back == {(1, False, None), (3, True, 1)}


def test_chain_longer_than_the_hops(spark):
    m = frame(spark, [(k, k + 1 if k < 80 else None) for k in range(81)], "id long, next long")
    got = {r.id: r.target for r in recursive.ends(m, 50).collect()}
    assert got[80] == 80 and got[30] == 80 and got[29] is None


def test_purge_of_a_long_run(spark):
    n = 150
    rows = [(k, "n", "", k < n, k + 1 if k < n else None) for k in range(n + 1)] + [(900, "m", "", True, 901), (901, "m", "", True, 5000), (902, "m", "", True, None), (903, "m", "", True, 902)]
    m = frame(spark, rows, "id long, node_uuid string, content string, deprecated boolean, migrated_to long")
    dead = {k for k in range(1, 130)} | {131, 140, 141, 901, 902}
    want = {r[0]: r[4] for r in rows}
    for k in sorted(dead):  # one by one
        goal = want.pop(k)
        want = {a: goal if b == k else b for a, b in want.items()}
    got = mutations.purge(m, frame(spark, [(k,) for k in dead], "id long")).collect()
    assert {r.id: r.migrated_to for r in got} == want


def test_alias_cascade_and_cycle(spark):
    e = frame(spark, [("ROOT", "a", "a"), ("a", "b", "b"), ("b", "c", "c")], "parent_uuid string, child_uuid string, name string")
    p = frame(spark, [("", "core", "a"), ("", "core", "a/b"), ("", "x", "m/b")], "namespace string, domain string, path string")
    got = {r.path for r in mutations.cascade(e, p, frame(spark, [("", "x", "m", "a")], "namespace string, domain string, path string, node_uuid string")).collect()}
    assert got == {"m", "m/b/c"}
    asked = frame(spark, [("c", "a"), ("a", "c"), ("ROOT", "a"), ("b", "b")], "parent_uuid string, child_uuid string")
    assert {(r.parent_uuid, r.child_uuid): r.cycle for r in mutations.would_cycle(e, asked).collect()} == {("c", "a"): True, ("a", "c"): False, ("ROOT", "a"): False, ("b", "b"): True}


def test_closures_reach_the_last_level(spark):
    n = 100
    r = frame(spark, [(k, k - 1 if k else None) for k in range(n)], "id long, parent_id long")
    got = changes.ancestors(r, frame(spark, [(n - 1,), (70,), (0,)], "origin long")).collect()
    assert sorted((x.origin, x.id, x.depth) for x in got) == sorted((o, k, o - k) for o in (n - 1, 70, 0) for k in range(o + 1))
    ring = changes.ancestors(frame(spark, [(5, 1), (1, 2), (2, 3), (3, 1)], "id long, parent_id long"), frame(spark, [(5,), (2,)], "origin long"))
    assert sorted(map(tuple, ring.collect())) == [(2, 1, 2), (2, 2, 0), (2, 3, 1), (5, 1, 1), (5, 2, 2), (5, 3, 3), (5, 5, 0)]
    depth = 17
    e = frame(spark, [(f"n{k}", f"n{k + 1}", f"n{k + 1}") for k in range(depth)], "parent_uuid string, child_uuid string, name string")
    asked = frame(spark, [(f"n{depth}", "n0"), ("n0", f"n{depth}")], "parent_uuid string, child_uuid string")
    assert {r.parent_uuid: r.cycle for r in mutations.would_cycle(e, asked).collect()} == {f"n{depth}": True, "n0": False}
    p = frame(spark, [], "namespace string, domain string, path string")
    got = mutations.cascade(e, p, frame(spark, [("", "x", "m", "n0")], "namespace string, domain string, path string, node_uuid string")).collect()
    assert {r.depth for r in got} == set(range(depth + 1))


def test_remove_refuses_when_a_child_would_be_lost(spark):
    p = frame(spark, [("", "core", "f", "f"), ("", "core", "f/c", "c"), ("", "core", "g", "g"), ("", "core", "g/d", "d"), ("", "x", "d2", "d")], "namespace string, domain string, path string, node_uuid string")
    got = mutations.remove_paths(p, None, frame(spark, [("", "core", "f"), ("", "core", "g")], "namespace string, domain string, path string")).collect()
    assert {(r.base, r.path, r.stays, r.refused) for r in got} == {("f", "f", False, True), ("f", "f/c", False, True), ("g", "g", False, False), ("g", "g/d", True, False)}


def test_invariants(spark):
    m = frame(spark, [("n", False), ("n", False), ("m", True)], "node_uuid string, deprecated boolean")
    e = frame(spark, [("a", "b"), ("a", "b")], "parent_uuid string, child_uuid string")
    p = frame(spark, [("", "core", "x")], "namespace string, domain string, path string")
    assert {(r.rule, r.key, r.n) for r in violations(m, e, p).collect()} == {("active memory", "n", 2), ("edge", "a|b", 2)}


WRITES = "tbl string, pk string, seq int, before string, after string, node_uuid string"


def test_recording(spark):
    w = frame(spark, [("memories", "1", 1, None, "a", "n"), ("memories", "1", 2, "a", None, "n"), ("memories", "2", 1, "x", "y", "n"), ("memories", "2", 3, "y", "z", "n"), ("nodes", "n", 1, None, "n", "n")], WRITES)
    rec = changes.recorded(w)
    assert {(r.row_key, r.before, r.after) for r in changes.changed(rec).collect()} == {("memories:2", "x", "z"), ("nodes:n", None, "n")}
    g = changes.groups(changes.changed(rec)).first()
    assert (g.top_table, g.action, g.row_count) == ("nodes", "created", 2)
    state = frame(spark, [("memories:2", "z"), ("nodes:n", "n"), ("k", "v")], "row_key string, image string")
    assert {tuple(r) for r in changes.reverted(state, rec).collect()} == {("memories:2", "x"), ("k", "v")}


def test_ranking_prefers_all_tokens(spark):
    d = frame(spark, [(1, "a", "alpha beta", 0), (2, "b", "alpha alpha alpha", 0), (3, "c", "gamma", 0), (4, "d", "Résumé alpha", 0)], "doc_id long, path string, content string, priority int")
    d = d.select("*", F.concat(F.lit("core://"), "path").alias("uri"), F.concat(F.lit("n"), "path").alias("node_uuid"))
    docs = S.search_documents(d, frame(spark, [], "node_uuid string, keyword string"))
    got = S.search(docs, frame(spark, [(1, "alpha beta"), (2, "resume")], "query_id int, query string")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r["pass"]) for r in got][0] == (1, 1, 0)
    assert [r.doc_id for r in got if r.query_id == 2] == [4]


def test_scan_finds_overlaps(spark):
    d = frame(spark, [(1, "abcabc"), (2, None), (3, "x")], "doc_id long, content string")
    assert {(r.doc_id, r.keyword, r.hits) for r in S.scan(d, ["ab", "bc", "abca"]).collect()} == {(1, "ab", 2), (1, "bc", 2), (1, "abca", 1)}
    assert S.scan(d, []).count() == 0


def test_glossary_stays_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 2)
    d = frame(spark, [(1, "abcabc é"), (2, None), (3, "x")], "doc_id long, content string")
    g = frame(spark, [(k,) for k in ("ab", "bc", "abca", "é", "ab", "", "zz", None)], "keyword string")
    with monkeypatch.context() as m:
        m.setattr(type(d), "collect", lambda self: pytest.fail("keywords went to the driver"))
        hits = S.glossary_hits(d, g)
    assert sorted((r.doc_id, r.keyword, r.hits) for r in hits.collect()) == [(1, "ab", 2), (1, "abca", 1), (1, "bc", 2), (1, "é", 1)]


def test_numbers_come_from_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select(F.format_string("n%04d", F.col("id") * 7 % 1000).alias("node_uuid")).repartition(5)
        got = mutations.numbered(df, frame(spark, [(41,), (7,)], "new_id long"), "new_id", "node_uuid").withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.new_id for r in sorted(got, key=lambda r: r.node_uuid)] == list(range(42, 1042))
    assert len({r.p for r in got}) > 1


def test_patch():
    assert patched("say “hi” now", 'say "hi"', "X") == "X now"
    assert patched("a  b\r\nc", "a b\nc", "d\ne") == "d\r\ne"
    assert patched("x x", "x", "y") is None and patched("abc", "q", "y") is None and patched(None, "a", "b") is None
    assert flat("é f")[0] == "é f"


def test_markdown_and_cards(spark, tmp_path):
    s = frame(spark, [("core://a", 3, "when a", "text\n\nmore"), ("core://a/b", 5, None, "x")], "uri string, priority int, disclosure string, content string")
    files.write_markdown(s, f"file://{tmp_path}/md")
    assert sorted(map(tuple, files.read_markdown(spark, f"file://{tmp_path}/md").collect()), key=str) == sorted(map(tuple, s.collect()), key=str)
    import base64
    import json

    body = b"chara\0" + base64.b64encode(json.dumps({"data": {"name": "A b", "description": "d", "scenario": " "}}).encode())
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", len(body), b"tEXt") + body + b"\0\0\0\0")
    rows = files.card_memories(files.read_cards(spark, f"file://{tmp_path}/c.png")).collect()
    assert [tuple(r) for r in rows] == [("A_b", "profile", 4, "d")]


def test_snapshots(spark, tmp_path):
    files.save({"t": spark.range(3)}, f"file://{tmp_path}/s", 1)
    files.save({"t": spark.range(5)}, f"file://{tmp_path}/s", 2)
    assert files.load(spark, f"file://{tmp_path}/s")["t"].count() == 5
    assert files.load(spark, f"file://{tmp_path}/s", 1)["t"].count() == 3


def test_streams_equal_batches(spark, sf, tmp_path):
    from loamgraph.fixtures import graph

    g = graph(spark, sf)
    g.logs.write.parquet(f"{tmp_path}/logs")
    g.changes.write.parquet(f"{tmp_path}/writes")
    for name, src, make, batch in (
        ("seen", "logs", access.last_access, lambda: g.logs.groupBy("node_uuid").agg(F.max("accessed_at").cast("timestamp").alias("last"), F.count("*").alias("n"))),
        ("kept", "writes", access.recorded, lambda: changes.recorded(g.changes).select("row_key", "before", "after")),
    ):
        live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{src}").schema).parquet(f"{tmp_path}/{src}")
        q = make(live).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, batch().collect()))


def test_occurrences_against_brute_force(spark):
    """Leftmost, then longest, no overlaps; each keyword's own hits are found one after the other."""
    import random

    from loamgraph.functions.udfs import occurrences

    r = random.Random(3)
    rows = [("".join(r.choice("ab") for _ in range(r.randint(0, 30))), sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(4)})) for _ in range(60)] + [("", ["a"]), (None, ["a"]), ("aa", None)]
    df = spark.createDataFrame(rows, "t string, k array<string>")
    for x in df.select("t", "k", occurrences("t", "k").alias("got")).collect():
        hits = []
        for w in x.k or ():
            at = 0
            while x.t and at + len(w) <= len(x.t):
                if x.t[at : at + len(w)] == w:
                    hits.append((at, w))
                    at += len(w)
                else:
                    at += 1
        want, end = [], 0
        for at, w in sorted(hits, key=lambda h: (h[0], -len(h[1]))):
            if at >= end:
                want.append((at, w))
                end = at + len(w)
        assert [(g.start, g.keyword) for g in x.got] == want
