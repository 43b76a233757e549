"""Hand-made cases of the relay, upkeep and cover-density operators."""

from pyspark.sql import functions as F

from loamgraph.operators import relays as R
from loamgraph.operators import search as S
from loamgraph.operators import upkeep as U


def test_covers_by_hand(spark):
    docs = spark.createDataFrame([(1, "a x b", 0), (2, "a b a", 0), (3, "a a", 0), (4, None, 0), (5, "", 0)], "doc_id long, content string, priority int")
    for c in ("path", "uri", "disclosure", "terms"):
        docs = docs.withColumn(c, F.lit(""))
    got = S.cover_search(docs, spark.createDataFrame([(1, "a b"), (2, "")], "query_id int, query string")).collect()
    # 2: "a b" and "b a"; 1: one cover with a strange word; 3: two places of one token
    assert sorted((r["rank"], r["pass"], r.doc_id, r.score) for r in got) == [(1, 0, 2, 0.2), (2, 0, 1, 0.05), (3, 1, 3, 0.2)]
    assert S.cover_search(docs.limit(0), spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0


def test_refresh_equals_a_new_index(spark):
    cols = "doc_id long, content string"
    old = spark.createDataFrame([(1, "one two"), (2, "two"), (3, "three")], cols)
    new = spark.createDataFrame([(1, "one four four"), (3, "three"), (4, "two")], cols)
    full = lambda d: d.select("*", *[F.lit("").alias(c) for c in ("path", "uri", "disclosure", "terms")])
    asked = spark.createDataFrame([(1,), (2,), (4,), (4,)], "doc_id long")
    for got, want in zip(S.refreshed(S.postings(full(old)), full(new), asked), S.postings(full(new)), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_line_edits(spark):
    rows = [("a\nb", "set", 2), ("a\nb", "set", 3), ("a\nb", "delete", 1), ("a", "insert", 0), ("a", "insert", 1), ("a \n", "append", 0), (None, "set", 1), ("", "delete", 1)]
    df = spark.createDataFrame(rows, "c string, op string, line int")
    got = [r.x for r in df.select(U.line_edit(F.col("c"), F.col("op"), F.col("line"), F.lit("N")).alias("x")).collect()]
    assert got == ["a\nN", "a\nb", "b", "N\na", "a\nN", "a\n\nN", None, ""]


def test_draws_follow_the_weights(spark):
    n = 3000
    groups = spark.range(n).select(F.col("id").cast("string").alias("k"))
    names = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("weight")) for x, w in (("a", 1.0), ("b", 3.0), ("c", 0.0))]))
    w = groups.select("k", names.alias("s")).select("k", F.concat("k", F.lit("-"), "s.x").alias("node_uuid"), "s.weight")
    got = U.draw(w, w.select("k", "node_uuid", F.col("node_uuid").alias("uri")), "seed", "k").collect()
    share = sum(r.uri.endswith("b") for r in got) / n
    assert len(got) == n and abs(share - 0.75) < 0.03 and not any(r.uri.endswith("c") for r in got)


def test_migrations_run_once_and_in_order(spark):
    mark = lambda x: lambda t: {"t": t["t"].withColumn("s", F.concat("s", F.lit(x)))}
    tables, done = U.migrate({"t": spark.createDataFrame([("",)], "s string")}, {"02"}, {"03": mark("c"), "01": mark("a"), "02": mark("b")})
    assert done == ["01", "03"] and tables["t"].first().s == "ac"


def test_preset_requests(spark):
    p = spark.createDataFrame([(1, "x", "{}", True), (2, "y", "{}", False)], "id long, name string, boot_uris string, is_active boolean")
    rows = [(1, "create", None, "x"), (2, "create", None, "z"), (3, "duplicate", 1, "z"), (4, "delete", 1, None), (5, "delete", 2, None), (6, "delete", 9, None), (7, "update", 1, "x")]
    got = U.preset_requests(p, spark.createDataFrame(rows, "seq long, op string, id long, name string"))
    assert [r.status for r in got.orderBy("seq").collect()] == ["taken", "ok", "taken", "active", "ok", "unknown", "ok"]
    assert sorted((r.id, r.name) for r in U.presets_after(p, got).collect()) == [(1, "x"), (3, "z")]


def test_relays_and_empty_tables(spark):
    d = "edge_id string, viewer string, target string, version long, from_state string, to_state string, relation string, content string, inheritable boolean"
    e = "edge_id string, parent string, part int, from_id string, to_id string"
    directs = spark.createDataFrame([("d", "a", "b", 1, "a_v1", "b_v1", "r", "", True), ("d", "a", "b", 2, "a_v2", "b_v1", "r", "", False)], d)
    parts = spark.createDataFrame([("x", "d", 1, "a_v2", "q"), ("x", "d", 2, "q", "b_v1"), ("y", "d", 1, "a_v1", "p"), ("y", "d", 2, "p", "b_v1"), ("z", "no", 1, "a_v2", "o"), ("z", "no", 2, "o", "b_v1")], e)
    assert [(r.version, r.relay) for r in R.relations(directs, parts).collect()] == [(2, "q")]
    assert [(r.version, r.relay) for r in R.relations(directs, parts.limit(0)).collect()] == [(2, None)]
    assert R.relations(directs.limit(0), parts).count() == 0
    gone = {(r.edge_id, r.parts, r.status) for r in R.delete(parts, spark.createDataFrame([("x",), ("n",), ("x",)], "edge_id string")).collect()}
    assert gone == {("x", 2, "deleted"), ("n", 0, "not found")}
