"""The older entity and state graph: customers as entities, their orders as versions, supplier links as edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query

LEGACY = """, ent AS (SELECT 'c-' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'faction' ELSE 'character' END AS kind, c_custkey % 11 = 0 AS hidden FROM customer),
sta AS (SELECT 'c-' || o_custkey AS entity_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, o_orderpriority AS name FROM orders),
sts AS (SELECT *, entity_id || '_v' || version AS id FROM sta),
rel AS (SELECT DISTINCT 'c-' || o_custkey AS a, 's-' || l_suppkey AS b, 'c-' || o_custkey || '__s-' || l_suppkey AS edge_id, max(o_orderkey) AS last FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
"""


def entities(g):
    return g.table("customer").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "faction").otherwise("character").alias("kind"), (F.col("c_custkey") % 11 == 0).alias("hidden"))


def states(g):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    s = g.table("orders").withColumn("version", F.row_number().over(w)).withColumn("entity_id", F.concat(F.lit("c-"), F.col("o_custkey").cast("string")))
    return s.select("entity_id", "o_orderkey", F.col("version").cast("long").alias("version"), F.col("o_orderpriority").alias("name"), F.concat("entity_id", F.lit("_v"), F.col("version").cast("string")).alias("id"))


def links(g):
    o = g.table("orders").select("o_orderkey", F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("a"))
    x = g.table("lineitem").select("l_orderkey", F.concat(F.lit("s-"), F.col("l_suppkey").cast("string")).alias("b")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("a", "b").agg(F.max("o_orderkey").alias("last")).select("a", "b", F.concat_ws("__", "a", "b").alias("edge_id"), "last")


@query("n2_next_version", LEGACY + "SELECT e.id, coalesce(max(s.version), 0) + 1 AS next FROM ent e LEFT JOIN sts s ON s.entity_id = e.id GROUP BY 1")
def n2(g):
    s = states(g).groupBy("entity_id").agg(F.max("version").alias("v"))
    return entities(g).join(s, F.col("id") == F.col("entity_id"), "left").select("id", (F.coalesce("v", F.lit(0)) + 1).alias("next"))


@query("n3_entity_info", LEGACY + "SELECT e.id, e.kind, count(DISTINCT s.id) AS versions, arg_max(s.name, s.version) AS latest, (SELECT count(*) FROM rel WHERE rel.a = e.id) AS relations FROM ent e LEFT JOIN sts s ON s.entity_id = e.id GROUP BY e.id, e.kind")
def n3(g):
    s = states(g).groupBy("entity_id").agg(F.count("*").alias("versions"), F.max_by("name", "version").alias("latest"))
    r = links(g).groupBy("a").agg(F.count("*").alias("relations"))
    got = entities(g).join(s, F.col("id") == F.col("entity_id"), "left").join(r, F.col("id") == F.col("a"), "left")
    return got.select("id", "kind", F.coalesce("versions", F.lit(0)).alias("versions"), "latest", F.coalesce("relations", F.lit(0)).alias("relations"))


@query("n5_delete_state", LEGACY + "SELECT id, entity_id, lag(id) OVER (PARTITION BY entity_id ORDER BY version) AS previous, version = max(version) OVER (PARTITION BY entity_id) AS current FROM sts WHERE version % 3 <> 0")
def n5(g):
    w = Window.partitionBy("entity_id").orderBy("version")
    return states(g).where("version % 3 <> 0").select("id", "entity_id", F.lag("id").over(w).alias("previous"), (F.col("version") == F.max("version").over(Window.partitionBy("entity_id"))).alias("current"))


@query("n6_deletable", LEGACY + "SELECT id FROM ent WHERE id NOT IN (SELECT entity_id FROM sts) AND id NOT IN (SELECT a FROM rel)")
def n6(g):
    e = entities(g).join(states(g).select("entity_id"), F.col("id") == F.col("entity_id"), "left_anti")
    return e.join(links(g).select("a"), F.col("id") == F.col("a"), "left_anti").select("id")


@query("n10_children", LEGACY + "SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM rel) WHERE k <= 5")
def n10(g):
    w = Window.partitionBy("a").orderBy("b")
    return links(g).withColumn("k", F.row_number().over(w)).where("k <= 5").select("a", "b")


@query("n10_children_50", LEGACY + "SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS k FROM rel) WHERE k <= 50")
def n10_50(g):
    w = Window.partitionBy("a").orderBy("b")
    return links(g).withColumn("k", F.row_number().over(w)).where("k <= 50").select("a", "b")


@query("n11_relation", LEGACY + ", l AS (SELECT entity_id, arg_max(id, version) AS state, max(version) AS v FROM sts GROUP BY 1) SELECT r.edge_id, l.state, l.v AS version FROM rel r JOIN l ON l.entity_id = r.a")
def n11(g):
    s = states(g).groupBy("entity_id").agg(F.max_by("id", "version").alias("state"), F.max("version").alias("version"))
    return links(g).join(s, F.col("a") == F.col("entity_id")).select("edge_id", "state", "version")


@query("n13_orphan_states", LEGACY + "SELECT s.id, s.version FROM sts s WHERE NOT EXISTS (SELECT 1 FROM rel r WHERE r.a = s.entity_id AND r.last = s.o_orderkey)")
def n13(g):
    used = links(g).select(F.col("a").alias("entity_id"), F.col("last").alias("o_orderkey"))
    return states(g).join(used, ["entity_id", "o_orderkey"], "left_anti").select("id", "version")


@query("n14_orphan_entities", LEGACY + "SELECT id FROM ent e WHERE NOT EXISTS (SELECT 1 FROM sts s WHERE s.entity_id = e.id) AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.a = e.id)")
def n14(g):
    return n6(g)


@query("n15_catalog", LEGACY + "SELECT e.id, e.kind, string_agg(r.b, ',' ORDER BY r.b) AS targets, count(r.b) AS n FROM ent e LEFT JOIN rel r ON r.a = e.id WHERE NOT e.hidden GROUP BY ALL")
def n15(g):
    r = links(g).groupBy("a").agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("targets"), F.count("*").alias("n"))
    return entities(g).where("not hidden").join(r, F.col("id") == F.col("a"), "left").select("id", "kind", "targets", F.coalesce("n", F.lit(0)).alias("n"))


@query("i13_legacy_paths", LEGACY + "SELECT id AS path, id AS node FROM ent UNION ALL SELECT a || '/' || b, edge_id FROM rel UNION ALL SELECT r.a || '/' || r.b || '/' || s.id, s.id FROM rel r JOIN sts s ON s.entity_id = r.a AND s.o_orderkey = r.last")
def i13(g):
    e, r, s = entities(g), links(g), states(g).select("entity_id", "o_orderkey", F.col("id").alias("state"))
    chapters = r.join(s, (F.col("a") == F.col("entity_id")) & (F.col("last") == F.col("o_orderkey")))
    return e.select(F.col("id").alias("path"), F.col("id").alias("node")).unionAll(r.select(F.concat_ws("/", "a", "b"), "edge_id")).unionAll(chapters.select(F.concat_ws("/", "a", "b", "state"), "state"))


_REQ = """, rq AS (SELECT id AS entity_id, kind, 'old' AS why FROM ent UNION ALL SELECT 'new-' || s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'planet' ELSE 'location' END, 'new' FROM supplier UNION ALL SELECT 'a__' || s_suppkey, 'character', 'bad' FROM supplier UNION ALL VALUES ('states', 'character', 'bad'))
"""


@query("n1_create_entity", LEGACY + _REQ + "SELECT entity_id, CASE WHEN why = 'bad' THEN 'bad id' WHEN kind NOT IN ('character', 'location', 'faction', 'event', 'item') THEN 'bad type' WHEN entity_id IN (SELECT id FROM ent) THEN 'exists' ELSE 'ok' END AS status, CASE WHEN why = 'new' AND kind <> 'planet' THEN entity_id || '_v1' END AS state_id FROM rq")
def n1(g):
    """New entities with their first version, or what forbids them: a reserved or ambiguous id, an unknown type, a known id."""
    s = F.col("s_suppkey")
    t = g.table("supplier")
    tag = lambda x: F.concat(F.lit(x), s.cast("string"))
    req = entities(g).select(F.col("id").alias("entity_id"), "kind").unionAll(t.select(tag("new-"), F.when(s % 4 == 0, "planet").otherwise("location"))).unionAll(t.select(tag("a__"), F.lit("character")))
    req = req.unionAll(g.spark.createDataFrame([("states", "character")], req.schema))
    known = entities(g).select(F.col("id").alias("entity_id"), F.lit(True).alias("known"))
    status = F.when(F.col("entity_id").contains("__") | (F.col("entity_id") == "states"), "bad id").when(~F.col("kind").isin("character", "location", "faction", "event", "item"), "bad type").when(F.col("known"), "exists").otherwise("ok")
    got = req.join(known, "entity_id", "left").withColumn("status", status)
    return got.select("entity_id", "status", F.when(F.col("status") == "ok", F.concat("entity_id", F.lit("_v1"))).alias("state_id"))


@query("n7_direct_edges", LEGACY + """, rq AS (SELECT a, b FROM rel WHERE last % 3 = 0 UNION SELECT a, a FROM rel UNION SELECT a, 'nobody' FROM rel UNION SELECT b.id, a.id FROM ent a JOIN ent b ON a.id <> b.id AND a.kind = 'faction' AND a.id = 'c-' || CAST(substr(b.id, 3) AS BIGINT) // 2),
nv AS (SELECT DISTINCT entity_id FROM sts UNION SELECT DISTINCT b FROM rel)
SELECT a, b, replace(a, '__', '_') || '__' || replace(b, '__', '_') AS edge_id, CASE WHEN a = b THEN 'self' WHEN a NOT IN (SELECT entity_id FROM nv) OR b NOT IN (SELECT entity_id FROM nv) THEN 'no entity' WHEN (a, b) IN (SELECT (a, b) FROM rel) THEN 'exists' ELSE 'ok' END AS status FROM rq""")
def n7(g):
    """Direct edges asked for between entities with a current version: one a pair, none to the entity itself."""
    r = links(g)
    f = entities(g).where("kind = 'faction'").select(F.col("id").alias("f"))
    half = entities(g).select("id", F.concat(F.lit("c-"), F.floor(F.substring("id", 3, 20).cast("long") / 2).cast("string")).alias("f")).join(f, "f").where("id <> f").select(F.col("id").alias("a"), F.col("f").alias("b"))
    req = r.where("last % 3 = 0").select("a", "b").unionAll(r.select("a", F.col("a"))).unionAll(r.select("a", F.lit("nobody"))).unionAll(half).distinct()
    now = states(g).select("entity_id").unionAll(r.select("b")).distinct()
    has = lambda c: now.select(F.col("entity_id").alias(c), F.lit(True).alias(f"has_{c}"))
    got = req.join(has("a"), "a", "left").join(has("b"), "b", "left").join(r.select("a", "b", F.lit(True).alias("there")), ["a", "b"], "left")
    status = F.when(F.col("a") == F.col("b"), "self").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "no entity").when(F.col("there"), "exists").otherwise("ok")
    return got.select("a", "b", T.edge_id(F.col("a"), F.col("b")).alias("edge_id"), status.alias("status"))
