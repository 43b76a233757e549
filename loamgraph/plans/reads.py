"""Lookups, joins, aggregations, rankings and set operations over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF, stamp
from ..functions import text as T
from ..operators import reads as R
from ..operators import recursive as C
from ..registry import query

_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def day(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("i1_scan", "SELECT id, node_uuid, content, deprecated, migrated_to, world_timestamp FROM memories")
def i1(g):
    return g.memories.select("id", "node_uuid", "content", "deprecated", "migrated_to", "world_timestamp")


@query("q1_resolve", """, req AS (SELECT namespace, domain, path FROM paths UNION ALL SELECT '', 'core', '' UNION ALL SELECT '', 'core', 'no/such'),
hit AS (SELECT *, row_number() OVER (PARTITION BY namespace, domain, path ORDER BY m_created DESC, memory_id DESC) AS rk FROM star),
n AS (SELECT namespace, node_uuid, count(*) AS n FROM paths GROUP BY ALL)
SELECT r.namespace, r.domain, r.path, CASE WHEN h.memory_id IS NULL THEN 'ROOT' ELSE h.node_uuid END AS node_uuid, coalesce(h.memory_id, 0) AS memory_id,
  CASE WHEN h.memory_id IS NULL THEN 'Root node for domain ''' || r.domain || '''.' ELSE h.content END AS content, h.priority, h.disclosure,
  greatest(coalesce(n.n, 1) - 1, 0) AS alias_count
FROM req r LEFT JOIN hit h ON h.namespace = r.namespace AND h.domain = r.domain AND h.path = r.path AND h.rk = 1
LEFT JOIN n ON n.namespace = r.namespace AND n.node_uuid = h.node_uuid WHERE h.memory_id IS NOT NULL OR r.path = ''""")
def q1(g):
    asked = g.paths.select("namespace", "domain", "path").unionAll(g.spark.createDataFrame([("", "core", ""), ("", "core", "no/such")], "namespace string, domain string, path string"))
    return R.resolve(g.star, g.paths, asked)


@query("q2_resolve_path", "SELECT p.namespace, p.domain, p.path, e.id AS edge_id, e.child_uuid FROM paths p JOIN edges e ON p.edge_id = e.id")
def q2(g):
    return g.paths.join(g.edges, F.col("edge_id") == F.col("id")).select("namespace", "domain", "path", "edge_id", "child_uuid")


@query("q3_node_paths", "SELECT node_uuid, domain, path, namespace, domain || '://' || path AS uri FROM paths")
def q3(g):
    return g.paths.select("node_uuid", "domain", "path", "namespace", T.uri_of(F.col("domain"), F.col("path")).alias("uri"))


@query("q4_node_memory", """SELECT a.node_uuid, a.id, a.content, coalesce(string_agg(p.domain || '://' || p.path, '|' ORDER BY p.namespace, p.domain, p.path), '') AS uris
FROM active a LEFT JOIN paths p ON p.node_uuid = a.node_uuid GROUP BY ALL""")
def q4(g):
    p = g.paths.select(F.col("node_uuid").alias("n"), F.struct("namespace", "domain", "path").alias("at"))
    got = g.active.join(p, F.col("node_uuid") == F.col("n"), "left").groupBy("node_uuid", "id", "content").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return got.select("node_uuid", "id", "content", F.array_join(F.transform("at", lambda x: T.uri_of(x["domain"], x["path"])), "|").alias("uris"))


CHILDREN = """, ask AS (SELECT 'ROOT' AS parent_uuid, '' AS namespace, 'core' AS cd, '' AS cp UNION ALL SELECT node_uuid, namespace, domain, path FROM paths WHERE node_uuid LIKE 'n-%' OR node_uuid LIKE 'r-%'),
fe AS (SELECT e.*, a.id AS memory_id, a.content, row_number() OVER (PARTITION BY parent_uuid, child_uuid ORDER BY priority NULLS FIRST, name, e.id) AS rk FROM edges e JOIN active a ON a.node_uuid = e.child_uuid),
c1 AS (SELECT k.*, f.child_uuid, f.name, f.priority, f.disclosure, f.memory_id, f.content, p.domain, p.path,
   CASE WHEN p.domain = k.cd AND starts_with(p.path, k.cp || '/') THEN 1 WHEN p.domain = k.cd THEN 2 ELSE 3 END AS tier
   FROM ask k JOIN fe f ON f.parent_uuid = k.parent_uuid AND f.rk = 1 JOIN paths p ON p.edge_id = f.id AND p.namespace = k.namespace WHERE k.parent_uuid <> 'ROOT' OR p.domain = k.cd),
c2 AS (SELECT *, row_number() OVER (PARTITION BY parent_uuid, namespace, cd, cp, child_uuid ORDER BY tier, domain, path) AS rk FROM c1),
bel AS (SELECT e.parent_uuid, p.namespace, count(DISTINCT e.id) AS n FROM edges e JOIN paths p ON p.edge_id = e.id GROUP BY ALL),
kids AS (SELECT c2.parent_uuid, c2.namespace, child_uuid, domain, path, name, priority, disclosure, memory_id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS snippet, coalesce(b.n, 0) AS approx_children_count
FROM c2 LEFT JOIN bel b ON b.parent_uuid = c2.child_uuid AND b.namespace = c2.namespace WHERE rk = 1)
"""


def asked_parents(g):
    at = g.paths.where("node_uuid like 'n-%' or node_uuid like 'r-%'").select("node_uuid", "namespace", "domain", "path")
    return at.unionAll(g.spark.createDataFrame([("ROOT", "", "core", "")], at.schema))


@query("q5_children", CHILDREN + "SELECT * FROM kids")
def q5(g):
    return R.children(g.edges, g.paths, g.active, asked_parents(g))


@query("q5_children_all", CHILDREN.replace(" WHERE node_uuid LIKE 'n-%' OR node_uuid LIKE 'r-%')", ")") + "SELECT * FROM kids")
def q5_all(g):
    at = g.paths.select("node_uuid", "namespace", "domain", "path")
    return R.children(g.edges, g.paths, g.active, at.unionAll(g.spark.createDataFrame([("ROOT", "", "core", "")], at.schema)))


@query("q6_all_paths", "SELECT namespace, domain, path, regexp_extract(path, '[^/]*$') AS name, node_uuid, memory_id, priority, disclosure FROM star")
def q6(g):
    return g.star.select("namespace", "domain", "path", T.last_segment(F.col("path")).alias("name"), "node_uuid", "memory_id", "priority", "disclosure").dropDuplicates(["namespace", "domain", "path"])


RECENT = """, one AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY namespace, domain, path) AS rk FROM star)
SELECT memory_id, node_uuid, domain || '://' || path AS uri, strftime(m_created, '%Y-%m-%d %H:%M') AS created FROM one WHERE rk = 1 {} ORDER BY m_created DESC, memory_id LIMIT {}"""


def recent(g, limit, where="true"):
    return R.recent(g.star.where(where), limit).select("memory_id", "node_uuid", T.uri_of(F.col("domain"), F.col("path")).alias("uri"), F.date_format("m_created", "yyyy-MM-dd HH:mm").alias("created"))


@query("q7_recent", RECENT.format("", 10))
def q7(g):
    return recent(g, 10)


@query("v4_recent_view", RECENT.format("", 50))
def v4(g):
    return recent(g, 50)


@query("v12_recent_in_domain", RECENT.replace("FROM star)", "FROM star WHERE domain = 'urgent')").format("", 20))
def v12(g):
    return recent(g, 20, "domain = 'urgent'")


@query("q8_memory_by_id", """SELECT m.id, m.deprecated, coalesce(string_agg(DISTINCT p.domain || '://' || p.path, '|' ORDER BY p.domain || '://' || p.path), '') AS uris FROM memories m LEFT JOIN paths p ON p.node_uuid = m.node_uuid GROUP BY ALL""")
def q8(g):
    p = g.paths.select(F.col("node_uuid").alias("n"), T.uri_of(F.col("domain"), F.col("path")).alias("uri"))
    return g.memories.join(p, F.col("node_uuid") == F.col("n"), "left").groupBy("id", "deprecated").agg(F.array_join(F.array_sort(F.collect_set("uri")), "|").alias("uris"))


@query("q9_deprecated", f"SELECT id, node_uuid, migrated_to, {_STAMP.format('created_at')} AS created, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet FROM memories WHERE deprecated")
def q9(g):
    return g.memories.where("deprecated").select("id", "node_uuid", "migrated_to", day("created_at").alias("created"), T.snippet(F.col("content"), 200).alias("snippet"))


CHAIN = """, chain AS (SELECT id AS start, id, migrated_to, 0 AS hop FROM memories UNION ALL SELECT c.start, m.id, m.migrated_to, c.hop + 1 FROM chain c JOIN memories m ON m.id = c.migrated_to WHERE c.hop < 50),
fin AS (SELECT start AS id, id AS target, hop FROM chain WHERE migrated_to IS NULL)
"""


@query("q12_chain", CHAIN + "SELECT id, target, CAST(hop AS BIGINT) AS hop FROM fin")
def q12(g):
    return C.ends(g.memories.select("id", F.col("migrated_to").alias("next")))


@query("q10_orphans", CHAIN + """SELECT m.id, m.node_uuid, CASE WHEN m.migrated_to IS NOT NULL THEN 'deprecated' ELSE 'orphaned' END AS category, f.target, t.content AS target_content
FROM memories m LEFT JOIN fin f ON f.id = m.id AND m.migrated_to IS NOT NULL LEFT JOIN memories t ON t.id = f.target WHERE m.deprecated""")
def q10(g):
    m = g.memories
    end = C.ends(m.select("id", F.col("migrated_to").alias("next"))).where("hop > 0").select(F.col("id").alias("i"), "target")
    t = m.select(F.col("id").alias("t"), F.col("content").alias("target_content"))
    got = m.where("deprecated").join(end, F.col("id") == F.col("i"), "left").join(t, F.col("target") == F.col("t"), "left")
    return got.select("id", "node_uuid", F.when(F.col("migrated_to").isNotNull(), "deprecated").otherwise("orphaned").alias("category"), "target", "target_content")


@query("q11_orphan_detail", CHAIN + """SELECT m.id, CASE WHEN NOT m.deprecated THEN 'active' WHEN m.migrated_to IS NOT NULL THEN 'deprecated' ELSE 'orphaned' END AS category, m.content, t.content AS target_content
FROM memories m LEFT JOIN fin f ON f.id = m.id AND m.migrated_to IS NOT NULL LEFT JOIN memories t ON t.id = f.target""")
def q11(g):
    m = g.memories
    end = C.ends(m.select("id", F.col("migrated_to").alias("next"))).where("hop > 0").select(F.col("id").alias("i"), "target")
    t = m.select(F.col("id").alias("t"), F.col("content").alias("target_content"))
    kind = F.when(~F.col("deprecated"), "active").when(F.col("migrated_to").isNotNull(), "deprecated").otherwise("orphaned")
    return m.join(end, F.col("id") == F.col("i"), "left").join(t, F.col("target") == F.col("t"), "left").select("id", kind.alias("category"), "content", "target_content")


@query("q13_namespaces", "SELECT DISTINCT namespace FROM paths")
def q13(g):
    return g.paths.select("namespace").distinct()


DOMAINS = ("core", "writer", "game", "notes", "project")


@query("q14_domains", f""", conf AS (SELECT unnest({list(DOMAINS)}) AS domain), db AS (SELECT domain, count(DISTINCT CASE WHEN NOT contains(path, '/') THEN path END) AS n FROM paths WHERE namespace = '' GROUP BY domain)
SELECT coalesce(c.domain, d.domain) AS domain, coalesce(d.n, 0) AS root_count, c.domain IS NOT NULL AS configured FROM conf c FULL JOIN db d ON c.domain = d.domain""")
def q14(g):
    conf = g.spark.createDataFrame([(d,) for d in DOMAINS], "domain string").withColumn("configured", F.lit(True))
    db = g.paths.where("namespace = ''").groupBy("domain").agg(F.countDistinct(F.when(~F.col("path").contains("/"), F.col("path"))).alias("root_count"))
    return conf.join(db, "domain", "full").select("domain", F.coalesce("root_count", F.lit(0)).alias("root_count"), F.coalesce("configured", F.lit(False)).alias("configured"))


@query("q15_browse", CHILDREN + """, al AS (SELECT p.namespace, p.node_uuid, string_agg(domain || '://' || path, '|' ORDER BY domain, path) AS a, count(*) AS n FROM paths p GROUP BY ALL)
SELECT s.namespace, s.domain, s.path, s.memory_id, al.n - 1 AS aliases, (SELECT count(*) FROM kids k JOIN ask ON k.parent_uuid = ask.parent_uuid AND k.namespace = ask.namespace WHERE ask.parent_uuid = s.node_uuid AND ask.namespace = s.namespace AND ask.cd = s.domain AND ask.cp = s.path AND k.domain = s.domain) AS kids
FROM star s JOIN al ON al.namespace = s.namespace AND al.node_uuid = s.node_uuid WHERE s.node_uuid LIKE 'n-%' OR s.node_uuid LIKE 'r-%'""")
def q15(g):
    ask = asked_parents(g).where("node_uuid <> 'ROOT'")
    kids = R.children(g.edges, g.paths, g.active, ask).where("path <> ''").groupBy(F.col("parent_uuid").alias("node_uuid"), "namespace", "domain").agg(F.count("*").alias("kids"))
    many = g.paths.groupBy("namespace", "node_uuid").agg((F.count("*") - 1).alias("aliases"))
    at = g.star.where("node_uuid like 'n-%' or node_uuid like 'r-%'").select("namespace", "domain", "path", "node_uuid", "memory_id")
    return at.join(many, ["namespace", "node_uuid"]).join(kids, ["node_uuid", "namespace", "domain"], "left").select("namespace", "domain", "path", "memory_id", "aliases", F.coalesce("kids", F.lit(0)).alias("kids"))


def whole(sql: str) -> str:
    """The same SQL, asking for every path's node."""
    return sql.replace(" WHERE node_uuid LIKE 'n-%' OR node_uuid LIKE 'r-%')", ")")


@query("q15_browse_all", whole(CHILDREN) + """, al AS (SELECT p.namespace, p.node_uuid, count(*) AS n FROM paths p GROUP BY ALL),
kn AS (SELECT parent_uuid, namespace, cd, cp, count(*) AS n FROM c2 WHERE rk = 1 AND domain = cd GROUP BY ALL)
SELECT s.namespace, s.domain, s.path, s.memory_id, al.n - 1 AS aliases, coalesce(kn.n, 0) AS kids FROM star s JOIN al ON al.namespace = s.namespace AND al.node_uuid = s.node_uuid
LEFT JOIN kn ON kn.parent_uuid = s.node_uuid AND kn.namespace = s.namespace AND kn.cd = s.domain AND kn.cp = s.path""")
def q15_all(g):
    ask = g.paths.select("node_uuid", "namespace", "domain", "path")
    many = g.paths.groupBy("namespace", "node_uuid").agg((F.count("*") - 1).alias("aliases"))
    kids = R.children_of(g.edges, g.paths, g.active, ask).where("domain = ctx_domain").groupBy(F.col("parent_uuid").alias("node_uuid"), "namespace", F.col("ctx_domain").alias("domain"), F.col("ctx_path").alias("path")).agg(F.count("*").alias("kids"))
    at = g.star.select("namespace", "domain", "path", "node_uuid", "memory_id")
    return at.join(many, ["namespace", "node_uuid"]).join(kids, ["node_uuid", "namespace", "domain", "path"], "left").select("namespace", "domain", "path", "memory_id", "aliases", F.coalesce("kids", F.lit(0)).alias("kids"))


@query("v8_three_children_all", whole(CHILDREN) + "SELECT parent_uuid, namespace, child_uuid FROM (SELECT *, row_number() OVER (PARTITION BY parent_uuid, namespace, cd, cp ORDER BY priority NULLS FIRST, path) AS rk3 FROM c2 WHERE rk = 1) WHERE rk3 <= 3")
def v8_all(g):
    from pyspark.sql import Window

    w = Window.partitionBy("parent_uuid", "namespace", "ctx_domain", "ctx_path").orderBy(F.col("priority").asc_nulls_first(), "path")
    ask = g.paths.select("node_uuid", "namespace", "domain", "path")
    ask = ask.unionAll(g.spark.createDataFrame([("ROOT", "", "core", "")], ask.schema))
    return R.children_of(g.edges, g.paths, g.active, ask).withColumn("k", F.row_number().over(w)).where("k <= 3").select("parent_uuid", "namespace", "child_uuid")


@query("q15b_breadcrumbs", """, p AS (SELECT namespace, domain, path, string_split(path, '/') AS parts FROM paths), i AS (SELECT *, unnest(generate_series(1, len(parts))) AS k FROM p)
SELECT namespace, domain, path, k AS level, array_to_string(parts[1:k], '/') AS crumb FROM i""")
def q15b(g):
    return g.paths.select("namespace", "domain", "path", F.posexplode(R.breadcrumbs(F.col("path")))).select("namespace", "domain", "path", (F.col("pos") + 1).cast("long").alias("level"), F.col("col").alias("crumb"))


@query("q16_subtree", "SELECT namespace, path, node_uuid FROM paths WHERE domain = 'core' AND (path = 'ASIA' OR starts_with(path, 'ASIA/'))")
def q16(g):
    return R.subtree(g.paths, "core", "ASIA").select("namespace", "path", "node_uuid")


@query("q17_escape_like", r"SELECT item_id, replace(replace(replace(text || '%_\', '\', '\\'), '%', '\%'), '_', '\_') AS escaped FROM benchmark")
def q17(g):
    return g.table("benchmark").select("item_id", T.escape_like(F.concat("text", F.lit("%_\\"))).alias("escaped"))


@query("q18_log_stats", "SELECT count(*) AS n, strftime(min(accessed_at), '%Y-%m-%d %H:%M:%S') AS first FROM logs")
def q18(g):
    return g.logs.agg(F.count("*").alias("n"), day(F.min("accessed_at")).alias("first"))


@query("q21_tree", """, t AS (SELECT 'ROOT' AS node, '' AS path, 0 AS depth UNION ALL SELECT e.child_uuid, CASE WHEN t.path = '' THEN e.name ELSE t.path || '/' || e.name END, t.depth + 1 FROM t JOIN edges e ON e.parent_uuid = t.node WHERE t.depth < 3 AND (e.parent_uuid <> 'ROOT' OR e.child_uuid LIKE 'r-%'))
SELECT node, path, depth FROM t WHERE depth > 0""")
def q21(g):
    e = g.edges.where("parent_uuid <> 'ROOT' or child_uuid like 'r-%'")
    start = g.spark.createDataFrame([("ROOT", None)], "node string, path string")
    return C.descend(e, start, 3).where("depth > 0")


@query("q23_deprecated_like", "SELECT id, content FROM memories WHERE deprecated AND contains(lower(content), lower('PART 1'))")
def q23(g):
    return g.memories.where(F.col("deprecated") & F.lower("content").contains("part 1")).select("id", "content")


@query("q25_serialize", """SELECT id, '{"id":' || id || ',"node_uuid":"' || node_uuid || '","deprecated":' || CAST(deprecated AS VARCHAR) || CASE WHEN migrated_to IS NULL THEN '' ELSE ',"migrated_to":' || migrated_to END || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '"}' AS pointer FROM memories""")
def q25(g):
    made = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")
    return g.memories.select("id", F.to_json(F.struct("id", "node_uuid", "deprecated", "migrated_to", made)).alias("pointer"))


@query("j2_four_way", "SELECT s.namespace, s.domain, s.path, s.memory_id, strftime(n.last_accessed_at, '%Y-%m-%d %H:%M:%S') AS last FROM star s JOIN nodes n ON n.uuid = s.node_uuid")
def j2(g):
    return g.star.join(g.nodes, F.col("node_uuid") == F.col("uuid")).select("namespace", "domain", "path", "memory_id", day("last_accessed_at").alias("last"))


@query("j3_left_on", "SELECT e.id, p.path, a.id AS memory_id FROM edges e LEFT JOIN paths p ON p.edge_id = e.id AND p.namespace = 'ns_building' LEFT JOIN active a ON a.node_uuid = e.child_uuid")
def j3(g):
    p = g.paths.where("namespace = 'ns_building'").select("edge_id", "path")
    a = g.active.select(F.col("id").alias("memory_id"), "node_uuid")
    return g.edges.join(p, F.col("id") == F.col("edge_id"), "left").join(a, F.col("child_uuid") == F.col("node_uuid"), "left").select("id", "path", "memory_id")


@query("j6_anti", "SELECT uuid FROM nodes WHERE uuid NOT IN (SELECT node_uuid FROM active)")
def j6(g):
    return g.nodes.join(g.active.select("node_uuid"), F.col("uuid") == F.col("node_uuid"), "left_anti").select("uuid")


@query("j8_semi", "SELECT uuid FROM nodes WHERE uuid IN (SELECT node_uuid FROM logs WHERE context = 'purchase')")
def j8(g):
    bought = g.logs.where("context = 'purchase'").select("node_uuid")
    return g.nodes.join(bought, F.col("uuid") == F.col("node_uuid"), "left_semi").select("uuid")


@query("a1_counts", """SELECT e.child_uuid, count(DISTINCT e.id) AS edges, count(*) FILTER (p.path IS NOT NULL) AS paths,
count(*) FILTER (p.namespace = '' AND NOT (p.domain = 'core' AND (p.path = 'ASIA' OR starts_with(p.path, 'ASIA/')))) AS outside FROM edges e LEFT JOIN paths p ON p.edge_id = e.id GROUP BY 1""")
def a1(g):
    p = g.paths.select("edge_id", "namespace", "domain", "path")
    inside = (F.col("domain") == "core") & ((F.col("path") == "ASIA") | F.col("path").startswith("ASIA/"))
    return g.edges.join(p, F.col("id") == F.col("edge_id"), "left").groupBy("child_uuid").agg(F.countDistinct("id").alias("edges"), F.count("path").alias("paths"), F.count(F.when((F.col("namespace") == "") & ~inside, 1)).alias("outside"))


@query("a2_out_degree", "SELECT parent_uuid, count(DISTINCT id) AS n FROM edges GROUP BY 1")
def a2(g):
    return g.edges.groupBy("parent_uuid").agg(F.countDistinct("id").alias("n"))


@query("a3_crowded", "SELECT parent_uuid, count(DISTINCT child_uuid) AS n FROM edges GROUP BY 1 HAVING count(DISTINCT child_uuid) > 10")
def a3(g):
    return g.edges.groupBy("parent_uuid").agg(F.countDistinct("child_uuid").alias("n")).where("n > 10")


@query("a4_tracking_start", f"SELECT strftime(coalesce(min(last_accessed_at), TIMESTAMP '{AS_OF}'), '%Y-%m-%d %H:%M:%S') AS start FROM nodes")
def a4(g):
    return g.nodes.agg(day(F.coalesce(F.min("last_accessed_at"), stamp(AS_OF))).alias("start"))


@query("a5_min_priority", "SELECT child_uuid, min(coalesce(priority, 2)) AS prio FROM edges GROUP BY 1")
def a5(g):
    return g.edges.groupBy("child_uuid").agg(F.min(F.coalesce("priority", F.lit(2))).alias("prio"))


@query("a6_fingerprint", "SELECT count(*) AS n, max(id) AS last FROM glossary")
def a6(g):
    return g.glossary.agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("a7_keywords", "SELECT node_uuid, string_agg(keyword, ' ' ORDER BY keyword) AS keywords FROM glossary GROUP BY 1")
def a7(g):
    return g.glossary.groupBy("node_uuid").agg(F.array_join(F.array_sort(F.collect_list("keyword")), " ").alias("keywords"))


@query("a8_many_versions", "SELECT node_uuid, count(*) AS n FROM memories GROUP BY 1 HAVING count(*) > 1")
def a8(g):
    return g.memories.groupBy("node_uuid").agg(F.count("*").alias("n")).where("n > 1")


@query("a9_uri_namespaces", "SELECT domain || '://' || path AS uri, string_agg(namespace, ',' ORDER BY namespace) AS namespaces FROM paths GROUP BY 1")
def a9(g):
    return g.paths.groupBy(T.uri_of(F.col("domain"), F.col("path")).alias("uri")).agg(F.array_join(F.array_sort(F.collect_list("namespace")), ",").alias("namespaces"))


@query("a10_degrees", "SELECT u AS node, count(DISTINCT CASE WHEN s = 'o' THEN id END) AS outgoing, count(DISTINCT CASE WHEN s = 'i' THEN id END) AS incoming FROM (SELECT id, parent_uuid AS u, 'o' AS s FROM edges UNION ALL SELECT id, child_uuid, 'i' FROM edges) GROUP BY 1")
def a10(g):
    both = g.edges.select(F.explode(F.array(F.struct("id", F.col("parent_uuid").alias("node"), F.lit("o").alias("s")), F.struct("id", F.col("child_uuid").alias("node"), F.lit("i").alias("s")))).alias("x")).select("x.*")
    return both.groupBy("node").agg(F.countDistinct(F.when(F.col("s") == "o", F.col("id"))).alias("outgoing"), F.countDistinct(F.when(F.col("s") == "i", F.col("id"))).alias("incoming"))


@query("a11_next_number", "SELECT parent_uuid, greatest(coalesce(max(TRY_CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT)), 0), 0) + 1 AS next FROM edges GROUP BY 1")
def a11(g):
    n = F.regexp_extract("name", r"(\d+)$", 1).try_cast("bigint")
    return g.edges.groupBy("parent_uuid").agg((F.greatest(F.coalesce(F.max(n), F.lit(0)), F.lit(0)) + 1).alias("next"))


@query("w1_latest", "SELECT node_uuid, id FROM (SELECT *, row_number() OVER (PARTITION BY node_uuid ORDER BY created_at DESC, id DESC) AS rk FROM active) WHERE rk = 1")
def w1(g):
    return R.first_by(g.active, ["node_uuid"], F.col("created_at").desc(), F.col("id").desc()).select("node_uuid", "id")


@query("w2_keep_newest", "SELECT id, node_uuid, row_number() OVER o > 1 AS deprecated, CASE WHEN row_number() OVER o > 1 THEN coalesce(migrated_to, first_value(id) OVER o) ELSE migrated_to END AS migrated_to FROM memories WINDOW o AS (PARTITION BY node_uuid ORDER BY created_at DESC, id DESC)")
def w2(g):
    from pyspark.sql import Window

    o = Window.partitionBy("node_uuid").orderBy(F.col("created_at").desc(), F.col("id").desc())
    old = F.row_number().over(o) > 1
    return g.memories.select("id", "node_uuid", old.alias("deprecated"), F.when(old, F.coalesce("migrated_to", F.first("id").over(o))).otherwise(F.col("migrated_to")).alias("migrated_to"))


PRIMARY = """, pr AS (SELECT *, row_number() OVER (PARTITION BY namespace, domain, node_uuid ORDER BY length(path) - length(replace(path, '/', '')), priority NULLS FIRST, length(path), path) AS rk FROM star)
"""


def primary(g):
    return R.first_by(g.star, ["namespace", "domain", "node_uuid"], T.depth(F.col("path")), F.col("priority").asc_nulls_first(), F.length("path"), "path")


@query("w4_primary_path", PRIMARY + "SELECT namespace, domain, node_uuid, path FROM pr WHERE rk = 1")
def w4(g):
    return primary(g).select("namespace", "domain", "node_uuid", "path")


@query("v3_index", PRIMARY + "SELECT namespace, domain, split_part(path, '/', 1) AS top, count(DISTINCT node_uuid) AS nodes FROM pr WHERE rk = 1 GROUP BY ALL")
def v3(g):
    return primary(g).groupBy("namespace", "domain", T.first_segment(F.col("path")).alias("top")).agg(F.countDistinct("node_uuid").alias("nodes"))


@query("w6_surviving_alias", "SELECT node_uuid, path FROM (SELECT *, row_number() OVER (PARTITION BY node_uuid ORDER BY CASE WHEN domain = 'core' THEN 0 ELSE 1 END, path, namespace) AS rk FROM paths) WHERE rk = 1")
def w6(g):
    return R.first_by(g.paths, ["node_uuid"], F.when(F.col("domain") == "core", 0).otherwise(1), "path", "namespace").select("node_uuid", "path")


@query("w7_max_candidate", "SELECT node_uuid, max(id) AS id FROM memories WHERE deprecated GROUP BY 1")
def w7(g):
    return g.memories.where("deprecated").groupBy("node_uuid").agg(F.max("id").alias("id"))


@query("w10_world_time", "SELECT memory_id, path FROM star WHERE domain = 'urgent' ORDER BY coalesce(world_timestamp, '0000-00-00') DESC, memory_id LIMIT 25")
def w10(g):
    return g.star.where("domain = 'urgent'").orderBy(F.coalesce("world_timestamp", F.lit("0000-00-00")).desc(), "memory_id").limit(25).select("memory_id", "path")


@query("w12_orphan_groups", CHAIN + "SELECT f.target, count(*) AS n FROM memories m JOIN fin f ON f.id = m.id WHERE m.deprecated AND m.migrated_to IS NOT NULL GROUP BY 1")
def w12(g):
    end = C.ends(g.memories.select("id", F.col("migrated_to").alias("next"))).where("hop > 0")
    return end.groupBy("target").agg(F.count("*").alias("n"))


@query("u1_union_hits", "SELECT kind, id FROM (SELECT 'entity' AS kind, uuid AS id FROM nodes WHERE contains(uuid, '7') UNION ALL SELECT 'edge', CAST(id AS VARCHAR) FROM edges WHERE contains(name, '7'))")
def u1(g):
    a = g.nodes.where(F.col("uuid").contains("7")).select(F.lit("entity").alias("kind"), F.col("uuid").alias("id"))
    return a.unionAll(g.edges.where(F.col("name").contains("7")).select(F.lit("edge"), F.col("id").cast("string")))


@query("u3_created", "SELECT namespace, domain, path FROM paths WHERE namespace = '' EXCEPT SELECT '', domain, path FROM paths WHERE path LIKE 'ASIA%'")
def u3(g):
    gone = g.paths.where(F.col("path").startswith("ASIA")).select("domain", "path").distinct()
    return g.paths.where("namespace = ''").join(gone, ["domain", "path"], "left_anti").select("namespace", "domain", "path").distinct()


@query("v2_boot", """, boot AS (SELECT unnest(['core://ASIA', 'core://EUROPE', 'core://NOWHERE']) AS uri)
SELECT b.uri, s.memory_id, s.memory_id IS NOT NULL AS loaded FROM boot b LEFT JOIN star s ON s.namespace = '' AND s.domain || '://' || s.path = b.uri""")
def v2(g):
    boot = g.spark.createDataFrame([("core://ASIA",), ("core://EUROPE",), ("core://NOWHERE",)], "uri string").select("uri", T.domain_of(F.col("uri")).alias("domain"), T.path_of(F.col("uri")).alias("path"))
    s = g.star.where("namespace = ''").select("domain", "path", "memory_id")
    return boot.join(s, ["domain", "path"], "left").select("uri", "memory_id", F.col("memory_id").isNotNull().alias("loaded"))


@query("v7_recent_domain", "SELECT node_uuid, path, strftime(m_created, '%Y-%m-%d %H:%M') AS created FROM (SELECT *, row_number() OVER (PARTITION BY node_uuid ORDER BY domain, path) AS rk FROM star WHERE domain = 'core' AND namespace = '') WHERE rk = 1 ORDER BY m_created DESC, node_uuid LIMIT 5")
def v7(g):
    s = R.first_by(g.star.where("domain = 'core' and namespace = ''"), ["node_uuid"], "domain", "path")
    return s.orderBy(F.col("m_created").desc(), "node_uuid").limit(5).select("node_uuid", "path", F.date_format("m_created", "yyyy-MM-dd HH:mm").alias("created"))


@query("v8_three_children", CHILDREN + "SELECT parent_uuid, namespace, child_uuid FROM (SELECT *, row_number() OVER (PARTITION BY parent_uuid, namespace ORDER BY priority NULLS FIRST, path) AS rk3 FROM kids) WHERE rk3 <= 3")
def v8(g):
    from pyspark.sql import Window

    w = Window.partitionBy("parent_uuid", "namespace").orderBy(F.col("priority").asc_nulls_first(), "path")
    return R.children(g.edges, g.paths, g.active, asked_parents(g)).withColumn("k", F.row_number().over(w)).where("k <= 3").select("parent_uuid", "namespace", "child_uuid")


@query("i8_export", """, t AS (SELECT 'ROOT' AS node, '' AS path, 0 AS depth UNION ALL SELECT e.child_uuid, CASE WHEN t.path = '' THEN e.name ELSE t.path || '/' || e.name END, t.depth + 1 FROM t JOIN edges e ON e.parent_uuid = t.node WHERE t.depth < 4 AND (e.parent_uuid <> 'ROOT' OR e.child_uuid LIKE 'r-%'))
SELECT t.path, repeat('#', least(t.depth, 6)) || ' core://' || t.path || chr(10) || chr(10) || a.content AS text FROM t JOIN active a ON a.node_uuid = t.node WHERE t.depth > 0""")
def i8(g):
    e = g.edges.where("parent_uuid <> 'ROOT' or child_uuid like 'r-%'")
    tree = C.descend(e, g.spark.createDataFrame([("ROOT", None)], "node string, path string")).where("depth > 0")
    a = g.active.select("node_uuid", "content")
    head = F.concat(F.repeat(F.lit("#"), F.least("depth", F.lit(6))), F.lit(" core://"), "path", F.lit("\n\n"), "content")
    return tree.join(a, F.col("node") == F.col("node_uuid")).select("path", head.alias("text"))


@query("i14_sizes", "SELECT doc_id, CASE WHEN n < 1024 THEN format('{:.1f}', n / 1.0) || ' B' WHEN n < 1048576 THEN format('{:.1f}', n / 1024.0) || ' KB' ELSE format('{:.1f}', n / 1048576.0) || ' MB' END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")
def i14(g):
    return g.table("documents").select("doc_id", T.human_size(F.octet_length("text")).alias("size"))
