"""Mutation queries: batches over the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF, stamp
from ..functions import text as T
from ..operators import mutations as M
from ..registry import query


@query("m1_create", """, req(seq, namespace, domain, parent_path, title, content, priority) AS (VALUES (1, '', 'core', 'ASIA', 'new', 'a', 1), (2, '', 'core', 'ASIA', 'new', 'b', 1), (3, '', 'core', '', 'ASIA', 'c', 0), (4, '', 'core', 'no/such', 'x', 'd', 0), (5, '', 'core', 'EUROPE', NULL, 'e', 2), (6, '', 'core', 'EUROPE', NULL, 'f', 2)),
g AS (SELECT r.*, CASE WHEN r.parent_path = '' THEN 'ROOT' ELSE p.node_uuid END AS parent_uuid FROM req r LEFT JOIN paths p ON p.namespace = r.namespace AND p.domain = r.domain AND p.path = r.parent_path),
n AS (SELECT g.*, coalesce(title, CAST(greatest(coalesce((SELECT max(TRY_CAST(name AS BIGINT)) FROM edges e WHERE e.parent_uuid = g.parent_uuid), 0), 0) + row_number() OVER (PARTITION BY namespace, parent_uuid, title IS NULL ORDER BY seq) AS VARCHAR)) AS name FROM g),
f AS (SELECT *, CASE WHEN parent_path = '' THEN name ELSE parent_path || '/' || name END AS path FROM n)
SELECT seq, namespace, domain, path, parent_uuid, name, content, priority, CASE WHEN parent_uuid IS NULL THEN 'no parent' WHEN EXISTS (SELECT 1 FROM paths p WHERE p.namespace = f.namespace AND p.domain = f.domain AND p.path = f.path) OR row_number() OVER (PARTITION BY namespace, domain, path ORDER BY seq) > 1 THEN 'taken' ELSE 'ok' END AS status FROM f""")
def m1(g):
    rows = [(1, "", "core", "ASIA", "new", "a", 1), (2, "", "core", "ASIA", "new", "b", 1), (3, "", "core", "", "ASIA", "c", 0), (4, "", "core", "no/such", "x", "d", 0), (5, "", "core", "EUROPE", None, "e", 2), (6, "", "core", "EUROPE", None, "f", 2)]
    req = g.spark.createDataFrame(rows, "seq int, namespace string, domain string, parent_path string, title string, content string, priority int")
    return M.create(g.paths, g.edges, g.memories, req)


@query("m2_update", """, top AS (SELECT max(id) AS t FROM memories), req AS (SELECT node_uuid, 'renewed ' || node_uuid AS content FROM active WHERE node_uuid LIKE 'o-%0'),
nw AS (SELECT a.*, r.content AS new_content, t + row_number() OVER (ORDER BY a.node_uuid) AS new_id FROM active a JOIN req r ON a.node_uuid = r.node_uuid, top)
SELECT id, node_uuid, content, true AS deprecated, new_id AS migrated_to, world_timestamp FROM nw UNION ALL SELECT new_id, node_uuid, new_content, false, NULL, world_timestamp FROM nw""")
def m2(g):
    req = g.active.where("node_uuid like 'o-%0'").select("node_uuid", F.concat(F.lit("renewed "), "node_uuid").alias("content"))
    return M.update_content(g.memories, req, stamp(AS_OF))


@query("m3_alias", """, st AS (SELECT '' AS namespace, 'notes' AS domain, 'mirror_' || name AS path, child_uuid AS node_uuid FROM edges WHERE child_uuid LIKE 'n-%'),
t AS (SELECT *, 0 AS depth FROM st UNION ALL SELECT t.namespace, t.domain, t.path || '/' || e.name, e.child_uuid, t.depth + 1 FROM t JOIN edges e ON e.parent_uuid = t.node_uuid WHERE t.depth < 4)
SELECT namespace, domain, path, node_uuid, depth FROM t""")
def m3(g):
    a = g.edges.where("child_uuid like 'n-%'").select(F.lit("").alias("namespace"), F.lit("notes").alias("domain"), F.concat(F.lit("mirror_"), "name").alias("path"), F.col("child_uuid").alias("node_uuid"))
    return M.cascade(g.edges, g.paths, a)


@query("m4_remove", """, req AS (SELECT namespace, domain, path AS base FROM paths WHERE namespace = '' AND (node_uuid LIKE 'n-1%' OR path LIKE '%_copy')),
gone AS (SELECT r.*, p.path, p.node_uuid FROM req r JOIN paths p ON p.namespace = r.namespace AND p.domain = r.domain AND (p.path = r.base OR starts_with(p.path, r.base || '/'))),
lft AS (SELECT DISTINCT node_uuid FROM paths p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = p.namespace AND g.domain = p.domain AND g.path = p.path)),
s AS (SELECT g.*, l.node_uuid IS NOT NULL AS stays FROM gone g LEFT JOIN lft l ON l.node_uuid = g.node_uuid)
SELECT *, bool_or(path <> base AND NOT contains(substr(path, length(base) + 2), '/') AND NOT stays) OVER (PARTITION BY namespace, domain, base) AS refused FROM s""")
def m4(g):
    req = g.paths.where("namespace = '' and (node_uuid like 'n-1%' or endswith(path, '_copy'))").select("namespace", "domain", "path")
    return M.remove_paths(g.paths, g.edges, req)


@query("m5_rollback", """, t AS (SELECT min(id) AS target, node_uuid FROM memories WHERE deprecated GROUP BY node_uuid)
SELECT m.id, m.node_uuid, m.id <> t.target AS deprecated, CASE WHEN m.id <> t.target THEN t.target END AS migrated_to FROM memories m JOIN t ON m.node_uuid = t.node_uuid WHERE m.id = t.target OR NOT m.deprecated""")
def m5(g):
    t = g.memories.where("deprecated").groupBy("node_uuid").agg(F.min("id").alias("id")).select("id")
    return M.rollback_to(g.memories, t)


@query("m7_deprecate", "SELECT a.id, a.node_uuid, (SELECT min(m.id) FROM memories m WHERE m.node_uuid = a.node_uuid) AS migrated_to FROM active a WHERE node_uuid LIKE 'c-1%'")
def m7(g):
    first = g.memories.groupBy(F.col("node_uuid").alias("n")).agg(F.min("id").alias("migrated_to"))
    return g.active.where("node_uuid like 'c-1%'").drop("migrated_to").join(first, F.col("node_uuid") == F.col("n")).select("id", "node_uuid", "migrated_to")


@query("m8_purge", """, gone AS (SELECT id, migrated_to, node_uuid FROM memories WHERE deprecated AND id % 100 IN (2, 3)),
w AS (SELECT id, migrated_to AS goal FROM gone UNION ALL SELECT w.id, g.migrated_to FROM w JOIN gone g ON w.goal = g.id),
e AS (SELECT id, goal FROM w WHERE goal NOT IN (SELECT id FROM gone))
SELECT m.id, m.node_uuid, CASE WHEN m.migrated_to IN (SELECT id FROM gone) THEN e.goal ELSE m.migrated_to END AS migrated_to
FROM memories m LEFT JOIN e ON e.id = m.migrated_to WHERE m.node_uuid IN (SELECT node_uuid FROM gone) AND m.id NOT IN (SELECT id FROM gone)""")
def m8(g):
    return M.purge(g.memories, g.memories.where("deprecated and id % 100 in (2, 3)").select("id"))


@query("m12_unreachable", "SELECT uuid FROM nodes WHERE uuid NOT IN (SELECT node_uuid FROM paths)")
def m12(g):
    return M.unreachable(g.nodes, g.paths)


@query("m13_cycle", """, req AS (SELECT 'o-' || o_orderkey AS parent_uuid, 'c-' || o_custkey AS child_uuid FROM orders WHERE o_orderkey % 10 = 0 UNION SELECT 'c-' || c_custkey, 'c-' || (c_custkey + 1) FROM customer WHERE c_custkey % 10 = 0 UNION SELECT 'ROOT', 'r-' || r_regionkey FROM region UNION SELECT 'r-1', 'r-1'),
rc AS (SELECT DISTINCT child_uuid AS origin, child_uuid AS node FROM req UNION SELECT rc.origin, e.child_uuid FROM rc JOIN edges e ON e.parent_uuid = rc.node)
SELECT parent_uuid, child_uuid, parent_uuid <> 'ROOT' AND EXISTS (SELECT 1 FROM rc WHERE rc.origin = req.child_uuid AND rc.node = req.parent_uuid) AS cycle FROM req""")
def m13(g):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    req = g.orders.where("o_orderkey % 10 = 0").select(tag("o-", "o_orderkey").alias("parent_uuid"), tag("c-", "o_custkey").alias("child_uuid"))
    c = g.table("customer").where("c_custkey % 10 = 0")
    req = req.unionAll(c.select(tag("c-", "c_custkey"), F.concat(F.lit("c-"), (F.col("c_custkey") + 1).cast("string")))).unionAll(g.table("region").select(F.lit("ROOT"), tag("r-", "r_regionkey")))
    req = req.unionAll(g.spark.createDataFrame([("r-1", "r-1")], req.schema)).distinct()
    return M.would_cycle(g.edges, req)


@query("m13_cycle_all", """, req AS (SELECT 'o-' || o_orderkey AS parent_uuid, 'c-' || o_custkey AS child_uuid FROM orders UNION SELECT 'c-' || c_custkey, 'c-' || (c_custkey + 1) FROM customer UNION SELECT 'ROOT', 'r-' || r_regionkey FROM region UNION SELECT 'r-1', 'r-1'),
rc AS (SELECT DISTINCT child_uuid AS origin, child_uuid AS node FROM req UNION SELECT rc.origin, e.child_uuid FROM rc JOIN edges e ON e.parent_uuid = rc.node)
SELECT parent_uuid, child_uuid, parent_uuid <> 'ROOT' AND EXISTS (SELECT 1 FROM rc WHERE rc.origin = req.child_uuid AND rc.node = req.parent_uuid) AS cycle FROM req""")
def m13_all(g):
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    req = g.orders.select(tag("o-", "o_orderkey").alias("parent_uuid"), tag("c-", "o_custkey").alias("child_uuid"))
    c = g.table("customer")
    req = req.unionAll(c.select(tag("c-", "c_custkey"), F.concat(F.lit("c-"), (F.col("c_custkey") + 1).cast("string")))).unionAll(g.table("region").select(F.lit("ROOT"), tag("r-", "r_regionkey")))
    req = req.unionAll(g.spark.createDataFrame([("r-1", "r-1")], req.schema)).distinct()
    return M.would_cycle(g.edges, req)


@query("m15_last_access", "SELECT node_uuid, strftime(max(accessed_at), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM logs GROUP BY 1")
def m15(g):
    return g.logs.groupBy("node_uuid").agg(F.date_format(F.max("accessed_at"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count("*").alias("n"))


@query("m16_retention", f"SELECT id FROM logs WHERE accessed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def m16(g):
    return g.logs.where(F.col("accessed_at") >= stamp(AS_OF) - F.expr("INTERVAL 7 DAYS")).select("id")


@query("m18_boot_rewrite", ", b AS (SELECT namespace, domain || '://' || path AS uri FROM paths WHERE path LIKE 'ASIA%') SELECT namespace, CASE WHEN uri = 'core://ASIA' OR starts_with(uri, 'core://ASIA/') THEN 'core://EAST' || substr(uri, 12) ELSE uri END AS uri FROM b")
def m18(g):
    uri = T.uri_of(F.col("domain"), F.col("path"))
    moved = F.when((uri == "core://ASIA") | uri.startswith("core://ASIA/"), F.concat(F.lit("core://EAST"), F.substring(uri, 12, 1 << 20))).otherwise(uri)
    return g.paths.where(F.col("path").startswith("ASIA")).select("namespace", moved.alias("uri"))


@query("m19_domain_check", ", d(domain) AS (VALUES ('core'), ('urgent'), ('Bad'), ('system'), ('fresh_1')) SELECT domain, CASE WHEN NOT regexp_matches(domain, '^[a-z][a-z0-9_]*$') OR domain = 'system' THEN 'invalid' WHEN domain IN (SELECT domain FROM paths) THEN 'in use' ELSE 'free' END AS status FROM d")
def m19(g):
    d = g.spark.createDataFrame([(x,) for x in ("core", "urgent", "Bad", "system", "fresh_1")], "domain string")
    used = g.paths.select("domain", F.lit(True).alias("used")).distinct()
    status = F.when(~F.col("domain").rlike(T.DOMAIN) | (F.col("domain") == "system"), "invalid").when(F.col("used"), "in use").otherwise("free")
    return d.join(used, "domain", "left").select("domain", status.alias("status"))


@query("m20_batch_edit", "SELECT id, replace(content, 'part', 'piece') AS content FROM active WHERE contains(content, 'part 1')")
def m20(g):
    return g.active.where(F.col("content").contains("part 1")).select("id", F.replace("content", F.lit("part"), F.lit("piece")).alias("content"))


@query("m26_tags", ", b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark) SELECT item_id, len(w) AS n, len(list_intersect(w, ['the', 'of', 'and'])) AS both, len(list_filter(w, lambda x: NOT list_contains(['the', 'of', 'and'], x))) AS rest FROM b")
def m26(g):
    w, tags = F.array_distinct(F.split("text", " ")), F.array(F.lit("the"), F.lit("of"), F.lit("and"))
    size = lambda x: F.size(x).cast("long")
    return g.table("benchmark").select("item_id", size(w).alias("n"), size(F.array_intersect(w, tags)).alias("both"), size(F.array_except(w, tags)).alias("rest"))


@query("m27_line_edit", "SELECT id, array_to_string(string_split(content, ' ')[1:2] || ['edited'] || string_split(content, ' ')[4:], ' ') AS content FROM active WHERE node_uuid LIKE 'o-%'")
def m27(g):
    parts = F.split("content", " ")
    return g.active.where("node_uuid like 'o-%'").select("id", F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit("edited")), F.slice(parts, 4, 1 << 20)), " ").alias("content"))
