"""Aliases of orders with every reason that forbids one, the health report, and presets of every nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..functions import text as T
from ..operators import alias as O
from ..registry import query
from . import diagnostics as D
from .presets import activate, boot_uris

_REQ = """, op1 AS (SELECT CAST(substr(node_uuid, 3) AS BIGINT) AS k, path FROM paths WHERE domain = 'core' AND node_uuid LIKE 'o-%' AND NOT ends_with(path, '_copy')),
rq AS (SELECT k AS seq, '' AS namespace, 'core' AS domain, CASE k % 6 WHEN 0 THEN 'alias_' || k // 12 WHEN 1 THEN regexp_replace(path, '/[^/]*$', '') || '/twin_' || k WHEN 2 THEN 'no/such/x' || k WHEN 3 THEN path WHEN 4 THEN path || '/up' ELSE CASE WHEN k % 4 = 1 THEN '' ELSE 'new_' || k END END AS path,
  'core' AS target_domain, CASE WHEN k % 6 = 4 THEN regexp_replace(path, '/[^/]*$', '') WHEN k % 29 = 0 THEN 'gone' ELSE path END AS target_path, CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS INT) END AS priority, CASE WHEN k % 2 = 0 THEN 'note ' || k END AS disclosure FROM op1),
g1 AS (SELECT rq.*, p.node_uuid, e.disclosure AS own, CASE WHEN contains(rq.path, '/') THEN regexp_replace(rq.path, '/[^/]*$', '') ELSE '' END AS up FROM rq LEFT JOIN paths p ON p.namespace = rq.namespace AND p.domain = rq.target_domain AND p.path = rq.target_path LEFT JOIN edges e ON e.id = p.edge_id),
g2 AS (SELECT g1.*, CASE WHEN up = '' THEN 'ROOT' ELSE u.node_uuid END AS parent_uuid, t.path IS NOT NULL AS there FROM g1 LEFT JOIN paths u ON u.namespace = g1.namespace AND u.domain = g1.domain AND u.path = g1.up LEFT JOIN paths t ON t.namespace = g1.namespace AND t.domain = g1.domain AND t.path = g1.path),
rc AS (SELECT DISTINCT node_uuid AS origin, node_uuid AS node FROM g2 WHERE node_uuid IS NOT NULL AND parent_uuid <> 'ROOT' UNION SELECT rc.origin, e.child_uuid FROM rc JOIN edges e ON e.parent_uuid = rc.node),
g3 AS (SELECT g2.*, CASE WHEN g2.path = '' THEN 'root' WHEN node_uuid IS NULL THEN 'no target' WHEN parent_uuid IS NULL THEN 'no parent' WHEN there THEN 'taken' WHEN rc.node IS NOT NULL AND parent_uuid <> 'ROOT' THEN 'cycle' END AS early FROM g2 LEFT JOIN rc ON rc.origin = g2.node_uuid AND rc.node = g2.parent_uuid),
g4 AS (SELECT *, min(CASE WHEN early IS NULL THEN seq END) OVER (PARTITION BY namespace, domain, path) AS best FROM g3),
he AS (SELECT parent_uuid, child_uuid, min(id) AS edge_id, arg_min(name, id) AS name, arg_min(priority, id) AS priority, arg_min(coalesce(disclosure, chr(0)), id) AS disclosure FROM edges GROUP BY ALL)"""


def requests(g):
    p = g.paths.where("domain = 'core' and node_uuid like 'o-%' and not endswith(path, '_copy')").withColumn("k", F.substring("node_uuid", 3, 20).cast("long"))
    k, up = F.col("k"), T.parent_path(F.col("path"))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    new = F.when(k % 6 == 0, text("alias_", F.floor(k / 12))).when(k % 6 == 1, text(up, "/twin_", k)).when(k % 6 == 2, text("no/such/x", k)).when(k % 6 == 3, F.col("path")).when(k % 6 == 4, text(F.col("path"), "/up"))
    new = new.otherwise(F.when(k % 4 == 1, F.lit("")).otherwise(text("new_", k)))
    target = F.when(k % 6 == 4, up).when(k % 29 == 0, "gone").otherwise(F.col("path"))
    return p.select(k.alias("seq"), F.lit("").alias("namespace"), F.lit("core").alias("domain"), new.alias("path"), F.lit("core").alias("target_domain"), target.alias("target_path"), F.when(k % 5 > 0, (k % 5).cast("int")).alias("priority"), F.when(k % 2 == 0, text("note ", k)).alias("disclosure"))


@query("m3_alias_checked", _REQ + """ SELECT seq, coalesce(early, CASE WHEN seq > best THEN 'taken' END, 'ok') AS status, g4.parent_uuid, node_uuid, coalesce(he.name, string_split(path, '/')[-1]) AS name, CASE WHEN he.edge_id IS NOT NULL THEN he.priority ELSE coalesce(g4.priority, 0) END AS priority,
  CASE WHEN he.edge_id IS NOT NULL THEN nullif(he.disclosure, chr(0)) ELSE coalesce(g4.disclosure, nullif(own, '')) END AS disclosure, he.edge_id FROM g4 LEFT JOIN he ON he.parent_uuid = g4.parent_uuid AND he.child_uuid = g4.node_uuid""")
def m3_alias_checked(g):
    """An alias asked for every order: new ones, taken ones, without target or parent, and below their own target."""
    return O.alias(g.paths, g.edges, requests(g))


@query("d6_report_lines", D.D1 + """, am AS (SELECT node_uuid, min(id) AS memory_id FROM active GROUP BY 1),
s1 AS (SELECT st.domain || '://' || st.path AS uri, priority, round_even(age / 86400, 1) AS d, CAST(CASE WHEN priority IS NULL THEN 14 WHEN priority <= 0 THEN 3 WHEN priority = 1 THEN 7 WHEN priority = 2 THEN 14 ELSE least(floor(3.5 * pow(2, least(priority, 20))), 36500) END AS BIGINT) AS t, last_accessed_at AS last FROM st JOIN nodes n ON n.uuid = st.node_uuid WHERE rk = 1 AND namespace = '' AND domain = 'core'),
s2 AS (SELECT m.n, coalesce(p.uri, '(root)') AS uri FROM (SELECT parent_uuid, count(DISTINCT child_uuid) AS n FROM edges GROUP BY 1 HAVING count(DISTINCT child_uuid) > 10) m LEFT JOIN (SELECT node_uuid, min(domain || '://' || path) AS uri FROM paths WHERE namespace = '' GROUP BY 1) p ON m.parent_uuid = p.node_uuid WHERE p.uri IS NOT NULL OR m.parent_uuid = 'ROOT'),
s3 AS (SELECT domain || '://' || path AS uri, memory_id, n.created_at AS created FROM paths p LEFT JOIN am ON am.node_uuid = p.node_uuid LEFT JOIN nodes n ON n.uuid = p.node_uuid WHERE namespace = '' AND domain = 'core' AND contains(path, '/') AND NOT EXISTS (SELECT 1 FROM paths q WHERE q.namespace = p.namespace AND q.domain = p.domain AND q.path = regexp_replace(p.path, '(^|/)[^/]*$', ''))),
s4 AS (SELECT domain, regexp_replace(path, '(^|/)[^/]*$', '') AS parent, node_uuid, list(path ORDER BY path) AS ps FROM paths WHERE namespace = '' AND domain = 'core' GROUP BY ALL HAVING count(*) > 1),
it AS (SELECT 1 AS section, row_number() OVER (ORDER BY coalesce(priority, 999), d DESC, uri) AS n, [uri, '   Priority: ' || priority || ' | Stale for: ~' || d || ' days (Threshold: ' || t || ' days) | ' || coalesce('Last Accessed: ' || strftime(last, '%Y-%m-%d'), 'Never accessed (since tracking began)')] AS ls FROM s1
  UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, uri), [uri || ' (' || n || ' children)'] FROM s2
  UNION ALL SELECT 3, row_number() OVER (ORDER BY uri), [uri, '   ' || coalesce('Memory ID: ' || memory_id, 'No active memory') || ' | Created: ' || coalesce(strftime(created, '%Y-%m-%d'), 'Unknown')] FROM s3
  UNION ALL SELECT 4, row_number() OVER (ORDER BY domain, parent, ps[1]), [coalesce('Memory ID: ' || memory_id, 'No active memory'), '   Parent: ' || domain || '://' || parent, '   Duplicate Paths (' || len(ps) || '):'] || list_transform(ps, lambda p: '     - ' || domain || '://' || p) FROM s4 LEFT JOIN am ON am.node_uuid = s4.node_uuid),
ln AS (SELECT section, n, unnest(range(len(ls))) AS line, unnest(ls) AS text FROM it)
SELECT section, n, CAST(line AS INT) AS line, CASE WHEN line = 0 THEN n || '. ' || text ELSE text END AS text FROM ln""")
def d6_report_lines(g):
    """All four parts of the health report of one domain, line by line."""
    here = "namespace = '' and domain = 'core'"
    uri = T.uri_of(F.col("domain"), F.col("path"))
    used = g.nodes.select(F.col("uuid").alias("node_uuid"), F.col("last_accessed_at").alias("last"), F.col("created_at").alias("created"))
    active = g.active.groupBy("node_uuid").agg(F.min("id").alias("memory_id"))
    stale = D.stale(g.star, g.nodes, AS_OF).where(here).join(used, "node_uuid").select(uri.alias("uri"), "priority", "stale_days", T.stale_limit(F.col("priority")).cast("long").alias("threshold"), "last")
    crowded = D.crowded(g.edges, g.paths, 10, "").select("uri", F.col("n").alias("n_children"))
    orphaned = D.orphaned_paths(g.paths).where(here).join(g.paths.select("namespace", "domain", "path", "node_uuid"), ["namespace", "domain", "path"])
    orphaned = orphaned.join(active, "node_uuid", "left").join(used, "node_uuid", "left").select(uri.alias("uri"), "memory_id", "created")
    twice = D.duplicate_aliases(g.paths).where(here).join(active, "node_uuid", "left").select("domain", "parent", "memory_id", F.split("paths", r"\|").alias("paths"))
    return O.report(stale, crowded, orphaned, twice)


#: A preset for every nation: its region and itself for the default namespace, and its customers below 100 for another one.
_PRE = """, cl AS (SELECT c_nationkey, list('core://cust_' || c_custkey ORDER BY c_custkey) AS own FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
pr AS (SELECT CAST(n_nationkey AS INT) AS id, n_name AS name, ['core://' || r_name, 'core://' || r_name || '/' || n_name] AS dft, own, n_nationkey = 7 AS is_active FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN cl ON c_nationkey = n_nationkey)"""


def presets(g):
    c = g.table("customer").where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("core://cust_"), k.cast("string"))).alias("own"))
    n = g.table("nation").join(g.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, "n_nationkey", "left")
    lists = F.create_map(F.lit(""), F.array(F.concat(F.lit("core://"), "r_name"), F.concat(F.lit("core://"), "r_name", F.lit("/"), "n_name")))
    lists = F.when(F.col("own").isNull(), lists).otherwise(F.map_concat(lists, F.create_map(F.lit("ns_building"), F.col("own"))))
    return n.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("name"), F.to_json(lists).alias("boot_uris"), (F.col("n_nationkey") == 7).alias("is_active"))


@query("q19_preset_table", _PRE + " SELECT id, name, is_active, CASE WHEN own IS NULL THEN 1 ELSE 2 END::BIGINT AS namespaces FROM pr")
def q19_preset_table(g):
    from .presets import BOOT

    return presets(g).select("id", "name", "is_active", F.size(F.map_keys(F.from_json("boot_uris", BOOT))).cast("long").alias("namespaces"))


@query("q20_boot_table", _PRE + " SELECT n.namespace, array_to_string(CASE WHEN n.namespace = 'ns_building' THEN coalesce(own, dft) ELSE dft END, '|') AS uris FROM (SELECT DISTINCT namespace FROM paths UNION SELECT DISTINCT lang FROM documents) n, pr WHERE is_active")
def q20_boot_table(g):
    """The boot list of every namespace that has paths or documents."""
    return boot_uris(presets(g), g.paths.select("namespace").union(g.documents.select("namespace")).distinct())


@query("m17_activate_table", _PRE + " SELECT id, name, id = (SELECT max(id) FROM pr) AS is_active FROM pr")
def m17_activate_table(g):
    """The last preset made the only active one."""
    p = presets(g)
    return activate(p, p.agg(F.max("id")).first()[0]).select("id", "name", "is_active")
