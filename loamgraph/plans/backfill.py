"""The graph backfill over the orders' versions, with branches and rings, and the paths of the empty namespace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backfill as O
from ..registry import query

#: Every fourth order's first two versions lead to the third, every seventh order's last one leads back to the first, and
#: of every fifth order the second version has its node already.
_OLD = """, om AS (SELECT id, CASE WHEN id < 1000000000000 AND id // 100 % 5 = 0 AND id % 100 = 2 OR id >= 1000000000000 AND id % 3 = 0 THEN node_uuid END AS node_uuid,
  CASE WHEN id < 1000000000000 AND id // 100 % 4 = 0 AND id % 100 = 1 AND migrated_to IS NOT NULL THEN coalesce(third, migrated_to)
       WHEN id < 1000000000000 AND id // 100 % 7 = 0 AND migrated_to IS NULL THEN id // 100 * 100 + 1 ELSE migrated_to END AS migrated_to FROM memories m LEFT JOIN (SELECT id - 2 AS first, id AS third FROM memories WHERE id < 1000000000000 AND id % 100 = 3) t ON t.first = m.id),
oq AS (SELECT domain, path, CASE WHEN node_uuid LIKE 'o-%' THEN CAST(substr(node_uuid, 3) AS BIGINT) * 100 + 1 ELSE memory_id END AS memory_id, CASE WHEN priority > 0 THEN priority END AS priority, disclosure FROM star WHERE namespace = ''),
pr AS (SELECT migrated_to AS id, max(id) AS up FROM om WHERE migrated_to IS NOT NULL GROUP BY 1),
wk AS (SELECT id, id AS cur, [id] AS seen FROM om UNION ALL SELECT wk.id, pr.up, list_append(seen, pr.up) FROM wk JOIN pr ON pr.id = wk.cur WHERE NOT list_contains(seen[1:len(seen) - 1], wk.cur)),
rt AS (SELECT id, arg_max(cur, len(seen)) AS root FROM wk GROUP BY 1),
gn AS (SELECT root, arg_min(om.node_uuid, om.id) AS given FROM om JOIN rt USING (id) WHERE om.node_uuid IS NOT NULL GROUP BY 1),
nn AS (SELECT om.id, coalesce(om.node_uuid, given, 'm-' || rt.root) AS node_uuid FROM om JOIN rt USING (id) LEFT JOIN gn ON gn.root = rt.root)"""
_EDGES = _OLD + """, pc AS (SELECT oq.*, nn.node_uuid AS child_uuid, regexp_replace(path, '(^|/)[^/]*$', '') AS up FROM oq JOIN nn ON nn.id = oq.memory_id),
pp AS (SELECT a.*, coalesce(b.child_uuid, 'ROOT') AS parent_uuid, len(string_split(a.path, '/')) AS depth FROM pc a LEFT JOIN pc b ON b.domain = a.domain AND b.path = a.up),
oe AS (SELECT *, row_number() OVER (ORDER BY depth, domain, path) AS id FROM (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY parent_uuid, child_uuid ORDER BY depth, domain, path) = 1))"""


def old(g):
    m, k, n = g.links, F.floor(F.col("id") / 100), F.col("id") % 100
    order = F.col("id") < 10**12
    node = F.when(order & (k % 5 == 0) & (n == 2) | ~order & (F.col("id") % 3 == 0), F.col("node_uuid"))
    third = F.when(F.col("n") + 2 <= F.col("last"), F.col("id") + 2)
    to = F.when(order & (k % 4 == 0) & (n == 1) & F.col("migrated_to").isNotNull(), F.coalesce(third, "migrated_to")).when(order & (k % 7 == 0) & F.col("migrated_to").isNull(), k * 100 + 1).otherwise(F.col("migrated_to"))
    memories = m.select("id", node.alias("node_uuid"), to.alias("migrated_to"))
    own = F.when(F.col("node_uuid").like("o-%"), F.substring("node_uuid", 3, 20).cast("long") * 100 + 1).otherwise(F.col("memory_id"))
    paths = g.places.where("namespace = ''").select("domain", "path", own.alias("memory_id"), F.when(F.col("priority") > 0, F.col("priority")).alias("priority"), "disclosure")
    return memories, paths


@query("m28_nodes", _OLD + " SELECT id, node_uuid FROM nn")
def m28_nodes(g):
    """The node of every version."""
    return O.nodes_of(old(g)[0])


@query("m28_edges", _EDGES + " SELECT id, parent_uuid, child_uuid, string_split(path, '/')[-1] AS name, coalesce(priority, 0) AS priority, disclosure FROM oe")
def m28_edges(g):
    """The edges that the old paths make."""
    return O.graph_of(*old(g))[1]


@query("m28_paths", _EDGES + " SELECT '' AS namespace, domain, pp.path, oe.id AS edge_id, pp.child_uuid AS node_uuid FROM (SELECT DISTINCT domain, path, parent_uuid, child_uuid FROM pp) pp JOIN (SELECT id, parent_uuid, child_uuid FROM oe) oe ON oe.parent_uuid = pp.parent_uuid AND oe.child_uuid = pp.child_uuid")
def m28_paths(g):
    """The paths with their edges, in the empty namespace."""
    return O.graph_of(*old(g))[2]


@query("m28_namespaces", "SELECT min(id) AS id, keyword, node_uuid, '' AS namespace FROM (SELECT id, keyword, node_uuid FROM glossary UNION ALL SELECT id + 1000, keyword, node_uuid FROM glossary) GROUP BY keyword, node_uuid")
def m28_namespaces(g):
    """Keywords that were entered twice, in the one namespace that there was."""
    k = g.glossary.select("id", "keyword", "node_uuid")
    return O.namespaced(k.unionByName(k.withColumn("id", F.col("id") + 1000)), ["keyword", "node_uuid"], "id")
