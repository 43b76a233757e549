"""Batches whose requests build upon each other: updates by the lines of every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as O
from ..operators.steps import table
from ..registry import query

#: A request for each line: order lines as requests of one node, the odd ones without content, some through another path.
_REQ = """, rq AS (SELECT id AS seq, 'core' AS d0, l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN 'line ' || id END AS content, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS INT) END AS priority,
  CASE WHEN CAST(l_quantity AS INT) % 5 = 0 THEN 'by air ' || l_linenumber END AS disclosure, CASE WHEN l_linestatus = 'F' AND l_linenumber % 2 = 1 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS world_timestamp FROM lv),
pa AS (SELECT CAST(substr(node_uuid, 3) AS BIGINT) AS ok, max(CASE WHEN domain = 'core' AND NOT ends_with(path, '_copy') THEN path END) AS main, max(CASE WHEN domain = 'urgent' THEN path END) AS urgent FROM paths WHERE node_uuid LIKE 'o-%' GROUP BY 1),
rs AS (SELECT seq, '' AS namespace, CASE WHEN u THEN 'urgent' ELSE 'core' END AS domain, CASE WHEN l_orderkey % 31 = 0 THEN 'no/such' WHEN u THEN urgent ELSE main END AS path, content, priority, disclosure, world_timestamp
  FROM (SELECT rq.*, pa.*, urgent IS NOT NULL AND l_linenumber % 3 = 0 AS u FROM rq JOIN pa ON ok = l_orderkey)),
gt AS (SELECT rs.*, s.edge_id, s.node_uuid, s.memory_id, s.priority AS had_priority, s.disclosure AS had_disclosure, s.world_timestamp AS had_world,
  CASE WHEN coalesce(rs.content, CAST(rs.priority AS VARCHAR), rs.disclosure, rs.world_timestamp) IS NULL THEN 'nothing' WHEN s.memory_id IS NULL THEN 'not found' ELSE 'ok' END AS status
  FROM rs LEFT JOIN star s ON s.namespace = rs.namespace AND s.domain = rs.domain AND s.path = rs.path),
nw AS (SELECT seq AS nseq, (SELECT max(id) FROM memories) + row_number() OVER (ORDER BY seq) AS own_id FROM gt WHERE status = 'ok' AND content IS NOT NULL),
st AS (SELECT gt.*, own_id, count(own_id) OVER w AS version, coalesce(last_value(own_id IGNORE NULLS) OVER w, memory_id) AS new_id, last_value(gt.world_timestamp IGNORE NULLS) OVER w AS world
  FROM gt LEFT JOIN nw ON nseq = seq WHERE status = 'ok' WINDOW w AS (PARTITION BY node_uuid ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
ANSWERS = _REQ + """ SELECT seq, status, node_uuid, coalesce(lag(new_id) OVER (PARTITION BY node_uuid ORDER BY seq), memory_id) AS old_id, new_id FROM st
UNION ALL SELECT seq, status, node_uuid, NULL, NULL FROM gt WHERE status <> 'ok'"""
VERSIONS = _REQ + """, la AS (SELECT node_uuid, version, arg_max(new_id, seq) AS id, last(coalesce(world, had_world) ORDER BY seq) AS world_timestamp FROM st GROUP BY ALL),
f0 AS (SELECT DISTINCT node_uuid, memory_id AS id, had_world FROM st),
al AS (SELECT f0.node_uuid, 0 AS version, f0.id, CASE WHEN la.id IS NULL THEN had_world ELSE la.world_timestamp END AS world_timestamp FROM f0 LEFT JOIN la ON la.node_uuid = f0.node_uuid AND la.version = 0
  UNION ALL SELECT node_uuid, version, id, world_timestamp FROM la WHERE version > 0),
ch AS (SELECT *, lead(id) OVER (PARTITION BY node_uuid ORDER BY version) AS migrated_to, max(version) OVER (PARTITION BY node_uuid) AS top FROM al)
SELECT ch.id, ch.node_uuid, coalesce(st.content, m.content) AS content, ch.version < top AS deprecated, ch.migrated_to, ch.world_timestamp FROM ch LEFT JOIN st ON st.own_id = ch.id LEFT JOIN memories m ON m.id = ch.id
WHERE ch.version > 0 OR top > 0 OR ch.world_timestamp IS DISTINCT FROM m.world_timestamp"""
EDGES = _REQ + """, ef AS (SELECT edge_id, had_priority, had_disclosure, coalesce(arg_max(priority, seq) FILTER (priority IS NOT NULL), had_priority) AS priority, coalesce(arg_max(disclosure, seq) FILTER (disclosure IS NOT NULL), had_disclosure) AS disclosure FROM st GROUP BY edge_id, had_priority, had_disclosure)
SELECT * FROM ef WHERE priority IS DISTINCT FROM had_priority OR disclosure IS DISTINCT FROM had_disclosure"""


def requests(g, raw=False):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    lines = g.table("lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.row_number().over(w))
    if raw:
        return lines
    own = lambda d: F.max(F.when(d, F.col("path")))
    p = g.paths.where("node_uuid like 'o-%'").groupBy(F.substring("node_uuid", 3, 20).cast("long").alias("l_orderkey"))
    p = p.agg(own((F.col("domain") == "core") & ~F.col("path").endswith("_copy")).alias("main"), own(F.col("domain") == "urgent").alias("urgent"))
    n = F.col("l_linenumber")
    other = F.col("urgent").isNotNull() & (n % 3 == 0)
    path = F.when(F.col("l_orderkey") % 31 == 0, "no/such").when(other, F.col("urgent")).otherwise(F.col("main"))
    return lines.join(p, "l_orderkey").select(
        "seq", F.lit("").alias("namespace"), F.when(other, "urgent").otherwise("core").alias("domain"), path.alias("path"), F.when(F.col("l_returnflag") != "N", F.concat(F.lit("line "), F.col("seq").cast("string"))).alias("content"),
        F.when(n % 2 == 0, n.cast("int")).alias("priority"), F.when(F.col("l_quantity").cast("int") % 5 == 0, F.concat(F.lit("by air "), n.cast("string"))).alias("disclosure"),
        F.when((F.col("l_linestatus") == "F") & (n % 2 == 1), F.col("l_shipdate").cast("date").cast("string")).alias("world_timestamp"),
    )


@query("m2_answers", ANSWERS)
def m2_answers(g):
    """What each of an order's requests finds and leaves, one after the other."""
    got = table(O.met(g.star, requests(g)).select("seq", "status", "node_uuid", "memory_id", "had_world", "world_timestamp", "content"), "requests")
    return O.answers(got, O.versioned(got, g.last_ids))


@query("m2_versions", VERSIONS)
def m2_versions(g):
    """The versions that a batch of several requests a node makes and retires, numbered and linked."""
    got = table(O.met(g.star, requests(g)).select("seq", "status", "node_uuid", "memory_id", "had_world", "world_timestamp", "content"), "requests")
    active = g.star.select(F.col("memory_id").alias("id"), "content", "world_timestamp").dropDuplicates(["id"])  # first versions are those at paths
    return O.versions(O.versioned(got, g.last_ids, "content"), active)


@query("m2_edges", EDGES)
def m2_edges(g):
    """Edges whose priority or disclosure the batch changes: the last value given."""
    return O.edges(O.met(g.star, requests(g)))
