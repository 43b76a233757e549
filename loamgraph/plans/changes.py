"""Change capture and revision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..registry import query

RECORDED = """, rec AS (SELECT tbl || ':' || pk AS row_key, tbl, node_uuid, arg_min(coalesce(before, chr(0)), seq) AS b, arg_max(after, seq) AS after, count(*) AS writes FROM changes GROUP BY ALL),
rd AS (SELECT row_key, tbl, node_uuid, nullif(b, chr(0)) AS before, after, writes FROM rec)
"""


@query("c1_row_keys", "SELECT 'paths:' || namespace || '|' || domain || '|' || path AS row_key, node_uuid FROM paths")
def c1(g):
    return g.paths.select(F.concat(F.lit("paths:"), F.concat_ws("|", "namespace", "domain", "path")).alias("row_key"), "node_uuid")


@query("c2_equal_rows", ", mm AS MATERIALIZED (SELECT id, migrated_to, content, world_timestamp FROM memories) SELECT a.id, b.id AS other, coalesce(a.content = b.content, a.content IS NULL AND b.content IS NULL) AND coalesce(a.world_timestamp = b.world_timestamp, a.world_timestamp IS NULL AND b.world_timestamp IS NULL) AS same FROM mm a JOIN mm b ON b.id = a.migrated_to")
def c2(g):
    b = g.memories.select(F.col("id").alias("other"), F.col("content").alias("c2"), F.col("world_timestamp").alias("w2"))
    same = F.col("content").eqNullSafe(F.col("c2")) & F.col("world_timestamp").eqNullSafe(F.col("w2"))
    return g.memories.join(b, F.col("migrated_to") == F.col("other")).select("id", "other", same.alias("same"))


@query("c3_recorded", RECORDED + "SELECT * FROM rd")
def c3(g):
    return C.recorded(g.changes)


@query("st2_recorded_batch", RECORDED + "SELECT row_key, before, after FROM rd")
def st2(g):
    return C.recorded(g.changes).select("row_key", "before", "after")


@query("c5_changed", RECORDED + "SELECT row_key, before, after FROM rd WHERE before IS DISTINCT FROM after")
def c5(g):
    return C.changed(C.recorded(g.changes)).select("row_key", "before", "after")


@query("c6_pools", RECORDED + "SELECT row_key, CASE WHEN writes > 3 THEN 'approved' ELSE 'pending' END AS pool FROM rd")
def c6(g):
    return C.recorded(g.changes).select("row_key", F.when(F.col("writes") > 3, "approved").otherwise("pending").alias("pool"))


MIXED = """, mx AS (SELECT 'memories' AS tbl, node_uuid, before, after FROM changes UNION ALL SELECT 'nodes', node_uuid, NULL, node_uuid FROM changes WHERE seq = 1 AND node_uuid LIKE '%7' UNION ALL SELECT 'paths', node_uuid, path, CASE WHEN domain = 'urgent' THEN NULL ELSE path END FROM paths WHERE node_uuid LIKE 'c-%' OR domain = 'urgent')
"""


def mixed(g):
    a = g.changes.select("tbl", "node_uuid", "before", "after")
    b = g.changes.where("seq = 1 and node_uuid like '%7'").select(F.lit("nodes"), "node_uuid", F.lit(None).cast("string"), "node_uuid")
    p = g.paths.where("node_uuid like 'c-%' or domain = 'urgent'").select(F.lit("paths"), "node_uuid", "path", F.when(F.col("domain") != "urgent", F.col("path")))
    return a.unionAll(b).unionAll(p)


_RANK = "CASE tbl WHEN 'nodes' THEN 5 WHEN 'memories' THEN 4 WHEN 'edges' THEN 3 WHEN 'paths' THEN 2 ELSE 1 END"


@query("c11_groups", MIXED + f", rk AS (SELECT *, {_RANK} AS r, max({_RANK}) OVER (PARTITION BY node_uuid) AS best FROM mx) SELECT node_uuid, max(CASE WHEN r = best THEN tbl END) AS top_table, CASE WHEN bool_and(before IS NULL) FILTER (r = best) THEN 'created' WHEN bool_and(after IS NULL) FILTER (r = best) THEN 'deleted' ELSE 'modified' END AS action, count(*) AS row_count FROM rk GROUP BY 1")
def c11(g):
    return C.groups(mixed(g))


@query("c14_reverted", RECORDED + ", st AS (SELECT 'memories:' || node_uuid AS row_key, content AS image FROM active) SELECT st.row_key, image FROM st LEFT JOIN (SELECT row_key AS k FROM rd) r ON r.k = st.row_key WHERE r.k IS NULL UNION ALL SELECT row_key, before FROM rd WHERE before IS NOT NULL")
def c14(g):
    state = g.active.select(F.concat(F.lit("memories:"), "node_uuid").alias("row_key"), F.col("content").alias("image"))
    return C.reverted(state, C.recorded(g.changes))


REV = ", rev AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey <= 1 THEN NULL ELSE CAST(floor(o_orderkey / 2.0) AS BIGINT) END AS parent_id FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey > 0))"


def revisions(g):
    k = g.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("id")).distinct()
    return k.select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("parent_id"))


@query("c16_tree", REV + " SELECT id, parent_id, id = (SELECT max(id) FROM rev) AS is_head FROM rev")
def c16(g):
    r = revisions(g)
    head = r.agg(F.max("id").alias("head"))
    return r.join(F.broadcast(head)).select("id", "parent_id", (F.col("id") == F.col("head")).alias("is_head"))


@query("c17_ancestors", REV + ", an AS (SELECT id AS origin, id, parent_id, 0 AS depth FROM rev WHERE id % 100 = 7 UNION ALL SELECT an.origin, r.id, r.parent_id, an.depth + 1 FROM an JOIN rev r ON r.id = an.parent_id) SELECT origin, id, depth FROM an")
def c17(g):
    r = revisions(g)
    got = C.ancestors(r, r.where("id % 100 = 7").select(F.col("id").alias("origin")))
    return got.join(r.select("id"), "id", "left_semi")


@query("c18_checkout", REV + ", an AS (SELECT id AS origin, id, parent_id, 0 AS depth FROM rev WHERE id % 100 = 7 UNION ALL SELECT an.origin, r.id, r.parent_id, an.depth + 1 FROM an JOIN rev r ON r.id = an.parent_id) SELECT origin, id % 3 AS key, arg_max(id, depth) AS nearest_target, arg_min(id, depth) AS nearest_head FROM an GROUP BY ALL")
def c18(g):
    r = revisions(g)
    got = C.ancestors(r, r.where("id % 100 = 7").select(F.col("id").alias("origin"))).join(r.select("id"), "id", "left_semi")
    return got.groupBy("origin", (F.col("id") % 3).alias("key")).agg(F.max_by("id", "depth").alias("nearest_target"), F.min_by("id", "depth").alias("nearest_head"))


@query("c17_ancestors_all", REV + ", an AS (SELECT id AS origin, id, parent_id, 0 AS depth FROM rev UNION ALL SELECT an.origin, r.id, r.parent_id, an.depth + 1 FROM an JOIN rev r ON r.id = an.parent_id) SELECT origin, id, depth FROM an")
def c17_all(g):
    return C.lineages(revisions(g))


@query("c18_checkout_all", REV + ", an AS (SELECT id AS origin, id, parent_id, 0 AS depth FROM rev UNION ALL SELECT an.origin, r.id, r.parent_id, an.depth + 1 FROM an JOIN rev r ON r.id = an.parent_id) SELECT origin, id % 3 AS key, arg_max(id, depth) AS nearest_target, arg_min(id, depth) AS nearest_head FROM an GROUP BY ALL")
def c18_all(g):
    return C.nearest(revisions(g), F.col("id") % 3).select("origin", "key", "nearest_target", "nearest_head")
