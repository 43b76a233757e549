"""Review, restore, delete and edit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import restore as X
from ..operators import review as V
from ..registry import query

#: A change set: every tenth customer is deleted with all its paths, half of its orders' edges go too, others' urgent
#: paths are new, and some versions are replaced or retired.
CHANGED = """, gone AS (SELECT 'c-' || c_custkey AS u, 3000000000 + c_custkey AS eid, c_custkey FROM customer WHERE c_custkey % 10 = 3),
cp AS (SELECT p.* FROM paths p JOIN edges e ON e.id = p.edge_id WHERE p.domain = 'core' AND p.namespace = '' AND (e.child_uuid IN (SELECT u FROM gone) OR e.parent_uuid IN (SELECT u FROM gone))),
ce AS (SELECT e.id, e.parent_uuid, e.child_uuid FROM edges e WHERE e.id IN (SELECT eid FROM gone) OR (e.parent_uuid IN (SELECT u FROM gone) AND e.id % 2 = 0)),
me AS (SELECT e.id, e.parent_uuid, e.child_uuid FROM edges e WHERE e.id BETWEEN 5000000000 AND 5999999999),
ch(row_key, tbl, node_uuid, edge_id, parent_uuid, namespace, domain, path, made, gone, was_active, is_active) AS (
 SELECT 'nodes:' || u, 'nodes', u, NULL::BIGINT, NULL, NULL, NULL, NULL, false, true, NULL::BOOLEAN, NULL::BOOLEAN FROM gone
 UNION ALL SELECT 'edges:' || id, 'edges', child_uuid, id, parent_uuid, NULL, NULL, NULL, false, true, NULL, NULL FROM ce
 UNION ALL SELECT 'edges:' || id, 'edges', child_uuid, id, parent_uuid, NULL, NULL, NULL, true, false, NULL, NULL FROM me
 UNION ALL SELECT 'paths:' || namespace || '|' || domain || '|' || path, 'paths', CASE WHEN edge_id % 3 <> 0 THEN node_uuid END, edge_id, NULL, namespace, domain, path, false, true, NULL, NULL FROM cp
 UNION ALL SELECT 'paths:' || namespace || '|' || domain || '|' || path, 'paths', node_uuid, edge_id, NULL, namespace, domain, path, true, false, NULL, NULL FROM paths WHERE domain = 'urgent'
 UNION ALL SELECT 'memories:' || id, 'memories', node_uuid, NULL, NULL, NULL, NULL, NULL, false, id % 4 = 0, true, false FROM active WHERE node_uuid IN (SELECT u FROM gone) OR node_uuid IN (SELECT child_uuid FROM ce)
 UNION ALL SELECT 'memories:-' || id, 'memories', node_uuid, NULL, NULL, NULL, NULL, NULL, true, false, NULL, true FROM active WHERE node_uuid IN (SELECT child_uuid FROM ce) AND id % 7 = 0),
ops AS (SELECT *, CASE WHEN made THEN '+' WHEN gone THEN '-' END AS act FROM ch),
nd AS (SELECT o.*, coalesce(o.node_uuid, CASE WHEN o.tbl = 'paths' THEN coalesce((SELECT min(x.node_uuid) FROM ops x WHERE x.tbl = 'edges' AND x.edge_id = o.edge_id), e.child_uuid) END) AS node FROM ops o LEFT JOIN edges e ON e.id = o.edge_id),
mv AS (SELECT DISTINCT edge_id, act FROM ops WHERE tbl = 'edges' AND act IS NOT NULL),
inn AS (SELECT node_uuid, act, min(row_key) AS via FROM ops WHERE tbl = 'edges' AND act IS NOT NULL GROUP BY ALL),
bp AS (SELECT edge_id, act, min(row_key) AS by_path FROM ops WHERE tbl = 'paths' AND act IS NOT NULL GROUP BY ALL),
cs AS (SELECT p.row_key, min(u.row_key) AS cause FROM ops p JOIN ops u ON u.tbl = 'paths' AND u.act = p.act AND u.namespace = p.namespace AND u.domain = p.domain AND u.path = regexp_replace(p.path, '/[^/]*$', '') AND contains(p.path, '/')
   LEFT JOIN mv s ON s.edge_id = p.edge_id AND s.act = p.act LEFT JOIN mv t ON t.edge_id = u.edge_id AND t.act = p.act
   WHERE p.tbl = 'paths' AND NOT (s.act IS NOT NULL AND (p.made OR (u.edge_id IS NOT NULL AND t.act IS NULL))) GROUP BY 1
  UNION ALL SELECT e.row_key, coalesce(b.by_path, i.via) FROM ops e LEFT JOIN bp b ON b.edge_id = e.edge_id AND b.act = e.act LEFT JOIN inn i ON i.node_uuid = e.parent_uuid AND i.act = e.act WHERE e.tbl = 'edges'
  UNION ALL SELECT m.row_key, i.via FROM ops m JOIN inn i ON i.node_uuid = m.node_uuid AND i.act = '-' WHERE m.tbl = 'memories' AND (m.gone OR (m.was_active AND NOT m.made AND NOT m.is_active AND m.node_uuid NOT IN (SELECT node_uuid FROM ops WHERE tbl = 'memories' AND made AND is_active)))
  UNION ALL SELECT n.row_key, i.via FROM ops n JOIN inn i ON i.node_uuid = n.node_uuid AND i.act = n.act WHERE n.tbl = 'nodes'),
ca AS (SELECT * FROM cs WHERE cause IS NOT NULL AND cause <> row_key),
wk AS (SELECT row_key, row_key AS at FROM ops UNION ALL SELECT wk.row_key, ca.cause FROM wk JOIN ca ON ca.row_key = wk.at),
an AS (SELECT wk.row_key, n.node FROM wk JOIN nd n ON n.row_key = wk.at WHERE wk.at NOT IN (SELECT row_key FROM ca))
"""


def changed(g):
    """The same change set from the projected tables."""
    none = lambda kind: F.lit(None).cast(kind)
    gone = g.table("customer").where("c_custkey % 10 = 3").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("u"), (F.lit(3_000_000_000) + F.col("c_custkey").cast("long")).alias("eid"))

    def row(df, tbl, key, node, edge=None, parent=None, at=False, made=False, lost=False, was=None, now=None):
        cols = [F.concat(F.lit(f"{tbl}:"), key), F.lit(tbl), node, edge if edge is not None else none("long"), parent if parent is not None else none("string")]
        cols += [F.col(c) if at else none("string") for c in ("namespace", "domain", "path")] + [F.lit(made) if isinstance(made, bool) else made, F.lit(lost) if isinstance(lost, bool) else lost, F.lit(was).cast("boolean"), F.lit(now).cast("boolean")]
        return df.select(*[c.alias(n.split()[0]) for c, n in zip(cols, V.CHANGE.split(", "), strict=True)])

    u = gone.select("u")
    e = g.edges.select("id", "parent_uuid", "child_uuid")
    below = e.join(u, F.col("parent_uuid") == F.col("u"), "left_semi")
    own = e.join(gone, F.col("id") == F.col("eid"), "left_semi")
    ce = own.unionByName(below.where("id % 2 = 0"))
    touched = e.join(u, F.col("child_uuid") == F.col("u"), "left_semi").unionByName(below).select(F.col("id").alias("edge_id")).distinct()
    cp = g.paths.where("domain = 'core' and namespace = ''").join(touched, "edge_id", "left_semi")
    pk = F.concat_ws("|", "namespace", "domain", "path")
    lost = u.unionAll(ce.select("child_uuid")).distinct()
    m = g.active.join(lost, F.col("node_uuid") == F.col("u"), "left_semi")
    new = g.active.join(ce.select("child_uuid").distinct(), F.col("node_uuid") == F.col("child_uuid"), "left_semi").where("id % 7 = 0")
    me = e.where("id between 5000000000 and 5999999999")
    text = lambda c: F.col(c).cast("string")
    parts = [
        row(gone, "nodes", F.col("u"), F.col("u"), lost=True), row(ce, "edges", text("id"), F.col("child_uuid"), F.col("id"), F.col("parent_uuid"), lost=True),
        row(me, "edges", text("id"), F.col("child_uuid"), F.col("id"), F.col("parent_uuid"), made=True), row(cp, "paths", pk, F.when(F.col("edge_id") % 3 != 0, F.col("node_uuid")), F.col("edge_id"), at=True, lost=True),
        row(g.paths.where("domain = 'urgent'"), "paths", pk, F.col("node_uuid"), F.col("edge_id"), at=True, made=True), row(m, "memories", text("id"), F.col("node_uuid"), lost=F.col("id") % 4 == 0, was=True, now=False),
        row(new, "memories", F.concat(F.lit("-"), text("id")), F.col("node_uuid"), made=True, now=True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("c9_row_nodes", CHANGED + "SELECT row_key, node FROM nd")
def c9(g):
    return V.node_of(changed(g), g.edges).select("row_key", "node")


@query("c10_anchors", CHANGED + "SELECT row_key, node FROM an")
def c10(g):
    return V.anchors(changed(g), g.edges)


@query("c12_review_groups", CHANGED + """, rk AS (SELECT an.node AS node_uuid, ch.tbl, ch.made, ch.gone, CASE ch.tbl WHEN 'nodes' THEN 5 WHEN 'memories' THEN 4 WHEN 'edges' THEN 3 WHEN 'paths' THEN 2 ELSE 1 END AS r FROM ch JOIN an USING (row_key) WHERE an.node IS NOT NULL),
tp AS (SELECT *, max(r) OVER (PARTITION BY node_uuid) AS best FROM rk),
gr AS (SELECT node_uuid, max(CASE WHEN r = best THEN tbl END) AS top_table, CASE WHEN bool_and(made) FILTER (r = best) THEN 'created' WHEN bool_and(gone) FILTER (r = best) THEN 'deleted' ELSE 'modified' END AS action, count(*) AS row_count FROM tp GROUP BY 1),
pu AS (SELECT node, 0 AS k, domain || '://' || path AS uri, namespace FROM nd WHERE tbl = 'paths' UNION ALL SELECT node_uuid, 1, domain || '://' || path, namespace FROM paths),
sh AS (SELECT node, arg_min(uri, (k, uri)) AS uri, array_to_string(list_sort(list(DISTINCT namespace)), ',') AS namespaces FROM pu GROUP BY 1)
SELECT g.node_uuid, coalesce(sh.uri, '[unmapped]/' || g.node_uuid) AS display_uri, top_table, action, row_count, namespaces FROM gr g LEFT JOIN sh ON sh.node = g.node_uuid""")
def c12(g):
    return V.groups(changed(g), g.edges, g.paths)


@query("c15_approved", CHANGED + "SELECT row_key, node, CASE WHEN node LIKE 'c-%' THEN 'approved' ELSE 'pending' END AS pool, NULL::BIGINT AS revision_id FROM an")
def c15(g):
    return V.approve(changed(g), g.edges, g.nodes.where("uuid like 'c-%'").select(F.col("uuid").alias("node")), 7)


@query("c15_committed", CHANGED + "SELECT row_key, node, 'committed' AS pool, 8::BIGINT AS revision_id FROM an")
def c15b(g):
    return V.approve(changed(g), g.edges, g.nodes.select(F.col("uuid").alias("node")), 7)


@query("m6_restore_path", """, rq AS (SELECT row_number() OVER (ORDER BY namespace, domain, path) AS seq, namespace, 'old' AS domain, path, CASE WHEN edge_id % 11 = 0 THEN 'x-' || edge_id ELSE node_uuid END AS node_uuid FROM paths WHERE namespace = '' AND domain = 'core'
 UNION ALL SELECT -1, '', 'core', '', 'c-1' UNION ALL SELECT -2, '', 'core', 'ASIA', 'r-2' UNION ALL SELECT -3 - o_orderkey, '', 'core', 'ASIA/back_' || o_orderkey, 'o-' || o_orderkey FROM ord),
pr AS (SELECT r.*, CASE WHEN contains(path, '/') THEN coalesce((SELECT p.node_uuid FROM paths p WHERE p.namespace = r.namespace AND p.domain = r.domain AND p.path = regexp_replace(r.path, '/[^/]*$', '')), 'ROOT') ELSE 'ROOT' END AS parent_uuid FROM rq r),
ve AS (SELECT node_uuid AS m, arg_max(id, (created_at, id)) AS latest, bool_or(NOT deprecated) AS act FROM memories GROUP BY 1),
ee AS (SELECT parent_uuid AS p, child_uuid AS c, min(id) AS edge_id FROM edges GROUP BY ALL)
SELECT seq, pr.namespace, pr.domain, pr.path, pr.node_uuid, pr.parent_uuid, regexp_extract(pr.path, '[^/]*$') AS name, ee.edge_id, CASE WHEN NOT act THEN latest END AS reactivated,
 CASE WHEN pr.path = '' THEN 'root' WHEN n.uuid IS NULL THEN 'no node' WHEN latest IS NULL THEN 'no memory' WHEN t.path IS NOT NULL THEN 'taken' ELSE 'ok' END AS status
FROM pr LEFT JOIN nodes n ON n.uuid = pr.node_uuid LEFT JOIN ve ON ve.m = pr.node_uuid LEFT JOIN ee ON ee.p = pr.parent_uuid AND ee.c = pr.node_uuid LEFT JOIN paths t ON t.namespace = pr.namespace AND t.domain = pr.domain AND t.path = pr.path""")
def m6(g):
    from ..operators.mutations import numbered

    old = g.paths.where("namespace = '' and domain = 'core'").select("namespace", "domain", "path", F.when(F.col("edge_id") % 11 == 0, F.concat(F.lit("x-"), F.col("edge_id").cast("string"))).otherwise(F.col("node_uuid")).alias("node_uuid"))
    old = numbered(old, g.spark.createDataFrame([(0,)], "seq long"), "seq", "namespace", "domain", "path").withColumn("domain", F.lit("old"))
    some = g.spark.createDataFrame([(-1, "", "core", "", "c-1"), (-2, "", "core", "ASIA", "r-2")], "seq long, namespace string, domain string, path string, node_uuid string")
    k = F.col("o_orderkey").cast("string")
    back = g.orders.select((-3 - F.col("o_orderkey")).cast("long").alias("seq"), F.lit("").alias("namespace"), F.lit("core").alias("domain"), F.concat(F.lit("ASIA/back_"), k).alias("path"), F.concat(F.lit("o-"), k).alias("node_uuid"))
    req = old.unionByName(some).unionByName(back).withColumns({"parent_uuid": F.lit(None).cast("string"), "priority": F.lit(0), "disclosure": F.lit(None).cast("string")})
    return X.restore_paths(g.nodes, g.memories, g.edges, g.paths, req)


@query("m9_restore_orphan", """, rq AS (SELECT id AS seq, id AS memory_id, '' AS namespace, 'core' AS domain, CASE id % 3 WHEN 0 THEN 'ASIA/m' || id WHEN 1 THEN 'top' || id ELSE 'no/such/m' || id END AS path FROM memories
 UNION ALL SELECT -1, 5, '', 'core', 'ASIA' UNION ALL SELECT -2, min(id), '', 'core', 'ASIA' FROM memories UNION ALL SELECT -3, min(id), '', 'core', '' FROM memories UNION ALL SELECT -4, 1000000000000 + r_regionkey, '', 'core', 'ASIA/CHINA/loop' FROM region WHERE r_name = 'ASIA'),
pr AS (SELECT r.*, CASE WHEN contains(path, '/') THEN (SELECT p.node_uuid FROM paths p WHERE p.namespace = r.namespace AND p.domain = r.domain AND p.path = regexp_replace(r.path, '/[^/]*$', '')) ELSE 'ROOT' END AS parent_uuid FROM rq r)
SELECT seq, pr.memory_id, m.node_uuid, pr.namespace, pr.domain, pr.path, pr.parent_uuid, CASE WHEN pr.path = '' THEN 'no path' WHEN m.id IS NULL THEN 'no memory' WHEN pr.parent_uuid IS NULL THEN 'no parent' WHEN t.path IS NOT NULL THEN 'taken' WHEN m.migrated_to IS NOT NULL THEN 'superseded' WHEN seq = -4 OR (m.node_uuid = pr.parent_uuid) THEN 'cycle' ELSE 'ok' END AS status
FROM pr LEFT JOIN memories m ON m.id = pr.memory_id LEFT JOIN paths t ON t.namespace = pr.namespace AND t.domain = pr.domain AND t.path = pr.path""")
def m9(g):
    i = F.col("id").cast("string")
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("ASIA/m"), i)).when(F.col("id") % 3 == 1, F.concat(F.lit("top"), i)).otherwise(F.concat(F.lit("no/such/m"), i))
    at = lambda df, seq, mem, path: df.select(seq.cast("long").alias("seq"), mem.cast("long").alias("memory_id"), F.lit("").alias("namespace"), F.lit("core").alias("domain"), path.alias("path"))
    low = g.memories.agg(F.min("id").alias("id"))
    req = at(g.memories, F.col("id"), F.col("id"), path).unionAll(at(g.spark.range(1), F.lit(-1), F.lit(5), F.lit("ASIA"))).unionAll(at(low, F.lit(-2), F.col("id"), F.lit("ASIA"))).unionAll(at(low, F.lit(-3), F.col("id"), F.lit("")))
    req = req.unionAll(at(g.table("region").where("r_name = 'ASIA'"), F.lit(-4), F.lit(1_000_000_000_000) + F.col("r_regionkey"), F.lit("ASIA/CHINA/loop")))
    return X.restore_orphans(g.memories, g.edges, g.paths, req)


@query("m10_delete_nodes", """, a AS (SELECT 'c-' || c_custkey AS u FROM customer WHERE c_custkey % 4 = 1), e AS (SELECT id, child_uuid FROM edges WHERE parent_uuid IN (SELECT u FROM a) OR child_uuid IN (SELECT u FROM a)),
tp AS (SELECT DISTINCT namespace, domain, path FROM paths WHERE edge_id IN (SELECT id FROM e)),
ps AS (SELECT p.*, unnest(generate_series(1, len(string_split(path, '/')))) AS k FROM paths p),
pp AS (SELECT DISTINCT ps.namespace, ps.domain, ps.path, ps.node_uuid FROM ps JOIN tp ON ps.namespace = tp.namespace AND ps.domain = tp.domain AND array_to_string(string_split(ps.path, '/')[1:k], '/') = tp.path)
SELECT 'nodes' AS tbl, uuid AS pk, uuid AS node_uuid FROM nodes WHERE uuid IN (SELECT u FROM a) UNION ALL SELECT 'memories', CAST(id AS VARCHAR), node_uuid FROM memories WHERE node_uuid IN (SELECT u FROM a)
UNION ALL SELECT 'edges', CAST(id AS VARCHAR), child_uuid FROM e UNION ALL SELECT 'paths', namespace || '|' || domain || '|' || path, node_uuid FROM pp UNION ALL SELECT 'glossary_keywords', keyword || '|' || node_uuid || '|' || namespace, node_uuid FROM glossary WHERE node_uuid IN (SELECT u FROM a)""")
def m10(g):
    a = g.table("customer").where("c_custkey % 4 = 1").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("node_uuid"))
    return X.delete_nodes(g.nodes, g.memories, g.edges, g.paths, g.glossary, a.unionAll(g.spark.createDataFrame([("ROOT",)], a.schema)))


@query("m25_edit", """, r AS (SELECT id, content, id % 9 AS k FROM memories)
SELECT id, CASE k WHEN 0 THEN replace(content, 'quantity', 'amount') WHEN 1 THEN content || chr(10) || 'more' WHEN 2 THEN 'first line' ELSE content END AS content,
 CASE k WHEN 0 THEN CASE WHEN contains(content, 'quantity') THEN 'ok' ELSE 'not found' END WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'out of range' WHEN 4 THEN 'nothing' WHEN 5 THEN 'several ways' WHEN 6 THEN 'incomplete' WHEN 7 THEN 'empty' ELSE 'same' END AS status FROM r""")
def m25(g):
    k = F.col("id") % 9
    text = lambda v: F.lit(v).cast("string")
    old = F.when(k == 0, "quantity").when(k == 5, "x").when(k == 6, "part").when(k == 8, "line")
    new = F.when(k == 0, "amount").when(k == 5, "y").when(k == 8, "line")
    appended = F.when(k == 1, "\nmore").when(k == 5, "z").when(k == 7, "")
    line = F.when(k == 2, 1).when(k == 3, 2)
    return X.edited(g.memories.select("id", "content", old.alias("old"), new.alias("new"), appended.alias("appended"), line.alias("line"), F.when(line.isNotNull(), text("first line")).alias("line_content")))


@query("g1_bind", """, rq AS (SELECT id AS seq, keyword, CASE WHEN id % 3 = 0 THEN 'x-' || id WHEN id % 3 = 1 THEN node_uuid ELSE 'r-1' END AS node_uuid, namespace FROM glossary UNION ALL SELECT -1, '', 'r-1', '')
SELECT seq, r.keyword, r.node_uuid, r.namespace, CASE WHEN r.keyword = '' THEN 'empty' WHEN n.uuid IS NULL THEN 'no node' WHEN g.id IS NOT NULL THEN 'bound' ELSE 'ok' END AS status
FROM rq r LEFT JOIN nodes n ON n.uuid = r.node_uuid LEFT JOIN glossary g ON g.keyword = r.keyword AND g.node_uuid = r.node_uuid AND g.namespace = r.namespace""")
def g1(g):
    i = F.col("id")
    node = F.when(i % 3 == 0, F.concat(F.lit("x-"), i.cast("string"))).when(i % 3 == 1, F.col("node_uuid")).otherwise(F.lit("r-1"))
    req = g.glossary.select(i.cast("long").alias("seq"), F.concat(F.lit(" "), "keyword", F.lit("\n")).alias("keyword"), node.alias("node_uuid"), "namespace")
    return X.bind_keywords(g.glossary, g.nodes, req.unionAll(g.spark.createDataFrame([(-1, " \t", "r-1", "")], req.schema)))


@query("g2_unbind", """, rq AS (SELECT id AS seq, keyword, node_uuid, namespace FROM glossary UNION ALL SELECT -id, keyword, 'r-1', namespace FROM glossary)
SELECT seq, r.keyword, r.node_uuid, r.namespace, g.id AS removed FROM rq r LEFT JOIN glossary g ON g.keyword = r.keyword AND g.node_uuid = r.node_uuid AND g.namespace = r.namespace""")
def g2(g):
    i = F.col("id").cast("long")
    req = g.glossary.select(i.alias("seq"), "keyword", "node_uuid", "namespace").unionAll(g.glossary.select(-i, "keyword", F.lit("r-1"), "namespace"))
    return X.unbind_keywords(g.glossary, req)


@query("v5_glossary_index", """, u AS (SELECT g.keyword, d.uri FROM glossary g JOIN docs d ON d.node_uuid = g.node_uuid)
SELECT keyword, '- ' || keyword || chr(10) || string_agg('  -> ' || uri, chr(10) ORDER BY uri) || chr(10) AS entry FROM u GROUP BY keyword""")
def v5(g):
    """The glossary's index: each keyword with the addresses it leads to; keywords without any are left out."""
    u = g.glossary.join(g.documents.select("node_uuid", "uri"), "node_uuid").groupBy("keyword").agg(F.array_sort(F.collect_list("uri")).alias("uris"))
    rows = F.array_join(F.transform("uris", lambda x: F.concat(F.lit("  -> "), x)), "\n")
    return u.select("keyword", F.concat(F.lit("- "), "keyword", F.lit("\n"), rows, F.lit("\n")).alias("entry"))


@query("v1_node_view", """, kw AS (SELECT node_uuid, string_agg(keyword, ', ' ORDER BY keyword) AS words FROM glossary GROUP BY 1),
kd AS (SELECT s.namespace, s.domain, s.path, string_agg('- ' || c.domain || '://' || c.path || CASE WHEN c.disclosure IS NOT NULL THEN ' (' || c.disclosure || ')' ELSE '' END, chr(10) ORDER BY c.priority, c.path) AS kids
  FROM star s JOIN star c ON c.parent_uuid = s.node_uuid AND c.namespace = s.namespace AND c.domain = s.domain AND starts_with(c.path, s.path || '/') GROUP BY ALL)
SELECT s.namespace, s.domain, s.path, '# [' || s.domain || '://' || s.path || ']' || CASE WHEN s.world_timestamp IS NOT NULL THEN chr(10) || '> (发生于: ' || s.world_timestamp || ')' ELSE '' END
 || CASE WHEN s.disclosure IS NOT NULL THEN chr(10) || '> (想起条件: ' || s.disclosure || ')' ELSE '' END || CASE WHEN words IS NOT NULL THEN chr(10) || '> (标签: ' || words || ')' ELSE '' END
 || chr(10) || chr(10) || '---' || chr(10) || chr(10) || s.content || chr(10) || CASE WHEN kids IS NOT NULL THEN chr(10) || '---' || chr(10) || '更深层的记忆:' || chr(10) || chr(10) || kids ELSE '' END AS view
FROM star s LEFT JOIN kw ON kw.node_uuid = s.node_uuid LEFT JOIN kd ON kd.namespace = s.namespace AND kd.domain = s.domain AND kd.path = s.path""")
def v1(g):
    """Every path's memory as a page: address, world time, condition, keywords, content and the entries below."""
    words = g.glossary.groupBy(F.col("node_uuid").alias("n")).agg(F.array_join(F.array_sort(F.collect_list("keyword")), ", ").alias("words"))
    low = g.star.select("namespace", "domain", F.col("parent_uuid").alias("node_uuid"), F.col("path").alias("c_path"), "priority", F.concat(F.lit("- "), "domain", F.lit("://"), "path", F.when(F.col("disclosure").isNotNull(), F.concat(F.lit(" ("), "disclosure", F.lit(")"))).otherwise("")).alias("line"))
    kids = g.star.select("namespace", "domain", "path", "node_uuid").join(low, ["namespace", "domain", "node_uuid"]).where(F.col("c_path").startswith(F.concat(F.col("path"), F.lit("/"))))
    # blocks of lines first: a node with very many entries is joined once, from sorted parts
    kids = kids.groupBy("namespace", "domain", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "c_path", "line"))), lambda x: x["line"]), "\n").alias("kids"))
    note = lambda c, head: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n> ({head}: "), c, F.lit(")"))).otherwise("")
    below = F.when(F.col("kids").isNotNull(), F.concat(F.lit("\n---\n更深层的记忆:\n\n"), "kids")).otherwise("")
    got = g.star.join(words, F.col("node_uuid") == F.col("n"), "left").join(kids, ["namespace", "domain", "path"], "left")
    view = F.concat(F.lit("# ["), "domain", F.lit("://"), "path", F.lit("]"), note("world_timestamp", "发生于"), note("disclosure", "想起条件"), note("words", "标签"), F.lit("\n\n---\n\n"), "content", F.lit("\n"), below)
    return got.select("namespace", "domain", "path", view.alias("view"))


#: Urgent orders are created in the change set; the paths of some of them were deleted again.
_ZERO = """, zr AS (SELECT *, edge_id % 4 = 0 AS nil FROM paths WHERE domain = 'urgent'),
zz(row_key, tbl, node_uuid, edge_id, nil, made) AS (SELECT 'paths:' || path, 'paths', node_uuid, edge_id, nil, true FROM zr UNION ALL SELECT 'edges:' || edge_id, 'edges', node_uuid, edge_id, false, true FROM zr
 UNION ALL SELECT 'nodes:' || node_uuid, 'nodes', node_uuid, NULL, false, edge_id % 3 <> 0 FROM zr UNION ALL SELECT 'memories:' || a.id, 'memories', a.node_uuid, NULL, false, true FROM active a JOIN zr ON zr.node_uuid = a.node_uuid),
rc AS (SELECT DISTINCT node_uuid FROM zz WHERE tbl = 'paths' AND NOT nil), nw AS (SELECT node_uuid FROM zz WHERE tbl = 'nodes' AND made)
"""


def zeroed(g):
    p = g.paths.where("domain = 'urgent'").select("node_uuid", "edge_id", "path", (F.col("edge_id") % 4 == 0).alias("nil"))
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, tbl, key, edge, made, gone: df.select(F.concat(F.lit(f"{tbl}:"), key).alias("row_key"), F.lit(tbl).alias("tbl"), "node_uuid", edge.alias("edge_id"), none("string").alias("parent_uuid"), none("string").alias("namespace"), none("string").alias("domain"), none("string").alias("path"), made.alias("made"), gone.alias("gone"), none("boolean").alias("was_active"), none("boolean").alias("is_active"))
    yes, no = F.lit(True), F.lit(False)
    m = g.active.join(p.select("node_uuid"), "node_uuid", "left_semi")
    out = row(p, "paths", F.col("path"), F.col("edge_id"), yes, F.col("nil")).unionByName(row(p, "edges", F.col("edge_id").cast("string"), F.col("edge_id"), yes, no))
    return out.unionByName(row(p, "nodes", F.col("node_uuid"), none("long"), F.col("edge_id") % 3 != 0, no)).unionByName(row(m, "memories", F.col("id").cast("string"), none("long"), yes, no))


@query("c4_no_op_rows", _ZERO + """SELECT row_key, tbl FROM zz WHERE NOT nil AND NOT (made AND CASE tbl WHEN 'nodes' THEN node_uuid NOT IN (SELECT node_uuid FROM rc)
 WHEN 'memories' THEN node_uuid IN (SELECT node_uuid FROM nw) AND node_uuid NOT IN (SELECT node_uuid FROM rc) WHEN 'edges' THEN edge_id NOT IN (SELECT edge_id FROM zz WHERE tbl = 'paths' AND NOT nil) ELSE false END)""")
def c4(g):
    return V.net_zero(zeroed(g)).select("row_key", "tbl")


@query("c7_old_keys", "SELECT 'paths:' || coalesce(nullif(namespace, 'ns_building'), '') || '|' || domain || '|' || path AS row_key, coalesce(nullif(namespace, 'ns_building'), '') AS namespace FROM paths")
def c7(g):
    """Rows of old change sets without a namespace get the empty one, and their keys with it."""
    old = g.paths.withColumn("namespace", F.when(F.col("namespace") != "ns_building", F.col("namespace")))
    fixed = old.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    return fixed.select(F.concat(F.lit("paths:"), F.concat_ws("|", "namespace", "domain", "path")).alias("row_key"), "namespace")


@query("c13_difference", CHANGED + """, mi AS (SELECT an.node, ch.*, CASE WHEN tbl = 'memories' THEN CAST(substr(row_key, 10) AS BIGINT) END AS mid FROM ch JOIN an USING (row_key) WHERE an.node IS NOT NULL),
pe AS (SELECT node, max(CASE WHEN tbl = 'memories' AND was_active THEN mid END) AS b, max(CASE WHEN tbl = 'memories' AND NOT gone AND is_active THEN mid END) AS a, bool_or(tbl IN ('nodes', 'memories') AND node_uuid = node AND made) AS born, bool_or(tbl IN ('nodes', 'memories') AND node_uuid = node AND gone) AS died FROM mi GROUP BY 1)
SELECT pe.node AS node_uuid, CASE WHEN b IS NOT NULL THEN mb.content WHEN NOT coalesce(born, false) THEN lv.content END AS before, CASE WHEN a IS NOT NULL THEN ma.content WHEN NOT coalesce(died, false) THEN lv.content END AS after
FROM pe LEFT JOIN memories mb ON mb.id = pe.b LEFT JOIN memories ma ON ma.id = pe.a LEFT JOIN active lv ON lv.node_uuid = pe.node""")
def c13(g):
    return V.difference(changed(g), g.edges, g.memories)


@query("c14_rollback", CHANGED + """, mi AS (SELECT an.node, ch.*, len(string_split(path, '/')) AS deep, bool_or(tbl = 'nodes' AND made) OVER (PARTITION BY an.node) AS fresh FROM ch JOIN an USING (row_key) WHERE an.node IS NOT NULL),
ac AS (SELECT *, CASE WHEN tbl = 'paths' AND made THEN 1 WHEN tbl = 'paths' AND gone THEN 2 WHEN tbl = 'memories' AND was_active THEN 3 END AS k FROM mi WHERE NOT fresh)
SELECT node, row_number() OVER (PARTITION BY node ORDER BY k, CASE k WHEN 1 THEN -deep WHEN 2 THEN deep ELSE 0 END, row_key) AS step, row_key, CASE k WHEN 1 THEN 'remove path' WHEN 2 THEN 'restore path' ELSE 'restore version' END AS action FROM ac WHERE k IS NOT NULL""")
def c14(g):
    return V.rollback(changed(g), g.edges)


@query("c18_checkout_images", """, rev AS (SELECT DISTINCT o_orderkey AS id, o_custkey, o_orderdate FROM orders WHERE o_orderkey > 0), pa AS (SELECT id, CASE WHEN id > 1 THEN (SELECT max(b.id) FROM rev b WHERE b.id <= a.id // 2) END AS parent_id FROM rev a),
hd AS (SELECT max(id) AS h FROM rev), up AS (SELECT h AS id, 0 AS depth FROM hd UNION ALL SELECT pa.parent_id, up.depth + 1 FROM up JOIN pa ON pa.id = up.id WHERE pa.parent_id IS NOT NULL),
un AS (SELECT 'c-' || o_custkey % 5 AS row_key, arg_min('at ' || rev.id, depth) AS before, min(depth) AS d FROM up JOIN rev ON rev.id = up.id GROUP BY 1)
SELECT up.id AS target, row_key, before FROM up JOIN un ON un.d < up.depth""")
def c18(g):
    """Going back from the newest revision to each one above it; a revision's parent is the last one of at most half its number."""
    from pyspark.sql import Window

    o = g.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("id"), "o_custkey").distinct()
    half = o.select((F.floor(F.col("id") / 2)).alias("k"), "id").unionAll(o.select(F.col("id").alias("k"), F.lit(None).cast("long")))
    w = Window.partitionBy(F.floor(F.log2(F.greatest(F.col("k"), F.lit(1))))).orderBy("k", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = half.withColumn("mine", F.max(F.when(F.col("id").isNull(), F.col("k"))).over(w))
    tops = o.groupBy(F.floor(F.log2(F.greatest(F.col("id"), F.lit(1)))).alias("band")).agg(F.max("id").alias("top"))
    last = last.where("id is not null").withColumn("band", F.floor(F.log2(F.greatest(F.col("k"), F.lit(1)))))
    below = last.where("mine is null").join(tops.withColumnRenamed("band", "b"), F.col("b") < F.col("band")).groupBy("id").agg(F.max("top").alias("mine"))
    parent = last.where("mine is not null").select("id", "mine").unionByName(below.select("id", "mine")).where("id > 1 and mine < id")
    revisions = o.select("id").join(parent, "id", "left").select("id", F.col("mine").alias("parent_id"))
    writes = o.select("id", F.concat(F.lit("c-"), (F.col("o_custkey") % 5).cast("string")).alias("row_key"), F.concat(F.lit("at "), F.col("id").cast("string")).alias("before"))
    return V.checkout(revisions, writes, o.agg(F.max("id").alias("origin")))


@query("m21_merge", """, rq AS (SELECT 'core://merged/' || (o_custkey % 97) AS target, p.namespace, p.domain, CASE WHEN p.edge_id % 50 = 7 THEN path || '_gone' ELSE path END AS path FROM paths p JOIN ord ON p.edge_id = 4000000000 + o_orderkey WHERE o_orderkey % 3 = 0),
g AS (SELECT rq.target, s.node_uuid FROM rq LEFT JOIN (SELECT DISTINCT namespace, domain, path, node_uuid FROM star) s USING (namespace, domain, path))
SELECT target, count(*) AS sources, count(node_uuid) AS found, '' AS keywords, CASE WHEN count(*) < 2 THEN 'too few' WHEN count(node_uuid) < count(*) THEN 'missing' ELSE 'ok' END AS status FROM g GROUP BY 1""")
def m21(g):
    o = g.orders.where("o_orderkey % 3 = 0").select((F.lit(4_000_000_000) + F.col("o_orderkey")).alias("edge_id"), F.concat(F.lit("core://merged/"), (F.col("o_custkey") % 97).cast("string")).alias("target"))
    req = g.paths.join(o, "edge_id").select("target", "namespace", "domain", F.when(F.col("edge_id") % 50 == 7, F.concat("path", F.lit("_gone"))).otherwise(F.col("path")).alias("path"))
    return X.merge(g.star, g.glossary, req)


@query("m24_remember", """, rq AS (SELECT edge_id AS seq, namespace, domain, path AS parent_path, CASE edge_id % 5 WHEN 0 THEN 'bad title' ELSE 'child' END AS title, CASE WHEN edge_id % 7 = 0 THEN ' ' ELSE 'when asked' END AS disclosure, CASE WHEN edge_id % 11 = 0 THEN '2024-05-05' END AS time FROM paths WHERE domain = 'urgent'
 UNION ALL SELECT -1, '', 'core', '', 'topmost', NULL, NULL)
SELECT seq, r.namespace, r.domain, CASE WHEN parent_path = '' THEN title ELSE parent_path || '/' || title END AS path, CASE WHEN parent_path = '' THEN 'ROOT' ELSE p.node_uuid END AS parent_uuid, title AS name, 'text' AS content, 5 AS priority, disclosure,
 coalesce(time, CASE WHEN parent_path <> '' THEN a.world_timestamp END, '2000-01-01') AS world_timestamp, CASE WHEN parent_path <> '' AND trim(coalesce(disclosure, '')) = '' THEN 'no condition' WHEN title = 'bad title' THEN 'bad title' ELSE 'ok' END AS status
FROM rq r LEFT JOIN paths p ON p.namespace = r.namespace AND p.domain = r.domain AND p.path = r.parent_path LEFT JOIN active a ON a.node_uuid = p.node_uuid""")
def m24(g):
    e = F.col("edge_id")
    text = lambda x: F.lit(x).cast("string")
    req = g.paths.where("domain = 'urgent'").select(e.alias("seq"), "namespace", "domain", F.col("path").alias("parent_path"), F.when(e % 5 == 0, "bad title").otherwise("child").alias("title"), text("text").alias("content"), F.lit(5).alias("priority"), F.when(e % 7 == 0, " ").otherwise("when asked").alias("disclosure"), F.when(e % 11 == 0, "2024-05-05").alias("time"))
    top = g.spark.createDataFrame([(-1, "", "core", "", "topmost", "text", 5, None, None)], "seq long, namespace string, domain string, parent_path string, title string, content string, priority int, disclosure string, time string")
    return X.remember(g.paths, g.edges, g.memories, req.unionAll(top), "2000-01-01")


@query("w13_orphans", "SELECT id, node_uuid, row_number() OVER (PARTITION BY node_uuid ORDER BY id) AS k FROM memories WHERE deprecated")
def w13(g):
    from pyspark.sql import Window

    return g.memories.where("deprecated").select("id", "node_uuid", F.row_number().over(Window.partitionBy("node_uuid").orderBy("id")).cast("long").alias("k"))


@query("v9_boot_lines", """, l AS (SELECT parent_uuid AS block, domain || '://' || path AS uri FROM star WHERE namespace = ''), f AS (SELECT domain || '://' || path AS uri FROM paths WHERE node_uuid LIKE 'c-%1' OR node_uuid LIKE 'n-%') SELECT block, '- ' || uri AS line FROM l WHERE uri NOT IN (SELECT uri FROM f)""")
def v9(g):
    """Entries of a start page whose addresses are not shown in full on it."""
    from ..functions import text as T

    uri = T.uri_of(F.col("domain"), F.col("path")).alias("uri")
    full = g.paths.where("node_uuid like 'c-%1' or node_uuid like 'n-%'").select(uri)
    lines = g.star.where("namespace = ''").select(F.col("parent_uuid").alias("block"), uri)
    return lines.join(full, "uri", "left_anti").select("block", F.concat(F.lit("- "), "uri").alias("line"))


@query("g8_occurrences")
def g8(g):
    """Where each document's glossary keywords are marked: leftmost, then longest, without overlaps."""
    from ..functions.udfs import occurrences
    from ..operators import search as S

    words = S.glossary_hits(g.documents, g.glossary).groupBy("doc_id").agg(F.array_sort(F.collect_set("keyword")).alias("words"))
    d = g.documents.select("doc_id", "content").join(words, "doc_id")
    return d.select("doc_id", F.explode(occurrences("content", "words")).alias("x")).select("doc_id", F.col("x.start").alias("start"), F.col("x.keyword").alias("keyword"))


@query("m14_edges", """, rq AS (SELECT id AS seq, parent_uuid, child_uuid, 'again' AS name, 1 AS priority FROM edges UNION ALL SELECT -id, 'r-1', child_uuid, name, priority FROM edges WHERE child_uuid LIKE 'o-%'),
th AS (SELECT parent_uuid, child_uuid, arg_min(id, id) AS id, arg_min(name, id) AS name, arg_min(priority, id) AS priority FROM edges GROUP BY ALL),
fr AS (SELECT parent_uuid, child_uuid, arg_min(name, seq) AS name, arg_min(priority, seq) AS priority FROM rq WHERE (parent_uuid, child_uuid) NOT IN (SELECT (parent_uuid, child_uuid) FROM th) GROUP BY ALL),
nw AS (SELECT *, (SELECT max(id) FROM edges) + row_number() OVER (ORDER BY parent_uuid, child_uuid) AS id FROM fr)
SELECT seq, parent_uuid, child_uuid, x.id, x.name, x.priority, created FROM rq JOIN (SELECT parent_uuid, child_uuid, id, name, priority, false AS created FROM th UNION ALL SELECT parent_uuid, child_uuid, id, name, priority, true FROM nw) x USING (parent_uuid, child_uuid)""")
def m14(g):
    again = g.edges.select(F.col("id").alias("seq"), "parent_uuid", "child_uuid", F.lit("again").alias("name"), F.lit(1).alias("priority"))
    more = g.edges.where("child_uuid like 'o-%'").select(-F.col("id"), F.lit("r-1"), "child_uuid", "name", "priority")
    return X.edges_for(g.edges, again.unionAll(more))


@query("c8_pointers", """SELECT 'memories:' || id AS row_key, '{"id":' || id || ',"node_uuid":"' || node_uuid || '","deprecated":' || deprecated || CASE WHEN migrated_to IS NOT NULL THEN ',"migrated_to":' || migrated_to ELSE '' END || '}' AS before FROM memories WHERE node_uuid LIKE 'o-%'""")
def c8(g):
    return X.pointers(g.memories, g.nodes.where("uuid like 'o-%'").select(F.col("uuid").alias("node_uuid")))


@query("q24_revisions", """, rev AS (SELECT DISTINCT o_orderkey AS id, CASE WHEN o_orderkey > 1 THEN o_orderkey // 2 END AS parent_id FROM orders WHERE o_orderkey > 0), rq AS (SELECT c_custkey AS id FROM customer)
SELECT rq.id, rev.parent_id, rev.id IS NOT NULL AS known FROM rq LEFT JOIN rev ON rev.id = rq.id""")
def q24(g):
    """Revisions by number, with their parents; an unknown number is answered as such."""
    rev = g.orders.where("o_orderkey > 0").select(F.col("o_orderkey").alias("r"), F.when(F.col("o_orderkey") > 1, F.floor(F.col("o_orderkey") / 2)).alias("parent_id")).distinct()
    return g.table("customer").select(F.col("c_custkey").alias("id")).join(rev, F.col("id") == F.col("r"), "left").select("id", "parent_id", F.col("r").isNotNull().alias("known"))


@query("w9_crowded_first", """, m AS (SELECT parent_uuid, count(DISTINCT child_uuid) AS n FROM edges GROUP BY 1 HAVING count(DISTINCT child_uuid) > 10) SELECT parent_uuid, n, row_number() OVER (ORDER BY n DESC, parent_uuid) AS place FROM m""")
def w9(g):
    """Crowded parents in the order of a report: the fullest first. Places are counted over ranges, not in one task."""
    from ..operators.mutations import numbered

    many = g.edges.groupBy("parent_uuid").agg(F.countDistinct("child_uuid").alias("n")).where("n > 10")
    return numbered(many, g.spark.createDataFrame([(0,)], "place long"), "place", F.col("n").desc(), "parent_uuid").select("parent_uuid", "n", "place")
