"""Upkeep queries: migrations, change-set files, revisions, presets, topics, start pages, draws and edits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import AS_OF, stamp
from ..functions import text as T
from ..operators import changes as C
from ..operators import upkeep as U
from ..operators.steps import shared
from ..registry import query
from ..sources import files as S
from .changes import RECORDED


@query("i5_migrated", """, dm AS (SELECT id, node_uuid, created_at, migrated_to, deprecated AND id % 4 <> 0 AS deprecated FROM memories),
s6 AS (SELECT * REPLACE (deprecated OR node_uuid NOT IN (SELECT node_uuid FROM paths) AS deprecated) FROM dm),
s7 AS (SELECT *, row_number() OVER o AS k, first_value(id) OVER o AS top FROM s6 WINDOW o AS (PARTITION BY node_uuid, deprecated ORDER BY created_at DESC, id DESC))
SELECT 'memories' AS tbl, CAST(id AS VARCHAR) AS pk, deprecated OR k > 1 AS deprecated, CASE WHEN NOT deprecated AND k > 1 THEN coalesce(migrated_to, top) ELSE migrated_to END AS migrated_to, node_uuid FROM s7
UNION ALL SELECT 'paths', namespace || '|' || domain || '|' || path, NULL, NULL, node_uuid FROM paths""")
def i5(g):
    """Three steps over tables with many active versions and paths without nodes; the fourth is recorded already."""
    m = g.memories.withColumn("deprecated", F.col("deprecated") & (F.col("id") % 4 != 0))
    p = g.paths.withColumn("node_uuid", F.when(F.col("edge_id") % 2 == 0, F.col("node_uuid")))
    # orphans are told by the nodes of paths, so the paths' nodes are known before
    steps = {"001_nodes": U.fill_path_nodes, "002_done": lambda t: {"memories": t["memories"].limit(0)}, **U.STEPS}
    t, _ = U.migrate({"memories": m, "paths": p, "edges": g.edges}, {"002_done"}, steps)
    rows = t["memories"].select(F.lit("memories").alias("tbl"), F.col("id").cast("string").alias("pk"), "deprecated", "migrated_to", "node_uuid")
    return rows.unionByName(t["paths"].select(F.lit("paths").alias("tbl"), F.concat_ws("|", "namespace", "domain", "path").alias("pk"), F.lit(None).cast("boolean").alias("deprecated"), F.lit(None).cast("long").alias("migrated_to"), "node_uuid"))


@query("i7_changeset_file", RECORDED + "SELECT * FROM rd")
def i7(g):
    """A change set written to a file of JSON lines and read back."""
    path = f"{shared(g.spark)}/changeset-{uuid.uuid4().hex}"
    rows = C.recorded(g.changes)
    S.write_json(rows, path)
    return S.read_json(g.spark, path, rows.schema)


@query("i10_glossary_file", "SELECT keyword, CASE WHEN id % 3 = 0 THEN 'src://' || id ELSE 'src://doc_' || id END AS uri FROM glossary WHERE id % 5 <> 0")
def i10_file(g):
    """Keywords with their addresses, written to a file without those that lead nowhere, and read back."""
    k = F.col("id").cast("string")
    uri = F.when(F.col("id") % 5 == 0, F.concat(F.lit("unlinked://"), k)).when(F.col("id") % 3 == 0, F.concat(F.lit("src://"), k)).otherwise(F.concat(F.lit("src://doc_"), k))
    path = f"{shared(g.spark)}/glossary-{uuid.uuid4().hex}"
    words = g.glossary.select("keyword", uri.alias("uri"))
    S.write_glossary(words.unionByName(words.select(F.concat(F.lit(" "), "keyword").alias("keyword"), "uri")), path)
    return S.read_glossary(g.spark, path)


_REVISED = RECORDED + """, cr AS (SELECT 'ns' || (CAST(substr(node_uuid, 3) AS BIGINT) % 4) AS namespace, row_key, before, after FROM rd),
rv AS (SELECT DISTINCT o_orderkey AS id, 'ns' || (o_custkey % 3) AS namespace FROM orders),
nw AS (SELECT n.namespace, h.parent_id, (SELECT max(id) FROM rv) + row_number() OVER (ORDER BY n.namespace) AS revision_id FROM (SELECT DISTINCT namespace FROM cr) n LEFT JOIN (SELECT namespace, max(id) AS parent_id FROM rv GROUP BY 1) h USING (namespace))
"""


@query("c19_commit", _REVISED + "SELECT revision_id, parent_id, namespace, row_key, CAST(to_json(struct_pack(before := before, after := after)) AS VARCHAR) AS json FROM cr JOIN nw USING (namespace)")
def c19(g):
    rows = C.recorded(g.changes).withColumn("namespace", F.concat(F.lit("ns"), (F.substring("node_uuid", 3, 20).cast("long") % 4).cast("string")))
    rev = g.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ns"), (F.col("o_custkey") % 3).cast("string")).alias("namespace")).distinct()
    return U.commit(rev, rows)


@query("m16_expired", f"SELECT id, 'old' AS why FROM logs WHERE accessed_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY UNION ALL SELECT id, 'all' FROM logs")
def m16_expired(g):
    row = lambda days, why: U.expired(g.logs, days, stamp(AS_OF)).select("id", F.lit(why).alias("why"))
    return row(7, "old").unionAll(row(0, "all"))


_PRESETS = """, pt AS (SELECT n_nationkey AS id, n_name AS name, '{"":["core://' || n_name || '"]}' AS boot_uris, n_nationkey = 7 AS is_active FROM nation),
rq AS (SELECT n_nationkey AS seq, CASE n_nationkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'duplicate' ELSE 'delete' END AS op, CASE WHEN n_nationkey % 5 = 4 THEN 900 ELSE n_nationkey END AS id,
 CASE WHEN n_nationkey % 3 = 0 THEN 'made_' || (n_nationkey % 6) WHEN n_nationkey % 3 = 1 THEN n_name ELSE 'own_' || n_nationkey END AS name FROM nation),
ea AS (SELECT rq.*, op IN ('create', 'update', 'duplicate') AS naming, CASE WHEN op <> 'create' AND p.id IS NULL THEN 'unknown' WHEN op = 'delete' AND p.is_active THEN 'active' WHEN op <> 'delete' AND o.id IS NOT NULL AND (op <> 'update' OR o.id <> rq.id) THEN 'taken' END AS early
  FROM rq LEFT JOIN pt p ON p.id = rq.id LEFT JOIN pt o ON o.name = rq.name),
st AS (SELECT *, coalesce(early, CASE WHEN naming AND row_number() OVER (PARTITION BY name, naming AND early IS NULL ORDER BY seq) > 1 THEN 'taken' ELSE 'ok' END) AS status FROM ea)
"""


def presets_of(g):
    n = g.table("nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit('{"":["core://'), "n_name", F.lit('"]}')).alias("boot_uris"), (F.col("n_nationkey") == 7).alias("is_active"))


def preset_answers(g):
    k = F.col("n_nationkey").cast("long")
    op = F.when(k % 4 == 0, "create").when(k % 4 == 1, "update").when(k % 4 == 2, "duplicate").otherwise("delete")
    name = F.when(k % 3 == 0, F.concat(F.lit("made_"), (k % 6).cast("string"))).when(k % 3 == 1, F.col("n_name")).otherwise(F.concat(F.lit("own_"), k.cast("string")))
    return U.preset_requests(presets_of(g), g.table("nation").select(k.alias("seq"), op.alias("op"), F.when(k % 5 == 4, 900).otherwise(k).alias("id"), name.alias("name")))


@query("m17_requests", _PRESETS + "SELECT seq, op, id, name, status FROM st")
def m17_requests(g):
    return preset_answers(g)


@query("m17_presets_after", _PRESETS + """, ok AS (SELECT * FROM st WHERE status = 'ok')
SELECT p.id, coalesce((SELECT arg_max(name, seq) FROM ok WHERE op = 'update' AND ok.id = p.id), p.name) AS name, p.boot_uris, p.is_active FROM pt p WHERE p.id NOT IN (SELECT id FROM ok WHERE op = 'delete')
UNION ALL SELECT (SELECT max(id) FROM pt) + row_number() OVER (ORDER BY seq), ok.name, CASE WHEN op = 'duplicate' THEN p.boot_uris ELSE '{}' END, false FROM ok LEFT JOIN pt p ON p.id = ok.id WHERE op IN ('create', 'duplicate')""")
def m17_after(g):
    return U.presets_after(presets_of(g), preset_answers(g))


@query("m18_boot_lists", """, b AS (SELECT c_custkey AS id, ['core://n' || (c_custkey % 7), 'core://n' || (c_custkey % 7) || '/x', 'core://n1x', 'core://n2/y/z'] AS u FROM customer)
SELECT id, array_to_string(list_transform(u, lambda x: CASE WHEN x = 'core://n1' THEN 'core://m' WHEN starts_with(x, 'core://n1/') THEN 'core://m/' || substr(x, 11) ELSE x END), '|') AS moved, array_to_string(list_filter(u, lambda x: x <> 'core://n2' AND NOT starts_with(x, 'core://n2/')), '|') AS cleaned,
 CASE id % 3 WHEN 0 THEN ',own' WHEN 1 THEN ',own,fresh' ELSE '' END AS namespaces FROM b""")
def m18_lists(g):
    k = F.col("c_custkey")
    n = F.concat(F.lit("core://n"), (k % 7).cast("string"))
    uris = F.array(n, F.concat(n, F.lit("/x")), F.lit("core://n1x"), F.lit("core://n2/y/z"))
    lists = F.create_map(F.lit(""), uris, F.lit("own"), uris)
    changed = F.when(k % 3 == 0, U.boot_set(lists, F.lit("own"), F.array(F.lit("core://a")))).when(k % 3 == 1, U.boot_set(lists, F.lit("fresh"), uris)).otherwise(U.boot_set(lists, F.lit("own"), F.lit(None).cast("array<string>")))
    join = lambda x: F.array_join(x, "|")
    return g.table("customer").select(k.alias("id"), join(U.rewritten(uris, F.lit("core://n1"), F.lit("core://m"))).alias("moved"), join(U.purged(uris, F.lit("core://n2"))).alias("cleaned"), F.array_join(F.map_keys(changed), ",").alias("namespaces"))


@query("m22_organise", """, rq AS (SELECT p.edge_id * 2 + (p.domain = 'core')::INT AS seq, r.r_name || CASE WHEN r.r_regionkey = 3 THEN '/no/topic' ELSE '/topic' END AS topic_path, p.domain, CASE WHEN p.edge_id % 13 = 0 THEN p.path || '_gone' ELSE p.path END AS path, CASE WHEN p.edge_id % 2 = 0 THEN 'move' ELSE 'link' END AS mode, CASE WHEN p.edge_id % 3 = 0 THEN 'noted' END AS note, 'r-' || r_regionkey AS parent
  FROM paths p JOIN region r ON r.r_regionkey = p.edge_id % 5 WHERE p.namespace = ''),
tg AS (SELECT rq.*, p.node_uuid, topic_path || '/' || regexp_extract(rq.path, '[^/]*$') AS new_path FROM rq LEFT JOIN paths p ON p.namespace = '' AND p.domain = rq.domain AND p.path = rq.path),
ea AS (SELECT *, CASE WHEN topic_path LIKE '%/no/topic' THEN 'no topic' WHEN node_uuid IS NULL THEN 'missing' WHEN node_uuid = parent THEN 'cycle' END AS early FROM tg),
st AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY new_path, early IS NULL ORDER BY seq) > 1 THEN 'taken' ELSE 'ok' END) AS status FROM ea)
SELECT seq, topic_path, domain, path, CASE WHEN status = 'ok' THEN new_path END AS new_path, CASE WHEN status = 'ok' THEN 4 END AS priority, CASE WHEN status = 'ok' THEN coalesce(note, '当说起' || regexp_extract(path, '[^/]*$') || '时') END AS disclosure, status, status = 'ok' AND mode = 'move' AS moved FROM st""")
def m22(g):
    e = F.col("edge_id")
    r = g.table("region").select("r_name", F.col("r_regionkey").cast("long").alias("r"))
    p = g.paths.where("namespace = ''").withColumn("r", e % 5).join(r, "r")
    req = p.select(
        (e * 2 + (F.col("domain") == "core").cast("int")).alias("seq"), F.lit("core").alias("topic_domain"), F.concat("r_name", F.when(F.col("r") == 3, "/no/topic").otherwise("/topic")).alias("topic_path"),
        "namespace", "domain", F.when(e % 13 == 0, F.concat("path", F.lit("_gone"))).otherwise(F.col("path")).alias("path"), F.lit(3).alias("importance"), F.when(e % 3 == 0, "noted").alias("note"), F.when(e % 2 == 0, "move").otherwise("link").alias("mode"),
    )
    return U.organise(g.paths, g.edges, g.memories, req).select("seq", "topic_path", "domain", "path", "new_path", "priority", "disclosure", "status", "moved")


_RECENT = "SELECT '{0}' AS section, CAST(k AS INT) AS k, uri, memory_id FROM (SELECT *, row_number() OVER (ORDER BY m_created DESC, node_uuid) AS k FROM (SELECT *, domain || '://' || path AS uri, row_number() OVER (PARTITION BY node_uuid ORDER BY path) AS rk FROM star WHERE namespace = '' AND domain = '{1}') WHERE rk = 1) WHERE k <= {2} AND uri NOT IN (SELECT uri FROM bt)"
_BOOT = "bt AS (SELECT k, uri FROM (SELECT row_number() OVER (ORDER BY m_created DESC, node_uuid) AS k, domain || '://' || path AS uri FROM star WHERE namespace = '' AND domain = 'urgent') WHERE k IN (1, 3) UNION ALL SELECT 100, 'core://ASIA' UNION ALL SELECT 101, 'core://NOWHERE')"


@query("v6_wakeup", f", {_BOOT} SELECT 'boot' AS section, CAST(k AS INT) AS k, bt.uri, memory_id FROM bt JOIN star s ON s.namespace = '' AND s.domain || '://' || s.path = bt.uri UNION ALL {_RECENT.format('recent', 'core', 5)} UNION ALL {_RECENT.format('scenes', 'urgent', 5)} UNION ALL {_RECENT.format('records', 'notes', 1)}")
def v6(g):
    from pyspark.sql import Window

    urgent = g.star.where("namespace = '' and domain = 'urgent'").orderBy(F.col("m_created").desc(), "node_uuid").limit(3)
    k = F.row_number().over(Window.orderBy(F.col("m_created").desc(), "node_uuid"))
    boot = urgent.select(k.alias("k"), T.uri_of(F.col("domain"), F.col("path")).alias("uri")).where("k in (1, 3)")
    boot = boot.unionAll(g.spark.createDataFrame([(100, "core://ASIA"), (101, "core://NOWHERE")], "k int, uri string"))
    return U.wakeup(g.star, boot, [("recent", "core", 5), ("scenes", "urgent", 5), ("records", "notes", 1)])


_CHANCE = "(CAST('0x' || substr(md5('day:' || {}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE"


@query("d5_draw", f""", wt AS (SELECT s.parent_uuid, s.node_uuid, greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(min(n.created_at))) / 86400.0, 0.5) * greatest(pow(0.5, greatest(0, min(coalesce(s.priority, 2)))), 1e-12) AS weight FROM star s JOIN nodes n ON n.uuid = s.node_uuid WHERE s.domain <> 'system' GROUP BY ALL),
wo AS (SELECT parent_uuid, arg_min(node_uuid, -ln({_CHANCE.format("node_uuid")}) / weight) AS node_uuid FROM wt GROUP BY 1)
SELECT wo.parent_uuid, wo.node_uuid, arg_min(domain || '://' || path, {_CHANCE.format("domain || '://' || path")}) AS uri FROM wo JOIN star s ON s.parent_uuid = wo.parent_uuid AND s.node_uuid = wo.node_uuid GROUP BY ALL""")
def d5_draw(g):
    """A weighted draw below every parent."""
    secs = lambda c: F.unix_timestamp(c.cast("timestamp"))
    s = g.star.where("domain <> 'system'")
    age = (secs(stamp(AS_OF)) - secs(F.min("created_at"))) / 86400.0
    weight = F.greatest(age, F.lit(0.5)) * F.greatest(F.pow(F.lit(0.5), F.greatest(F.lit(0), F.min(F.coalesce("priority", F.lit(2))))), F.lit(1e-12))
    w = s.join(g.nodes, F.col("node_uuid") == F.col("uuid")).groupBy("parent_uuid", "node_uuid").agg(weight.alias("weight"))
    return U.draw(w, s.select("parent_uuid", "node_uuid", T.uri_of(F.col("domain"), F.col("path")).alias("uri")), "day", "parent_uuid")


@query("u6_tags_after", """, b AS (SELECT id, ['t' || (id % 3), 'a', 'b', 't' || (id % 5)] AS tags, ['c', ' a ', ' ', 't' || (id % 7)] AS adds, ['t' || (id % 4), 'b'] AS removed FROM active)
SELECT id, CASE WHEN NOT list_has_any(adds, removed) THEN CASE WHEN len(rest) > 0 THEN array_to_string(rest, '|') || '|' ELSE '' END || array_to_string(fresh, '|') END AS tags FROM (SELECT id, adds, removed, list_filter([CASE WHEN NOT list_contains(removed, tags[1]) THEN tags[1] END, CASE WHEN NOT list_contains(removed, 'a') THEN 'a' END, CASE WHEN tags[4] <> tags[1] AND NOT list_contains(removed, tags[4]) THEN tags[4] END], lambda x: x IS NOT NULL) AS rest, list_filter(['c', 'a', trim(adds[4])], lambda x: x <> 'a' AND x <> CASE WHEN list_contains(removed, tags[1]) THEN '' ELSE tags[1] END AND x <> CASE WHEN list_contains(removed, tags[4]) THEN '' ELSE tags[4] END) AS fresh FROM b)""")
def u6_after(g):
    i = F.col("id")
    t = lambda n: F.concat(F.lit("t"), (i % n).cast("string"))
    tags, add, remove = F.array(t(3), F.lit("a"), F.lit("b"), t(5)), F.array(F.lit("c"), F.lit(" a "), F.lit(" "), t(7)), F.array(t(4), F.lit("b"))
    return g.active.select("id", F.array_join(U.tags_after(tags, add, remove), "|").alias("tags"))


@query("m27_line_edits", """, b AS (SELECT id, id % 5 AS k, (id // 5) % 11 AS line, string_split(content, ' ') AS p FROM memories)
SELECT id, CASE WHEN k = 0 THEN array_to_string(p, chr(10)) || chr(10) || chr(10) || 'new' WHEN k = 1 AND line BETWEEN 1 AND len(p) THEN array_to_string(p[1:line - 1] || ['new'] || p[line + 1:], chr(10)) WHEN k = 2 AND line BETWEEN 1 AND len(p) THEN array_to_string(p[1:line - 1] || p[line + 1:], chr(10)) WHEN k = 3 AND line <= len(p) THEN array_to_string(p[1:line] || ['new'] || p[line + 1:], chr(10)) ELSE array_to_string(p, chr(10)) END AS content FROM b""")
def m27_edits(g):
    k = F.col("id") % 5
    op = F.when(k == 0, "append").when(k == 1, "set").when(k == 2, "delete").when(k == 3, "insert").otherwise("none")
    return g.memories.select("id", U.line_edit(F.translate("content", " ", "\n"), op, (F.floor(F.col("id") / 5) % 11).cast("int"), F.lit("new")).alias("content"))
