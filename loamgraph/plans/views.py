"""Views over the older graph and the text graph whose rows carry everything that the view shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds, states
from ..operators import relays as R
from ..operators.steps import table
from ..registry import query
from .legacy import entities
from .legacy import states as orders
from .relays import RELAYS, directs, every_state, pairs, relays

_EDGES = RELAYS.rstrip() + """, ev AS (SELECT id, entity_id, version FROM sts UNION ALL SELECT 's-' || s_suppkey || '_v1', 's-' || s_suppkey, 1 FROM supplier UNION ALL SELECT DISTINCT relay, regexp_replace(relay, '_v1$', ''), 1 FROM re),
ee AS (SELECT from_state AS f, to_state AS t FROM di UNION ALL SELECT from_state, relay FROM re UNION ALL SELECT relay, to_state FROM re),
ic AS (SELECT t AS id, count(*) AS n FROM ee GROUP BY 1), oc AS (SELECT f AS id, count(*) AS n FROM ee GROUP BY 1), nv AS (SELECT arg_max(id, version) AS id FROM ev GROUP BY entity_id)"""


@query("n13_orphans", _EDGES + """ SELECT ev.id, entity_id, version, coalesce(ic.n, 0) AS in_count, coalesce(oc.n, 0) AS out_count, nv.id IS NOT NULL AS is_current, coalesce(oc.n, 0) = 0 AS all_zero
FROM ev LEFT JOIN ic ON ic.id = ev.id LEFT JOIN oc ON oc.id = ev.id LEFT JOIN nv ON nv.id = ev.id WHERE ic.n IS NULL""")
def n13_orphans(g):
    """States that nothing leads to, and which of them lead nowhere either."""
    d = directs(g, table(pairs(g), "pairs"))
    edges = d.select(F.col("from_state").alias("from_id"), F.col("to_state").alias("to_id")).unionByName(relays(g, d).select("from_id", "to_id"))
    s = every_state(g, d).select("id", "entity_id", "version")
    got = states.orphans(s, s.groupBy("entity_id").agg(F.max_by("id", "version").alias("id")), edges)
    return got.withColumn("all_zero", F.col("out_count") == 0)


@query("n15_catalog_edges", RELAYS.rstrip() + """, rr AS (SELECT viewer, target, relation, edge_id, count(relay) AS chapters FROM rs GROUP BY ALL), cn AS (SELECT entity_id, arg_max(name, version) AS name FROM sts GROUP BY 1)
SELECT e.id, e.kind, cn.name, rr.target, rr.relation, rr.edge_id, rr.chapters FROM ent e JOIN cn ON cn.entity_id = e.id LEFT JOIN rr ON rr.viewer = e.id WHERE NOT e.hidden""")
def n15_catalog_edges(g):
    """The catalog: every visible entity with its current name and its latest relation to each target, with the number of
    chapters that hang on it; one row a relation."""
    name = orders(g).groupBy(F.col("entity_id").alias("id")).agg(F.max_by("name", "version").alias("name"))
    rel = R.relations(directs(g), relays(g)).groupBy(F.col("viewer").alias("id"), "target", "relation", "edge_id").agg(F.count("relay").alias("chapters"))
    return entities(g).where("not hidden").join(name, "id").join(rel, "id", "left").select("id", "kind", "name", "target", "relation", "edge_id", "chapters")


@query("a6_fingerprints", "SELECT namespace, count(*) AS n, max(id) AS newest, strftime(max(accessed_at), '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT node_uuid, id, accessed_at, node_uuid AS namespace FROM logs) GROUP BY 1")
def a6_fingerprints(g):
    """Whether anything was added since: count, largest id and newest time, here of every node's log."""
    return g.logs.groupBy(F.col("node_uuid").alias("namespace")).agg(F.count("*").alias("n"), F.max("id").alias("newest"), F.date_format(F.max("accessed_at"), "yyyy-MM-dd HH:mm:ss").alias("last"))


_GROUP = """, ck AS (SELECT *, id // 100 % 6 = 0 AND migrated_to IS NOT NULL AND id % 100 = 1 AS cutoff FROM memories WHERE node_uuid LIKE 'o-%'),
dp AS (SELECT id, node_uuid, cutoff FROM ck WHERE deprecated),
ac AS (SELECT node_uuid, max(id) AS target FROM ck WHERE NOT deprecated GROUP BY 1),
gr AS (SELECT dp.id, dp.node_uuid, CASE WHEN dp.cutoff THEN NULL ELSE ac.target END AS own, ac.target FROM dp LEFT JOIN ac USING (node_uuid)),
tg AS (SELECT DISTINCT own AS target, node_uuid FROM gr WHERE own IS NOT NULL)"""


@query("w12_groups", _GROUP + " SELECT coalesce(own, tg.target) AS target, count(*) AS n, min(gr.id) AS first, count(*) FILTER (own IS NULL) AS attached FROM gr LEFT JOIN tg ON tg.node_uuid = gr.node_uuid GROUP BY 1")
def w12_groups(g):
    """Retired versions by the version that they end in; those whose link is cut off go to the group of their node, and the
    rest (null) is without any. The largest group comes first wherever rows are ordered by n."""
    from ..operators.recursive import ends

    m = g.memories.where("node_uuid like 'o-%'").withColumn("migrated_to", F.when((F.floor(F.col("id") / 100) % 6 == 0) & (F.col("id") % 100 == 1), F.lit(None)).otherwise(F.col("migrated_to")).cast("long"))
    last = ends(m.select("id", F.col("migrated_to").alias("next"))).select("id", "target")
    active = m.where("not deprecated").select(F.col("id").alias("target"), F.lit(True).alias("live"))
    got = m.where("deprecated").select("id", "node_uuid").join(last, "id").join(active, "target", "left").withColumn("own", F.when(F.col("live"), F.col("target")))
    of = got.where("own is not null").groupBy("node_uuid").agg(F.max("own").alias("node_target"))
    got = got.join(of, "node_uuid", "left")
    return got.groupBy(F.coalesce("own", "node_target").alias("target")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.count(F.when(F.col("own").isNull(), 1)).alias("attached"))


_CUTS = {"c200": (200, "..."), "c120": (120, ""), "c100": (100, "..."), "c80": (80, "..."), "c60": (60, "..."), "c40": (40, "..."), "l100": (100, " [truncated]"), "l150": (150, "...")}
_cut = lambda c, n, mark: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '{mark}' ELSE {c} END"


@query("s5_cuts", "SELECT doc_id, " + ", ".join(f"{_cut('text', n, mark)} AS {name}" for name, (n, mark) in _CUTS.items()) + f", {_cut('t', 50, '...')} AS c50 FROM (SELECT *, replace(text, chr(10), ' ') AS t FROM documents)")
def s5_cuts(g):
    """Every cut that a view makes of a text: lengths, marks, and newlines as blanks in the shortest of lists."""
    cuts = [T.snippet(F.col("text"), n, mark).alias(name) for name, (n, mark) in _CUTS.items()]
    return g.table("documents").select("doc_id", *cuts, T.snippet(F.replace("text", F.lit("\n"), F.lit(" ")), 50).alias("c50"))


_BATCH = """, hit AS (SELECT namespace, domain, path, edge_id, node_uuid, memory_id, content, priority AS had, disclosure AS had_note, row_number() OVER (ORDER BY namespace, domain, path) AS seq FROM star WHERE contains(replace(content, '’', ''''), 'part 1') OR contains(content, 'BUILDING')),
nw AS (SELECT *, (SELECT max(id) FROM memories) + row_number() OVER (ORDER BY seq) AS new_id, lag(seq) OVER (PARTITION BY node_uuid ORDER BY seq) AS earlier FROM hit)"""


@query("m20_batch", _BATCH + """ SELECT nw.seq, 'ok' AS status, nw.node_uuid, coalesce(p.new_id, nw.memory_id) AS old_id, nw.new_id FROM nw LEFT JOIN nw p ON p.seq = nw.earlier""")
def m20_batch(g):
    """Search, replace and rank in one batch: every path whose text has one of two passages gets the text with them replaced, a
    new priority and a note, as ordered updates; a node that two paths lead to is updated twice."""
    text = T.typographic(F.col("content"))
    hit = g.star.where(text.contains("part 1") | F.col("content").contains("BUILDING"))
    first = hit.select("namespace", "domain", "path", F.replace(F.replace(text, F.lit("part 1"), F.lit("piece 1")), F.lit("BUILDING"), F.lit("CONSTRUCTION")).alias("content"))
    return folds.update(g.star, g.memories, numbered_batch(first).select("seq", "namespace", "domain", "path", "content", F.lit(1).alias("priority"), F.lit("edited").alias("disclosure"), F.lit(None).cast("string").alias("world_timestamp")))[0]


def numbered_batch(rows):
    """Rows with seq in the order of their paths, numbered over ranges."""
    from ..operators.mutations import numbered

    return numbered(rows, rows.sparkSession.range(0).select(F.col("id").alias("seq")), "seq", "namespace", "domain", "path")


@query("n4_degrees", _EDGES + """ SELECT ev.id, entity_id, version, coalesce(ic.n, 0) AS in_count, coalesce(oc.n, 0) AS out_count, nv.id IS NOT NULL AS is_current
FROM ev LEFT JOIN ic ON ic.id = ev.id LEFT JOIN oc ON oc.id = ev.id LEFT JOIN nv ON nv.id = ev.id""")
def n4_degrees(g):
    """Every state with its edges in and out, without those that link versions."""
    edges = directs(g).select(F.col("from_state").alias("from_id"), F.col("to_state").alias("to_id")).unionByName(relays(g).select("from_id", "to_id"))
    s = every_state(g).select("id", "entity_id", "version")
    return states.degrees(s, s.groupBy("entity_id").agg(F.max_by("id", "version").alias("id")), edges)


@query("n3_overview", RELAYS.rstrip() + """, rr AS (SELECT viewer, target, edge_id, count(relay) AS chapters FROM rs GROUP BY ALL), ra AS (SELECT viewer, count(*) AS relations, CAST(sum(chapters) AS BIGINT) AS chapters FROM rr GROUP BY 1),
sa AS (SELECT entity_id, count(*) AS versions, max(version) AS version, arg_max(id, version) AS state, arg_max(name, version) AS name FROM sts GROUP BY 1)
SELECT e.id, e.kind, sa.name, sa.version, sa.state, coalesce(sa.versions, 0) AS versions, coalesce(ra.relations, 0) AS relations, coalesce(ra.chapters, 0) AS chapters FROM ent e LEFT JOIN sa ON sa.entity_id = e.id LEFT JOIN ra ON ra.viewer = e.id""")
def n3_overview(g):
    """Every entity with its newest state, the number of its versions, of its latest relations and of the chapters on these."""
    s = orders(g).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("versions"), F.max("version").alias("version"), F.max_by("id", "version").alias("state"), F.max_by("name", "version").alias("name"))
    rel = R.relations(directs(g), relays(g)).groupBy("viewer", "target", "edge_id").agg(F.count("relay").alias("chapters"))
    rel = rel.groupBy(F.col("viewer").alias("id")).agg(F.count("*").alias("relations"), F.sum("chapters").alias("chapters"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entities(g).join(s, "id", "left").join(rel, "id", "left").select("id", "kind", "name", "version", "state", none("versions"), none("relations"), none("chapters"))


_DOMAINS = """, us AS (SELECT DISTINCT domain, true AS used FROM paths), bo AS (SELECT DISTINCT source AS domain, true AS booted FROM documents WHERE length(source) % 2 = 0 UNION SELECT 'core', true FROM region),
dm AS (SELECT domain FROM us UNION SELECT source FROM documents UNION SELECT lang FROM documents UNION SELECT n_name FROM nation UNION SELECT 'system' FROM region UNION SELECT lower(n_name) FROM nation)"""


@query("m19_domains", _DOMAINS + """ SELECT dm.domain, CASE WHEN NOT regexp_full_match(dm.domain, '[a-z][a-z0-9_]*') OR dm.domain = 'system' THEN 'invalid' WHEN used THEN 'exists' ELSE 'ok' END AS added,
CASE WHEN used THEN 'has paths' WHEN booted THEN 'in a preset' ELSE 'ok' END AS removed FROM dm LEFT JOIN us ON us.domain = dm.domain LEFT JOIN bo ON bo.domain = dm.domain""")
def m19_domains(g):
    """Whether names can be added as domains, and what keeps them from being removed: paths, or an address in any preset."""
    d, n = g.table("documents"), g.table("nation")
    used = g.paths.select("domain").distinct().withColumn("used", F.lit(True))
    lists = d.where(F.length("source") % 2 == 0).select(F.array(F.concat("source", F.lit("://1"))).alias("uris")).unionAll(g.table("region").select(F.array(F.concat(F.lit("core://"), "r_name"))))
    booted = lists.select(F.explode("uris").alias("uri")).select(T.domain_of(F.col("uri")).alias("domain")).distinct().withColumn("booted", F.lit(True))
    names = used.select("domain").union(d.select("source")).union(d.select("lang")).union(n.select("n_name")).union(n.select(F.lower("n_name"))).union(g.table("region").select(F.lit("system"))).distinct()
    got = names.join(used, "domain", "left").join(booted, "domain", "left")
    added = F.when(~F.col("domain").rlike(T.DOMAIN) | (F.col("domain") == "system"), "invalid").when(F.col("used"), "exists").otherwise("ok")
    return got.select("domain", added.alias("added"), F.when(F.col("used"), "has paths").when(F.col("booted"), "in a preset").otherwise("ok").alias("removed"))


@query("s25_checks", r"""SELECT page_id, regexp_matches(url, '^[a-zA-Z0-9_-]+$') AS title, regexp_matches(url, '^[a-z][a-z0-9_]*$') AS domain, regexp_matches(url, '^([a-zA-Z_]\w*)://(.*)$') AS uri FROM
(SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN string_split(url, '/')[-1] WHEN 2 THEN lower(regexp_extract(url, '^(\w+)', 1)) ELSE string_split(url, '/')[3] END AS url FROM pages)""")
def s25_checks(g):
    """Which of the three forms a name has: addresses, their last parts, their schemes and their hosts."""
    k, parts = F.col("page_id") % 4, F.split("url", "/")
    name = F.when(k == 0, F.col("url")).when(k == 1, F.element_at(parts, -1)).when(k == 2, F.lower(F.regexp_extract("url", r"^(\w+)", 1))).otherwise(F.try_element_at(parts, F.lit(3)))
    return g.table("pages").select("page_id", name.alias("n")).select("page_id", F.col("n").rlike(T.TITLE).alias("title"), F.col("n").rlike(T.DOMAIN).alias("domain"), F.col("n").rlike(T.URI).alias("uri"))
