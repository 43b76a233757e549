"""Graph health: stale, crowded, orphaned and duplicate entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import AS_OF, stamp
from ..functions import text as T
from ..operators.reads import first_by
from ..registry import query
from ..schema import ROOT, violations


def stale(star: DataFrame, nodes: DataFrame, as_of: str) -> DataFrame:
    """One row per stale node: last use (or creation, but not before tracking began) is older than its priority allows."""
    now = stamp(as_of)
    began = nodes.agg(F.coalesce(F.min("last_accessed_at"), now).alias("began"))
    used = nodes.join(F.broadcast(began)).select("uuid", F.coalesce("last_accessed_at", F.greatest("created_at", "began")).alias("used"))
    secs = lambda c: F.unix_timestamp(c.cast("timestamp"))
    got = star.join(used, F.col("node_uuid") == F.col("uuid")).withColumn("age", secs(now) - secs(F.col("used")))
    got = got.where(F.col("age") > T.stale_limit(F.col("priority")) * 86400)
    one = first_by(got, ["namespace", "node_uuid"], F.coalesce("priority", F.lit(999)), "domain", "path")
    return one.select("namespace", "node_uuid", "domain", "path", "priority", F.bround(F.col("age") / 86400, 1).alias("stale_days"))


def crowded(edges: DataFrame, paths: DataFrame, most: int, namespace: str) -> DataFrame:
    """Parents with more than ``most`` children, under their first path; the root is shown as itself."""
    many = edges.groupBy("parent_uuid").agg(F.countDistinct("child_uuid").alias("n")).where(F.col("n") > most)
    p = paths.where(F.col("namespace") == namespace).groupBy(F.col("node_uuid").alias("parent_uuid")).agg(F.min(T.uri_of(F.col("domain"), F.col("path"))).alias("uri"))
    return many.join(p, "parent_uuid", "left").where(F.col("uri").isNotNull() | (F.col("parent_uuid") == ROOT)).select("parent_uuid", "n", F.coalesce("uri", F.lit("(root)")).alias("uri"))


def orphaned_paths(paths: DataFrame) -> DataFrame:
    """Paths whose parent path is not there."""
    p = paths.where(F.col("path").contains("/")).withColumn("parent", T.parent_path(F.col("path")))
    there = paths.select("namespace", "domain", F.col("path").alias("parent"))
    return p.join(there, ["namespace", "domain", "parent"], "left_anti").select("namespace", "domain", "path")


def duplicate_aliases(paths: DataFrame) -> DataFrame:
    """Nodes with several paths under one parent path."""
    return paths.groupBy("namespace", "domain", T.parent_path(F.col("path")).alias("parent"), "node_uuid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths")).where("n > 1")


D1 = f""", beg AS (SELECT coalesce(min(last_accessed_at), TIMESTAMP '{AS_OF}') AS began FROM nodes),
us AS (SELECT uuid, coalesce(last_accessed_at, greatest(created_at, began)) AS used FROM nodes, beg),
ag AS (SELECT s.*, floor(epoch(TIMESTAMP '{AS_OF}')) - floor(epoch(used)) AS age FROM star s JOIN us ON s.node_uuid = us.uuid),
st AS (SELECT *, row_number() OVER (PARTITION BY namespace, node_uuid ORDER BY coalesce(priority, 999), domain, path) AS rk FROM ag
  WHERE age > 86400 * CASE WHEN priority IS NULL THEN 14 WHEN priority <= 0 THEN 3 WHEN priority = 1 THEN 7 WHEN priority = 2 THEN 14 ELSE least(floor(3.5 * pow(2, least(priority, 20))), 36500) END)
"""


@query("d1_stale", D1 + "SELECT namespace, node_uuid, domain, path, priority, round_even(age / 86400, 1) AS stale_days FROM st WHERE rk = 1")
def d1(g):
    return stale(g.star, g.nodes, AS_OF)


@query("d2_crowded", ", m AS (SELECT parent_uuid, count(DISTINCT child_uuid) AS n FROM edges GROUP BY 1 HAVING count(DISTINCT child_uuid) > 10), p AS (SELECT node_uuid, min(domain || '://' || path) AS uri FROM paths WHERE namespace = '' GROUP BY 1) SELECT m.parent_uuid, m.n, coalesce(p.uri, '(root)') AS uri FROM m LEFT JOIN p ON m.parent_uuid = p.node_uuid WHERE p.uri IS NOT NULL OR m.parent_uuid = 'ROOT'")
def d2(g):
    return crowded(g.edges, g.paths, 10, "")


@query("d3_orphaned_paths", "SELECT namespace, domain, path FROM paths p WHERE contains(path, '/') AND NOT EXISTS (SELECT 1 FROM paths q WHERE q.namespace = p.namespace AND q.domain = p.domain AND q.path = regexp_replace(p.path, '(^|/)[^/]*$', ''))")
def d3(g):
    return orphaned_paths(g.paths)


@query("d4_duplicate_aliases", "SELECT namespace, domain, regexp_replace(path, '(^|/)[^/]*$', '') AS parent, node_uuid, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM paths GROUP BY ALL HAVING count(*) > 1")
def d4(g):
    return duplicate_aliases(g.paths)


@query("d5_random_weight", f"SELECT s.node_uuid, round(greatest((epoch(TIMESTAMP '{AS_OF}') - epoch(min(n.created_at))) / 86400.0, 0.5) * greatest(pow(0.5, greatest(0, min(coalesce(s.priority, 2)))), 1e-12), 6) AS weight FROM star s JOIN nodes n ON n.uuid = s.node_uuid WHERE s.namespace = '' GROUP BY 1")
def d5(g):
    s = g.star.where("namespace = ''").join(g.nodes, F.col("node_uuid") == F.col("uuid"))
    secs = lambda c: F.unix_timestamp(c.cast("timestamp"))
    age = (secs(stamp(AS_OF)) - secs(F.min("created_at"))) / 86400.0
    return s.groupBy("node_uuid").agg(F.round(F.greatest(age, F.lit(0.5)) * F.greatest(F.pow(F.lit(0.5), F.greatest(F.lit(0), F.min(F.coalesce("priority", F.lit(2))))), F.lit(1e-12)), 6).alias("weight"))


@query("d6_report", D1 + ", a AS (SELECT 'stale' AS kind, count(*) AS n FROM st WHERE rk = 1 UNION ALL SELECT 'crowded', (SELECT count(*) FROM (SELECT parent_uuid FROM edges WHERE parent_uuid = 'ROOT' OR parent_uuid IN (SELECT node_uuid FROM paths WHERE namespace = '') GROUP BY 1 HAVING count(DISTINCT child_uuid) > 10))) SELECT kind, n FROM a")
def d6(g):
    a = stale(g.star, g.nodes, AS_OF).agg(F.lit("stale").alias("kind"), F.count("*").alias("n"))
    return a.unionAll(crowded(g.edges, g.paths, 10, "").agg(F.lit("crowded").alias("kind"), F.count("*").alias("n")))


@query("inv_violations", "SELECT 'active memory' AS rule, node_uuid AS key, count(*) AS n FROM active GROUP BY node_uuid HAVING count(*) > 1 UNION ALL SELECT 'edge', parent_uuid || '|' || child_uuid, count(*) FROM edges GROUP BY parent_uuid, child_uuid HAVING count(*) > 1 UNION ALL SELECT 'path', namespace || '|' || domain || '|' || path, count(*) FROM paths GROUP BY namespace, domain, path HAVING count(*) > 1")
def inv(g):
    return violations(g.memories, g.edges, g.paths)
