"""Collections to the fixed point, over chains of each customer's orders.

Every twelve orders of a customer in a row form a chain: each but the first hangs below the one before it, by a path of
its own. The first hangs below the root; of every third customer that path has gone. Urgent orders have a second path.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import collect as O
from ..operators.steps import table
from ..registry import query

_CHAIN = """, cn AS (SELECT o_orderkey AS k, o_custkey AS c, prio, o_custkey % 3 = 0 AS cutoff, row_number() OVER w - 1 AS n, lag(o_orderkey) OVER w AS prev FROM ord WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
ch AS (SELECT *, n // 12 AS link, n % 12 AS place, CASE WHEN n % 12 > 0 THEN prev END AS up FROM cn),
al AS (SELECT *, cutoff AND NOT bool_or(prio = 0) OVER (PARTITION BY c, link ORDER BY place) AS dead FROM ch)"""
_GONE = _CHAIN + """, hd AS (SELECT *, prio = 4 AND k % 2 = 0 OR 'o-' || k NOT IN (SELECT node_uuid FROM memories) AS hard FROM ch),
dd AS (SELECT *, max(CASE WHEN hard THEN place END) OVER w AS last_hard, max(CASE WHEN prio = 0 AND NOT hard THEN place END) OVER w AS last_alias FROM hd WINDOW w AS (PARTITION BY c, link ORDER BY place)),
fd AS (SELECT *, CASE WHEN hard THEN true WHEN last_hard IS NOT NULL AND (last_alias IS NULL OR last_alias < last_hard) THEN true WHEN cutoff AND last_alias IS NULL THEN true ELSE false END AS dead FROM dd),
fe AS (SELECT *, lag(dead, 1, false) OVER (PARTITION BY c, link ORDER BY place) AS up_dead FROM fd)"""


def chains(g):
    """(nodes, edges, paths, memories, glossary) of the chains."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    c = g.orders.withColumn("n", F.row_number().over(w) - 1).withColumn("up", F.when(F.col("n") % 12 > 0, F.lag("o_orderkey").over(w)))
    c = table(c.select("o_orderkey", "o_custkey", "prio", "up"), "chains")  # all five are told from it
    tag = lambda x: F.concat(F.lit("o-"), x.cast("string"))
    nodes = c.select(tag(F.col("o_orderkey")).alias("uuid"))
    parent = F.when(F.col("up").isNull(), "ROOT").otherwise(tag(F.col("up")))
    second = c.where("prio = 0")
    edges = c.select(F.col("o_orderkey").alias("id"), parent.alias("parent_uuid"), tag(F.col("o_orderkey")).alias("child_uuid"))
    edges = edges.unionByName(second.select((F.col("o_orderkey") + 10**12).alias("id"), F.lit("ROOT").alias("parent_uuid"), tag(F.col("o_orderkey")).alias("child_uuid")))
    here = c.where("up is not null or o_custkey % 3 <> 0")
    path = lambda df, ns, base: df.select(F.lit(ns).alias("namespace"), F.lit("core").alias("domain"), F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") + base).alias("edge_id"), tag(F.col("o_orderkey")).alias("node_uuid"))
    paths = path(here, "chain", 0).unionByName(path(second, "urgent", 10**12))
    memories = g.memories.where("node_uuid like 'o-%'")
    glossary = c.where("o_orderkey % 5 = 0").select(F.concat(F.lit("key "), F.col("prio").cast("string")).alias("keyword"), tag(F.col("o_orderkey")).alias("node_uuid"), F.lit("").alias("namespace"))
    return nodes, edges, paths, memories, glossary


@query("m12_fixed_point", _CHAIN + " SELECT 'o-' || k AS uuid, CAST(place AS INT) AS round FROM al WHERE dead")
def m12_fixed_point(g):
    """The nodes that die and the round in which they do: up to twelve rounds, one link of a chain after the other."""
    nodes, edges, paths, _, _ = chains(g)
    return O.dead_nodes(nodes, edges, paths)[0]


@query("m12_collect", _CHAIN + """ SELECT 'paths' AS tbl, 'chain|core|ord_' || k AS key, 'removed' AS change FROM al WHERE (SELECT bool_or(x.dead) FROM al x WHERE x.k = al.up)
UNION ALL SELECT 'edges', CAST(k AS VARCHAR), 'removed' FROM al WHERE dead OR (SELECT bool_or(x.dead) FROM al x WHERE x.k = al.up)
UNION ALL SELECT 'glossary', 'key ' || prio || '|o-' || k || '|', 'removed' FROM al WHERE dead AND k % 5 = 0
UNION ALL SELECT 'memories', CAST(m.id AS VARCHAR), 'retired' FROM al JOIN active m ON m.node_uuid = 'o-' || k WHERE dead""")
def m12_collect(g):
    """All rows that the soft collection removes or retires."""
    return O.collect(*chains(g))


@query("m8_collect", _GONE + """ SELECT 'paths' AS tbl, 'chain|core|ord_' || k AS key, 'removed' AS change FROM fe WHERE (up IS NOT NULL OR NOT cutoff) AND (up_dead OR hard)
UNION ALL SELECT 'paths', 'urgent|core|ord_' || k, 'removed' FROM fe WHERE prio = 0 AND hard
UNION ALL SELECT 'edges', CAST(k AS VARCHAR), 'removed' FROM fe WHERE dead OR up_dead
UNION ALL SELECT 'edges', CAST(k + 1000000000000 AS VARCHAR), 'removed' FROM fe WHERE prio = 0 AND dead
UNION ALL SELECT 'glossary', 'key ' || prio || '|o-' || k || '|', 'removed' FROM fe WHERE dead AND k % 5 = 0
UNION ALL SELECT 'memories', CAST(m.id AS VARCHAR), 'retired' FROM fe JOIN active m ON m.node_uuid = 'o-' || k WHERE dead AND NOT hard
UNION ALL SELECT 'nodes', 'o-' || k, 'removed' FROM fe WHERE hard""")
def m8_collect(g):
    """The collection after all versions of every second order of low priority were deleted: nodes without any version go whole."""
    nodes, edges, paths, memories, glossary = chains(g)
    emptied = g.orders.where("prio = 4 and o_orderkey % 2 = 0").select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("node_uuid"))
    left = memories.join(emptied, "node_uuid", "left_anti")
    return O.collect(nodes, edges, paths, left, glossary, O.memoryless(nodes, left))
