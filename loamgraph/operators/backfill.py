"""The migration of flat texts with version links to a graph: one node for each chain's root, edges from the paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import ROOT
from .mutations import numbered
from .reads import first_by
from .steps import table


def cut(df: DataFrame) -> DataFrame:
    """A step, as a columnar table."""
    return table(df, "backfill")


def roots(links: DataFrame, known: bool = False) -> DataFrame:
    """(id, root) of links(id, up): where following up ends; unknown ups end it. On a ring every id is its own root, and what
    leads into one has the id where it enters as root. Pointers double, so rounds are the logarithm of the longest way.
    ``known``: every up is an id."""
    start = links.select("id", "up")
    if not known:
        there = links.select(F.col("id").alias("up"), F.lit(True).alias("there"))
        start = start.join(there, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"))
    start = cut(start)

    def walk(way: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, to) of the ids that end, and of those that never do, which stand on rings then. Ids that have ended are joined no more."""
        at = way.where("up is not null").select("id", F.col("up").alias("to"))
        none, stood = way.where("up is null").select("id", F.col("id").alias("to")), None
        ended = at.limit(0)
        while True:
            n, stands = at.agg(F.count("*"), F.countDistinct("to")).first()
            # the ids that pointers stand on only get fewer; if twice the steps leave as many, all of them are on rings
            if not n or stands == stood:
                return none.unionByName(ended), at
            stood = stands
            far = at.withColumn("open", F.lit(True)).unionByName(ended.withColumn("open", F.lit(False)))
            far = far.select(F.col("id").alias("to"), F.col("to").alias("to2"), "open")
            both = cut(at.join(far, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.coalesce("open", F.lit(False)).alias("open")))
            at, ended = both.where("open").drop("open"), ended.unionByName(both.where("not open").drop("open"))

    at, never = walk(start)
    if not never.isEmpty():
        ring = never.select(F.col("to").alias("id")).distinct().withColumn("ring", F.lit(True))
        opened = start.join(never.select("id"), "id", "left_semi").join(ring, "id", "left")
        at = at.unionByName(walk(cut(opened.select("id", F.when(F.col("ring").isNull(), F.col("up")).alias("up"))))[0])
    return at.select("id", F.col("to").alias("root"))


def nodes_of(memories: DataFrame) -> DataFrame:
    """(id, node_uuid) of memories(id, node_uuid, migrated_to): a given node stays; others get the first given node of their
    chain (by id), or a new one that is named after the chain's root. Of several versions that lead to one, the one with
    the largest id is its predecessor, so branches fall into chains of their own."""
    up = memories.where("migrated_to is not null").groupBy(F.col("migrated_to").alias("id")).agg(F.max("id").alias("up"))
    at = roots(memories.select("id").join(up, "id", "left"), known=True)
    m = memories.select("id", "node_uuid").join(at, "id")
    given = m.where("node_uuid is not null").groupBy("root").agg(F.min_by("node_uuid", "id").alias("given"))
    return m.join(given, "root", "left").select("id", F.coalesce("node_uuid", "given", F.concat(F.lit("m-"), F.col("root").cast("string"))).alias("node_uuid"))


def graph_of(memories: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, paths) from memories(id, node_uuid, migrated_to) and paths(domain, path, memory_id, priority, disclosure).

    nodes: (id, node_uuid). An edge joins the nodes of a path's parent, or the root, and of the path itself; of paths that
    make the same edge the shallowest, then the first by domain and path, names it, and edges are numbered in that order.
    paths: (namespace, domain, path, edge_id, node_uuid) in the empty namespace; paths without a known memory are left out.
    """
    nodes = cut(nodes_of(memories))
    at = lambda c, d: nodes.select(F.col("id").alias(c), F.col("node_uuid").alias(d))
    p = first_by(paths, ["domain", "path"], "memory_id").join(at("memory_id", "child_uuid"), "memory_id")
    ups = p.select("domain", F.col("path").alias("up"), F.col("child_uuid").alias("parent_uuid"))
    p = p.withColumn("up", T.parent_path(F.col("path"))).join(ups, ["domain", "up"], "left").withColumn("parent_uuid", F.coalesce("parent_uuid", F.lit(ROOT)))
    p = cut(p.withColumn("depth", T.depth(F.col("path"))))
    one = first_by(p, ["parent_uuid", "child_uuid"], "depth", "domain", "path")
    one = one.select("parent_uuid", "child_uuid", T.last_segment(F.col("path")).alias("name"), F.coalesce("priority", F.lit(0)).alias("priority"), "disclosure", "depth", "domain", "path")
    none = one.select(F.lit(0).cast("long").alias("id")).limit(0)
    edges = cut(numbered(one, none, "id", "depth", "domain", "path").select("id", "parent_uuid", "child_uuid", "name", "priority", "disclosure"))
    new = p.join(edges.select("parent_uuid", "child_uuid", F.col("id").alias("edge_id")), ["parent_uuid", "child_uuid"])
    return nodes, edges, new.select(F.lit("").alias("namespace"), "domain", "path", "edge_id", F.col("child_uuid").alias("node_uuid"))


def namespaced(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of a table that had no namespaces, in the empty one; of rows that are equal in their keys the first stays."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("namespace", F.lit(""))
