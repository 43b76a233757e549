"""Collection of what nothing leads to, to the fixed point, by counts of references.

A node is dead when no path leads to it. With a node its edges go, with an edge its paths and all paths below them; a
node whose last path goes with them is dead in the next round. Which paths go with which node is one table, made once:
a round joins the newly dead with it and compares each touched node's lost paths with all it had, so a round costs what
dies in it. Rings of nodes that have paths keep each other, as counts do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ROOT
from .steps import table

KEY = ["namespace", "domain", "path"]


def losses(edges: DataFrame, paths: DataFrame, hard: DataFrame) -> DataFrame:
    """(cause, namespace, domain, path, node_uuid): each path with every node that it goes with: the parents of its own
    edge and of the edges of all paths above it; and the nodes of hard(uuid) among those at its end or above."""
    tops = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/")))
    below = paths.select(*KEY, "node_uuid", tops.alias("top"))
    at = paths.select("namespace", "domain", F.col("path").alias("top"), "edge_id", F.col("node_uuid").alias("own"))
    each = below.join(at, ["namespace", "domain", "top"])
    by_parent = each.join(edges.select(F.col("id").alias("edge_id"), F.col("parent_uuid").alias("cause")), "edge_id").where(F.col("cause") != ROOT)
    by_end = each.join(hard.select(F.col("uuid").alias("own")).distinct(), "own").withColumn("cause", F.col("own"))
    return by_parent.select("cause", *KEY, "node_uuid").unionByName(by_end.select("cause", *KEY, "node_uuid")).distinct()


def dead_nodes(nodes: DataFrame, edges: DataFrame, paths: DataFrame, hard: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((uuid, round), paths): the nodes that die, with the round in which they do, and the paths that go. hard(uuid) are
    dead from the start, with all paths to them; else only nodes without a path are. The root never dies."""
    hard = hard if hard is not None else nodes.select("uuid").where("false")
    hard = hard.where(F.col("uuid") != ROOT).select("uuid").distinct()
    goes = table(losses(edges, paths, hard), "losses")
    had = paths.groupBy(F.col("node_uuid").alias("uuid")).agg(F.count("*").alias("had"))
    without = nodes.where(F.col("uuid") != ROOT).select("uuid").join(paths.select(F.col("node_uuid").alias("uuid")), "uuid", "left_anti")
    front = table(without.unionByName(hard).distinct(), "front")
    dead, gone, turn = [front.withColumn("round", F.lit(0))], [], 0
    while not front.isEmpty():
        new = goes.join(front.withColumnRenamed("uuid", "cause"), "cause", "left_semi").select(*KEY, "node_uuid").distinct()
        if gone:
            new = new.join(reduce(DataFrame.unionAll, gone).select(*KEY), KEY, "left_anti")
        gone.append(table(new, "gone"))
        lost = reduce(DataFrame.unionAll, gone).join(gone[-1].select("node_uuid").distinct(), "node_uuid", "left_semi").groupBy(F.col("node_uuid").alias("uuid")).agg(F.count("*").alias("lost"))
        turn += 1
        front = lost.join(had, "uuid").where("lost = had").select("uuid").join(reduce(DataFrame.unionAll, [d.select("uuid") for d in dead]), "uuid", "left_anti")
        front = table(front, "front")
        dead.append(front.withColumn("round", F.lit(turn)))
        if turn % 8 == 0:  # plans stay short
            dead, gone = [table(reduce(DataFrame.unionAll, dead), "dead")], [table(reduce(DataFrame.unionAll, gone), "gone")]
    none = paths.select(*KEY, "node_uuid").where("false")
    return reduce(DataFrame.unionAll, dead), reduce(DataFrame.unionAll, gone) if gone else none


def collect(nodes: DataFrame, edges: DataFrame, paths: DataFrame, memories: DataFrame, glossary: DataFrame, hard: DataFrame | None = None) -> DataFrame:
    """(tbl, key, change) of all rows that a collection removes or retires, as ``dead_nodes`` finds them.

    Removed are the dead nodes' edges, keywords and paths, paths below those, and edges all of whose paths went;
    versions of dead nodes are retired, those of hard ones removed with the node itself.
    """
    hard = hard if hard is not None else nodes.select("uuid").where("false")
    dead, gone = dead_nodes(nodes, edges, paths, hard)
    dead = table(dead.select("uuid").distinct(), "dead")
    whole = dead.join(hard.select("uuid").distinct(), "uuid", "left_semi")
    soft = dead.join(whole, "uuid", "left_anti")
    key = F.concat_ws("|", *KEY)
    left = paths.join(gone.select(*KEY), KEY, "left_anti").select("edge_id").distinct()
    empty = paths.join(gone.select(*KEY), KEY, "left_semi").select("edge_id").distinct().join(left, "edge_id", "left_anti").select(F.col("edge_id").alias("id"))
    ends = lambda c: edges.select("id", F.col(c).alias("uuid")).join(dead, "uuid", "left_semi").select("id")
    row = lambda df, tbl, key_, change: df.select(F.lit(tbl).alias("tbl"), key_.cast("string").alias("key"), F.lit(change).alias("change"))
    of = lambda df, nodes_: df.join(nodes_.withColumnRenamed("uuid", "node_uuid"), "node_uuid", "left_semi")
    return reduce(DataFrame.unionAll, [
        row(gone, "paths", key, "removed"),
        row(empty.unionAll(ends("parent_uuid")).unionAll(ends("child_uuid")).distinct(), "edges", F.col("id"), "removed"),
        row(of(glossary, dead), "glossary", F.concat_ws("|", "keyword", "node_uuid", "namespace"), "removed"),
        row(of(memories.where("not deprecated"), soft), "memories", F.col("id"), "retired"),
        row(of(memories, whole), "memories", F.col("id"), "removed"),
        row(whole, "nodes", F.col("uuid"), "removed"),
    ])


def memoryless(nodes: DataFrame, memories: DataFrame) -> DataFrame:
    """(uuid) of the nodes that have no version at all, which a hard collection deletes."""
    return nodes.where(F.col("uuid") != ROOT).select("uuid").join(memories.select(F.col("node_uuid").alias("uuid")), "uuid", "left_anti")
