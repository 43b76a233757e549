"""Chains, closures and reachability over links, by pointer doubling or a growing frontier; never row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import cut, table


def ends(links: DataFrame, hops: int = 50) -> DataFrame:
    """(id, target, hop): where following links(id, next) from each id ends, within ``hops`` steps; null where a link
    breaks or the chain is longer. Pointer doubling: log2(hops) joins whatever the chains' lengths."""
    at = links.select("id", F.col("next").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hop"))
    step = 1
    while step < hops:
        far = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("hop").alias("hop2"), F.lit(True).alias("there"))
        joined = at.join(far, "to", "left")
        at = joined.select("id", F.when(F.col("to").isNull(), None).when(F.col("there").isNull(), F.col("to")).otherwise(F.coalesce("to2", "to")).alias("to"), (F.col("hop") + F.coalesce("hop2", F.lit(0))).alias("hop"))
        step *= 2
        if step in (8, 64, 512):  # a plan of at most three doublings
            at = cut(at)
    known = links.select(F.col("id").alias("to"), F.col("next").isNull().alias("last"))
    out = at.join(known, "to", "left")
    return out.select("id", F.when(F.col("hop") == 0, F.col("id")).when(F.col("last") & (F.col("hop") <= hops), F.col("to")).alias("target"), "hop")


def descend(edges: DataFrame, start: DataFrame, levels: int | None = None) -> DataFrame:
    """All (node, path, depth) under start(node, path), to the last level or to ``levels``: names joined by slashes, no
    node twice on one path, so rings of edges end."""
    e = edges.select(F.col("parent_uuid").alias("node"), F.col("child_uuid").alias("next"), "name")
    front = start.select("node", "path", F.lit(0).alias("depth"), F.array("node").alias("seen"))
    out, level = front, 0
    while levels is None or level < levels:
        front, level = cut(front), level + 1
        if front.isEmpty():
            break
        front = front.join(e, "node").where(~F.array_contains("seen", F.col("next"))).select(F.col("next").alias("node"), F.concat_ws("/", "path", "name").alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("next")).alias("seen"))
        out = out.unionAll(front)
    return out.drop("seen")


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, node) for every node that links(a, b) reach from start(origin, node), in as many steps as it takes: the
    frontier holds new nodes only, so cycles end."""
    seen = table(start.select("origin", "node"), "seen")
    front = seen
    while True:
        front = front.join(links.select(F.col("a").alias("node"), "b"), "node").select("origin", F.col("b").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti")
        front = table(front, "front")  # a small one is sent to the links
        if front.isEmpty():
            break
        seen = table(seen.unionAll(front), "seen")
    return seen.distinct()
