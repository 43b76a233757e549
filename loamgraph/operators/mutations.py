"""Batch mutations: each takes tables and a frame of requests and returns the rows that change, before and after.

Requests of one batch are taken as simultaneous; where two touch the same key the one with the smallest ``seq`` wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udfs import nfc
from ..schema import ROOT
from . import recursive as C
from .reads import first_by
from .steps import cut, table


def numbered(df: DataFrame, after: DataFrame, column: str, *order) -> DataFrame:
    """New ids from the largest one on, in the batch's order: each range of it is sorted by itself and starts after the
    rows of those before."""
    top = after.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top"))
    dealt = table(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    ranges = dealt.groupBy(F.shiftright("_i", 33).alias("_r")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = dealt.withColumn("_r", F.shiftright("_i", 33)).join(F.broadcast(starts), "_r").join(F.broadcast(top))
    return at.withColumn(column, F.col("_top") + F.col("_start") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).drop("_top", "_i", "_r", "_start")


def create(paths: DataFrame, edges: DataFrame, memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Plans requests(seq, namespace, domain, parent_path, title, content, priority): the new path, its parent's node, the
    new memory's id and a status: ok, no parent, or taken. Without a title the next free number under the parent is used."""
    p = paths.select("namespace", "domain", F.col("path").alias("parent_path"), F.col("node_uuid").alias("parent_uuid"))
    got = requests.join(p, ["namespace", "domain", "parent_path"], "left").withColumn("parent_uuid", F.when(F.col("parent_path") == "", F.lit(ROOT)).otherwise(F.col("parent_uuid")))
    number = edges.groupBy(F.col("parent_uuid")).agg(F.coalesce(F.max(F.col("name").try_cast("bigint")), F.lit(0)).alias("top"))
    order = Window.partitionBy("namespace", "parent_uuid", F.col("title").isNull()).orderBy("seq")
    got = got.join(number, "parent_uuid", "left").withColumn("name", F.coalesce("title", (F.greatest(F.coalesce("top", F.lit(0)), F.lit(0)) + F.row_number().over(order)).cast("string")))
    got = got.withColumn("path", F.when(F.col("parent_path") == "", F.col("name")).otherwise(F.concat_ws("/", "parent_path", "name")))
    taken = paths.select("namespace", "domain", "path", F.lit(True).alias("taken"))
    first = F.row_number().over(Window.partitionBy("namespace", "domain", "path").orderBy("seq")) == 1
    got = got.join(taken, ["namespace", "domain", "path"], "left").withColumn("first", first)
    status = F.when(F.col("parent_uuid").isNull(), "no parent").when(F.col("taken") | ~F.col("first"), "taken").otherwise("ok")
    return got.select("seq", "namespace", "domain", "path", "parent_uuid", "name", nfc(F.col("content")).alias("content"), "priority", status.alias("status"))


def update_content(memories: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """New versions for requests(node_uuid, content): the new active row, and the old one retired towards it."""
    active = memories.where("not deprecated")
    both = active.join(requests.select("node_uuid", F.col("content").alias("new_content")), "node_uuid")
    new = numbered(both, memories.withColumnRenamed("id", "new_id"), "new_id", "node_uuid")
    old = new.select("id", "node_uuid", "content", F.lit(True).alias("deprecated"), F.col("new_id").alias("migrated_to"), "world_timestamp")
    fresh = new.select(F.col("new_id").alias("id"), "node_uuid", nfc(F.col("new_content")).alias("content"), F.lit(False).alias("deprecated"), F.lit(None).cast("long").alias("migrated_to"), "world_timestamp")
    return old.unionByName(fresh)


def rollback_to(memories: DataFrame, targets: DataFrame) -> DataFrame:
    """Makes each target id the active version of its node; the one that was active moves towards it."""
    t = memories.join(targets, "id").where("deprecated").select(F.col("id").alias("target"), "node_uuid")
    m = memories.join(t, "node_uuid").where((F.col("id") == F.col("target")) | ~F.col("deprecated"))
    back = F.col("id") == F.col("target")
    return m.select("id", "node_uuid", (~back).alias("deprecated"), F.when(~back, F.col("target")).alias("migrated_to"))


def purge(memories: DataFrame, targets: DataFrame) -> DataFrame:
    """Deletes retired versions: predecessors skip over them to the next version that stays; returns what is left of
    the touched nodes."""
    gone = memories.join(targets, "id").where("deprecated").select("id", "migrated_to", "node_uuid")
    left = memories.join(gone.select("node_uuid").distinct(), "node_uuid").join(gone.select("id"), "id", "left_anti")
    # runs of deleted versions are skipped whole: pointers double until none leads to a deleted version
    at = cut(gone.select("id", F.col("migrated_to").alias("goal")))
    n, step = at.count(), 1
    while step < n and not at.join(at.select(F.col("id").alias("goal")), "goal", "left_semi").isEmpty():
        far = at.select(F.col("id").alias("goal"), F.col("goal").alias("goal2"), F.lit(True).alias("dead"))
        at = cut(at.join(far, "goal", "left").select("id", F.when(F.col("dead"), F.col("goal2")).otherwise(F.col("goal")).alias("goal")))
        step *= 2
    # what still leads to a deleted version runs in a ring of them, after which no version stays
    known = at.select(F.col("id").alias("g"), "goal").join(gone.select(F.col("id").alias("goal")), "goal", "left_anti")
    over = gone.select(F.col("id").alias("g"), F.lit(True).alias("dead")).join(known, "g", "left")
    return left.join(over, F.col("migrated_to") == F.col("g"), "left").select("id", "node_uuid", F.when(F.col("dead"), F.col("goal")).otherwise(F.col("migrated_to")).alias("migrated_to"))


def cascade(edges: DataFrame, paths: DataFrame, aliases: DataFrame) -> DataFrame:
    """Paths that aliases(namespace, domain, path, node_uuid) bring: the alias and one for each way down from its node, to
    the last level, unless taken."""
    start = aliases.select(F.col("node_uuid").alias("node"), "path", "namespace", "domain")
    front = start.select("node", "path", F.lit(0).alias("depth"), F.array("node").alias("seen"), "namespace", "domain")
    out = front
    e = edges.select(F.col("parent_uuid").alias("node"), F.col("child_uuid").alias("next"), "name")
    while True:
        front = cut(front)
        if front.isEmpty():
            break
        front = front.join(e, "node").where(~F.array_contains("seen", F.col("next"))).select(F.col("next").alias("node"), F.concat_ws("/", "path", "name").alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("next")).alias("seen"), "namespace", "domain")
        out = out.unionByName(front)
    new = out.select("namespace", "domain", "path", F.col("node").alias("node_uuid"), "depth").join(paths.select("namespace", "domain", "path"), ["namespace", "domain", "path"], "left_anti")
    return first_by(new, ["namespace", "domain", "path"], "depth", "node_uuid")


def would_cycle(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """For requests(parent_uuid, child_uuid): whether the parent is the child or below it; never for the root."""
    hit = above(edges, requests.select("parent_uuid")).withColumn("hit", F.lit(True))
    got = requests.join(hit, ["child_uuid", "parent_uuid"], "left")
    return got.select("parent_uuid", "child_uuid", F.when(F.col("parent_uuid").isNotNull(), F.coalesce("hit", F.lit(False))).alias("cycle"))


def above(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_uuid, child_uuid): what may not hang below parents(parent_uuid), which is each itself and all above it; nothing
    for the root. Going up from the parents meets far less than going down from all that is to hang there."""
    links = edges.select(F.col("child_uuid").alias("a"), F.col("parent_uuid").alias("b"))
    top = parents.where(F.col("parent_uuid") != ROOT).select(F.col("parent_uuid").alias("origin"), F.col("parent_uuid").alias("node")).distinct()
    return C.reachable(links, top).select(F.col("origin").alias("parent_uuid"), F.col("node").alias("child_uuid"))


def remove_paths(paths: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """Plans the removal of requests(namespace, domain, path) with everything below: for each path that goes, whether its
    node keeps another path, and a request's status: refused while a direct child would be left without any path."""
    r = requests.select("namespace", "domain", F.col("path").alias("base"))
    p = paths.select("namespace", "domain", "path", "node_uuid")
    tops = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/")))
    going = p.withColumn("base", tops).join(r, ["namespace", "domain", "base"])
    left = p.join(going.select("namespace", "domain", "path").distinct(), ["namespace", "domain", "path"], "left_anti").select(F.col("node_uuid").alias("n")).distinct().withColumn("stays", F.lit(True))
    got = going.join(left, F.col("node_uuid") == F.col("n"), "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    direct = (F.col("path") != F.col("base")) & (~F.substring(F.col("path"), F.length("base") + 2, 1 << 20).contains("/"))
    stuck = got.groupBy("namespace", "domain", "base").agg(F.max(direct & ~F.col("stays")).alias("refused"))
    return got.join(stuck, ["namespace", "domain", "base"]).select("namespace", "domain", "base", "path", "node_uuid", "stays", "refused")


def unreachable(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes that no path leads to; a soft collection retires their memories."""
    return nodes.join(paths.select(F.col("node_uuid").alias("uuid")), "uuid", "left_anti").select("uuid")
