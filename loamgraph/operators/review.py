"""Review of a change set: the node of each row, its cause, groups by root cause, and approval.

Change rows are flat: CHANGE. made: the row was created; gone: it was deleted; neither: it was changed. For edges edge_id
is their own id; for memories was_active and is_active tell the versions' states before and after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import changes as C
from .steps import table

CHANGE = "row_key string, tbl string, node_uuid string, edge_id long, parent_uuid string, namespace string, domain string, path string, made boolean, gone boolean, was_active boolean, is_active boolean"


def node_of(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with ``node``: a node's own id, the node of a memory or keyword, an edge's child; a path without a node takes
    that of its edge, in the change set first and in the live edges then."""
    own = rows.where("tbl = 'edges'").groupBy(F.col("edge_id").alias("e")).agg(F.min("node_uuid").alias("changed_child"))
    live = edges.select(F.col("id").alias("l"), F.col("child_uuid").alias("live_child"))
    got = rows.join(own, F.col("edge_id") == F.col("e"), "left").join(live, F.col("edge_id") == F.col("l"), "left")
    return got.withColumn("node", F.coalesce("node_uuid", F.when(F.col("tbl") == "paths", F.coalesce("changed_child", "live_child")))).drop("e", "l", "changed_child", "live_child")


def causes(rows: DataFrame) -> DataFrame:
    """(row_key, cause): the change that brought each row's change about, where one did.

    A path goes or comes with the path above it, unless its own edge does so too and, when going, the edge above stays.
    An edge goes or comes with a path of it, or else with an edge into its parent. A version that goes, or is retired
    without a new one, goes with a deleted edge into its node; a node goes or comes with an edge into it. Of several
    causes the smallest key counts.
    """
    act = F.when(F.col("made"), "+").when(F.col("gone"), "-")
    r = rows.withColumn("act", act)
    edges = r.where("tbl = 'edges' and act is not null")
    paths = r.where("tbl = 'paths' and act is not null")
    moved = edges.select("edge_id", "act").distinct()
    above = paths.select("namespace", "domain", F.col("path").alias("up"), "act", F.col("row_key").alias("cause"), F.col("edge_id").alias("up_edge"))
    up = paths.where(F.col("path").contains("/")).withColumn("up", T.parent_path(F.col("path"))).join(above, ["namespace", "domain", "up", "act"])
    up = up.join(moved.withColumn("sync", F.lit(True)), ["edge_id", "act"], "left").join(moved.select(F.col("edge_id").alias("up_edge"), "act", F.lit(True).alias("up_moved")), ["up_edge", "act"], "left")
    apart = F.coalesce("sync", F.lit(False)) & (F.col("made") | (F.col("up_edge").isNotNull() & F.col("up_moved").isNull()))
    out = up.where(~apart).groupBy("row_key").agg(F.min("cause").alias("cause"))
    into = edges.groupBy("node_uuid", "act").agg(F.min("row_key").alias("via"))
    by_path = paths.groupBy("edge_id", "act").agg(F.min("row_key").alias("by_path"))
    e = edges.select("row_key", "edge_id", "act", "parent_uuid").join(by_path, ["edge_id", "act"], "left").join(into.withColumnRenamed("node_uuid", "parent_uuid"), ["parent_uuid", "act"], "left")
    out = out.unionByName(e.select("row_key", F.coalesce("by_path", "via").alias("cause")))
    m = r.where("tbl = 'memories'")
    fresh = m.where("made and is_active").select("node_uuid").distinct().withColumn("fresh", F.lit(True))
    m = m.join(fresh, "node_uuid", "left").where("gone or (was_active and not made and not is_active and fresh is null)")
    out = out.unionByName(m.select("row_key", "node_uuid").join(into.where("act = '-'"), "node_uuid").select("row_key", F.col("via").alias("cause")))
    n = r.where("tbl = 'nodes' and act is not null").select("row_key", "node_uuid", "act").join(into, ["node_uuid", "act"])
    out = out.unionByName(n.select("row_key", F.col("via").alias("cause")))
    return out.where("cause is not null and cause <> row_key")


def anchors(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_key, node): the node of each row's root cause. Causes are followed by pointer doubling to their ends, however
    far; rows of a ring of causes stand for themselves. The change set is written once, as each rule of causes reads it."""
    return _anchors(table(rows, "changes"), edges)


def _anchors(rows: DataFrame, edges: DataFrame) -> DataFrame:
    named = table(node_of(rows, edges).select("row_key", "node"), "named")
    at = table(causes(rows), "causes")
    first, n, step = at, at.count(), 1
    while step < n and not at.join(at.select(F.col("row_key").alias("cause")), "cause", "left_semi").isEmpty():
        far = at.select(F.col("row_key").alias("cause"), F.col("cause").alias("cause2"))
        at = table(at.join(far, "cause", "left").select("row_key", F.coalesce("cause2", "cause").alias("cause")), "causes")
        step *= 2
    at = at.join(first.select(F.col("row_key").alias("cause")), "cause", "left_anti")
    root = named.join(at, "row_key", "left").select("row_key", F.coalesce("cause", "row_key").alias("root"))
    return root.join(named.select(F.col("row_key").alias("root"), "node"), "root").select("row_key", "node")


def groups(rows: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Per root cause's node: a uri to show, the most telling table, what happened to it, rows, and namespaces."""
    rows = table(rows, "changes")
    at = _anchors(rows, edges).where("node is not null")
    image = rows.select("row_key", "tbl", F.when(~F.col("made"), F.lit("b")).alias("before"), F.when(~F.col("gone"), F.lit("a")).alias("after"))
    top = C.groups(image.join(at, "row_key").select("tbl", F.col("node").alias("node_uuid"), "before", "after"))
    uri = T.uri_of(F.col("domain"), F.col("path"))
    changed = node_of(rows, edges).where("tbl = 'paths'").select("node", F.struct(F.lit(0).alias("k"), uri.alias("uri")).alias("u"), "namespace")
    live = paths.select(F.col("node_uuid").alias("node"), F.struct(F.lit(1).alias("k"), uri.alias("uri")).alias("u"), "namespace")
    shown = changed.unionByName(live).groupBy("node").agg(F.min("u").alias("u"), F.array_join(F.array_sort(F.collect_set("namespace")), ",").alias("namespaces"))
    got = top.join(shown, F.col("node_uuid") == F.col("node"), "left")
    return got.select("node_uuid", F.coalesce("u.uri", F.concat(F.lit("[unmapped]/"), "node_uuid")).alias("display_uri"), "top_table", "action", "row_count", "namespaces")


def approve(rows: DataFrame, edges: DataFrame, asked: DataFrame, head: int | None) -> DataFrame:
    """(row_key, node, pool, revision_id): rows whose group is in asked(node) move to the approved pool; once no row is
    pending all approved ones are committed as one revision after ``head``."""
    at = anchors(rows, edges).join(asked.select("node", F.lit(True).alias("hit")).distinct(), "node", "left")
    pending = at.agg(F.count(F.when(F.col("hit").isNull(), 1)).alias("pending"))
    pool = F.when(F.col("hit").isNull(), "pending").when(F.col("pending") == 0, "committed").otherwise("approved")
    return at.join(F.broadcast(pending)).select("row_key", "node", pool.alias("pool"), F.when(pool == "committed", F.lit((head or 0) + 1)).cast("long").alias("revision_id"))


def net_zero(rows: DataFrame) -> DataFrame:
    """rows without what came to nothing: rows created and deleted again (made and gone), and with any of these also new
    nodes that no remaining path leads to, their new versions and keywords, and new edges without a remaining path."""
    nil = F.col("made") & F.col("gone")
    some = rows.agg(F.coalesce(F.bool_or(nil), F.lit(False)).alias("some"))
    alive = rows.where(~nil)
    ways = alive.where("tbl = 'paths'")
    ends = alive.where("tbl = 'edges'").select("edge_id", F.col("node_uuid").alias("child"))
    reached = ways.join(ends, "edge_id").select(F.col("child").alias("n")).unionAll(ways.where("node_uuid is not null").select("node_uuid")).distinct().withColumn("reached", F.lit(True))
    created = rows.where("tbl = 'nodes' and made").select(F.col("node_uuid").alias("c")).distinct().withColumn("created", F.lit(True))
    held = ways.select(F.col("edge_id").alias("e")).distinct().withColumn("held", F.lit(True))
    got = rows.join(reached, F.col("node_uuid") == F.col("n"), "left").join(created, F.col("node_uuid") == F.col("c"), "left").join(held, F.col("edge_id") == F.col("e"), "left").join(F.broadcast(some))
    lost = F.when(F.col("tbl") == "nodes", F.col("reached").isNull()).when(F.col("tbl").isin("memories", "glossary_keywords"), F.col("created").isNotNull() & F.col("reached").isNull()).when(F.col("tbl") == "edges", F.col("held").isNull()).otherwise(False)
    return got.where(~(F.col("some") & (nil | (F.col("made") & lost)))).select(rows.columns)


def difference(rows: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Per group: the content before and after. Each is the version that the change set names; where it names none, the
    live one, unless the node or a version was created (before) or deleted (after) in the change set."""
    at = anchors(rows, edges).where("node is not null")
    mine = rows.withColumn("memory_id", F.when(F.col("tbl") == "memories", F.regexp_extract("row_key", r"^memories:(-?\d+)$", 1).cast("long"))).join(at, "row_key")
    is_, own = lambda t: F.col("tbl") == t, F.col("node_uuid") == F.col("node")
    per = mine.groupBy("node").agg(
        F.max(F.when(is_("memories") & F.col("was_active"), F.col("memory_id"))).alias("b_id"), F.max(F.when(is_("memories") & ~F.col("gone") & F.col("is_active"), F.col("memory_id"))).alias("a_id"),
        F.bool_or((is_("nodes") | is_("memories")) & own & F.col("made")).alias("born"), F.bool_or((is_("nodes") | is_("memories")) & own & F.col("gone")).alias("died"),
    )
    live = memories.where("not deprecated").groupBy(F.col("node_uuid").alias("n")).agg(F.max("content").alias("live"))
    text = lambda name: memories.select(F.col("id").alias(f"{name}_id"), F.col("content").alias(name))
    got = per.join(text("b"), "b_id", "left").join(text("a"), "a_id", "left").join(live, F.col("node") == F.col("n"), "left")
    return got.select(F.col("node").alias("node_uuid"), F.when(F.col("b_id").isNotNull(), F.col("b")).when(~F.col("born"), F.col("live")).alias("before"), F.when(F.col("a_id").isNotNull(), F.col("a")).when(~F.col("died"), F.col("live")).alias("after"))


def rollback(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, step, row_key, action): what undoes each group, in order. A created node goes with all it has, and nothing
    else of its group is needed; else created paths go, the deepest first, deleted ones return, the highest first, then
    the version that was active and the deleted keywords return and created keywords go."""
    mine = rows.join(anchors(rows, edges).where("node is not null"), "row_key")
    fresh = mine.where("tbl = 'nodes' and made").select("node").distinct().withColumn("fresh", F.lit(True))
    mine = mine.join(fresh, "node", "left")
    deep = F.size(F.split("path", "/"))
    path, word = F.col("tbl") == "paths", F.col("tbl") == "glossary_keywords"
    action = (
        F.when(F.col("fresh"), F.when((F.col("tbl") == "nodes") & F.col("made"), F.struct(F.lit("delete node").alias("action"), F.lit(0).alias("k"), F.lit(0).alias("d"))))
        .when(path & F.col("made"), F.struct(F.lit("remove path").alias("action"), F.lit(1).alias("k"), (-deep).alias("d"))).when(path & F.col("gone"), F.struct(F.lit("restore path").alias("action"), F.lit(2).alias("k"), deep.alias("d")))
        .when((F.col("tbl") == "memories") & F.col("was_active"), F.struct(F.lit("restore version").alias("action"), F.lit(3).alias("k"), F.lit(0).alias("d")))
        .when(word & F.col("made"), F.struct(F.lit("unbind").alias("action"), F.lit(4).alias("k"), F.lit(0).alias("d"))).when(word & F.col("gone"), F.struct(F.lit("bind").alias("action"), F.lit(4).alias("k"), F.lit(0).alias("d")))
    )
    got = mine.withColumn("x", action).where("x is not null")
    step = F.row_number().over(Window.partitionBy("node").orderBy("x.k", "x.d", "row_key"))
    return got.select("node", step.cast("long").alias("step"), "row_key", "x.action")


def checkout(revisions: DataFrame, writes: DataFrame, head: DataFrame) -> DataFrame:
    """(target, row_key, before): for each revision at or above head(origin), the images that going back to it restores: of
    all revisions below it up to the head, each key's before-image nearest the head. writes(id, row_key, before)."""
    up = C.ancestors(revisions, head)
    undone = writes.join(up.select("id", "depth"), "id")
    targets = up.select(F.col("id").alias("target"), F.col("depth").alias("at"))
    # the nearest image of a key to the head is the same for all targets beyond it: one row per key, then the targets
    first = undone.groupBy("row_key").agg(F.min(F.struct("depth", "before")).alias("x"))
    return targets.join(first, F.col("x.depth") < F.col("at")).select("target", "row_key", F.col("x.before").alias("before"))
