"""Batch restores, deletions, edits and keyword bindings; requests of a batch are simultaneous and answered with a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import fuzzy_patch
from ..functions.udfs import nfc
from ..schema import ROOT
from .mutations import above
from .reads import first_by
from .steps import table


def _ups(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """(namespace, domain, up, at): the paths that requests want to be below, once each, with their nodes."""
    asked = requests.select("namespace", "domain", T.parent_path(F.col("path")).alias("up")).distinct()
    up = paths.select("namespace", "domain", F.col("path").alias("up"), F.col("node_uuid").alias("at"))
    return table(up.join(asked, ["namespace", "domain", "up"], "left_semi"), "ups")


def _parent(requests: DataFrame, paths: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """requests with found_parent, the node at the path above (the root for top paths), and taken."""
    got = requests.withColumn("up", T.parent_path(F.col("path")))
    up = up if up is not None else _ups(requests, paths)
    there = paths.select("namespace", "domain", "path", F.lit(True).alias("taken"))
    got = got.join(up, ["namespace", "domain", "up"], "left").join(there, ["namespace", "domain", "path"], "left")
    return got.withColumn("found_parent", F.when(F.col("up") == "", F.lit(ROOT)).otherwise(F.col("at"))).drop("at")


def restore_paths(nodes: DataFrame, memories: DataFrame, edges: DataFrame, paths: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers requests(seq, namespace, domain, path, node_uuid, parent_uuid, priority, disclosure): the parent, the edge
    that is there already (null: a new one named after the last segment), the version to activate (null: one is active)
    and a status: ok, root, no node, no memory or taken. A missing parent path falls back to the root."""
    got = _parent(requests, paths)
    parent = F.coalesce("parent_uuid", "found_parent", F.lit(ROOT))
    e = edges.groupBy(F.col("parent_uuid").alias("p"), F.col("child_uuid").alias("c")).agg(F.min("id").alias("edge_id"))
    got = got.withColumn("parent", parent).join(e, (F.col("parent") == F.col("p")) & (F.col("node_uuid") == F.col("c")), "left")
    known = nodes.select(F.col("uuid").alias("u"), F.lit(True).alias("known"))
    versions = memories.groupBy(F.col("node_uuid").alias("m")).agg(F.max_by("id", F.struct("created_at", "id")).alias("latest"), F.max(~F.col("deprecated")).alias("active"))
    got = got.join(known, F.col("node_uuid") == F.col("u"), "left").join(versions, F.col("node_uuid") == F.col("m"), "left")
    first = F.row_number().over(Window.partitionBy("namespace", "domain", "path").orderBy("seq")) == 1
    status = F.when(F.col("path") == "", "root").when(F.col("known").isNull(), "no node").when(F.col("latest").isNull(), "no memory").when(F.col("taken") | ~first, "taken").otherwise("ok")
    return got.select("seq", "namespace", "domain", "path", "node_uuid", F.col("parent").alias("parent_uuid"), T.last_segment(F.col("path")).alias("name"), "edge_id", F.when(~F.col("active"), F.col("latest")).alias("reactivated"), status.alias("status"))


def restore_orphans(memories: DataFrame, edges: DataFrame, paths: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers requests(seq, memory_id, namespace, domain, path): a version that has no successor gets a path of its own
    and becomes its node's active one. Status: ok, no path, no memory, no parent, taken, superseded or cycle."""
    m = memories.select(F.col("id").alias("memory_id"), "node_uuid", "migrated_to", F.lit(True).alias("known"))
    up = _ups(requests, paths)
    got = _parent(requests.join(m, "memory_id", "left"), paths, up)
    rings = table(above(edges, up.select(F.col("at").alias("parent_uuid"))), "rings").select(F.col("parent_uuid").alias("found_parent"), F.col("child_uuid").alias("node_uuid"), F.lit(True).alias("cycle"))
    got = got.join(rings, ["found_parent", "node_uuid"], "left")
    first = F.row_number().over(Window.partitionBy("namespace", "domain", "path").orderBy("seq")) == 1
    status = (
        F.when(F.coalesce("path", F.lit("")) == "", "no path").when(F.col("known").isNull(), "no memory").when(F.col("found_parent").isNull(), "no parent")
        .when(F.col("taken") | ~first, "taken").when(F.col("migrated_to").isNotNull(), "superseded").when(F.col("cycle"), "cycle").otherwise("ok")
    )
    return got.select("seq", "memory_id", "node_uuid", "namespace", "domain", "path", F.col("found_parent").alias("parent_uuid"), status.alias("status"))


def delete_nodes(nodes: DataFrame, memories: DataFrame, edges: DataFrame, paths: DataFrame, glossary: DataFrame, asked: DataFrame) -> DataFrame:
    """(tbl, pk, node_uuid) of every row that goes with asked(node_uuid): the nodes, their versions and keywords, every edge
    from or into them, the paths of these edges and all paths below those. The root stays."""
    a = asked.where(F.col("node_uuid") != ROOT).select("node_uuid").distinct()
    at = lambda c: F.col(c).cast("string")
    e = edges.join(a.select(F.col("node_uuid").alias("parent_uuid")), "parent_uuid", "left_semi").unionByName(edges.join(a.select(F.col("node_uuid").alias("child_uuid")), "child_uuid", "left_semi")).select("id", "child_uuid").distinct()
    tops = paths.join(e.select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("namespace", "domain", F.col("path").alias("base")).distinct()
    ways = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/")))
    p = paths.withColumn("base", ways).join(tops, ["namespace", "domain", "base"], "left_semi").select("namespace", "domain", "path", "node_uuid").distinct()
    own = lambda df, c: df.join(a.select(F.col("node_uuid").alias(c)), c, "left_semi")
    row = lambda df, tbl, pk, node: df.select(F.lit(tbl).alias("tbl"), pk.alias("pk"), F.col(node).alias("node_uuid"))
    return (
        row(own(nodes, "uuid"), "nodes", F.col("uuid"), "uuid").unionAll(row(own(memories, "node_uuid"), "memories", at("id"), "node_uuid"))
        .unionAll(row(e, "edges", at("id"), "child_uuid")).unionAll(row(p, "paths", F.concat_ws("|", "namespace", "domain", "path"), "node_uuid"))
        .unionAll(row(own(glossary, "node_uuid"), "glossary_keywords", F.concat_ws("|", "keyword", "node_uuid", "namespace"), "node_uuid"))
    )


def edited(rows: DataFrame) -> DataFrame:
    """rows(id, content, old, new, appended, line, line_content) with the new content and a status.

    One way of editing a row: the only occurrence of ``old`` becomes ``new`` (with written-out newlines read as such, then
    by the fuzzy patch, where it does not occur), or ``appended`` follows, or a line is replaced. Status: ok, or what
    forbids it: several ways, nothing, incomplete, same, ambiguous, not found, empty, out of range; content stays then.
    """
    c, old, new = F.col("content"), F.col("old"), F.col("new")
    ways = old.isNotNull().cast("int") + F.col("appended").isNotNull().cast("int") + F.col("line").isNotNull().cast("int")
    plain_old, plain_new = T.literal_newlines(old), T.literal_newlines(new)
    times = lambda x: F.when(x == "", 0).otherwise(F.floor((F.length(c) - F.length(F.replace(c, x, F.lit("")))) / F.length(x)))
    got = rows.withColumn("hits", times(old)).withColumn("plain_hits", F.when(plain_old != old, times(plain_old)).otherwise(0))
    got = got.withColumn("patched", F.when((ways == 1) & old.isNotNull() & new.isNotNull() & (F.col("hits") == 0) & (F.col("plain_hits") != 1), fuzzy_patch(c, old, new)))
    swapped = F.when(F.col("hits") == 1, F.replace(c, old, new)).when(F.col("plain_hits") == 1, F.replace(c, plain_old, plain_new)).otherwise(F.col("patched"))
    lines = F.split(c, "\n", -1)
    line = F.col("line").cast("int")
    put = F.array_join(F.concat(F.slice(lines, F.lit(1), line - 1), F.array("line_content"), F.slice(lines, line + 1, F.size(lines))), "\n")
    inside = (line >= 1) & (line <= F.size(lines))
    fresh = F.when(old.isNotNull(), swapped).when(F.col("appended").isNotNull(), F.concat(c, "appended")).when(inside, put)
    got = got.withColumn("fresh", fresh)
    status = (
        F.when(ways > 1, "several ways").when(ways == 0, "nothing").when(old.isNotNull() & new.isNull(), "incomplete").when(line.isNotNull() & F.col("line_content").isNull(), "incomplete")
        .when(old.isNotNull() & (old == new), "same").when(F.col("hits") > 1, "ambiguous").when(old.isNotNull() & F.col("fresh").isNull(), "not found")
        .when(F.col("appended") == "", "empty").when(line.isNotNull() & ~inside, "out of range").when(F.col("fresh") == c, "same").otherwise("ok")
    )
    return got.withColumn("status", status).select("id", F.when(F.col("status") == "ok", nfc(F.col("fresh"))).otherwise(c).alias("content"), "status")


def bind_keywords(glossary: DataFrame, nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers requests(seq, keyword, node_uuid, namespace) to bind trimmed keywords: ok, empty, no node or bound."""
    r = requests.withColumn("keyword", F.regexp_replace("keyword", r"^\s+|\s+$", ""))
    known = nodes.select(F.col("uuid").alias("node_uuid"), F.lit(True).alias("known"))
    there = glossary.select("keyword", "node_uuid", "namespace", F.lit(True).alias("there")).distinct()
    first = F.row_number().over(Window.partitionBy("keyword", "node_uuid", "namespace").orderBy("seq")) == 1
    got = r.join(known, "node_uuid", "left").join(there, ["keyword", "node_uuid", "namespace"], "left")
    status = F.when(F.col("keyword") == "", "empty").when(F.col("known").isNull(), "no node").when(F.col("there") | ~first, "bound").otherwise("ok")
    return got.select("seq", "keyword", "node_uuid", "namespace", status.alias("status"))


def unbind_keywords(glossary: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers requests(seq, keyword, node_uuid, namespace) with the binding that goes (the first to ask gets it) or null."""
    r = requests.withColumn("keyword", F.regexp_replace("keyword", r"^\s+|\s+$", ""))
    got = r.join(first_by(glossary, ["keyword", "node_uuid", "namespace"], "id").select("id", "keyword", "node_uuid", "namespace"), ["keyword", "node_uuid", "namespace"], "left")
    first = F.row_number().over(Window.partitionBy("keyword", "node_uuid", "namespace").orderBy("seq")) == 1
    return got.select("seq", "keyword", "node_uuid", "namespace", F.when(first, F.col("id")).alias("removed"))


def remember(paths: DataFrame, edges: DataFrame, memories: DataFrame, requests: DataFrame, clock: str | None = None) -> DataFrame:
    """``create`` for requests(seq, namespace, domain, parent_path, title, content, priority, disclosure, time): a child needs
    a condition to be found by and a plain title; its world time is the one given, else its parent's, else the clock's."""
    from .mutations import create

    made = create(paths, edges, memories, requests.select("seq", "namespace", "domain", "parent_path", "title", "content", "priority"))
    up = memories.where("not deprecated").groupBy(F.col("node_uuid").alias("n")).agg(F.max("world_timestamp").alias("parent_time"))
    got = made.join(requests.select("seq", "parent_path", "title", "disclosure", "time"), "seq").join(up, F.col("parent_uuid") == F.col("n"), "left")
    below = F.col("parent_path") != ""
    status = F.when(below & (F.trim(F.coalesce("disclosure", F.lit(""))) == ""), "no condition").when(F.col("title").isNotNull() & ~F.col("title").rlike(T.TITLE), "bad title").otherwise(F.col("status"))
    time = F.coalesce("time", F.when(below, F.col("parent_time")), F.lit(clock))
    return got.select("seq", "namespace", "domain", "path", "parent_uuid", "name", "content", "priority", "disclosure", time.alias("world_timestamp"), status.alias("status"))


def merge(star: DataFrame, glossary: DataFrame, requests: DataFrame) -> DataFrame:
    """Per requests(target, namespace, domain, path), one row a source: how many sources there are and how many are found,
    the distinct keywords that move to the target, and a status: ok, too few, or missing. Sources of a merge that is ok
    lose their paths."""
    s = star.select("namespace", "domain", "path", "node_uuid").distinct()
    got = requests.join(s, ["namespace", "domain", "path"], "left")
    words = glossary.groupBy("node_uuid").agg(F.collect_set("keyword").alias("words"))
    got = got.join(words, "node_uuid", "left")
    per = got.groupBy("target").agg(F.count("*").alias("sources"), F.count("node_uuid").alias("found"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("words", F.array().cast("array<string>")))))), ",").alias("keywords"))
    return per.withColumn("status", F.when(F.col("sources") < 2, "too few").when(F.col("found") < F.col("sources"), "missing").otherwise("ok"))


def edges_for(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """The edge of each requests(seq, parent_uuid, child_uuid, name, priority): the one that joins the pair, or a new one,
    which the first request for the pair names. New ids follow the largest one, in the order of the pairs."""
    from .mutations import numbered

    there = edges.groupBy("parent_uuid", "child_uuid").agg(F.min("id").alias("id"))
    there = there.join(edges.select("id", "name", "priority"), "id")
    fresh = first_by(requests.join(there.select("parent_uuid", "child_uuid"), ["parent_uuid", "child_uuid"], "left_anti"), ["parent_uuid", "child_uuid"], "seq")
    made = numbered(fresh.select("parent_uuid", "child_uuid", "name", "priority"), edges, "id", "parent_uuid", "child_uuid")
    cols = ["parent_uuid", "child_uuid", "id", "name", "priority"]
    every = there.select(*cols, F.lit(False).alias("created")).unionByName(made.select(*cols, F.lit(True).alias("created")))
    return requests.select("seq", "parent_uuid", "child_uuid").join(every, ["parent_uuid", "child_uuid"]).select("seq", *cols, "created")


def pointers(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """(row_key, before): the versions of asked(node_uuid) as a change set keeps them, by id and state without content."""
    gone = memories.join(asked.select("node_uuid").distinct(), "node_uuid", "left_semi")
    return gone.select(F.concat(F.lit("memories:"), F.col("id").cast("string")).alias("row_key"), F.to_json(F.struct("id", "node_uuid", "deprecated", "migrated_to")).alias("before"))
