"""Second paths to nodes, with what forbids them, and the lines of the health report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import ROOT
from .mutations import numbered, would_cycle
from .reads import first_by
from .steps import cut


def alias(paths: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(seq, namespace, domain, path, target_domain, target_path, priority, disclosure), all upon the same tables:
    seq, status, parent_uuid, node_uuid, name, priority, disclosure and edge_id.

    Statuses, the first that holds: 'root' (an empty path), 'no target', 'no parent', 'taken' (a path that is there, or that
    a request with a smaller seq gets), 'cycle' (the parent is the target or below it; never the root), 'ok'. The edge is the one
    that the two nodes have (edge_id) or a new one (null) with the request's priority, 0 without, and its disclosure or else
    that of the target's own edge. ``mutations.cascade`` adds the paths below.
    """
    at = paths.select("namespace", F.col("domain").alias("target_domain"), F.col("path").alias("target_path"), F.col("node_uuid"), "edge_id")
    own = edges.select(F.col("id").alias("edge_id"), F.col("disclosure").alias("own"))
    got = requests.join(at, ["namespace", "target_domain", "target_path"], "left").join(own, "edge_id", "left").drop("edge_id")
    got = got.withColumn("parent_path", T.parent_path(F.col("path")))
    ups = paths.select("namespace", "domain", F.col("path").alias("parent_path"), F.col("node_uuid").alias("up"))
    got = got.join(ups, ["namespace", "domain", "parent_path"], "left").withColumn("parent_uuid", F.when(F.col("parent_path") == "", F.lit(ROOT)).otherwise(F.col("up")))
    there = paths.select("namespace", "domain", "path", F.lit(True).alias("there"))
    got = got.join(there, ["namespace", "domain", "path"], "left")
    early = F.when(F.col("path") == "", "root").when(F.col("node_uuid").isNull(), "no target").when(F.col("parent_uuid").isNull(), "no parent").when(F.col("there"), "taken")
    got = cut(got.withColumn("early", early))
    pairs = got.where("early is null").select("parent_uuid", F.col("node_uuid").alias("child_uuid")).distinct()
    ring = would_cycle(edges, pairs).select("parent_uuid", F.col("child_uuid").alias("node_uuid"), "cycle")
    got = cut(got.join(ring, ["parent_uuid", "node_uuid"], "left").withColumn("early", F.coalesce("early", F.when(F.col("cycle"), "cycle"))))
    best = got.where("early is null").groupBy("namespace", "domain", "path").agg(F.min("seq").alias("best"))
    got = got.join(best, ["namespace", "domain", "path"], "left")
    status = F.coalesce("early", F.when(F.col("seq") > F.col("best"), "taken"), F.lit("ok"))
    had = edges.select("parent_uuid", F.col("child_uuid").alias("node_uuid"), F.col("id").alias("edge_id"), F.col("name").alias("had_name"), F.col("priority").alias("had_priority"), F.col("disclosure").alias("had_disclosure"))
    got = got.withColumn("status", status).join(first_by(had, ["parent_uuid", "node_uuid"], "edge_id"), ["parent_uuid", "node_uuid"], "left")
    old = F.col("edge_id").isNotNull()
    pick = lambda a, b: F.when(old, F.col(a)).otherwise(b)
    note = F.coalesce("disclosure", F.when(F.col("own") != "", F.col("own")))
    return got.select(
        "seq", "status", "parent_uuid", "node_uuid", pick("had_name", T.last_segment(F.col("path"))).alias("name"), pick("had_priority", F.coalesce("priority", F.lit(0))).alias("priority"), pick("had_disclosure", note).alias("disclosure"), "edge_id",
    )


def report(stale: DataFrame, crowded: DataFrame, orphaned: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(section, n, line, text): the health report as numbered items of one or more lines, in the order of section, n and line.

    stale(uri, priority, stale_days, threshold, last), crowded(uri, n), orphaned(uri, memory_id, created) and duplicates(domain,
    parent, memory_id, paths). Items are numbered over ranges, so a section may be of any size. Fixed formats.
    """
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    memory = F.coalesce(F.concat(F.lit("Memory ID: "), F.col("memory_id").cast("string")), F.lit("No active memory"))
    used = F.coalesce(F.concat(F.lit("Last Accessed: "), F.date_format("last", "yyyy-MM-dd")), F.lit("Never accessed (since tracking began)"))

    def items(df: DataFrame, section: int, lines: Column, *order) -> DataFrame:
        none = df.sparkSession.range(0).select(F.col("id").alias("i"))
        at = numbered(df.withColumn("lines", lines), none, "i", *order)
        return at.select(F.lit(section).alias("section"), F.col("i").alias("n"), F.posexplode("lines").alias("line", "text")).withColumn("text", F.when(F.col("line") == 0, F.concat(F.col("n").cast("string"), F.lit(". "), "text")).otherwise(F.col("text")))

    head = "Priority: "
    parts = [
        items(stale, 1, F.array(F.col("uri"), text("   ", head, F.col("priority"), " | Stale for: ~", F.col("stale_days"), " days (Threshold: ", F.col("threshold"), " days) | ", used)), F.coalesce("priority", F.lit(999)), F.col("stale_days").desc(), "uri"),
        items(crowded, 2, F.array(text(F.col("uri"), " (", F.col("n_children"), " children)")), F.col("n_children").desc(), "uri"),
        items(orphaned, 3, F.array(F.col("uri"), text("   ", memory, " | Created: ", F.coalesce(F.date_format("created", "yyyy-MM-dd"), F.lit("Unknown")))), "uri"),
        items(duplicates, 4, F.concat(F.array(memory, text("   Parent: ", F.col("domain"), "://", F.col("parent")), text("   Duplicate Paths (", F.size("paths"), "):")), F.transform("paths", lambda p: F.concat(F.lit("     - "), F.col("domain"), F.lit("://"), p))), "domain", "parent", F.element_at("paths", 1)),
    ]
    return reduce(DataFrame.unionAll, parts)
