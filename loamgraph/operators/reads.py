"""Set-at-a-time reads: every function takes frames of keys and answers all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import ROOT


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def resolve(star: DataFrame, paths: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers requests(namespace, domain, path): the active memory there and how many other paths its node has.
    A missing empty path is the domain's virtual root; other missing paths give no row."""
    hit = first_by(star, ["namespace", "domain", "path"], F.col("m_created").desc(), F.col("memory_id").desc())
    many = paths.groupBy("namespace", "node_uuid").agg(F.count("*").alias("n"))
    got = requests.join(hit, ["namespace", "domain", "path"], "left").join(many, ["namespace", "node_uuid"], "left")
    root = F.col("memory_id").isNull() & (F.col("path") == "")
    return got.where(F.col("memory_id").isNotNull() | root).select(
        "namespace", "domain", "path",
        F.when(root, F.lit(ROOT)).otherwise(F.col("node_uuid")).alias("node_uuid"),
        F.when(root, F.lit(0)).otherwise(F.col("memory_id")).cast("long").alias("memory_id"),
        F.when(root, F.concat(F.lit("Root node for domain '"), "domain", F.lit("'."))).otherwise(F.col("content")).alias("content"),
        "priority", "disclosure", F.greatest(F.coalesce(F.col("n"), F.lit(1)) - 1, F.lit(0)).cast("long").alias("alias_count"),
    )


def children_of(edges: DataFrame, paths: DataFrame, active: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of parents(node_uuid, namespace, domain, path), which come along as ctx_domain and ctx_path: one row a child
    and asker, under the path nearest the asker.

    The first edge per child in (priority, name, id) counts; a child without a path of that edge in the namespace is
    left out, and under the root also one without a path in the asker's domain. Among the edge's paths one under the
    asker's path comes first, then one of the domain, then any; ties by domain and path.
    """
    ask = parents.select(F.col("node_uuid").alias("parent_uuid"), "namespace", F.col("domain").alias("ctx_domain"), F.col("path").alias("ctx_path"))
    m = active.select(F.col("node_uuid").alias("child_uuid"), F.col("id").alias("memory_id"), "content")
    e = edges.select("id", "parent_uuid", "child_uuid", "name", "priority", "disclosure")
    first = first_by(e.join(m, "child_uuid"), ["parent_uuid", "child_uuid"], F.col("priority").asc_nulls_first(), "name", "id")
    at = paths.select("namespace", "domain", "path", F.col("edge_id").alias("id"))
    got = ask.join(first, "parent_uuid").join(at, ["id", "namespace"])
    got = got.where((F.col("parent_uuid") != ROOT) | F.col("ctx_domain").isNull() | (F.col("domain") == F.col("ctx_domain")))
    same = F.col("domain") == F.col("ctx_domain")
    tier = F.when(same & F.col("path").startswith(F.concat(F.col("ctx_path"), F.lit("/"))), 1).when(same, 2).otherwise(3)
    return first_by(got, ["parent_uuid", "namespace", "ctx_domain", "ctx_path", "child_uuid"], tier, "domain", "path")


def children(edges: DataFrame, paths: DataFrame, active: DataFrame, parents: DataFrame) -> DataFrame:
    """``children_of`` with a snippet of each child and how many children it has itself."""
    best = children_of(edges, paths, active, parents)
    e, at = edges.select("id", "parent_uuid"), paths.select("namespace", F.col("edge_id").alias("id"))
    below = e.join(at, "id").groupBy(F.col("parent_uuid").alias("child_uuid"), "namespace").agg(F.countDistinct("id").alias("approx_children_count"))
    return best.join(below, ["child_uuid", "namespace"], "left").select(
        "parent_uuid", "namespace", "child_uuid", "domain", "path", "name", "priority", "disclosure", "memory_id",
        T.snippet(F.col("content"), 100).alias("snippet"), F.coalesce("approx_children_count", F.lit(0)).cast("long").alias("approx_children_count"),
    )


def recent(star: DataFrame, limit: int) -> DataFrame:
    """The newest memories, each under its first path."""
    one = first_by(star, ["memory_id"], "namespace", "domain", "path")
    return one.orderBy(F.col("m_created").desc(), "memory_id").limit(limit)


def subtree(paths: DataFrame, domain: str, base: str) -> DataFrame:
    return paths.where((F.col("domain") == domain) & ((F.col("path") == base) | F.col("path").startswith(f"{base}/")))


def breadcrumbs(path: Column) -> Column:
    """Every leading part of a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
