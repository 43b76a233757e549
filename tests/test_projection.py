"""The projected star and nodes against joins of the paths, edges and memories, also where rows are missing."""

import os

from loamgraph.fixtures import _KEPT, graph
from pyspark.sql import functions as F


def same(a, b):
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(a.columns)).isEmpty() and b.exceptAll(a.select(b.columns)).isEmpty()


def joined(g):
    e = g.edges.select(F.col("id").alias("edge_id"), "parent_uuid", F.col("child_uuid").alias("node_uuid"), "name", "priority", "disclosure")
    m = g.active.select(F.col("id").alias("memory_id"), "node_uuid", "content", F.col("created_at").alias("m_created"), "world_timestamp")
    return g.paths.drop("node_uuid", "created_at").join(e, "edge_id").join(m, "node_uuid")


def test_star_without_some_customers_nations_and_lines(spark, sf, tmp_path):
    for f in os.listdir(sf):
        name, df = f[:-8], spark.read.parquet(f"{sf}/{f}")
        for table, gone in (("customer", "c_custkey % 7 = 3"), ("nation", "n_nationkey = 4"), ("lineitem", "l_orderkey % 9 = 2")):
            df = df.where(f"not ({gone})") if name == table else df
        df.write.parquet(f"{tmp_path}/{f}")
    g = graph(spark, str(tmp_path))
    assert g.star.count() > 0 and {k[2] for k in _KEPT if k[1] == g.state} == {"star"}  # no other table was written for it
    assert same(g.star, joined(g))
    last = g.logs.groupBy("node_uuid").agg(F.max("accessed_at").alias("last_accessed_at"))
    made = g.edges.groupBy(F.col("child_uuid").alias("uuid")).agg(F.min("created_at").alias("created_at"))
    assert same(g.nodes, made.join(last, F.col("uuid") == F.col("node_uuid"), "left").drop("node_uuid"))
