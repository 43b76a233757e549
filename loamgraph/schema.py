"""The tables of a versioned text graph and what always holds for them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "ROOT"
NODES = "uuid string, created_at timestamp_ntz, last_accessed_at timestamp_ntz"
MEMORIES = "id long, node_uuid string, content string, deprecated boolean, migrated_to long, created_at timestamp_ntz, world_timestamp string"
EDGES = "id long, parent_uuid string, child_uuid string, name string, priority int, disclosure string, created_at timestamp_ntz"
PATHS = "namespace string, domain string, path string, edge_id long, node_uuid string, created_at timestamp_ntz"
GLOSSARY = "id long, keyword string, node_uuid string, namespace string, created_at timestamp_ntz"
LOGS = "id long, node_uuid string, namespace string, accessed_at timestamp_ntz, context string"
REVISIONS = "id long, parent_id long, namespace string, author string, message string, created_at timestamp_ntz"


def violations(memories: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(rule, key, n) of every broken uniqueness rule: one active memory a node, one edge a pair, one row a path."""
    many = lambda df, rule, *cols: df.groupBy(F.concat_ws("|", *cols).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), "key", "n")
    active = many(memories.where("not deprecated and node_uuid is not null"), "active memory", "node_uuid")
    return active.unionAll(many(edges, "edge", "parent_uuid", "child_uuid")).unionAll(many(paths, "path", "namespace", "domain", "path"))
