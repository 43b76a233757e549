"""Boot presets, key unions and net-zero filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query

BOOT = "map<string,array<string>>"
#: (id, name, boot uris by namespace as JSON, active)
PRESETS = [(1, "plain", '{"": ["core://ASIA"]}', False), (2, "work", '{"": ["core://ASIA", "core://EUROPE"], "ns_building": ["core://cust_1"]}', True), (3, "empty", "{}", False)]
_ROWS = ", ".join(f"({i}, '{n}', '{j}', {str(a).lower()})" for i, n, j, a in PRESETS)
_WITH = f", pre(id, name, boot_uris, is_active) AS (VALUES {_ROWS})"


def presets(g) -> DataFrame:
    return g.spark.createDataFrame(PRESETS, "id int, name string, boot_uris string, is_active boolean")


def boot_uris(rows: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Per namespace the active preset's list: its own, else the default one, else nothing."""
    m = rows.where("is_active").select(F.from_json("boot_uris", BOOT).alias("m"))
    pick = F.coalesce(F.try_element_at("m", F.col("namespace")), F.try_element_at("m", F.lit("")), F.array().cast("array<string>"))
    return namespaces.join(m).select("namespace", F.array_join(pick, "|").alias("uris"))


def activate(rows: DataFrame, preset: int) -> DataFrame:
    """Makes one preset the only active one; an unknown id changes nothing."""
    there = rows.agg(F.max((F.col("id") == preset).cast("int")).alias("there"))
    return rows.join(F.broadcast(there)).withColumn("is_active", F.when(F.col("there") == 1, F.col("id") == preset).otherwise(F.col("is_active"))).drop("there")


@query("q19_presets", _WITH + " SELECT id, name, is_active, len(map_keys(from_json(boot_uris, '\"MAP(VARCHAR, VARCHAR[])\"'))) AS namespaces FROM pre")
def q19(g):
    return presets(g).select("id", "name", "is_active", F.size(F.map_keys(F.from_json("boot_uris", BOOT))).cast("long").alias("namespaces"))


@query("q20_boot_uris", ", n(namespace) AS (VALUES (''), ('ns_building'), ('other')) SELECT namespace, CASE WHEN namespace = 'ns_building' THEN 'core://cust_1' ELSE 'core://ASIA|core://EUROPE' END AS uris FROM n")
def q20(g):
    return boot_uris(presets(g), g.spark.createDataFrame([("",), ("ns_building",), ("other",)], "namespace string"))


@query("m17_activate", _WITH + " SELECT id, name, boot_uris, id = 3 AS is_active FROM pre")
def m17(g):
    return activate(presets(g), 3)


@query("u4_key_union", ", a AS (SELECT node_uuid, max(content) AS before FROM memories WHERE deprecated GROUP BY 1), b AS (SELECT node_uuid, max(content) AS after FROM active GROUP BY 1) SELECT coalesce(a.node_uuid, b.node_uuid) AS node_uuid, a.before, b.after FROM a FULL JOIN b ON a.node_uuid = b.node_uuid")
def u4(g):
    a = g.memories.where("deprecated").groupBy("node_uuid").agg(F.max("content").alias("before"))
    return a.join(g.active.groupBy("node_uuid").agg(F.max("content").alias("after")), "node_uuid", "full")


@query("u5_pools", ", p AS (SELECT node_uuid AS k, 'pending' AS pool FROM active UNION ALL SELECT node_uuid, 'approved' FROM memories WHERE deprecated), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pool) AS i FROM p) SELECT k, pool FROM r WHERE i = 1")
def u5(g):
    p = g.active.select(F.col("node_uuid").alias("k"), F.lit("pending").alias("pool")).unionAll(g.memories.where("deprecated").select("node_uuid", F.lit("approved")))
    return p.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("pool"))).where("i = 1").select("k", "pool")


@query("c4_net_zero", ", c AS (SELECT node_uuid, min(path) AS p FROM paths WHERE domain = 'urgent' GROUP BY 1), n AS (SELECT uuid FROM nodes WHERE uuid LIKE 'o-%') SELECT uuid AS node_uuid, uuid NOT IN (SELECT node_uuid FROM c) AS dropped FROM n")
def c4(g):
    """Created nodes no longer reachable from any surviving path of the change set count as nothing."""
    kept = g.paths.where("domain = 'urgent'").select("node_uuid").distinct().withColumn("kept", F.lit(True))
    return g.nodes.where("uuid like 'o-%'").join(kept, F.col("uuid") == F.col("node_uuid"), "left").select(F.col("uuid").alias("node_uuid"), F.col("kept").isNull().alias("dropped"))
