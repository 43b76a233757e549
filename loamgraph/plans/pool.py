"""Pools over the lines of all orders as events, as a batch and as a stream of files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import pool as O
from ..operators.steps import scratch
from ..registry import query
from ..streaming import pool as stream

#: An event for each line: mostly writes, every seventh something else; a new head after every 4,000th order.
SQL = """, ev AS (SELECT id AS seq, l_orderkey // 4000 AS head, CASE WHEN id % 7 = 3 THEN 'approve' WHEN id % 11 = 5 THEN 'restore' WHEN id % 13 = 6 THEN 'remove' ELSE 'record' END AS kind, 'memories:' || l_suppkey % 997 AS row_key,
  CASE WHEN l_linenumber > 1 THEN 'b' || id END AS before, CASE WHEN l_returnflag <> 'R' THEN 'a' || id END AS after FROM lv),
e1 AS (SELECT * FROM ev QUALIFY head = max(head) OVER (PARTITION BY row_key)),
e2 AS (SELECT * FROM e1 QUALIFY seq > coalesce(max(CASE WHEN kind = 'remove' THEN seq END) OVER (PARTITION BY row_key), -1)),
e3 AS (SELECT * FROM e2 QUALIFY seq >= min(CASE WHEN kind = 'record' THEN seq END) OVER (PARTITION BY row_key)),
fi AS (SELECT row_key, max(head) AS head, min(seq) AS fs, max(seq) AS ls, max(CASE WHEN kind IN ('record', 'restore') THEN seq END) AS lt, count(*) FILTER (kind = 'record') AS writes FROM e3 GROUP BY 1)
SELECT fi.row_key, fi.head, f.before, CASE WHEN t.kind = 'restore' THEN f.before ELSE t.after END AS after, CASE WHEN l.kind = 'approve' THEN 'approved' ELSE 'pending' END AS pool, writes
FROM fi JOIN ev f ON f.seq = fs JOIN ev l ON l.seq = ls JOIN ev t ON t.seq = lt"""


def events(g):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    lines = g.table("lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.row_number().over(w))
    s = F.col("seq")
    kind = F.when(s % 7 == 3, "approve").when(s % 11 == 5, "restore").when(s % 13 == 6, "remove").otherwise("record")
    return lines.select(
        "seq", F.floor(F.col("l_orderkey") / 4000).alias("head"), kind.alias("kind"), F.concat(F.lit("memories:"), (F.col("l_suppkey") % 997).cast("string")).alias("row_key"),
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("b"), s.cast("string"))).alias("before"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("a"), s.cast("string"))).alias("after"),
    )


@query("c6_pool_entries", SQL)
def c6_pool_entries(g):
    """Every entry that the events of all order lines leave."""
    return O.pooled(events(g))


@query("st2_pool_stream", SQL)
def st2_pool_stream(g):
    """The same from a stream over files of events, three micro-batches, stopped in between and started again."""
    spark, base = g.spark, scratch(g.spark, "pool")
    # parts of about as many events, told by their orders, so that no task holds one of them
    ends = g.table("lineitem").agg(F.percentile_approx("l_orderkey", [1 / 3, 2 / 3]).alias("x")).first()["x"] or [0, 0]
    part = sum(((F.col("seq") > k * 100 + 99).cast("int") for k in ends), F.lit(0))
    events(g).withColumn("part", part).write.partitionBy("part").parquet(f"{base}/made")
    made = spark.read.schema(f"{O.EVENTS}, part int").parquet(f"{base}/made")
    cores = min(16, spark.sparkContext.defaultParallelism)
    for part in range(3):
        found = made.where(F.col("part") == part).drop("part")
        found.write.mode("append").parquet(f"{base}/in")
        stream.run(spark.readStream.schema(O.EVENTS).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", cores)
    return stream.current(spark, f"{base}/out")
