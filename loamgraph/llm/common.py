"""Helpers that the corpus operators share: scratch folders on shared storage, record batches, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local folder serves a
    local session, and any other is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loamgraph-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder; ``clean`` or the end of the process removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def store(uri: str):
    """(file system, path) of a URI such as file:///a, s3://b or hdfs://c, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def clean() -> None:
    """Removes every scratch folder of this process; frames that read them are dead afterwards."""
    while _SCRATCH:
        with contextlib.suppress(Exception):
            where, path = store(_SCRATCH.pop())
            where.delete_dir(path)


atexit.register(clean)


def written(df: DataFrame, tag: str, parts: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors. ``parts``: files
    at most, for results whose size is known to be small."""
    path = scratch(df.sparkSession, tag)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True for the fifth of all ids that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def spread(spark: SparkSession, total_bytes: int, least: int = 1 << 20, most: int = 64 << 20) -> int:
    """Tasks for so many bytes: one for each core while they get ``least`` bytes, and none gets over ``most``."""
    cores = 2 * spark.sparkContext.defaultParallelism
    return max(1, -(-total_bytes // most), min(cores, -(-total_bytes // least)))


def prefixed(df: DataFrame, order: list, sums: dict[str, str], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each row the sum of the rows before it in ``order``, for ``sums`` = {new column: column or number}; with
    ``within`` of those before it with the same values there, which must lead the order.

    Rows are dealt by ranges and sorted there; sums per range are added up over ranges, so neither all rows nor those
    of one key meet in a task. Nulls come first. Rows that tie in the order are in any order.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = written(df.repartitionByRange(*named).sortWithinPartitions(*named).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_r", F.shiftright("_i", 33))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    added = {k: F.expr(v) for k, v in sums.items()}
    totals = dealt.groupBy("_r", *within).agg(*[F.sum(c).alias(k) for k, c in added.items()])
    over = before(Window.partitionBy(*within).orderBy("_r") if within else Window.orderBy("_r"))  # a row for each range
    starts = written(totals.select(F.col("_r").alias("_s"), *[F.col(c).alias(f"_w{k}") for k, c in enumerate(within)], *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(f"_{k}") for k in sums]), "starts")
    inner = before(Window.partitionBy("_r", *within).orderBy("_i"))
    here = dealt.withColumns({k: F.coalesce(F.sum(c).over(inner), F.lit(0)) for k, c in added.items()})
    same = F.col("_r") == F.col("_s")
    for k, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_w{k}"))
    return here.join(starts, same).withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_i", "_r", "_s", *[f"_w{k}" for k in range(len(within))], *[f"_{k}" for k in sums])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: one row (id, root) per id that differs from its root.

    Alternates large and small stars: each round re-hangs every neighbour on the smallest one, and ends when a round
    changes nothing, after as many rounds as that takes. Each round is two grouped minima, so a hub costs one row per
    edge, never a pair list; minima are written before they are joined, so both sides of a join come from shuffles that
    AQE can split.
    """
    was, parts = None, None
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        seen = Observation()
        links = written(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links", parts)
        now = seen.get
        if now == was or not now["n"]:
            break
        was, parts = now, max(4, now["n"] // 250_000)
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low", parts)
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = written(big.unionAll(low.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "kept", parts)
        low = written(kept.groupBy("a").agg(F.min("b").alias("m")), "low", parts)
        small = kept.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        links = small.where("a <> b").distinct()
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
