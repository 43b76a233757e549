"""Cutting lineage between the steps of an iteration."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The session's shared folder (``spark.checkpoint.dir``). Where that is unset a local folder serves a local session,
    and any other is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.getConf().get("spark.checkpoint.dir") and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="loamgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the session's shared folder, so a plan does not grow with the steps and a lost executor
    costs nothing."""
    shared(df.sparkSession)
    return df.checkpoint()


_MADE: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed with all below it when the process ends."""
    path = f"{shared(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(tidy)
    _MADE.append((spark, path))
    return path


def table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder: cuts lineage as ``cut`` does in a fraction of the bytes, columns
    are pruned, and small ones are known to be small."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, text: str, *keys: str, least: int = 1 << 20, most: int = 16 << 20) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks by the bytes of its column ``text``, however its files are cut: two tasks a core while
    they get ``least`` bytes, and none gets much over ``most``."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(1, -(-total // most), min(2 * df.sparkSession.sparkContext.defaultParallelism, -(-total // least))), *keys)


def tidy() -> None:
    """Removes what ``scratch`` has named; frames that read it are dead afterwards."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
