"""Structured Streaming twins of the access log and of change recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(logs: DataFrame) -> DataFrame:
    """Watermarks need instants; wall-clock times count in the session's time zone."""
    return logs.withColumn("accessed_at", F.col("accessed_at").cast("timestamp"))


def last_access(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per node the last access and the number of accesses; for the update or complete mode."""
    return timed(logs).withWatermark("accessed_at", late).groupBy("node_uuid").agg(F.max("accessed_at").alias("last"), F.count("*").alias("n"))


def access_windows(logs: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Accesses per node and window; for the append mode, once the watermark has passed a window."""
    return timed(logs).withWatermark("accessed_at", late).groupBy("node_uuid", F.window("accessed_at", width)).agg(F.count("*").alias("n"))


def sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of accesses to a node with no gap as long as ``gap``."""
    return timed(logs).withWatermark("accessed_at", late).groupBy("node_uuid", F.session_window("accessed_at", gap)).agg(F.count("*").alias("n"))


def recorded(writes: DataFrame) -> DataFrame:
    """The first before and the last after of each key, kept as state; for the update or complete mode."""
    key = F.concat(F.col("tbl"), F.lit(":"), F.col("pk")).alias("row_key")
    return writes.groupBy(key).agg(F.min(F.struct("seq", "before"))["before"].alias("before"), F.max(F.struct("seq", "after"))["after"].alias("after"))
