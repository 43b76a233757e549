"""Pools of row changes under review: one entry a row, moved by events.

events(seq, head, kind, row_key, before, after), in the order of seq; head is the revision that the event was made upon. A
commit makes a new head and thereby drains the pool: an event upon a newer head meets an empty entry. Kinds:

record: a write; the entry's first one gives before, each one gives after, and the entry is pending (again).
approve: the entry is approved. restore: after becomes before, and the entry is pending. remove: the entry is dropped.

Events other than records change nothing where there is no entry. Heads must not fall as seq grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "seq long, head long, kind string, row_key string, before string, after string"


def pooled(events: DataFrame) -> DataFrame:
    """row_key, head, before, after, pool and writes of every entry that the events leave.

    Three grouped passes, each with partial sums, so a row that a third of all events touch costs its task three rows.
    """
    rec = F.col("kind") == "record"
    removed = events.groupBy("row_key", "head").agg(F.max(F.when(F.col("kind") == "remove", F.col("seq"))).alias("removed"))
    last = removed.groupBy(F.col("row_key").alias("k")).agg(F.max(F.struct("head", "removed")).alias("at"))
    live = events.join(last, F.col("row_key") == F.col("k")).where((F.col("head") == F.col("at.head")) & (F.col("seq") > F.coalesce("at.removed", F.lit(-(2**63))))).drop("k", "at")
    first = live.where(rec).groupBy(F.col("row_key").alias("k")).agg(F.min("seq").alias("first"))
    live = live.join(first, F.col("row_key") == F.col("k")).where(F.col("seq") >= F.col("first"))
    text = F.col("kind").isin("record", "restore")
    got = live.groupBy("row_key", "head").agg(
        F.min(F.when(rec, F.struct("seq", "before")))["before"].alias("before"),
        F.max(F.when(text, F.struct("seq", "kind", "after"))).alias("last"),
        F.max(F.struct("seq", "kind"))["kind"].alias("kind"),
        F.count(F.when(rec, 1)).alias("writes"),
    )
    after = F.when(F.col("last.kind") == "restore", F.col("before")).otherwise(F.col("last.after"))
    return got.select("row_key", "head", "before", after.alias("after"), F.when(F.col("kind") == "approve", "approved").otherwise("pending").alias("pool"), "writes")


def fold(entry: tuple | None, events: list[tuple]) -> tuple | None:
    """One row's entry (head, before, after, pool, writes) after events (seq, head, kind, before, after), in their order."""
    for _, head, kind, before, after in sorted(events, key=lambda e: e[0]):
        if entry and head > entry[0]:
            entry = None
        if kind == "record":
            entry = (entry[0], entry[1], after, "pending", entry[4] + 1) if entry else (head, before, after, "pending", 1)
        elif entry and kind == "approve":
            entry = (*entry[:3], "approved", entry[4])
        elif entry and kind == "restore":
            entry = (entry[0], entry[1], entry[1], "pending", entry[4])
        elif kind == "remove":
            entry = None
    return entry
