"""Pools of row changes as keyed state of a stream; ``operators.pool`` is the batch twin."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pool import fold

ENTRY = "head long, before string, after string, pool string, writes long"
OUT = f"row_key string, {ENTRY}"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entries(StatefulProcessor):
    """One entry a row. A micro-batch's events of a row are ordered here, so a trigger bounds what a task holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key, rows, timerValues):
        none = lambda x: None if x is None or x != x else x  # noqa: E731  pandas' missing values
        events = [(int(s), int(h), k, none(b), none(a)) for part in rows for s, h, k, b, a in zip(part["seq"], part["head"], part["kind"], part["before"], part["after"])]
        old = self.entry.get() if self.entry.exists() else None
        new = fold((int(old[0]), none(old[1]), none(old[2]), old[3], int(old[4])) if old else None, events)
        if new:
            self.entry.update(new)
        elif old:
            self.entry.clear()
        head, before, after, pool, writes = new or (max(e[1] for e in events), None, None, "none", 0)
        yield pd.DataFrame({"row_key": [key[0]], "head": [head], "before": pd.Series([before], dtype=object), "after": pd.Series([after], dtype=object), "pool": [pool], "writes": [writes]})

    def close(self) -> None:
        pass


def entries(events: DataFrame) -> DataFrame:
    """The entry of every row that a micro-batch's events touch, as they leave it; pool 'none' where there is none any more.
    For the update mode. The session needs the RocksDB state store (``store``)."""
    return events.groupBy("row_key").transformWithStateInPandas(Entries(), OUT, "Update", "None")


@contextlib.contextmanager
def store(spark: SparkSession, partitions: int):
    """Settings that a stream's start takes over for its life: the state store and the number of its partitions."""
    names = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.shuffle.partitions": str(partitions)}
    had = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in had.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def run(events: DataFrame, out: str, checkpoint: str, partitions: int) -> None:
    """Takes all events that there are, in micro-batches, and appends the touched entries to the table at ``out``, each with
    its batch. Started again on the same checkpoint it goes on with the kept state and what is new."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with store(events.sparkSession, partitions):
        entries(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The entries as the stream has left them: of each row what its last batch says."""
    log = spark.read.schema(f"{OUT}, batch long").option("recursiveFileLookup", True).parquet(out)
    last = log.withColumn("k", F.row_number().over(Window.partitionBy("row_key").orderBy(F.col("batch").desc()))).where("k = 1 and pool <> 'none'")
    return last.select("row_key", "head", "before", "after", "pool", "writes")
