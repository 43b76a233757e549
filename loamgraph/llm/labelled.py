"""A bounded, seeded sample of labelled texts for fitting classifiers, and feature extraction over batches."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Rows whose texts a task holds as Python objects at a time.
TOGETHER = 512
#: ASCII that is no letter or digit becomes a space; bytes of other characters stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def sample(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside the held-out fifth: the first by a hash of the id.

    The chosen ids are at most ``limit`` rows of two numbers, so that side is broadcast and only texts of the sample
    are shuffled. Of rows that repeat an id the smallest text counts, so the bound holds however often an id repeats.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fitted(rows: DataFrame, terms: Callable[[str], np.ndarray], fit: Callable[[list[np.ndarray], np.ndarray], dict]) -> dict:
    """What ``fit`` makes of each sampled text's term buckets and its label, in one task: only the weights come back.

    The task holds what the sample's bound allows, whatever the corpus. Its rows come in the order of the ids' hash, as
    fits depend on the order of their rows and that of partitions varies. A lost task is run again from the sample.
    """

    def extract(batches):
        for batch in batches:
            found = [terms(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), batch.column(2), batch.column(3)], names=["h", "terms", "y", "doc_id"])

    def train(batches):
        got = pa.Table.from_batches(list(batches), pa.schema([("h", pa.int64()), ("terms", pa.binary()), ("y", pa.int32()), ("doc_id", pa.string())]))
        got = got.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        found = [np.frombuffer(x.as_py(), np.uint32) for x in got.column("terms")]
        weights = fit(found, np.array(got.column("y").to_pylist(), np.int64))
        yield pa.record_batch([pa.array([pickle.dumps(weights)], pa.binary())], names=["weights"])

    keyed = rows.select(F.xxhash64("doc_id", F.lit(7)).alias("h"), "text", "y", F.col("doc_id").cast("string").alias("doc_id"))
    got = keyed.mapInArrow(extract, "h long, terms binary, y int, doc_id string").repartition(1).mapInArrow(train, "weights binary").collect()
    return pickle.loads(got[0][0]) if got else fit([], np.zeros(0, np.int64))


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float) -> DataFrame:
    """Every row of docs(doc_id, text) with held_out, score and predicted."""

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), TOGETHER):
                part = batch.slice(k, TOGETHER)
                yield pa.record_batch([part.column(0), pa.array(score([t or "" for t in part.column(1).to_pylist()]), pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def passing(docs: DataFrame, score: Callable[[list[str]], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs whose score ``keep`` accepts, all columns as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, len(batch), TOGETHER):
                part = batch.slice(k, TOGETHER)
                yield part.filter(pa.array(keep(score([t or "" for t in part.column(at).to_pylist()])), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
