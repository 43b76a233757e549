"""Importance resampling towards a target distribution, over hashed word runs.

Features of a text are its runs of 1 to ``RUNS`` words; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo
``buckets``. Bucket counts of the raw and of the target corpus give each bucket a gain (a smoothed log ratio), the
mean gain of a document's features is its weight, and weight plus Gumbel noise of its id is its score: the highest
scores are a draw without replacement in proportion to the weights.

CRCs of a whole batch come from a position table. CRC-32 is affine, so a span's value is a constant of its length
xor the contributions of its bytes, each of which depends on the byte and on its distance from the span's end only:
``TABLE[distance, byte]``. The contributions of all spans stand in one array and ``bitwise_xor.reduceat`` folds each
span. Spans of more than ``REACH`` bytes are cut into blocks from their end; the blocks' values fold pairwise, the
left one moved by the bytes on its right, so a span of n blocks takes log2(n) steps that all long spans take together.

Both passes over the texts are maps; what is shuffled is at most ``buckets`` counts a task and two numbers a document.
Ranks come from ranges of scores, so no task orders all documents.

Defined results: null and empty texts have no features and weigh 0; repeated rows count as often as they stand there and
are scored alike; a null id has the noise of an empty id and loses ties; equal scores go to the smaller id; an empty
target makes rare buckets gain, an empty table gives an empty result; extra columns are not looked at. A batch is worked
through in pieces of at most ``PIECE`` bytes or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prefixed, table, written

BUCKETS, RUNS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Distances in the position table; bytes of texts that are hashed together.
REACH, PIECE = 64, 1 << 20
#: A-Z become small, other ASCII that is no letter or digit becomes a space, bytes of other characters stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def crc_table() -> np.ndarray:
    """TABLE[d, b]: what byte b contributes with d bytes behind it."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)  # the polynomial of CRC-32
    rows = [x]
    for _ in range(REACH - 1):
        rows.append(x[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.stack(rows)


TABLE = crc_table()


def moved(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Register values with as many bytes of zero behind them as ``by``'s four tables stand for."""
    return by[0][values & 255] ^ by[1][(values >> 8) & 255] ^ by[2][(values >> 16) & 255] ^ by[3][values >> 24]


def movers(levels: int) -> list[np.ndarray]:
    """Tables that move a value by 1, 2, 4, ... bytes, one table for each of its four bytes."""
    one, each = TABLE[0], np.arange(256, dtype=np.uint32)
    step = np.stack([one, each, each << 8, each << 16])
    out = [step]
    for _ in range(levels - 1):
        step = np.stack([moved(t, step) for t in step])
        out.append(step)
    return out


MOVES = movers(40)


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of so many bytes of zero, for each length."""
    known, at = np.unique(lengths, return_inverse=True)
    value = np.full(len(known), 0xFFFFFFFF, np.uint32)
    for k in range(int(known.max(initial=0)).bit_length()):
        on = (known >> k) & 1 == 1
        value[on] = moved(value[on], MOVES[k])
    return ~value[at]


def folded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The xor of all contributions of each span of at least 1 and at most ``REACH`` bytes."""
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)
    distance = np.repeat(starts + lengths - 1, lengths) - at
    return np.bitwise_xor.reduceat(TABLE.ravel()[(distance << 8) | data[at]], first)


def crc_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """zlib's CRC-32 of each span, of at least 1 byte, of ``data`` (bytes); spans may overlap."""
    out = np.zeros(len(starts), np.uint32)
    near = lengths <= REACH
    if near.any():
        out[near] = folded(data, starts[near], lengths[near])
    if len(far := np.flatnonzero(~near)):
        many = -(-lengths[far] // REACH)
        span = np.repeat(np.arange(len(far)), many)
        place = np.repeat(np.cumsum(many), many) - 1 - np.arange(len(span))  # blocks on its right
        ends = np.repeat(starts[far] + lengths[far], many) - place * REACH
        begins = np.maximum(ends - REACH, np.repeat(starts[far], many))
        value, level = folded(data, begins, ends - begins), REACH.bit_length() - 1
        while place.any():
            odd = place & 1 == 1
            value[odd] = moved(value[odd], MOVES[level])
            place, level = place >> 1, level + 1
            lead = np.flatnonzero(np.r_[True, (span[1:] != span[:-1]) | (place[1:] != place[:-1])])
            value, span, place = np.bitwise_xor.reduceat(value, lead), span[lead], place[lead]
        out[far] = value
    return out ^ length_constants(lengths)


def hashed(texts: list[str], buckets: int, runs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each feature, its bucket, words of each document)."""
    words = [t.encode(errors="replace").translate(WORDS).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    data = np.frombuffer(b" ".join(flat), np.uint8)
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(size + 1) - 1
    starts, doc = ends - size, np.repeat(np.arange(len(texts)), counts)
    docs, values = [], []
    for n in range(1, runs + 1):
        last = np.arange(n - 1, len(flat))
        last = last[doc[last] == doc[last - n + 1]]
        if len(last):
            docs.append(doc[last])
            values.append(crc_spans(data, starts[last - n + 1], ends[last] - starts[last - n + 1]))
    return np.concatenate(docs), (np.concatenate(values) % np.uint32(buckets)).astype(np.int64), counts


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of at most ``PIECE`` characters together, or one text."""
    held, size, first = [], 0, 0
    for k, t in enumerate(texts):
        t = t.as_py() or ""
        if held and size + len(t) > PIECE:
            yield first, held
            held, size, first = [], 0, k
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """(bucket, n): the features of all of ``texts``' column text in each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                total += np.bincount(hashed(part, buckets, runs)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, from the counts (bucket, n) of both corpora: at most ``buckets`` rows come back."""
    spark = raw.sparkSession
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionAll(target.select("bucket", F.lit(0).cast("long"), F.col("n")))
    both = both.unionAll(spark.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = np.floor(1000 * np.log(float(r.t + 1) * float(all_s + buckets) / (float(r.s + 1) * float(all_t + buckets))))
    return out


def weighted(docs: DataFrame, gain: np.ndarray, runs: int = RUNS) -> DataFrame:
    """(doc_id, n_features, weight, words) of every row of docs(doc_id, text)."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            found = []
            for _, part in pieces(batch.column(1)):
                doc, bucket, words = hashed(part, buckets, runs)
                n = np.bincount(doc, minlength=len(part))
                total = np.zeros(len(part), np.int64)
                np.add.at(total, doc, gain[bucket])
                found.append((n, total // np.maximum(n, 1), words))
            cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in cols)], names=["doc_id", "n_features", "weight", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, weight long, words long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document, ranked where it is drawn."""
    gain = gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighted(docs, gain, runs).withColumn("score", F.col("weight") + noise), "weights")
    n = scored.where(F.col("words") >= least_words).count()
    able = scored.where(F.col("words") >= least_words).drop("words")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    ranked = prefixed(able, order, {"before": "1"}).withColumn("rank", F.col("before") + 1).drop("before")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("words") < least_words).drop("words").withColumn("rank", F.lit(None).cast("long")))


def op13_resample(spark, sf_dir) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
