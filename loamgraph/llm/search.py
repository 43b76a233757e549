"""Exact top-k search by columnar branch and bound, in blocks.

Vectors are held block-wise in vertical layout (one row per dimension). For a block of queries and a block of
candidates, partial inner products grow one block of dimensions at a time; what the remaining dimensions can still
add is at most the product of the two remaining norms (Cauchy-Schwarz). A candidate whose partial score plus that
bound is under the query's k-th best certain score is out, and the columns of the survivors are compacted before
the next block of dimensions. Scores of survivors are complete and exact.

The queries are a fixed share of the rows, so query blocks meet every candidate block. Packed blocks, of bounded
bytes, are files in the shared folder; a run of them (those of one packing task) and a query block are one small row
of file names, so no vector is shuffled or sent twice through a shuffle; a task reads the blocks of its runs for one
query block after the other, and the k-th best scores found so far bound what later blocks must reach. The number of
tasks follows the cores, not the number of rows. Each task yields at most k rows per query, which a grouped top-k
merges.

Components become floor(scale * x). Products are computed as doubles where the norms prove every sum to be below
2**53, and with unbounded integers otherwise.

Defined results: vectors that are null, empty of components or hold a null or non-finite component take no part,
neither does a null id; vectors of fewer dimensions count as zero in the missing ones; rows with the query's own id
are no candidates of it, and a repeated query id is answered once, from its first row in the order of components;
ties go to the smaller id; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, store, table, written

SCALE, K, EVERY = 256, 5, 50
#: Rows of a candidate block and of a query block, at most; bytes of a block as doubles, at most (one vector if it is
#: longer); dimensions that are added at a time; queries that start together.
CANDIDATES, QUERIES, BYTES, STEP, TOGETHER = 16384, 512, 8 << 20, 16, 64
BLOCK = "file string, n int, dims int, kind string, run int"
EXACT = float(2**53)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, scaled and floored."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.where(F.coalesce(finite, F.lit(False)))


def blocks(v: DataFrame, out_dir: str, rows: int, scale: int) -> DataFrame:
    """Packs each partition's vectors, up to ``rows`` or ``BYTES`` at a time, into files of ids and columns of whole
    numbers; run: the task that packed a block."""

    def pack(batches):
        fs, base = store(out_dir)
        fs.create_dir(base, recursive=True)
        held, count, wide, run = [], 0, 0, TaskContext.get().partitionId()

        def emit(batch: pa.RecordBatch):
            lists = batch.column(1)
            lengths = np.diff(np.asarray(lists.offsets))
            flat = np.floor(scale * np.asarray(lists.flatten(), np.float64))
            d, top_ = int(lengths.max()), np.abs(flat).max()
            kind = "<i2" if top_ < 2**15 else "<i4" if top_ < 2**31 else "<f8"
            m = np.zeros((len(lengths), d), kind)
            m[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(np.asarray(batch.column(0), "<i8").tobytes() + np.ascontiguousarray(m.T).tobytes())
            return pa.record_batch([pa.array([x]) for x in (name,)] + [pa.array([x], pa.int32()) for x in (len(lengths), d)] + [pa.array([kind]), pa.array([run], pa.int32())], names=["file", "n", "dims", "kind", "run"])

        for batch in batches:
            start = 0
            for k, d in enumerate(np.diff(np.asarray(batch.column(1).offsets)).tolist()):
                if count == rows or count and (count + 1) * max(wide, d) * 8 > BYTES:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, count, wide, start = [], 0, 0, k
                count, wide = count + 1, max(wide, d)
            held.append(batch.slice(start))
        if count:
            yield emit(pa.Table.from_batches([x for x in held if len(x)]).combine_chunks().to_batches()[0])

    return written(v.mapInArrow(pack, BLOCK), "blocks")


def load(fs, base: str, file: str, n: int, dims: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    with fs.open_input_stream(f"{base}/{file}") as f:
        raw = f.read()
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, kind, n * dims, 8 * n).reshape(dims, n).astype(np.float64)


def top(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray, step: int = STEP):
    """(query ids, ids, scores): of each query, the k best candidates among those that reach its floor.
    q and c: dimensions x vectors."""
    d = max(len(q), len(c))
    q, c = (np.pad(x, ((0, d - len(x)), (0, 0))) for x in (q, c))
    if np.sqrt((q**2).sum(0).max(initial=0)) * np.sqrt((c**2).sum(0).max(initial=0)) >= EXACT / 4:
        return whole_numbers(qids, q, cids, c, k)
    order = np.argsort(-(q**2).mean(1) * (c**2).mean(1), kind="stable")  # the heaviest dimensions first
    q, c = q[order], c[order]
    rest_q = np.sqrt(np.cumsum((q**2)[::-1], 0)[::-1])
    rest_c = np.sqrt(np.cumsum((c**2)[::-1], 0)[::-1])
    first = min(d, step)
    out = []
    for i, qid in enumerate(qids):
        if i % TOGETHER == 0:  # one block of dimensions for all pairs of some queries
            part = q[:first, i : i + TOGETHER].T @ c[:first]
        alive = np.flatnonzero(cids != qid)
        score, at = part[i % TOGETHER, alive], first
        while True:
            slack = rest_q[at, i] * rest_c[at, alive] * (1 + 1e-9) if at < d else 0.0
            sure = floor[i]
            if len(alive) > k:
                sure = max(sure, np.partition(score - slack, len(alive) - k)[len(alive) - k])
            keep = score + slack >= sure
            alive, score = alive[keep], score[keep]
            if at >= d:
                break
            upto = min(d, at + step)
            score = score + q[at:upto, i] @ c[at:upto, alive]  # the survivors' columns only
            at = upto
        best = np.lexsort((cids[alive], -score))[:k]
        out.append((np.full(len(best), qid), cids[alive[best]], score[best].astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def best_of(cols: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best rows of each query."""
    order = np.lexsort((cols[1], -cols[2], cols[0]))
    ids = cols[0][order]
    start = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    rank = np.arange(len(ids)) - np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0)) if len(ids) else np.zeros(0, np.int64)
    return [x[order][rank < k] for x in cols]


def whole_numbers(qids, q, cids, c, k):
    """The same by unbounded integers; scores that no 64-bit integer holds are an error, as the result is one."""
    qi, ci = ([[int(x) for x in col] for col in m.T] for m in (q, c))
    out = []
    for qid, a in zip(qids, qi, strict=True):
        ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), int(cid)) for cid, b in zip(cids, ci, strict=True) if cid != qid)[:k]
        out += [(int(qid), cid, -s) for s, cid in ranked]
    return [np.array([r[j] for r in out], np.int64) for j in range(3)]


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row of ``queries``."""
    one = Window.partitionBy("vec_id").orderBy("v")
    asked = usable(queries).withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    ask = written(asked, "queries")
    folder = scratch(vectors.sparkSession, "vectors")
    cand = blocks(usable(vectors), folder, CANDIDATES, scale)
    question = blocks(ask.repartition(max(1, -(-ask.count() // QUERIES))), folder, QUERIES, scale)
    # every run of candidate blocks, those of one packing task, meets every query block: rows of file names only
    names = ["file", "n", "dims", "kind"]
    runs = cand.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("blocks"))
    asks = question.select(F.struct(*names).alias("ask"))
    asks = written(asks.withColumn("q", F.monotonically_increasing_id()), "asks")
    numbers = asks.agg(F.collect_list("q").alias("qs"))  # one row: a number for each block of queries
    cells = runs.join(F.broadcast(numbers)).select("run", "blocks", F.explode("qs").alias("q")).join(asks, "q").select(F.col("ask.file").alias("q_file"), "run", "ask", "blocks")
    tasks = max(1, min(asks.count() * runs.count(), 8 * vectors.sparkSession.sparkContext.defaultParallelism))
    cells = cells.repartitionByRange(tasks, "q_file", "run").sortWithinPartitions("q_file", "run").select("ask", "blocks")

    def run(batches):
        fs, base = store(folder)
        name, held, qids, q, floor = None, None, None, None, None
        out = lambda: pa.record_batch([pa.array(x, pa.int64()) for x in held], names=["query_id", "vec_id", "score"])
        for batch in batches:
            for ask, found in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if ask["file"] != name:
                    if held:
                        yield out()
                    name, held = ask["file"], [np.zeros(0, np.int64)] * 3
                    qids, q = load(fs, base, **ask)
                    floor = np.full(len(qids), -np.inf)
                for block in found:
                    held = best_of([np.concatenate(x) for x in zip(held, top(qids, q, *load(fs, base, **block), k, floor), strict=True)], k)
                    ids, start, many = np.unique(held[0], return_index=True, return_counts=True)
                    full = many >= k
                    at = np.searchsorted(ids, qids)
                    at = np.minimum(at, max(len(ids) - 1, 0))
                    floor = np.array([held[2][start[a] + k - 1] if len(ids) and ids[a] == i and full[a] else -np.inf for a, i in zip(at, qids, strict=True)])
        if held:
            yield out()

    found = cells.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
