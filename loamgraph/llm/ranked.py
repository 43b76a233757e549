"""Ranked lexical search: accumulators of short lists first, then document-at-a-time skipping over long lists.

``build`` cuts the corpus into segments of bounded size. A segment's row without a term holds its documents (ids and
lengths in the order of ids), every other row one term's postings: places of documents, frequencies and, for long lists,
the largest frequency and the smallest length in each range of ``RANGE`` documents. All rows and all terms are indexed;
no posting moves between tasks when the index is made.

``search`` needs two numbers of the corpus (N, L) and the document frequency of the asked terms. Queries go in blocks; a
block meets a segment in one group that holds the postings of the block's terms there. In such a group, for each query:

1. Short lists are added up term at a time into one array of accumulators. Its largest value in each range is the bound
   of an iterator like any other, and its k-th best value is a first threshold, as no score is lower.
2. The long lists and that iterator are merged document at a time, in windows of ranges: a range whose bounds add up
   to less than the threshold is skipped, and is left as soon as what it has and what later lists can add is less. The k
   best scores so far raise the threshold for the windows to come.

Scores are exact: they are 64-bit integers, and bounds are the same formula over the largest frequency and the
smallest length. Every group yields at most k rows a query; the best of all are taken by a window that Spark limits in
each task before it shuffles.

A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document adds w * (10**9 tf div (1000 tf + 8 m)) for each occurrence
of the term in the query, with m = 25 + 75 n N div L.

Defined results: null, empty and termless texts are in no answer and do not count in N; a query without terms has no
rows; a query id that occurs in several rows is asked once, with its smallest text; every row of a repeated document id
is a document; a null document id comes last among equal scores; scores of 0 are not returned; an empty table gives an
empty result; extra columns are not looked at. A text longer than a segment is a segment by itself.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K = 10
#: Documents and bytes of text of a segment, at most; documents of a range; ranges of a window; queries of a block.
DOCUMENTS, BYTES, RANGE, WINDOW, QUERIES = 16384, 16 << 20, 128, 16, 256
#: A list is short with at most so many postings, or at most this share of its segment's documents.
SHORT, SHARE = 64, 1 / 64
#: Rows (term and block) up to which the asked terms are sent to all tasks; above it the join shuffles.
BROADCAST = 100_000
INDEX = "segment long, term string, df int, docs binary, tfs binary, bounds binary, nulls int, filled long, total long"
#: A-Z become small, other ASCII that is no letter or digit becomes a space, bytes of other characters stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="replace").translate(TERMS).split()


class Segment:
    """Documents on their way into one segment of the index."""

    def __init__(self):
        self.ids, self.lengths, self.sizes, self.found, self.tfs, self.bytes = [], array("q"), array("q"), array("q"), array("q"), 0
        self.names = defaultdict(count().__next__)

    def add(self, doc_id, text: str) -> None:
        words = terms(text)
        tf = Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(tf))
        self.found.extend(map(self.names.__getitem__, tf))
        self.tfs.extend(tf.values())
        self.bytes += len(text)

    def rows(self, segment: int) -> pa.RecordBatch:
        nulls = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, nulls))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array(self.lengths, np.int64)[order]
        names = list(self.names)
        at = sorted(range(len(names)), key=names.__getitem__)  # terms in order, so that readers can leave out row groups
        rank = np.empty(len(at), np.int64)
        rank[at] = np.arange(len(at))
        term, doc, tf = rank[np.array(self.found, np.int64)], np.repeat(place, np.array(self.sizes)), np.array(self.tfs, np.int64)
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        df = np.bincount(term, minlength=len(names))
        ends = np.cumsum(df)
        bounds = [None] * len(names)
        for t in np.flatnonzero(df > max(SHORT, SHARE * len(order))):
            mine = slice(ends[t] - df[t], ends[t])
            r = doc[mine] // RANGE
            lead = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            bounds[t] = np.stack([r[lead], np.maximum.reduceat(tf[mine], lead), np.minimum.reduceat(lengths[doc[mine]], lead)]).astype("<i8").tobytes()
        wide = "<u1" if tf.max(initial=0) < 256 else "<u4"

        def packed(values: np.ndarray, own: bytes) -> pa.Array:
            """A binary value for each term, and before them the documents' own."""
            starts = np.r_[0, len(own), len(own) + ends * values.itemsize].astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.tobytes()), pa.py_buffer(own + values.tobytes())])

        some = [None] * len(names)
        return pa.record_batch([
            pa.array(np.full(len(names) + 1, segment)), pa.array([None, *(names[k].decode() for k in at)], pa.string()), pa.array(np.r_[len(order), df].astype(np.int32)),
            packed(doc.astype("<u2"), ids[order].astype("<i8").tobytes()), packed(tf.astype(wide), lengths.astype("<i8").tobytes()),
            pa.array([None, *bounds], pa.binary()), pa.array([int(nulls.sum()), *some], pa.int32()), pa.array([int((lengths > 0).sum()), *some], pa.int64()), pa.array([int(lengths.sum()), *some], pa.int64()),
        ], names=[x.split()[0] for x in INDEX.split(", ")])


def build(docs: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text), written to the shared folder."""

    def run(batches):
        made, held = 0, Segment()
        name = lambda: (TaskContext.get().partitionId() << 32) + made
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                if held.ids and (len(held.ids) == DOCUMENTS or held.bytes + len(text) > BYTES):
                    yield held.rows(name())
                    made, held = made + 1, Segment()
                held.add(doc_id.as_py(), text)
        if held.ids:
            yield held.rows(name())

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "index")


def asked(queries: DataFrame) -> DataFrame:
    """(item_id, term, times) of every query."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                tf = Counter(terms(text.as_py()))
                yield pa.record_batch([pa.array([item.as_py()] * len(tf), pa.int64()), pa.array([t.decode() for t in tf], pa.string()), pa.array(tf.values(), pa.int64())], names=["item_id", "term", "times"])

    one = queries.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "item_id long, term string, times long")


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def norms(n: np.ndarray, all_docs: int, all_terms: int) -> np.ndarray:
    """m of documents of n terms; in unbounded integers where 64 bits do not hold the product."""
    if 75 * int(n.max(initial=0)) * all_docs < 2**63:
        return 25 + 75 * n * all_docs // all_terms
    return np.array([25 + 75 * int(x) * all_docs // all_terms for x in n], np.int64)


class Postings:
    """One term's list in a group: what it adds for one occurrence in a query, by document, and its bounds by range."""

    def __init__(self, row: dict, m: np.ndarray, ranges: int, of):
        self.weight, self.m = row["w"], m
        self.docs = np.frombuffer(row["docs"], "<u2").astype(np.int64)
        self.tf = np.frombuffer(row["tfs"], "<u1" if len(row["tfs"]) == len(self.docs) else "<u4").astype(np.int64)
        self.long, self.gain = row["bounds"] is not None, None
        if self.long:
            r, tf, n = np.frombuffer(row["bounds"], "<i8").reshape(3, -1)
            self.bound = np.zeros(ranges, np.int64)
            self.bound[r] = self.weight * saturation(tf, of(n))
            self.starts = np.searchsorted(self.docs, np.arange(ranges + 1) * RANGE)

    def gains(self) -> np.ndarray:
        if self.gain is None:
            self.gain = self.weight * saturation(self.tf, self.m[self.docs])
        return self.gain


def best(lists: list[tuple[Postings, int]], documents: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, ranges evaluated) of the k best documents of a segment for one query's (postings, times)."""
    ranges = -(-documents // RANGE)
    held = np.zeros(ranges * RANGE, np.int64)
    for p, times in lists:
        if not p.long:
            held[p.docs] += times * p.gains()  # a document is once in a list
    by_range = held.reshape(ranges, RANGE)
    high = by_range.max(1)
    rest = sorted(((p, times) for p, times in lists if p.long), key=lambda x: -int(x[0].bound.max()) * x[1])
    top_score, top_place, threshold, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0
    if (touched := held[held > 0]).size >= k:
        threshold = int(np.partition(touched, len(touched) - k)[len(touched) - k])
    later = np.zeros((len(rest) + 1, ranges), np.int64)  # what the lists from the j-th on can add in each range
    for j in range(len(rest) - 1, -1, -1):
        later[j] = later[j + 1] + rest[j][1] * rest[j][0].bound
    for a in range(0, ranges, WINDOW):
        b = min(ranges, a + WINDOW)
        alive = high[a:b] + later[0, a:b] >= threshold
        if not alive.any():
            continue
        seen += int(alive.sum())
        scores = by_range[a:b]  # a view: the window's documents are scored in place
        for j, (p, times) in enumerate(rest):
            if alive.all():
                mine = slice(p.starts[a], p.starts[b])
                held[p.docs[mine]] += times * p.gains()[mine]
            else:
                for c in np.flatnonzero(alive) + a:
                    mine = slice(p.starts[c], p.starts[c + 1])
                    held[p.docs[mine]] += times * p.gains()[mine]
            alive &= scores.max(1) + later[j + 1, a:b] >= threshold
            if not alive.any():
                break
        full = np.flatnonzero((scores >= threshold) & alive[:, None])
        if len(full):
            place = np.r_[top_place, full + a * RANGE]
            score = np.r_[top_score, scores.ravel()[full]]
            order = np.lexsort((place, -score))[:k]
            top_place, top_score = place[order], score[order]
            if len(order) == k:
                threshold = max(threshold, int(top_score[-1]))
    return top_place, top_score, seen


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each of queries(item_id, text)."""
    size = index.agg(F.sum("filled").alias("docs"), F.sum("total").alias("terms")).first()
    all_docs, all_terms = size.docs or 0, size.terms or 0
    ask = written(asked(queries), "asked")
    blocks = max(1, -(-ask.select("item_id").distinct().count() // QUERIES))
    ask = ask.withColumn("block", F.expr(f"pmod(xxhash64(item_id), {blocks})"))
    names = ask.select("term").distinct()
    many = names.count() > BROADCAST
    near = (lambda x: x) if many else F.broadcast
    df = index.where("term is not null").select("term", "df").join(near(names), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * all_docs + 2)) / (2 * F.col("df") + 1)))
    askers = F.collect_list(F.struct("item_id", "times")).alias("askers")  # at most QUERIES of them
    wanted = written(ask.join(df.select("term", weight.alias("w")), "term").groupBy("block", "term", "w").agg(askers), "wanted")
    near = F.broadcast if not many and wanted.count() <= BROADCAST else lambda x: x
    columns = ["segment", "block", "w", "docs", "tfs", "bounds", "nulls", "askers"]
    hits = index.where("term is not null").join(near(wanted), "term").select(*columns)
    own = index.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    none = F.lit(None)
    own = own.withColumns({"w": none.cast("long"), "askers": none.cast(hits.schema["askers"].dataType)}).select(*columns)

    def run(cell: pa.Table) -> pa.Table:
        rows = cell.select(columns[2:]).to_pylist()
        docs = next(r for r in rows if r["askers"] is None)
        ids, n = np.frombuffer(docs["docs"], "<i8"), np.frombuffer(docs["tfs"], "<i8")
        of = lambda x: norms(x, all_docs, all_terms)
        m, ranges, by_item = of(n) if all_terms else n, -(-len(ids) // RANGE), defaultdict(list)
        for r in rows:
            if r["askers"] is not None:
                p = Postings(r, m, ranges, of)
                for x in r["askers"]:
                    by_item[x["item_id"]].append((p, x["times"]))
        items, places, scores = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item, lists in by_item.items():
            place, score, _ = best(lists, len(ids), k)
            items += [item] * len(place)
            places.append(place)
            scores.append(score)
        at = np.concatenate(places)
        return pa.table([pa.array(items, pa.int64()), pa.array(ids[at], mask=at >= len(ids) - docs["nulls"]), pa.array(np.concatenate(scores))], names=["item_id", "doc_id", "score"])

    found = hits.unionAll(own).groupBy("segment", "block").applyInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked(spark, sf_dir) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_SMALL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
size AS (SELECT count(*) AS all_docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d WHERE len(terms) > 0),
p AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT row, doc_id, unnest(terms) AS term, len(terms) AS n FROM d) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, size GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark GROUP BY item_id)),
t AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
s AS (SELECT item_id, row, any_value(doc_id) AS doc_id,
             CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) AS BIGINT) AS score
      FROM t JOIN w USING (term) JOIN p USING (term), size GROUP BY item_id, row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {K}
"""
