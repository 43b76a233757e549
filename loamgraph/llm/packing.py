"""Best-fit packing with certified bounds: tokenised documents into sequences of fixed length.

``pieces`` tokenises whole documents (a public tokenizer's ids, then one end id) and cuts only those longer than a
sequence. ``pack`` deals the shorter pieces into partitions of bounded size, packs each best-fit decreasing, and
computes a lower bound on its bins by dual-feasible functions of the size histogram. A partition whose bin count
equals its bound is certified. Partitions with gaps exchange their documents (they are dealt anew among
themselves) and are packed again, until that spares no bin. At the end the loosest bins of neighbouring partitions
are pooled and packed once more, so partitions do not each leave a half-empty bin; a pool that gains nothing keeps
its bins. The same functions over the lengths of all pieces certify the whole packing (``sequences_bound``).

Tokenising looks up white-space-separated chunks in a bounded table, as the tokenizer never joins across white
space; a table lives as long as its task, and a full one is emptied, never skipped.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; a null id stays null;
an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

LENGTH, END = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces per partition, partitions whose loose bins are pooled, entries of the table of chunks.
ITEMS, POOL, ENTRIES = 4096, 32, 600_000
_ASCII_GAPS = re.compile(r"[ \t\n\r\f\v]+")
#: ASCII signs but the apostrophe, which may begin a unit of letters; their runs at the end of a chunk that follow a
#: letter or digit; separators of text.split() that the tokenizer does not take for white space.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_TAILS = re.compile(r"[!-&(-/:-@\[-`{-~](?<=[^\W_].)[!-&(-/:-@\[-`{-~]*(?!\S)")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Chunks:
    """Ids of texts, as little-endian 32-bit bytes, through a table of chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.of, self.known = Tokenizer.from_file(path), {}
        self.added = [t.content for t in self.of.get_added_tokens_decoder().values()]
        # bytes as the vocabulary spells them: printable ones as themselves, the others from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spell = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}

        # the shortcut below holds for vocabularies that see letters without case and split signs off; others go without
        self.quick = True
        probes = ["Hello", "hELLO,", "don't", "ÀÉß", "ﬁn", "x--y", "abc!?", "naïve.", "ŒUVRE", "end...", "Ab-", "zzz"]
        self.learn(probes)
        self.quick = all(self.known[w] == x for w, x in zip(probes, self.encode(probes), strict=True))
        self.known = {}

    def encode(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), 4096):
            out += [array("I", e.ids).tobytes() for e in self.of.encode_batch_fast(words[k : k + 4096], add_special_tokens=False)]
        return out

    def learn(self, new: list[str]) -> None:
        """A run of letters, looked up without case, or of signs is one unit of the vocabulary's merges, with no need to
        normalise or split it; letters followed by signs are two. All else is left to the tokenizer."""
        plain, split, units = [], [], {}
        for w in new:
            if self.quick and (not (k := w.rstrip(_SIGNS)) or (k.isalpha() and (w.isascii() or max(w) < "ƀ") and len(low := k.lower()) == len(k))):
                if not k or w == low:
                    units[w] = None
                else:
                    split.append((w, low, w[len(k) :]))
            else:
                plain.append(w)
        for _, a, b in split:
            units[a] = units[b] = None
        merge, known = self.of.model.tokenize, self.known
        for part in units:
            if part and part not in known:
                spelled = part if part.isascii() else "".join(map(self.spell.__getitem__, part.encode()))
                known[part] = array("I", [t.id for t in merge(spelled)]).tobytes()
        known.update(zip(plain, self.encode(plain), strict=True))
        known.update((w, known[a] + known[b] if b else known[a]) for w, a, b in split)

    def words(self, text: str) -> list[str]:
        """The chunks to look up. In plain Latin text case goes, and signs at a chunk's end are chunks of their own, so that
        there are few different ones; a chunk that ends otherwise keeps them."""
        if any(c in text for c in _ODD):
            return _ASCII_GAPS.split(text.strip(" \t\n\r\f\v"))
        if self.quick and not any(x in text for x in self.added):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
            return _TAILS.sub(r" \g<0>", text.lower()).split()
        return text.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > ENTRIES:
            self.known = {}
        split = [self.words(t) for t in texts]
        new = set()
        for words in split:
            new.update(words)
        new.difference_update(self.known)
        self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        table_, mark = Chunks(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for k in range(0, len(doc_ids), 512):
                texts = [t or "" for t in batch.column(1).slice(k, 512).to_pylist()]
                rows = []
                for doc_id, raw in zip(doc_ids[k : k + 512], table_.ids(texts), strict=True):
                    raw += mark
                    for p, at in enumerate(range(0, len(raw), 4 * length)):
                        part = raw[at : at + 4 * length]
                        rows.append((doc_id, p, at // 4, len(part) // 4, crc32(part), part))
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                yield pa.record_batch(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def bound(sizes: np.ndarray, length: int) -> int:
    """The largest lower bound on the bins of these sizes that the dual-feasible functions give."""
    return bound_of(np.bincount(sizes, minlength=length + 1).astype(np.int64), length)


def bound_of(count: np.ndarray, length: int) -> int:
    """The same from how often each size occurs."""
    x = np.arange(length + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // length)
    # f_e: large sizes count as a whole bin, those under e as nothing
    below = np.concatenate([[0], np.cumsum(count * x)])
    many = np.concatenate([[0], np.cumsum(count)])
    e = np.arange(1, length // 2 + 1)
    whole = many[length + 1] - many[length - e + 1]
    middle = below[length - e + 1] - below[e]
    best = max(best, int((-(-(whole * length + middle) // length)).max()))
    for k in range(1, 21):  # f_k: sizes rounded down to multiples of 1 / k where (k + 1) x is no multiple of the length
        y = (k + 1) * x
        f = np.where(y % length == 0, x * k, (y // length) * length)
        best = max(best, -(-int((count * f).sum()) // (length * k)))
    return best


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) of each size, best-fit decreasing. A bit mask of the free rooms finds the tightest."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(length + 1)]
    mask, n = 0, 0
    for i in order:
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = length, n, n + 1
        bins[i], offsets[i] = b, length - room
        left = room - s
        rooms[left].append(b)
        mask |= 1 << left if left else 0
    return bins, offsets, n


PACKED = PIECE + ", uid long, part long, bin long, offset long, used long, least long"


def pack_parts(items: DataFrame, length: int) -> DataFrame:
    """Packs each ``part``; used and least: the part's bins and the bound that certifies them."""

    def one(got: pa.Table) -> pa.Table:
        order = np.argsort(got.column("uid").to_numpy(), kind="stable")
        got = got.take(pa.array(order))
        sizes = got.column("length").to_numpy()
        bins, offsets, n = best_fit(sizes, length)
        least = bound(sizes, length)
        full = lambda v: pa.array(np.full(len(sizes), v, np.int64))
        for name, col in (("bin", pa.array(bins)), ("offset", pa.array(offsets)), ("used", full(n)), ("least", full(least))):
            got = got.append_column(name, col)
        return got.select([c.split()[0] for c in PACKED.split(", ")])

    return items.select("doc_id", "piece", "start", "length", "ids_crc32", "uid", "part").groupBy("part").applyInArrow(one, PACKED)


def repack_loose(loose: DataFrame, length: int) -> DataFrame:
    """Packs the bins of each ``pool`` once more; a pool whose bins do not become fewer keeps them as they were."""

    def one(got: pa.Table) -> pa.Table:
        got = got.take(pa.array(np.argsort(got.column("uid").to_numpy(), kind="stable")))
        sizes = got.column("length").to_numpy()
        bins, offsets, n = best_fit(sizes, length)
        pool = got.column("pool").to_numpy()
        was = len(set(zip(got.column("part").to_pylist(), got.column("bin").to_pylist(), strict=True)))
        cols = {c.split()[0]: got.column(c.split()[0]) for c in PIECE.split(", ")}
        if n < was:
            cols |= {"part": pa.array(pool), "bin": pa.array(bins), "offset": pa.array(offsets)}
        else:
            cols |= {c: got.column(c) for c in ("part", "bin", "offset")}
        return pa.table(cols)

    return loose.select("doc_id", "piece", "start", "length", "ids_crc32", "uid", "part", "bin", "offset", "pool").groupBy("pool").applyInArrow(one, PIECE + ", part long, bin long, offset long")


def gaps(packed: DataFrame) -> tuple[int, int]:
    """(parts with a gap, bins in them)."""
    per = packed.where("used > least").groupBy("part").agg(F.first("used").alias("u"))
    n, used = per.agg(F.count("*"), F.sum("u")).first()
    return n, used or 0


def certified(found: DataFrame, length: int = LENGTH) -> int:
    """The least number of sequences that any packing of ``found`` needs, from how often each length occurs."""
    counts = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # a row for each length up to a sequence's
    have = np.zeros(length + 1, np.int64)
    for r in counts:
        have[r.length] = r.n
    return bound_of(have, length)


def pack(found: DataFrame, length: int = LENGTH, items: int = ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``found``, and sequences_bound, the
    certified least number of sequences for all of them."""
    rows = written(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    least = certified(rows, length)
    whole = rows.where(F.col("length") == length).select(*[c.split()[0] for c in PIECE.split(", ")], (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = rows.where(F.col("length") < length)
    n = max(1, -(-short.count() // items))
    deal = lambda seed, k: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(k)).cast("long")
    best = written(pack_parts(short.withColumn("part", deal(0, n)), length), "packed")
    base, turn = n, 0
    while True:  # each round spares a bin at least, or is the last
        turn += 1
        k, used = gaps(best)
        if k < 2:
            break
        again = written(pack_parts(best.where("used > least").withColumn("part", base + deal(turn, k)), length), "packed")
        now = again.groupBy("part").agg(F.first("used").alias("u")).agg(F.sum("u")).first()[0]
        if now >= used:
            break
        best, base = written(best.where("used = least").unionByName(again), "packed"), base + k
    cols = [c.split()[0] for c in PIECE.split(", ")]
    if n > 1:
        # the bins that are emptiest in their part meet those of other parts
        bins = best.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
        loose = bins.where(F.col("fill") < length - length // 20).select("part", "bin")
        tight = best.join(loose, ["part", "bin"], "left_anti")
        pooled = best.join(loose, ["part", "bin"], "left_semi").withColumn("pool", base + F.floor(F.col("part") / POOL))
        best = tight.select(*cols, "part", "bin", "offset").unionByName(repack_loose(pooled, length))
    packed = best.select(*cols, ((F.col("part") * (1 << 24) + F.col("bin")) * 2).alias("sequence_id"), "offset")
    return whole.unionByName(packed).withColumn("sequences_bound", F.lit(least).cast("long"))


def op3_packing(spark, sf_dir) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
