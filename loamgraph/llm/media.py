"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

``store_media`` turns each payload into an 8-bit grey PNG (64 samples a row, so every multiple of 64 bytes is a
whole image) and appends it to its task's tar shard under the payload's SHA-256. A shard holds each digest once;
across shards the smallest (shard, offset) is the address that every row of that digest carries.
``headers`` fills metadata columns from range reads of the image's first 33 bytes; ``features`` reads whole
members back, checks the digest and computes the features.

Shards are written by executors into shared storage through the URI's file system and named by a random id; a
task that runs again writes another file, and only files named by the surviving result rows are ever read.

Defined results: null texts are empty and store one row of 64 zero samples; rows with a null id stay; repeated
rows and equal texts share one member and all values; an empty table gives an empty result; extra columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread, store, table, written

WIDTH = 64
SHARD_BYTES = 128 << 20
HEADER = 33
LEVEL = 6
ROWS = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(payload: bytes) -> bytes:
    """8-bit grey image of the payload, 64 samples a row, unfiltered."""
    rows = len(payload) // WIDTH
    raw = np.zeros((rows, WIDTH + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def samples(image: bytes) -> bytes:
    """The payload of an image that ``png`` made."""
    at, body = 8, b""
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        if kind == b"IDAT":
            body += image[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header for a plain file, without times or owners, so equal members are equal bytes."""
    h = bytearray(512)
    for at, part in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        h[at : at + len(part)] = part
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def feature(payload: bytes) -> str:
    """Rows, mean, deviation, share of zero samples and a 64-bit brightness pattern of a 8 x 8 grid."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    edges = np.arange(65) * n // 64
    cells = np.add.reduceat(x.astype(np.int64), np.minimum(edges[:-1], n - 1)) / np.maximum(np.diff(edges), 1)
    bits = int("".join("1" if c > cells.mean() else "0" for c in cells), 2)
    return f"{n // WIDTH}:{x.mean():.4f}:{x.std():.4f}:{np.count_nonzero(x == 0) / n:.4f}:{bits:016x}"


def store_media(docs: DataFrame, out_dir: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards under ``out_dir``; per row: doc_id, n_bytes, digest and where its task put the member."""

    def shards(batches):
        fs, base = store(out_dir)
        fs.create_dir(base, recursive=True)
        sink, name, at, known = None, "", 0, {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out = []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                raw = (text.as_py() or "").encode()
                payload = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                digest = hashlib.sha256(payload).digest()
                if digest not in known:
                    if sink is None or at >= shard_bytes:
                        if sink is not None:
                            sink.write(bytes(1024))
                            sink.close()
                        name, at, known = f"{uuid.uuid4().hex}.tar", 0, {}
                        sink = fs.open_output_stream(f"{base}/{name}")
                    image = png(payload)
                    sink.write(tar_header(f"{digest.hex()}.png", len(image)) + image + bytes(-len(image) % 512))
                    known[digest] = (name, at + 512, len(image))
                    at += 512 + len(image) + -len(image) % 512
                out.append((doc_id, len(raw), digest, *known[digest]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if sink is not None:
            sink.write(bytes(1024))
            sink.close()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(shards, ROWS), "media-rows")


def addresses(rows: DataFrame) -> DataFrame:
    """One address per digest, in the order of the shards, over as many tasks as the images' bytes ask for."""
    at = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    at = written(at, "media-at")
    tasks = spread(rows.sparkSession, at.agg(F.sum("length")).first()[0] or 0)
    return at.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")


READ = "digest binary, width int, height int, bit_depth int, payload_bytes long, tail_crc32 long, media_bytes long, media_digest binary, feature string"


def features(at: DataFrame, out_dir: str, whole: bool = True) -> DataFrame:
    """Per digest: header fields by a range read of 33 bytes and, if ``whole``, what the read-back payload gives."""

    def read(batches):
        fs, base = store(out_dir)
        file, name = None, None
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    file, name = fs.open_input_file(f"{base}/{shard}"), shard
                head = file.read_at(HEADER, offset)
                w, h, depth = struct.unpack_from(">IIB", head, 16)
                if not whole:
                    out.append((digest, w, h, depth, w * h, None, length, None, None))
                    continue
                image = head + file.read_at(length - HEADER, offset + HEADER)
                payload = samples(image)
                found = hashlib.sha256(payload).digest()
                if found != digest:
                    raise ValueError(f"{shard}@{offset}: stored {digest.hex()}, read {found.hex()}")
                out.append((found, w, h, depth, len(payload), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).digest(), feature(payload)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) if out else [[]] * len(kinds), kinds, strict=True)], names=names)
        if file:
            file.close()

    return at.mapInArrow(read, READ)


def media(docs: DataFrame, out_dir: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores every text's payload and returns its row with address, header columns and features."""
    rows = store_media(docs, out_dir, shard_bytes)
    found = written(features(addresses(rows), out_dir), "media-read")
    hexed = lambda c: F.lower(F.hex(c))
    both = rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
    return both.withColumns({"payload_sha256": hexed("digest"), "media_sha256": hexed("media_digest")}).drop("digest", "media_digest")


def op10_media(spark, sf_dir) -> DataFrame:
    return media(table(spark, sf_dir, "documents"), scratch(spark, "media"))
