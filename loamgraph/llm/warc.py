"""WARC archives: a monolithic-gzip normaliser with a sidecar offset index, and revisit records for equal payloads.

``write_monolithic`` writes each task's records as one gzip stream, the form many crawls are kept in, which can
only be read from its start. ``normalise`` inflates such a file once, record by record, writes every record as a
gzip member of its own and a sidecar with offset and length of each, so that ``read_records`` fetches single
records by range reads, spread evenly over tasks.

Which record of equal payloads is the response is decided by a grouped minimum over digests, written before it
is joined; a digest that a third of all pages share costs one row per task there, and AQE splits its side of the join.
Archives are read back by as many tasks as their bytes ask for.

Defined results: null html is an empty payload; a null page_id is written as "-", read back as null and never
the response while another id has the payload; rows that repeat the smallest page_id of a payload are all
responses; a null url becomes ``about:blank``; control characters and spaces in a url are percent-encoded; an
empty table gives no file and an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread, store, table, written

FILE_BYTES = 64 << 20
MIN_BYTES = 0
STAMP = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is the full payload's, and no body."""
    quote = lambda u: "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in u.encode()) if u.isascii() else "".join(f"%{b:02X}" if b <= 32 or b >= 127 else chr(b) for b in u.encode())
    name = "-" if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {quote(url or 'about:blank')}", f"WARC-Date: {STAMP}", f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


def split_records(chunks):
    """Whole records out of inflated chunks; holds one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            size = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < size:
                break
            yield bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("the archive ends inside a record")


def inflate(file, step: int = 1 << 18):
    """Chunks of a gzip file of one or more members."""
    z = zlib.decompressobj(31)
    while data := file.read(step):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    yield z.flush()


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds refers_to: the smallest page_id with an equal payload, where that is another row's."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("k"), F.octet_length(payload).alias("n"))
    # a row per payload that occurs again, written before the join: both sides are then shuffled as they are, and AQE
    # splits the side of a digest that many pages share
    first = written(p.where(F.col("n") >= min_bytes).groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("k", "first"), "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return p.join(first.hint("merge"), "k", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_monolithic(pages: DataFrame, out_dir: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One gzip stream per task and ``file_bytes`` of records; the names of the files."""

    def write(batches):
        fs, base = store(out_dir)
        fs.create_dir(base, recursive=True)
        names, sink, z, n = [], None, None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    sink, z, n = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), zlib.compressobj(1, wbits=31), 0
                data = record(page_id, url, (html or "").encode(), refers_to)
                sink.write(z.compress(data))
                n += len(data)
                if n >= file_bytes:
                    sink.write(z.flush())
                    sink.close()
                    sink = None
        if sink is not None:
            sink.write(z.flush())
            sink.close()
        yield pa.record_batch([pa.array(names, pa.string())], names=["name"])

    return written(pages.mapInArrow(write, "name string"), "warc-files")


def normalise(files: DataFrame, in_dir: str, out_dir: str) -> DataFrame:
    """Rewrites every file with a member per record and a sidecar ``.idx`` (offset, length, id per line); returns the
    new files' names, records and bytes. The sources stay, so that a lost or speculative task can be run again."""

    def one(batches):
        fs, base = store(in_dir)
        to, target = store(out_dir)
        to.create_dir(target, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, at, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as file, to.open_output_stream(f"{target}/{new}", compression=None) as sink:
                    for data in split_records(inflate(file)):
                        z = zlib.compressobj(6, wbits=31)
                        member = z.compress(data) + z.flush()
                        sink.write(member)
                        rows.append((at, len(member), fields(data[: data.find(b"\r\n\r\n")])["warc-record-id"]))
                        at += len(member)
                with to.open_output_stream(f"{target}/{new}.idx") as side:
                    side.write("".join(f"{a}\t{n}\t{i}\n" for a, n, i in rows).encode())
                yield pa.record_batch([pa.array([new], pa.string()), pa.array([len(rows)], pa.int64()), pa.array([at], pa.int64())], names=["file", "records", "bytes"])

    return written(files.mapInArrow(one, "file string, records long, bytes long"), "warc-done")


def read_index(spark, done: DataFrame, out_dir: str) -> DataFrame:
    """The sidecars of the files in ``done`` as rows (file, offset, length), dealt evenly over tasks."""
    lines = spark.read.schema("offset long, length long, id string").option("sep", "\t").option("quote", "").option("pathGlobFilter", "*.idx").csv(out_dir)
    lines = lines.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.idx$", 1).alias("file"), "offset", "length")
    return lines.join(done.select("file"), "file", "left_semi").repartitionByRange(spread(spark, done.agg(F.sum("bytes")).first()[0] or 0), "file", "offset").sortWithinPartitions("file", "offset")


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read_records(index: DataFrame, out_dir: str) -> DataFrame:
    """Fetches each record by its own range and checks a response's payload against its digest."""

    def read(batches):
        fs, base = store(out_dir)
        file, name = None, None
        ident = lambda s: None if (x := s.removeprefix("<urn:page:").removesuffix(">")) == "-" else int(x)
        for batch in batches:
            out = []
            for f, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != name:
                    if file:
                        file.close()
                    file, name = fs.open_input_file(f"{base}/{f}"), f
                data = zlib.decompress(file.read_at(length, offset), 31)
                end = data.find(b"\r\n\r\n")
                w = fields(data[:end])
                block = data[end + 4 : end + 4 + int(w["content-length"])]
                head = block.find(b"\r\n\r\n")
                size, digest = int(fields(block[:head])["content-length"]), w["warc-payload-digest"].removeprefix("sha1:")
                if w["warc-type"] == "response":
                    payload = block[head + 4 :]
                    if len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest:
                        raise ValueError(f"{f}@{offset}: the payload is not the one written")
                out.append((ident(w["warc-record-id"]), size, digest, w["warc-type"], ident(w["warc-refers-to"]) if "warc-refers-to" in w else None, w["warc-target-uri"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) if out else [[]] * 6, kinds, strict=True)], names=[x.split()[0] for x in PAGE.split(", ")])
        if file:
            file.close()

    return index.mapInArrow(read, PAGE)


def round_trip(pages: DataFrame, out_dir: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes monolithic archives, normalises them, and reads every record back through the sidecar index."""
    spark = pages.sparkSession
    raw, done = f"{out_dir}/monolithic", f"{out_dir}/members"
    files = write_monolithic(decided(pages, min_bytes), raw)
    n = files.count()
    if not n:
        return spark.createDataFrame([], PAGE)
    made = normalise(files.repartition(n), raw, done)
    fs, base = store(raw)  # every new file is committed by now
    fs.delete_dir(base)
    return read_records(read_index(spark, made, done), done)


def op9_warc(spark, sf_dir) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc")).drop("target_uri")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex FROM p),
bits AS (SELECT *, (SELECT string_agg(right('000' || bin(CAST('0x' || substr(hex, i, 1) AS BIGINT)), 4), '' ORDER BY i) FROM generate_series(1, 40) AS s(i)) AS bb FROM h),
d AS (SELECT page_id, n, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
        16 * CAST(substr(bb, 5*j+1, 1) AS INT) + 8 * CAST(substr(bb, 5*j+2, 1) AS INT) + 4 * CAST(substr(bb, 5*j+3, 1) AS INT)
        + 2 * CAST(substr(bb, 5*j+4, 1) AS INT) + CAST(substr(bb, 5*j+5, 1) AS INT)) AS INT) + 1, 1), '' ORDER BY j) FROM generate_series(0, 31) AS s(j)) AS dig FROM bits),
m AS (SELECT dig, min(page_id) AS first FROM d GROUP BY dig)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.dig AS payload_digest, CASE WHEN d.page_id = m.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id = m.first THEN NULL ELSE m.first END AS refers_to FROM d JOIN m ON d.dig = m.dig
"""
