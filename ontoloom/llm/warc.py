"""WARC archives: written through Spark's text sink, read back with segment reassembly.

A record's end is CR LF CR LF, which is the sink's line separator here, so the files are plain WARC/1.1 (gzip
compressed), come through Spark's commit protocol and can lie on any storage that Spark reaches. A response is an
HTTP message with chunked transfer framing; one of over ``SEGMENT`` bytes is cut into a first record and
continuation records. Reading groups segments by origin identifier, orders them by segment number, checks that none
is missing and that the total length is right, and decodes the framing. Of equal payloads of at least ``REVISIT``
bytes the one with the largest id is kept as response, the others become revisit records that name it.

Defined results. A null payload is empty. Rows that are equal in every column give as many records; of rows that
share the largest id all are responses. Payloads without any id are all responses. An empty table gives an empty
table. A broken archive raises WarcError: truncated blocks, a missing segment, a wrong length or digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_path, texts

REVISIT = 1000
SEGMENT = 16 << 10
CHUNK = 4 << 10
RECORDS_PER_FILE = 2000
CRLF = b"\r\n"
END = CRLF + CRLF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def framed(payload: bytes) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + CHUNK]), payload[i : i + CHUNK]) for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise WarcError("no chunk size")
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError as e:
            raise WarcError("bad chunk size") from e
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            raise WarcError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record less its closing CR LF CR LF."""
    head = "".join(f"{k}: {str(v).translate({13: ' ', 10: ' '})}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def records(page_id, url, key: int, digest: bytes, payload: bytes, refers_to: str | None) -> list[bytes]:
    """The records of one page. ``key`` tells rows with the same id apart."""
    own = f"<urn:page:{page_id}:{key & (1 << 64) - 1:016x}>"
    common = [("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", b32(digest)), ("WARC-Page-ID", page_id), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)], head)]
    block = head + framed(payload)
    if len(block) <= SEGMENT:
        return [record([("WARC-Type", "response"), *common], block)]
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Total-Length", total)], part))
    return out


def parsed(data: bytes):
    """(fields, block) of each record of an archive."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at) or (end := data.find(END, at)) < 0:
            raise WarcError(f"no record at byte {at}")
        fields = {}
        for line in data[at:end].split(CRLF)[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode()] = v.strip().decode()
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop : stop + 4] != END:
            raise WarcError(f"record at byte {at} is cut short")
        yield fields, data[start:stop]
        at = stop + 4


def inflated(data: bytes) -> bytes:
    """All gzip members; what does not start as one is taken as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        if not d.eof:
            raise WarcError("gzip member is cut short")
        data = d.unused_data
    return b"".join([*out, data])


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html") -> None:
    raw = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.xxhash64("id", "url", "digest"))
    held = rows.where((F.octet_length("payload") >= REVISIT) & F.col("id").isNotNull()).groupBy("digest").agg(F.max(F.struct("id", "key")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(held.select("digest", "kept"), "digest", "left")
    # Payloads that are held elsewhere don't go on to Python.
    again = F.coalesce(F.col("kept.id") != F.col("id"), F.lit(False))
    rows = rows.select("id", "url", "key", F.unhex("digest").alias("digest"), F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("kept.id")).alias("kept_id"), F.when(again, F.col("kept.key")).alias("kept_key"))

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6)]
            out = []
            for payload, i, u, key, digest, kept, kept_key in zip(texts(b.column(4)), *cols, strict=True):
                to = None if kept is None else f"<urn:page:{kept}:{kept_key & (1 << 64) - 1:016x}>"
                out += records(i, u, key, digest, payload, to)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    done = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    done.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


PARSED = "origin string, number int, total long, page_id long, type string, refers_to string, digest string, block binary"
READ = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(spark, path: str) -> DataFrame:
    """Each response and revisit record: READ, with the length and digest of the payload as found (a revisit has
    the digest that it names and no length)."""

    def scan(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for f, block in parsed(inflated(content.as_py())):
                    kind, page = f["warc-type"], f.get("warc-page-id")
                    origin = f["warc-segment-origin-id"] if kind == "continuation" else f["warc-record-id"]
                    total = f.get("warc-segment-total-length")
                    rows.append((origin, int(f.get("warc-segment-number", 0)), int(total) if total else None, None if page in (None, "None") else int(page), kind, f.get("warc-refers-to"), f.get("warc-payload-digest"), block))
                types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in PARSED.split(", ")])

    def payload(block: bytes) -> bytes:
        head, found, body = block.partition(END)
        if not found:
            raise WarcError("no HTTP header")
        return unframed(body) if b"transfer-encoding: chunked" in head.lower() else body

    def finished(rows: list[tuple]) -> list[tuple]:
        """The records of one origin. Rows that were equal have every segment as often."""
        origin, number = rows[0][0], rows[0][1]
        if number == 0:
            whole = [(r, r[7]) for r in rows]
        else:
            by: dict[int, list] = {}
            for r in rows:
                by.setdefault(r[1], []).append(r)
            copies = len(by.get(1, ()))
            if sorted(by) != list(range(1, len(by) + 1)) or any(len(x) != copies for x in by.values()):
                raise WarcError(f"{origin}: a segment is missing")
            whole = []
            for k in range(copies):
                block = b"".join(by[n][k][7] for n in sorted(by))
                if len(block) != by[len(by)][k][2]:
                    raise WarcError(f"{origin}: {len(block)} bytes, not {by[len(by)][k][2]}")
                whole.append((by[1][k], block))
        out = []
        for r, block in whole:
            if r[4] == "revisit":
                out.append((origin, r[3], None, base64.b32decode(r[6].removeprefix("sha1:")).hex(), "revisit", r[5]))
            elif r[4] == "response":
                body = payload(block)
                digest = hashlib.sha1(body).digest()
                if r[6] and b32(digest) != r[6]:
                    raise WarcError(f"{origin}: the digest differs")
                out.append((origin, r[3], len(body), digest.hex(), "response", None))
        return out

    def assemble(batches):
        held: list[tuple] = []
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

        def batch(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

        for b in batches:
            out = []
            origins = np.array(b.column(0).to_pylist(), object)
            for i in range(b.num_rows):
                row = (origins[i], *(b.column(c)[i].as_py() for c in range(1, 8)))
                if held and held[-1][0] != row[0]:
                    out += finished(held)
                    held = []
                held.append(row)
            yield batch(out)
        if held:
            yield batch(finished(held))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(scan, PARSED).repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(assemble, READ)


def archived(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back, revisits resolved: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, id, url, html)
    read = cut(read_archives(spark, path))
    own = read.where("refers_to IS NULL").select(F.col("page_id").alias(id), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    # Only what refers to another record is joined, so responses, which refer to none, don't meet under one key.
    held = read.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("held_id"), F.first("payload_bytes").alias("held_bytes"))
    again = read.where("refers_to IS NOT NULL").join(held.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    again = again.select(F.col("page_id").alias(id), F.coalesce("payload_bytes", "held_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("held_id").alias("refers_to"))
    return own.unionByName(again)
