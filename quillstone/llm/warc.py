"""WARC archives: records of web pages, written in segments and put together again.

Writing: a page's payload is sent as a chunked HTTP response; a block over ``segment_bytes`` is split into a response
record and continuation records. Of equal payloads one page holds the response and the others revisit it. Records are
gzip members of archives, which are rows of a DataFrame (archive, content), as reading binary files gives them.

Reading: records are parsed, continuation records are grouped by the record that they continue and ordered by segment
number, the total length is verified, and chunked transfer framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, texts

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
ARCHIVE_BYTES = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        m = re.match(rb"\s*([0-9a-fA-F]+)", body[at:end]) if end >= 0 else None
        if m is None:
            return None
        size, at = int(m[1], 16), end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_records(page_id, url: str, payload: bytes | None, digest: str, size: int, refers_to, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of a page; payload None: a revisit record of the page refers_to."""
    own = f"<urn:page:{page_id}:{digest}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")]
        return [record(fields + common, _HTTP)]
    block = _HTTP + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common]
    if len(block) <= segment_bytes:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], block[:segment_bytes])]
    for n, at in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        last = [("WARC-Segment-Total-Length", str(len(block)))] * (at + segment_bytes >= len(block))
        out.append(record(fields + last, block[at : at + segment_bytes]))
    return out


def parse(content: bytes):
    """(fields by lower-case name, block) of each record of an archive, gzip members or plain."""
    while content:
        if content[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            data, content = z.decompress(content), z.unused_data
        else:
            data, content = content, b""
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                break
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(fields.get("content-length", 0))
            yield fields, data[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def write_archives(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: archives with the records of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Of rows with equal payloads of at least ``least_bytes``, those with the smallest page_id are responses and the others
    revisit them; smaller ones are all responses. Null html is the empty payload; null ids revisit, unless no row of the
    payload has an id.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def digest():
        def step(b):
            data = texts(b.column("html"))
            return {"page_id": b.column("page_id"), "url": b.column("url"), "payload": data, "digest": [payload_digest(d) for d in data], "size": [len(d) for d in data]}

        return step

    names = f"page_id {kind}, url string, payload binary, digest string, size long"
    have = arrow_map(pages.select("page_id", "url", "html"), digest, names)
    # only ids and digests are grouped; a payload that many pages share is one row of ``first``
    slim = arrow_map(pages.select("page_id", "url", "html"), lambda: (lambda f: lambda b: f(b) | {"payload": [None] * b.num_rows})(digest()), names)
    first = slim.filter(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = cut(first.filter("n > 1").drop("n").withColumnsRenamed({"digest": "d", "size": "s"}))
    met = have.join(first, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    met = met.select("page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "digest", "size", F.when(revisits, F.col("first_id")).alias("refers_to"))

    def write():
        def step(b):
            out, held, size = [], [], 0
            for row in b.to_pylist():
                records = page_records(row["page_id"], row["url"] or "", row["payload"], row["digest"], row["size"], row["refers_to"], segment_bytes)
                for r in records:
                    held.append(r)
                    size += len(r)
                    if size >= archive_bytes:
                        out.append(b"".join(held))
                        held, size = [], 0
            out += [b"".join(held)] if held else []
            return {"archive": [f"{hashlib.sha1(x).hexdigest()}.warc.gz" for x in out], "content": out}

        return step

    return arrow_map(met, write, "archive string, content binary")


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each record of ``archives`` (content): its fields, named as in the standard, and its block."""

    def make():
        def step(b):
            out = {c: [] for c in ("record_id", "type", "uri", "digest", "size", "refers_to", "number", "origin", "total", "block")}
            for content in b.column("content").to_pylist():
                for f, block in parse(content or b""):
                    n = lambda k: int(f[k]) if f.get(k, "").isdigit() else None  # noqa: B023, E731
                    values = (f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-payload-digest", "").rpartition(":")[2], n("x-payload-length"), f.get("warc-refers-to"), n("warc-segment-number"), f.get("warc-segment-origin-id"), n("warc-segment-total-length"), block)
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
            return out

        return step

    schema = "record_id string, type string, uri string, digest string, size long, refers_to string, number int, origin string, total long, block binary"
    return arrow_map(archives.select("content"), make, schema, rows=4)


def reassemble(records: DataFrame) -> DataFrame:
    """Records without continuations: record_id, type, uri, digest, size, refers_to, payload, complete.

    Segments are ordered by number; each counts once, however often it was written. ``complete`` is false, and the
    payload null, where a segment is missing, the total length differs, the framing is broken or the payload's digest
    does not match. Revisit records are complete without a payload.
    """
    whole = records.filter("type <> 'continuation' and number is null").withColumn("rest", F.lit(None).cast("array<struct<number:int,total:bigint,block:binary>>"))
    rest = records.filter("type = 'continuation'").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "block")).alias("rest")).withColumnRenamed("origin", "o")
    firsts = records.filter("type <> 'continuation' and number = 1").join(rest, F.col("record_id") == F.col("o"), "left").drop("o")
    both = whole.unionByName(firsts).drop("origin", "total")

    def make():
        def payload(row):
            block = row["block"]
            if row["number"]:
                parts = {s["number"]: s for s in row["rest"] or ()}
                if sorted(parts) != list(range(2, len(parts) + 2)) or not parts:
                    return None
                block += b"".join(parts[k]["block"] for k in sorted(parts))
                if parts[len(parts) + 1]["total"] != len(block):
                    return None
            head, _, body = block.partition(b"\r\n\r\n")
            body = dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked", head) else body
            return body if body is not None and payload_digest(body) == row["digest"] else None

        def step(b):
            out = {c: [] for c in ("payload", "complete")}
            for row in b.to_pylist():
                got = None if row["type"] == "revisit" else payload(row)
                out["payload"].append(got)
                out["complete"].append(got is not None or row["type"] == "revisit")
            return out | {c: b.column(c) for c in ("record_id", "type", "uri", "digest", "size", "refers_to")}

        return step

    return arrow_map(both, make, "record_id string, type string, uri string, digest string, size long, refers_to string, payload binary, complete boolean", rows=64)


def page_of(record_id):
    """The page id in a record's URI as text, null for a page without one."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(.*):[A-Z2-7]{32}>$", 1), F.lit("None"))


def round_trip(pages: DataFrame, least_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, complete of every row, read back from its archives."""
    kind = pages.schema["page_id"].dataType
    read = reassemble(read_records(cut(write_archives(pages, least_bytes, segment_bytes))))
    return read.select(
        page_of("record_id").cast(kind).alias("page_id"),
        F.when(F.col("type") == "revisit", F.col("size")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page_of("refers_to").cast(kind).alias("refers_to"), "complete",
    )
