"""WARC archives through a chunked record table.

Every page becomes one record; a payload over `chunk_bytes` becomes a first segment and `continuation` segments (WARC 1.1,
section on segmentation), rows of (record, segment number, bytes) that are never joined again.  The rows are written as
WARC text by Spark's text sink and split again at the record boundary by its text source, on any file system Spark writes
to.  The version line is the boundary; a segment ends early where its bytes would look like one, so that splitting is
exact.  On reading, a record's segments stream past in order and update one digest.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, utf8_rows

VERSION = b"WARC/1.1\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = b"2024-01-01T00:00:00Z"


def segments(payload: bytes, size: int) -> list[tuple[int, int]]:
    """Start and end of each segment: at most `size` bytes, no version line inside, none made with the line ends that follow."""
    out, at = [], 0
    view = memoryview(payload)
    while True:
        end = min(len(payload), at + size)
        hit = payload.find(VERSION, at, end)
        if hit >= 0:
            end = hit + 2
        elif view[max(at, end - 8) : end] == VERSION[:8]:
            end -= 6
        out.append((at, end))
        at = end
        if at >= len(payload):
            return out


def _urn(number: int, segment: int) -> bytes:
    return b"<urn:uuid:" + str(uuid.uuid5(NAMESPACE, f"{number}/{segment}")).encode() + b">"


def _headers(kind: bytes, number: int, segment: int, page: int | None, url: str | None, digest: bytes, length: int, more: list[tuple[bytes, bytes]]) -> bytes:
    target = b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes([c]) for c in (url or "urn:x-page:none").encode())
    lines = [(b"WARC-Type", kind), (b"WARC-Record-ID", _urn(number, segment)), (b"WARC-Date", DATE), (b"WARC-Target-URI", target), (b"WARC-Payload-Digest", b"sha256:" + digest), (b"X-Page-Number", b"%d" % number)]
    if page is not None:
        lines.append((b"X-Page-ID", b"%d" % page))
    lines += more + [(b"Content-Type", b"text/html"), (b"Content-Length", b"%d" % length)]
    return b"".join(k + b": " + v + b"\r\n" for k, v in lines)


def _rows(chunk_bytes: int):
    """One row for each segment: WARC text from after the version line to before the last newline."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            columns = [b.column(c).to_pylist() for c in ("number", "page_id", "url", "digest", "refers_to")]
            for number, page, url, digest, refers, html in zip(*columns, utf8_rows(b.column("html"))):
                payload, digest = html or b"", digest.encode()
                if refers is not None:
                    more = [(b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), (b"X-Refers-To-Page-ID", b"%d" % refers), (b"X-Payload-Length", b"%d" % len(payload))]
                    rows.append(VERSION + _headers(b"revisit", number, 1, page, url, digest, 0, more) + b"\r\n\r\n\r")
                    continue
                cuts = segments(payload, chunk_bytes)
                for k, (start, end) in enumerate(cuts, 1):
                    more = [(b"WARC-Segment-Number", b"%d" % k)] if len(cuts) > 1 else []
                    if k > 1:
                        more.append((b"WARC-Segment-Origin-ID", _urn(number, 1)))
                    if 1 < k == len(cuts):
                        more.append((b"WARC-Segment-Total-Length", b"%d" % len(payload)))
                    rows.append(VERSION + _headers(b"response" if k == 1 else b"continuation", number, k, page, url, digest, end - start, more) + b"\r\n" + payload[start:end] + b"\r\n\r")
                    size += end - start
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return run


SEGMENT = "number long, segment int, page_id long, kind string, refers_to long, said string, length long, total long, bytes binary"


def _parsed(batches):
    """Each row of archive text as a segment."""
    for b in batches:
        out = []
        for raw in b.column("value").to_pylist():
            if not raw.strip():
                continue
            head, _, block = raw.partition(b"\r\n\r\n")
            h = dict(line.split(b": ", 1) for line in head.split(b"\r\n"))
            n = int(h[b"Content-Length"])
            if len(block) < n or block[n:].strip(b"\r\n"):
                raise ValueError(f"record {h[b'WARC-Record-ID'].decode()} has {len(block)} bytes, its header says {n}")
            number = lambda k: int(h[k]) if k in h else None
            kind = h[b"WARC-Type"].decode()
            out.append((number(b"X-Page-Number"), number(b"WARC-Segment-Number") or 0, number(b"X-Page-ID"), kind, number(b"X-Refers-To-Page-ID"), h[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode(), number(b"X-Payload-Length") if kind == "revisit" else n, number(b"WARC-Segment-Total-Length"), block[:n]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], [x.split()[0] for x in SEGMENT.split(", ")])


def _joined(batches):
    """Segments sorted by record and segment number: one row for each record, its digest updated segment by segment."""
    open_: dict = {}
    out = []

    def close():
        if open_:
            if open_["total"] != open_["length"] or open_["said"] != open_["sha"].hexdigest():
                raise ValueError(f"record {open_['number']} is not whole")
            out.append((open_["page_id"], open_["length"], open_["said"], "response", None))
            open_.clear()

    for b in batches:
        for r in b.to_pylist():
            if open_ and open_["number"] != r["number"]:
                close()
            if not open_:
                open_.update(number=r["number"], page_id=r["page_id"], said=r["said"], length=0, total=None, last=0, sha=hashlib.sha256())
            if r["segment"] != open_["last"] + 1:
                raise ValueError(f"record {r['number']} lacks a segment")
            open_["sha"].update(r["bytes"])
            open_.update(length=open_["length"] + len(r["bytes"]), last=r["segment"], total=r["total"])
        if out:
            yield _records(out)
            out = []
    close()
    if out:
        yield _records(out)


def _records(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, chunk_bytes: int = 64 << 10) -> None:
    """Writes one record for each row to gzipped WARC files under path.

    Of rows with equal payloads of at least `least` bytes the smallest id is the response and the others revisit it; among
    rows that repeat that id, all are responses.  A null payload is empty; rows with a null id are responses of their own.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("number"), pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256))
    long_ = rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = long_.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").select("digest", "refers_to")
    again = long_.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    full = rows.join(again, ["page_id", "digest"], "left").select("number", "page_id", "url", "digest", "refers_to", "html")
    text = full.mapInArrow(_rows(chunk_bytes), "value binary").select(F.col("value").cast("string"))
    text.write.option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, every payload checked against its digest.

    Segments of one record are brought together and stream through an incremental digest; whole records need no shuffle.
    """
    found = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary")).mapInArrow(_parsed, SEGMENT)
    whole = found.filter("segment = 0")
    sha = F.sha2("bytes", 256)
    checked = F.when((F.col("kind") == "revisit") | (sha == F.col("said")), F.col("said")).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    short = whole.select("page_id", F.col("length").alias("payload_bytes"), checked.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    parts = found.filter("segment > 0").select("number", "segment", "page_id", "said", "total", "bytes").repartition("number").sortWithinPartitions("number", "segment")
    long_ = parts.mapInArrow(_joined, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return short.unionByName(long_)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, chunk_bytes: int = 64 << 10) -> DataFrame:
    """Writes the archives (to path, or a new folder in the shared one) and returns what reading them gives."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, html_col, chunk_bytes=chunk_bytes)
    return read_archives(pages.sparkSession, path).withColumnRenamed("page_id", id_col)
