"""Repeated lines through two Bloom filters.

A line's hash goes to a segment of two Bloom filters: `once` for hashes seen, `twice` for hashes seen again.  A task streams
the hashes of its segments and holds nothing but their filters.  The `twice` filters, of a fixed size together, are
broadcast; only lines that they suspect are shuffled, by a 128-bit digest, for the exact count of documents.  If the corpus
outgrows the filters they suspect more lines, which costs shuffle but changes no result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, id_back, utf8_rows, written

BLANK = b" \t\n\r\x0b\x0c"
SEGMENTS = 256
PROBES = 3


def key_of(line: bytes, least: int) -> bytes | None:
    """The line stripped and A-Z lower-cased; None if it has fewer than `least` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def _digests(text: bytes | None, least: int) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for k in (key_of(x, least) for x in (text or b"").split(b"\n")) if k is not None}


def _hashes(least: int):
    """For each batch and segment: the distinct hashes, and those that lie in two of the batch's rows."""

    def run(batches):
        for b in batches:
            seen: set[bytes] = set()
            again: set[bytes] = set()
            for t in utf8_rows(b.column("text")):
                own = _digests(t, least)
                again |= own & seen
                seen |= own
            if not seen:
                continue
            split = []
            for part in (seen, again):
                h = np.sort(np.frombuffer(b"".join(part), ">u8")[::2].astype(np.uint64))
                edge = np.searchsorted(h, np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(56))
                split.append([x.tobytes() for x in np.split(h, edge[1:])])
            used = [i for i in range(SEGMENTS) if split[0][i]]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([split[0][i] for i in used], pa.binary()), pa.array([split[1][i] for i in used], pa.binary())], ["segment", "seen", "again"])

    return run


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    step = (h >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)]).astype(np.int64)


def _holds(filter_: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filter_[at >> 3] >> (at & 7)) & 1).all(0)


def _add(filter_: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())


def _two_filters(bits: int):
    def run(batches):
        filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for segment, seen, again in zip(*(b.column(c).to_pylist() for c in ("segment", "seen", "again"))):
                once, twice = filters.setdefault(segment, (np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)))
                at = _places(np.frombuffer(seen, np.uint64), bits)
                old = _holds(once, at).astype(bool)
                _add(twice, at[:, old])
                _add(once, at[:, ~old])
                _add(twice, _places(np.frombuffer(again, np.uint64), bits))
        for segment, (_, twice) in filters.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    return run


def _suspects(least: int, bits: int, shared):
    def run(batches):
        for b in batches:
            ids, digests = [], []
            for i, t in zip(b.column("id").to_pylist(), utf8_rows(b.column("text"))):
                own = sorted(_digests(t, least))
                ids += [i] * len(own)
                digests += own
            if not ids:
                continue
            h = np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64)
            segment, held = (h >> np.uint64(56)).astype(np.int64), np.zeros(len(h), bool)
            for s in np.unique(segment).tolist():
                if s in shared.value:
                    mine = segment == s
                    held[mine] = _holds(np.frombuffer(shared.value[s], np.uint8), _places(h[mine], bits))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(pa.array(held)), pa.array(digests, pa.binary()).filter(pa.array(held))], ["id", "digest"])

    return run


def _finish(least: int, digest: bool):
    def run(batches):
        for b in batches:
            out = []
            for i, t, gone in zip(b.column("id").to_pylist(), utf8_rows(b.column("text")), b.column("gone").to_pylist()):
                lines = (t or b"").split(b"\n")
                kept = lines
                if gone:
                    drop = set(gone)
                    kept = [x for x in lines if (k := key_of(x, least)) is None or xxhash.xxh3_128_digest(k) not in drop]
                left = b"\n".join(kept)
                out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(left).hexdigest() if digest else None if t is None else left.decode("utf-8")))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))] + [b.column("rest")], ["id", "n_lines", "n_dropped", "kept", "rest"])

    return run


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5, digest: bool = False, carry: tuple[str, ...] = (), filter_bytes: int = 16 << 20) -> DataFrame:
    """Per row: id, n_lines (before), n_dropped, kept (the text left, or its SHA-256 if digest), and rest, a struct of the columns in carry.

    Lines whose key (stripped, A-Z lower-cased, at least `least` code points) is found in at least `documents` documents go
    from all but the largest id that holds the key.  Null or empty text is one empty line (kept is null for null unless
    digest); rows that repeat an id count as one document; a null id is larger than all others.  Other columns are ignored.
    `filter_bytes` bounds the broadcast filter.
    """
    spark = docs.sparkSession
    others = F.struct(*[docs[c] for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), docs[text_col].alias("text"), others.alias("rest"))
    bits = filter_bytes * 8 // SEGMENTS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    twice = rows.select("text").mapInArrow(_hashes(least), "segment int, seen binary, again binary").repartition(min(parts, SEGMENTS), "segment").mapInArrow(_two_filters(bits), "segment int, twice binary")
    shared = spark.sparkContext.broadcast({r.segment: bytes(r.twice) for r in twice.toLocalIterator()})  # at most filter_bytes
    suspects = written(rows.select("id", "text").mapInArrow(_suspects(least, bits, shared), "id long, digest binary"), "suspects")
    counted = suspects.distinct().groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter(F.col("n") >= documents)
    counted = written(counted.select("digest", "last"), "counted")  # so that the join below shuffles both sides anew and can be split where a line is very common
    gone = suspects.join(counted, "digest").filter("id < last").groupBy("id").agg(F.collect_set("digest").alias("gone"))
    found = rows.join(gone, "id", "left").select("id", "text", "gone", "rest")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType()), rows.schema["rest"]])
    return found.mapInArrow(_finish(least, digest), schema).select(id_back(id_col), "n_lines", "n_dropped", "kept", "rest")
