"""Repeated word windows (Rabin-Karp), removed as maximal intervals.

Every window of `width` words gets its Rabin-Karp hash.  Texts are packed into chunks of a few megabytes.  A chunk sends
each distinct hash once, with its smallest document, to the hash's bucket; the bucket counts them and answers one bit per
hash: does a smaller document hold it?  So what is shuffled doesn't depend on how often a window occurs: a passage in a
third of all documents costs one entry a chunk.  The chunk then merges its marked windows into maximal intervals.

Two windows count as equal if their 64-bit hashes and buckets agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, covered, id_back, utf8_rows, window_hashes, with_id, word_hashes, written

CHUNK = "chunk long, n_windows long, ids binary, lengths binary, texts binary"


def _pack(width: int, chunk_bytes: int):
    def run(batches):
        for b in batches:
            first = b.column("chunk").to_pylist()
            ids, texts = b.column("id").to_pylist(), utf8_rows(b.column("text"))
            at = 0
            for i, t in blocks(ids, texts, chunk_bytes):
                n = sum(max(0, len((x or b"").split()) - width + 1) for x in t)
                row = (first[at], n, np.array(i, np.int64).tobytes(), np.array([-1 if x is None else len(x) for x in t], np.int64).tobytes(), pa.compress(b"".join(x or b"" for x in t), "zstd", asbytes=True))
                at += len(i)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["chunk", "n_windows", "ids", "lengths", "texts"])

    return run


def _unpack(ids: bytes, lengths: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes | None]]:
    sizes = np.frombuffer(lengths, np.int64)
    data = pa.decompress(texts, int(np.maximum(sizes, 0).sum()), "zstd", asbytes=True)
    ends = np.cumsum(np.maximum(sizes, 0)).tolist()
    return np.frombuffer(ids, np.int64), [data[e - n : e] if n >= 0 else None for e, n in zip(ends, sizes.tolist())]


def _windows(ids: np.ndarray, texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All window hashes of a chunk, the row each lies in, and how many each row has."""
    every = [window_hashes(word_hashes(t or b"")[2], width) for t in texts]
    counts = np.array([len(h) for h in every], np.int64)
    return (np.concatenate(every) if every else np.empty(0, np.uint64)), np.repeat(np.arange(len(ids)), counts), counts


def _distinct(hashes: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, each one's smallest document as a rank, the place of each window's hash, the ranks' documents."""
    names, rank = np.unique(ids, return_inverse=True)
    keys, place = np.unique(hashes, return_inverse=True)
    least = np.full(len(keys), len(names), np.int64)
    np.minimum.at(least, place, rank[rows])
    return keys, least, place, names


def _bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys start: buckets are equal ranges of the hash."""
    starts = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _narrow(gaps: np.ndarray) -> bytes:
    """Gaps of sorted hashes in as few bytes each as the largest needs."""
    size = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([size]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _wide(data: bytes) -> np.ndarray:
    size = data[0]
    out = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    return out.view("<u8").ravel()


def _ask(width: int, buckets: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, texts = _unpack(row["ids"], row["lengths"], row["texts"])
                keys, least, _, names = _distinct(*_windows(ids, texts, width)[:2], ids)
                edge = _bucket_edges(keys, buckets)
                out = []
                for i in np.flatnonzero(np.diff(edge)):
                    part = slice(edge[i], edge[i + 1])
                    used, local = np.unique(least[part], return_inverse=True)
                    out.append((int(i), row["chunk"], _narrow(np.diff(keys[part], prepend=keys[part][:1])), int(keys[part][0]).to_bytes(8, "little"), local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes(), names[used].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "chunk", "gaps", "first", "local", "names"])

    return run


def _answer(part: pa.Table) -> pa.Table:
    """One bucket: for each hash of each chunk, whether a smaller document than the chunk's smallest holds it."""
    keys, least, sizes = [], [], []
    for row in part.to_pylist():
        k = np.cumsum(_wide(row["gaps"])) + np.frombuffer(row["first"], np.uint64)
        names = np.frombuffer(row["names"], np.int64)
        keys.append(k)
        sizes.append(len(k))
        least.append(names[np.frombuffer(row["local"], np.uint16 if len(row["local"]) == 2 * len(k) else np.uint32)])
    keys, least = np.concatenate(keys), np.concatenate(least)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(k))))
    marked = np.zeros(len(keys), bool)
    marked[order] = smallest < least[order]
    ends = np.cumsum(sizes)
    return pa.table({"chunk": part.column("chunk"), "bucket": part.column("bucket"), "bits": pa.array([np.packbits(marked[e - n : e]).tobytes() for e, n in zip(ends, sizes)], pa.binary())})


RESULT = "id long, n_words long, n_removed long, kept string, starts array<int>, ends array<int>"


def _finish(width: int, buckets: int, digest: bool):
    def run(_, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()))
        for row in chunk.to_pylist():
            ids, texts = _unpack(row["ids"], row["lengths"], row["texts"])
            hashes, rows, counts = _windows(ids, texts, width)
            keys, least, place, names = _distinct(hashes, rows, ids)
            edge = _bucket_edges(keys, buckets)
            held = np.zeros(len(keys), bool)
            for i in np.flatnonzero(np.diff(edge)):
                n = edge[i + 1] - edge[i]
                held[edge[i] : edge[i + 1]] = np.unpackbits(np.frombuffer(bits[int(i)], np.uint8), count=n).astype(bool)
            rank = np.searchsorted(names, ids)
            marked = held[place] | (rank[rows] > least[place])
            at = 0
            for i, t, n in zip(ids.tolist(), texts, counts.tolist()):
                words = (t or b"").split()
                gone = covered(marked[at : at + n], width, len(words))
                at += n
                edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
                kept, p = [], 0
                for a, b in zip(edges[::2], edges[1::2]):
                    kept += words[p:a]
                    p = b
                kept = b" ".join(kept + words[p:] if edges else words)
                out.append((i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode(), edges[::2], edges[1::2]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], ["id", "n_words", "n_removed", "kept", "starts", "ends"])

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, digest: bool = False, chunk_bytes: int = 4 << 20, bucket_windows: int = 2_000_000) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (the words left, or their SHA-256 if digest), starts and ends of the maximal removed word intervals.

    A word goes if a window of `width` words that covers it also starts in a row with a smaller id.  Null or empty texts
    have no words; texts shorter than a window lose none; rows that repeat an id count as the same document, so neither
    removes the other; a null id is larger than all others.  Other columns, whatever their names, are ignored.

    A chunk holds about `chunk_bytes` of text, a bucket about `bucket_windows` hashes; a task holds one of either.  Raise
    both together with the corpus (64 MB and 30 million at 100 TB), so that a chunk still sends many hashes to a bucket.
    """
    rows = with_id(docs, id_col, text=text_col)
    chunks = written(rows.withColumn("chunk", F.monotonically_increasing_id()).mapInArrow(_pack(width, chunk_bytes), CHUNK), "chunks")
    total = chunks.agg(F.sum("n_windows")).first()[0] or 0
    buckets = max(1, -(-total // bucket_windows))
    asked = chunks.mapInArrow(_ask(width, buckets), "bucket int, chunk long, gaps binary, first binary, local binary, names binary")
    replies = asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, bits binary")
    done = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_finish(width, buckets, digest), RESULT)
    return done.select(id_back(id_col), "n_words", "n_removed", "kept", "starts", "ends")
