"""Repeated byte strings through sharded suffix arrays.

Windows of `width` bytes that are equal must meet in one shard.  So each window is known by the least hash among its
`GRAM`-byte strings, its anchor: equal windows have equal anchors at equal places.  Strings that a bounded draw of texts
holds often come last in that order, so a passage that very many rows share gives its anchor only to windows that hold
nothing rarer, and no shard grows with the number of its copies.  Consecutive windows of one anchor form a segment of bytes.

Equal segments of an anchor are put together before any sorting: all of them repeat.  Where an anchor has segments that
differ, one of each goes to the anchor's shard, and the shard's suffixes, sorted by external induction (see suffix_sort)
with their common prefixes, say which windows repeat.  All other segments are unique.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _N, _SYMBOL, _powers, blocks, id_back, mixed, utf8_rows, with_id, written
from .suffix_sort import Shard

GRAM = 64
#: An anchor is common if it has over one in so many of all segments; so there are fewer such anchors than this.
COMMON_SHARE = 1 << 16
#: Bits of a string's hash that say whether it comes last as an anchor.
LAST_BITS = 24


def _prefix(data: np.ndarray) -> np.ndarray:
    power, _ = _powers("word")
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * power[: len(data)], out=out[1:])
    return out


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each string of GRAM bytes, and the running sums."""
    sums, (_, inverse) = _prefix(raw), _powers("word")
    return mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(raw) - GRAM + 1]), sums


def _least_place(hashes: np.ndarray, width: int, last: np.ndarray) -> np.ndarray:
    """Place of the least of every `width` consecutive hashes, the first if several are; those that `last` marks come last."""
    late = last[(hashes >> np.uint64(64 - LAST_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    key = late | (hashes << np.uint64(1) >> np.uint64(25) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    rest = width - have
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    return (key & np.uint64((1 << 24) - 1)).astype(np.int64)


def segments(data: bytes, ends: np.ndarray, width: int, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of at most _N bytes of texts that end at `ends`: anchor hash, content hash, first window's place, number of windows."""
    raw = np.frombuffer(data, np.uint8)
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(raw) < width:
        return none
    gram, sums = _grams(raw)
    _, inverse = _powers("word")
    anchor = _least_place(gram, width - GRAM + 1, last)
    place = np.arange(len(anchor))
    place = place[place + width <= ends[np.searchsorted(ends, place, "right")]]
    if not len(place):
        return none
    new = np.concatenate([[True], (np.diff(anchor[place]) != 0) | (np.diff(place) != 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    start = place[first]
    to = start + count + width - 1
    content = mixed((sums[to] - sums[start]) * inverse[start] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return gram[anchor[start]], content, start, count


def _pieces(text: bytes, width: int):
    """A long text in overlapping pieces of which each window is in one; with each piece's place."""
    step = _N - width
    for at in range(0, max(1, len(text) - width + 1), step):
        yield at, text[at : at + step + width - 1]


def _common_grams(batches):
    """How often each hash prefix occurs among the strings of a batch's texts."""
    for b in batches:
        for _, texts in blocks([None] * b.num_rows, utf8_rows(b.column("text")), _N):
            for text in [b"".join(t or b"" for t in texts)] if len(texts) > 1 else [p for _, p in _pieces(texts[0] or b"", GRAM)]:
                raw = np.frombuffer(text, np.uint8)
                if len(raw) >= GRAM:
                    prefix, n = np.unique((_grams(raw)[0] >> np.uint64(64 - LAST_BITS)).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(n)], ["prefix", "n"])


def _last(rows: DataFrame, sample_bytes: int, often: int = 8, most: int = 1 << 20) -> np.ndarray:
    """Marks the hash prefixes of strings found `often` times in a draw of about `sample_bytes` of text, the `most` commonest.

    Any marks give the same result; these keep anchors rare.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, max(sample_bytes, total // 1500) / max(total, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    counts = drawn.select("text").mapInArrow(_common_grams, "prefix int, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= often).orderBy(F.desc("n"), "prefix").limit(most).select("prefix").toArrow()
    last = np.zeros(1 << LAST_BITS, bool)
    last[found.column("prefix").to_numpy()] = True
    return last


def _segment_rows(width: int, shared):
    def run(batches):
        last = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for keys, texts in blocks(b.column("key").to_pylist(), utf8_rows(b.column("text")), _N):
                if len(texts) == 1 and texts[0] and len(texts[0]) > _N:
                    work = [([keys[0]], [piece], [at]) for at, piece in _pieces(texts[0], width)]
                else:
                    work = [(keys, [t or b"" for t in texts], [0] * len(texts))]
                for names, parts, offset in work:
                    ends = np.cumsum([len(p) for p in parts])
                    anchor, content, start, count = segments(b"".join(parts), ends, width, last)
                    if len(anchor):
                        row = np.searchsorted(ends, start, "right")
                        begin = start - np.concatenate([[0], ends])[row] + np.array(offset)[row]
                        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(np.array(names, np.int64)[row]), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "content", "key", "start", "n"])

    return run


def _cut(width: int):
    """The bytes of the segments to compare."""

    def run(batches):
        for b in batches:
            for key, text, parts in zip(b.column("key").to_pylist(), utf8_rows(b.column("text")), b.column("parts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array([p["anchor"] for p in parts], pa.int64()), pa.array([key] * len(parts), pa.int64()), pa.array([p["start"] for p in parts], pa.int32()), pa.array([p["alone"] for p in parts], pa.bool_()), pa.array([text[p["start"] : p["start"] + p["n"] + width - 1] for p in parts], pa.binary())], ["anchor", "key", "start", "alone", "bytes"])

    return run


def _shard(width: int, memory_bytes: int):
    """The task's rows are one shard: they go to disk as they come, and the repeated windows of segments that stand alone come back."""

    def run(batches):
        shard, keys, places, ends, alone = Shard(width, memory_bytes), [], [], [], []
        try:
            for b in batches:
                texts = b.column("bytes").to_pylist()
                keys.append(b.column("key").to_numpy())
                # where the row's text begins in the shard, less where it begins in its document
                begin = shard.n + np.cumsum([0] + [len(t) + 1 for t in texts])
                places.append(begin[:-1] - b.column("start").to_numpy())
                ends.append(begin[1:])
                alone.append(b.column("alone").to_numpy(zero_copy_only=False))
                shard.add(texts)
            if shard.n:
                keys, places, ends, alone = map(np.concatenate, (keys, places, ends, alone))
                starts, stops = shard.repeated()
                for at in range(0, len(starts), 1 << 16):
                    low, high = np.asarray(starts[at : at + (1 << 16)]), np.asarray(stops[at : at + (1 << 16)])
                    row = np.searchsorted(ends, low, "right")
                    low, high, row = low[alone[row]], high[alone[row]], row[alone[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array((low - places[row]).astype(np.int32)), pa.array((high + width - 1 - places[row]).astype(np.int32))], ["key", "start", "end"])
        finally:
            shard.close()

    return run


def _finish(digest: bool):
    def run(batches):
        for b in batches:
            out = []
            for i, text, gone in zip(b.column("id").to_pylist(), utf8_rows(b.column("text")), b.column("gone").to_pylist()):
                text, spans = text or b"", []
                for start, end in sorted((g["start"], g["end"]) for g in gone or ()):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept, at = [], 0
                for start, end in spans:
                    kept.append(text[at:start])
                    at = end
                kept = b"".join([*kept, text[at:]])
                out.append((i, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digest else None, None if digest else kept, [s for s, _ in spans], [e for _, e in spans]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends"])

    return run


def _judge_rare(found: DataFrame) -> DataFrame:
    """Whether each segment stands alone, and whether it speaks for its equals among several of an anchor: one shuffle."""
    order, whole = Window.partitionBy("anchor").orderBy("content"), Window.partitionBy("anchor")
    seen = found.withColumns({"prev": F.lag("content").over(order), "next": F.lead("content").over(order), "low": F.min("content").over(whole), "high": F.max("content").over(whole)})
    first = F.col("prev").isNull() | (F.col("prev") != F.col("content"))
    alone = first & (F.col("next").isNull() | (F.col("next") != F.col("content")))
    return seen.select("anchor", "key", "start", "n", alone.alias("alone"), (first & (F.col("low") < F.col("high"))).alias("compare")).filter("compare OR NOT alone")


def _judge_common(found: DataFrame) -> DataFrame:
    """The same for anchors of very many segments, by counts that are combined before the shuffle; joins on the content can be split."""
    classes = written(found.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start")).alias("one")), "classes")
    several = classes.groupBy("anchor").agg((F.min("content") < F.max("content")).alias("several"))
    known = written(classes.join(F.broadcast(several), "anchor").filter("several OR copies > 1"), "known")
    return found.join(known, ["anchor", "content"]).select("anchor", "key", "start", "n", (F.col("copies") == 1).alias("alone"), (F.col("several") & (F.struct("key", "start") == F.col("one"))).alias("compare")).filter("compare OR NOT alone")


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<int>, ends array<int>"


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, digest: bool = False, shard_bytes: int = 4 << 20, memory_bytes: int = 128 << 20, common_least: int = 16, sample_bytes: int = 4 << 20) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (the bytes left) or their kept_sha256 if digest, starts and ends of the removed runs.

    A byte goes if a string of `width` bytes that covers it also starts anywhere else, in this row or another; strings don't
    cross rows.  Null is empty; texts shorter than `width` lose nothing; of repeated rows, ids equal or not, every copy goes.
    Other columns are ignored.  A task sorts a shard of about `shard_bytes`, an anchor's segments in one, and holds about
    `memory_bytes` of it.  Anchors of over `common_least` segments, and of over one in COMMON_SHARE of all, are counted
    before they are shuffled.  Strings are drawn from `sample_bytes` of text (a 1,500th of all, if that is more) to see which are common.
    """
    rows = with_id(docs, id_col, text=text_col).withColumn("key", F.xxhash64("id", "text"))
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(_last(rows, sample_bytes)))  # 2 MB
    found = written(rows.select("key", "text").mapInArrow(_segment_rows(width, shared), "anchor long, content long, key long, start int, n int"), "segments")
    floor = max(common_least, found.count() // COMMON_SHARE)
    common = found.groupBy("anchor").count().filter(F.col("count") > floor).select("anchor")  # fewer than COMMON_SHARE rows
    judged = written(_judge_rare(found.join(F.broadcast(common), "anchor", "left_anti")).union(_judge_common(found.join(F.broadcast(common), "anchor", "left_semi"))), "judged")
    repeated = judged.filter("NOT alone").select("key", "start", (F.col("start") + F.col("n") + width - 1).alias("end"))
    compare = judged.filter("compare")
    parts = compare.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n", "alone")).alias("parts"))
    bytes_ = rows.select("key", F.col("text").cast("binary").alias("text")).join(parts, "key").mapInArrow(_cut(width), "anchor long, key long, start int, alone boolean, bytes binary")
    total = compare.agg(F.sum(F.col("n") + width)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    sorted_ = bytes_.repartition(shards, "anchor").mapInArrow(_shard(width, memory_bytes), "key long, start int, end int")
    gone = repeated.union(sorted_).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    out = rows.join(gone, "key", "left").select("id", "text", "gone").mapInArrow(_finish(digest), RESULT)
    return out.select(id_back(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends")
