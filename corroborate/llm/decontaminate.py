"""Benchmark decontamination by latent semantic retrieval.

Every word becomes one of 65,536 hashed terms; the terms of all documents are written once.  Passages of all documents form
a TF-IDF matrix A; terms in more than `common` of all passages weigh nothing, unless a benchmark item
has so few others that the checks below could do without them.  A's
right singular space comes from a randomised SVD: with a random matrix W, the passes Y = A W, G = Y'Y and Z = A'Y are sums
over passages, added up in Spark; with G = U S U', B = S^-1/2 U' Z' is A in the space that Y spans, and B's singular
vectors V (terms by `rank`) stand for those of A.  Windows slide over the weighing words of each document, as long
as the benchmark items of one length class need; a window whose cosine with an item is at least `cosine`, and that holds as
many of the item's weighing words as the checks below need at least, is a candidate.  It counts if the longest common subsequence of the item and the words around the window holds `near` of the item's words, or
`fair` of them while the words around hold `answer` of the item's answer, the words of its last sentence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8_rows, with_id, word_hashes, written

STEP = 4  # weighing words between windows
PASSAGE = 32  # words of a passage of the matrix
MARGIN = 16  # words around a window that are compared
TERMS = 1 << 16
GROUP = 200_000  # words worked on at once
SUMS = "part int, data binary"


def terms_of(text: bytes | None) -> np.ndarray:
    """The hashed term of each word, ASCII letters lower-cased."""
    return (word_hashes(text.lower())[2] >> np.uint64(48)).astype(np.uint16) if text else np.empty(0, np.uint16)


def _to_terms(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([terms_of(t).tobytes() for t in utf8_rows(b.column("text"))], pa.binary())], ["id", "terms"])


def _groups(batches):
    """Ids, all terms and each row's number of terms, for consecutive rows of about GROUP words."""
    for b in batches:
        for ids, data in blocks(b.column("id").to_pylist(), b.column("terms").to_pylist(), 2 * GROUP):
            counts = np.array([len(d) // 2 for d in data])
            if counts.any():
                yield ids, np.frombuffer(b"".join(data), np.uint16).astype(np.int64), counts


def _cells(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of consecutive runs of `width` words that don't cross rows, and the row of each."""
    n = -(-counts // width)
    row = np.repeat(np.arange(len(counts)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(counts) - counts)[row] + inside * width, row


def _passages(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages, and the passage of each word."""
    starts, _ = _cells(counts, PASSAGE)
    return starts, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))


def _frequencies(batches):
    """Passages that hold each term, and all passages, over a task's rows."""
    df, passages = np.zeros(TERMS, np.int64), 0
    for _, terms, counts in _groups(batches):
        starts, cell = _passages(terms, counts)
        passages += len(starts)
        for at in range(0, len(starts), TERMS):  # a cell and a term fit in 32 bits
            here = slice(starts[at], starts[at + TERMS] if at + TERMS < len(starts) else None)
            keys = np.sort(((cell[here] - at) << 16 | terms[here]).astype(np.uint32))
            df += np.bincount(keys[np.flatnonzero(np.diff(keys, prepend=keys[:1] + 1))] & 0xFFFF, minlength=TERMS)
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([df.tobytes(), np.array([passages]).tobytes()])], ["part", "data"])


def _summed(kind):
    """Adds up the arrays of each part; a task holds one array for each of its parts."""

    def run(batches):
        total: dict = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist()):
                x = np.frombuffer(data, kind).astype(np.float64 if kind == np.float32 else kind)
                total[part] = total[part] + x if part in total else x
        for part, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.astype(kind).tobytes()])], ["part", "data"])

    return run


def _total(df: DataFrame, kind, fan: int = 64) -> list:
    """The parts' sums over all tasks, added up in two levels, so that no task reads more than its share of the tasks' arrays."""
    dealt = df.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(fan)))
    some = dealt.repartition("part", "slot").select("part", "data").mapInArrow(_summed(kind), SUMS)
    return some.repartition("part").mapInArrow(_summed(kind), SUMS).collect()  # one array for each part


def _range(width: int, idf, parts: int):
    """G and Z over a task's rows; Z in parts of consecutive terms."""

    def run(batches):
        weight = idf.value
        random = np.random.default_rng(11).standard_normal((TERMS, width), np.float32) * weight[:, None]
        g, z = np.zeros((width, width)), np.zeros((TERMS, width), np.float32)
        for _, terms, counts in _groups(batches):
            starts, cell = _passages(terms, counts)
            kept = np.flatnonzero(weight[terms] > 0)
            if not len(kept):
                continue
            terms, cell = terms[kept], cell[kept]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            y = np.add.reduceat(random[terms], first, axis=0)
            g += y.T @ y
            place = np.cumsum(np.diff(cell, prepend=cell[:1]) > 0)
            order = np.argsort(terms.astype(np.uint16), kind="stable")
            terms = terms[order]
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            z[terms[first]] += np.add.reduceat(y[place[order]], first, axis=0) * weight[terms[first], None]
        out = [(0, g.astype(np.float32).tobytes())] + [(i + 1, x.tobytes()) for i, x in enumerate(np.split(z, parts))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out])], ["part", "data"])

    return run


def spare(n: int, fair: float) -> int:
    """How many of an item's n words a text may lack that still holds `fair` of them."""
    return int((1 - fair) * n + 1e-9)


def _needed(shared, fair: float, least: int):
    """Terms of the items that have too few words besides the common ones."""

    def run(batches):
        often, need = shared.value, np.zeros(TERMS, np.int64)
        for b in batches:
            for t in map(terms_of, utf8_rows(b.column("text"))):
                if (~often[t]).sum() <= max(least - 1, spare(len(t), fair)):
                    need[t] = 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([need.tobytes()])], ["part", "data"])

    return run


def weights(terms: DataFrame, items: DataFrame, common: float, fair: float, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Inverse frequency of each term among all passages, 0 for terms in more than `common` of them that no item needs; and
    which terms are in more than `common`."""
    sums = _total(terms.mapInArrow(_frequencies, SUMS), np.int64)
    got = {r.part: np.frombuffer(r.data, np.int64) for r in sums}
    df, n = got.get(0, np.zeros(TERMS, np.int64)), int(got[1][0]) if 1 in got else 0
    idf = np.log((2 + n) / (1 + df)).astype(np.float32)
    often = df > common * n
    many = often.copy()
    shared = terms.sparkSession.sparkContext.broadcast(often.copy())
    need = _total(items.select("text").mapInArrow(_needed(shared, fair, least), SUMS), np.int64)
    for r in need:
        often[np.frombuffer(r.data, np.int64) > 0] = False
    idf[often] = 0
    return idf, many


def latent_space(terms: DataFrame, idf: np.ndarray, rank: int = 32, over: int = 8) -> np.ndarray:
    """V (terms, rank) from the passages of all rows of terms(id, terms)."""
    width, parts = rank + over, 16
    shared = terms.sparkSession.sparkContext.broadcast(idf)
    sums = _total(terms.mapInArrow(_range(width, shared, parts), SUMS), np.float32)
    got = {r.part: np.frombuffer(r.data, np.float32).astype(float) for r in sums}
    g = got[0].reshape(width, width) if got else np.zeros((width, width))
    z = np.concatenate([got[i + 1] for i in range(parts)]).reshape(-1, width) if got else np.zeros((TERMS, width))
    scale, u = np.linalg.eigh((g + g.T) / 2)
    sound = scale > 1e-6 * max(scale.max(), 1e-12)
    if not sound.any():
        return np.zeros((TERMS, rank), np.float32)
    b = (u[:, sound] / np.sqrt(scale[sound])).T @ z.T
    power, u = np.linalg.eigh(b @ b.T)
    keep = np.argsort(power)[::-1][:rank]
    return ((b.T @ u[:, keep]) / np.sqrt(np.maximum(power[keep], 1e-12))).astype(np.float32)


def answer_of(text: str) -> str:
    """The last sentence; the last five words if that has fewer than three."""
    last = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s.strip()]
    return last[-1] if last and len(last[-1].split()) >= 3 else " ".join(text.split()[-5:])


def subsequence(masks: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence with the sequence of n terms whose places are the masks' bits."""
    full = row = (1 << n) - 1
    for w in region:
        if m := masks.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


class Items:
    """Benchmark items in the latent space, with the number of steps that a window needs to hold each; known by their place in rows."""

    def __init__(self, rows: list[tuple[int | None, str]], idf: np.ndarray, v: np.ndarray, fair: float, many: np.ndarray | None = None):
        self.v = v * idf[:, None]
        self.weighs = idf > 0
        self.size: dict[int, int] = {}
        self.masks: dict[int, dict[int, int]] = {}
        self.answer: dict[int, Counter] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.ids = [i for i, _ in rows]
        for i, (_, t) in enumerate(rows):
            terms = terms_of(t.encode())
            if len(terms):
                self.size[i], self.answer[i] = len(terms), Counter(terms_of(answer_of(t).encode()).tolist())
                masks = self.masks[i] = {}
                for k, w in enumerate(terms.tolist()):
                    masks[w] = masks.get(w, 0) | 1 << k
                weighing = terms[self.weighs[terms]]
                # common terms that weigh are looked for by the items that need them, not by all that hold them
                rare = weighing if many is None else weighing[~many[weighing]]
                held = weighing if len(rare) <= max(3, spare(len(terms), fair)) else rare
                least = max(1, len(held) - spare(len(terms), fair))
                by.setdefault(-(-(max(1, len(weighing)) + STEP - 1) // STEP), []).append((i, self.v[terms].sum(0), held, least))
        parts = [x for part in by.values() for x in part]
        self.names = [x[0] for x in parts]
        self.steps = np.repeat(np.array([*by], np.int64), [len(part) for part in by.values()])
        self.vectors = _unit(np.array([x[1] for x in parts]).reshape(-1, v.shape[1]))
        self.least = np.array([x[3] for x in parts], np.int64)
        # the items that hold each term
        holds = np.unique(np.concatenate([np.empty(0, np.int64), *[x[2].astype(np.int64) << 32 | k for k, x in enumerate(parts)]]))
        self.pointer, self.owner = np.searchsorted(holds >> 32, np.arange(TERMS + 1)), holds & 0xFFFFFFFF

    def compare(self, item: int, region: list[int], fair: float) -> tuple[float, float]:
        """Share of the item in its longest common subsequence with the region (0 if below fair), share of its answer in the region."""
        masks, n, answer = self.masks[item], self.size[item], self.answer[item]
        shared = [w for w in region if w in masks]
        if len(shared) < fair * n:
            return 0.0, 0.0
        return subsequence(masks, n, shared) / n, (answer & Counter(shared)).total() / max(1, answer.total())


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def _scan(shared, cosine: float, near: float, fair: float, answer: float):
    def run(batches):
        items: Items = shared.value
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for ids, every, counts in _groups(batches):
            if len(best) > 20_000:
                yield _pairs(best, items.ids)
                best = {}
            kept = np.flatnonzero(items.weighs[every])
            terms = every[kept]
            row_ends = np.cumsum(counts)
            edge = np.searchsorted(kept, row_ends)
            starts, row = _cells(np.diff(edge, prepend=0), STEP)
            if not len(starts) or not items.names:
                continue
            n_cells = np.bincount(row, minlength=len(ids))
            last = np.cumsum(n_cells)[row]
            first = last - n_cells[row]
            sums = np.concatenate([np.zeros((1, items.v.shape[1])), np.cumsum(np.add.reduceat(items.v[terms], starts, axis=0), axis=0, dtype=np.float64)])
            # windows with enough of an item's words: those around `least` of its words in a row that fit in one
            n = items.pointer[terms + 1] - items.pointer[terms]
            word = np.repeat(np.arange(len(terms)), n)
            item = items.owner[np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + items.pointer[terms][word]]
            order = np.argsort(item, kind="stable")
            item, cell = item[order], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))[word[order]]
            to = np.arange(len(item)) + (items.least[item] - 1 if len(item) else 0)
            fits = np.flatnonzero(to < len(item))
            fits = fits[(item[to[fits]] == item[fits]) & (row[cell[to[fits]]] == row[cell[fits]])]
            item, low, high = item[fits], cell[fits], cell[to[fits]]
            steps = items.steps[item]
            low, high = np.maximum(high - steps + 1, first[low]), low
            n = np.maximum(high - low + 1, 0)
            at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = np.repeat(item, n)
            # a window is whole, or its row's only one
            at = np.minimum(at, np.maximum(first[at], last[at] - items.steps[item]))
            pair = np.unique(at * len(items.names) + item)
            at, item = np.divmod(pair, len(items.names))
            ends = np.minimum(at + items.steps[item], last[at])
            like = (_unit(sums[ends] - sums[at]) * items.vectors[item]).sum(1)
            near_to = np.flatnonzero(like >= cosine)
            for c, e, k, cos in zip(at[near_to].tolist(), ends[near_to].tolist(), item[near_to].tolist(), like[near_to].tolist()):
                r = int(row[c])
                end = kept[(starts[e] if e < len(starts) else len(terms)) - 1]
                low, high = (row_ends[r - 1] if r else 0), row_ends[r]
                lcs, said = items.compare(items.names[k], every[max(low, kept[starts[c]] - MARGIN) : min(high, end + 1 + MARGIN)].tolist(), fair)
                if lcs >= near or (lcs >= fair and said >= answer):
                    key = (ids[r], items.names[k])
                    best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (lcs, said, cos))
        if best:
            yield _pairs(best, items.ids)

    return run


def _pairs(best: dict, item_ids: list) -> pa.RecordBatch:
    columns = [[k[0] for k in best], [item_ids[k[1]] for k in best], *zip(*best.values())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["id", "item_id", "lcs_share", "answer_share", "cosine"])


PAIR = "id long, item_id long, lcs_share double, answer_share double, cosine double"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = 0.15, near: float = 0.8, fair: float = 0.6, answer: float = 0.8, common: float = 0.005, block_bytes: int = 32 << 20) -> DataFrame:
    """(id, item_id, lcs_share, answer_share, cosine), one row for each document and benchmark item that it holds.

    Null or blank documents and items hold and match nothing; a null document id counts as the largest; rows that repeat an
    id return one row an item.  Items that share an id, or have none, are all searched for, and share a row of the result.  Benchmark items go to the tasks in blocks of at most about `block_bytes` of text, one pass
    over the documents' terms for each; the latent space is fitted once, on all documents.
    """
    spark = docs.sparkSession
    terms = written(with_id(docs, id_col, text=text_col).mapInArrow(_to_terms, "id long, terms binary"), "terms")
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text].alias("text")).filter("trim(text) <> ''").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = lambda i: [(r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()]  # noqa: E731  about block_bytes
    idf, many = weights(terms, items, common, fair)
    v = latent_space(terms, idf)
    out = None
    for i in range(n):
        shared = spark.sparkContext.broadcast(Items(part(i), idf, v, fair, many))
        found = terms.mapInArrow(_scan(shared, cosine, near, fair, answer), PAIR)
        if n > 1:  # one block of items at a time on the driver
            found = written(found, "found")
            shared.unpersist()
        out = found if out is None else out.union(found)
    best = out.groupBy("id", "item_id").agg(F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m"))
    return best.select(F.when(F.col("id") != 2**63 - 1, F.col("id")).alias(id_col), F.col("item_id").alias(item_col), "m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item."""
    bad = written(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_bad")).distinct(), "leaks")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
