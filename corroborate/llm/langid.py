"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to `order` bytes with the counts of the bytes that follow (method C: an
unseen byte costs an escape of d / (n + d), d distinct of n bytes seen, and falls to the next shorter context; below order
zero all 256 bytes are alike).  The counts are frozen after training.  A text's code length under a language is the sum
over its UTF-8 bytes, each after those before it; the shortest wins, and the score is that language's share of 2^-length.

The trees of all languages share hash tables of their contexts and of what followed them, so a block of text is looked up
order by order as arrays, the longest context first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, slices, utf8_rows

UNKNOWN = "und"
PIECE = 1 << 18  # bytes that are looked up at once
EMPTY = np.uint64(2**64 - 1)


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """For every byte the number of the order + 1 bytes that end in it, itself in the lowest place; zeros before the start."""
    code = np.zeros(len(data), np.uint64)
    for k in range(min(order + 1, len(data))):
        code[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return code


def _pieces(texts: list[bytes], order: int):
    """(codes, how much history each has, text of each) of about PIECE bytes at a time."""
    for start, part in blocks(list(range(len(texts))), texts, PIECE):
        if len(part) > 1:
            data = np.frombuffer(b"".join(part), np.uint8)
            sizes = np.array([len(t) for t in part])
            place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield _codes(data, order), np.minimum(place, order), np.repeat(np.array(start), sizes)
        else:
            data = np.frombuffer(part[0], np.uint8)
            for at in range(0, len(data), PIECE):
                low = max(0, at - order)
                code = _codes(data[low : at + PIECE], order)[at - low :]
                yield code, np.minimum(np.arange(at, at + len(code)), order), np.full(len(code), start[0])


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * (k + 1)) - 1)


def _count_grams(order: int):
    """(lang, k, gram, n) of the texts of a batch."""

    def run(batches):
        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), object), utf8_rows(b.column("text"))
            for lang in sorted(set(langs)):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                for code, history, _ in _pieces(mine, order):
                    for k in range(order + 1):
                        keys, n = np.unique(code[history >= k] & _mask(k), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "k", "gram", "n"])

    return run


class Table:
    """Places of distinct numbers by hash, for arrays of questions."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.places = np.full(1 << bits, EMPTY), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = left[self.slots[slot[left]] == EMPTY]
            self.slots[slot[free]] = keys[free]  # of several for one slot the last is in
            mine = free[self.slots[slot[free]] == keys[free]]
            self.places[slot[mine]] = mine
            left = np.setdiff1d(left, mine, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.last

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and which of x are there."""
        slot = self._hash(x)
        held = self.slots[slot]
        more = np.flatnonzero((held != x) & (held != EMPTY))
        while len(more):
            slot[more] = (slot[more] + 1) & self.last
            now = self.slots[slot[more]]
            more = more[(now != x[more]) & (now != EMPTY)]
        return self.places[slot], self.slots[slot] == x


class Trees:
    """Frozen statistics of all languages: for each order the known (context, byte) pairs with their cost in bits for each
    language, escapes already paid, and the known contexts with the cost of leaving them."""

    def __init__(self, langs: list[str], order: int, rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """rows: order -> (gram, language index, count)."""
        self.langs, self.order, self.keys, self.cost, self.contexts, self.leave = langs, order, [], [], [], []
        for k in range(order + 1):
            gram, lang, n = rows.get(k, (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0)))
            keys, place = np.unique(gram, return_inverse=True)
            counts = np.zeros((len(keys), len(langs)))
            counts[place, lang] = n
            contexts, owner = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, owner, counts)
            np.add.at(kinds, owner, counts > 0)
            seen = total > 0
            leave = np.where(seen, -np.log2(np.where(seen, kinds, 1) / np.where(seen, total + kinds, 1)), 0.0)
            lower = self.bits(keys & _mask(k - 1), np.full(len(keys), k - 1)) if k else np.full(counts.shape, 8.0)
            here = -np.log2(np.maximum(counts, 1) / np.maximum(total + kinds, 1)[owner])
            self.keys.append(Table(keys))
            self.cost.append(np.where(counts > 0, here, leave[owner] + lower))
            self.contexts.append(Table(contexts))
            self.leave.append(leave)

    def bits(self, code: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Cost of each coded byte under each language, from its longest context down."""
        out = np.zeros((len(code), len(self.langs)))
        open_ = np.arange(len(code))
        for k in range(min(self.order, int(history.max(initial=-1))), -1, -1):
            now = open_ if k == 0 else open_[history[open_] >= k]
            x = code[now] & _mask(k)
            at, known = self.keys[k].find(x)
            out[now[known]] += self.cost[k][at[known]]
            lost, x = now[~known], x[~known]
            at, known = self.contexts[k].find(x >> np.uint64(8))
            out[lost[known]] += self.leave[k][at[known]]
            open_ = np.concatenate([lost, open_[history[open_] < k]]) if k else lost
        out[open_] += 8.0
        return out

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for code, history, row in _pieces(texts, self.order):
            if len(code):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                out[row[first]] += np.add.reduceat(self.bits(code, history), first, axis=0)
        return out


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, order: int = 4, rows_per_language: int = 1000) -> Trees:
    """Counts over about `rows_per_language` rows of each language (all, if it has fewer), drawn by a hash of the id: the fit's
    documented bound.  Every (language, context, byte) of these rows is kept."""
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).filter("text is not null and lang is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Trees([], order, {})
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))])
    drawn = rows.filter(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    grams = drawn.select("lang", "text").mapInArrow(_count_grams(order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    langs = sorted(counts)
    index = {lang: i for i, lang in enumerate(langs)}
    number = F.create_map(*[F.lit(x) for pair in index.items() for x in pair])
    kept = grams.select("k", "gram", number[F.col("lang")].cast("long").alias("lang"), "n").toArrow()
    k, gram, lang, n = (kept.column(c).to_numpy() for c in ("k", "gram", "lang", "n"))
    return Trees(langs, order, {i: (gram[k == i].view(np.uint64), lang[k == i], n[k == i].astype(float)) for i in range(order + 1)})


def _score(shared, text_col: str, names: tuple[str, str]):
    def run(batches):
        trees: Trees = shared.value
        for b in slices(batches):
            texts = utf8_rows(b.column(text_col))
            lettered = [bool(t and trees.langs) and any(map(str.isalpha, t.decode())) for t in texts]
            total = trees.text_bits([t if ok else b"" for t, ok in zip(texts, lettered)])
            best = total.argmin(1) if trees.langs else np.zeros(len(texts), int)
            preds = [trees.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), lettered)]
            scores = np.zeros(len(texts))
            if trees.langs:
                gap = np.maximum(total.min(1)[:, None] - total, -1000)
                scores = np.where(lettered, 1 / np.exp2(gap).sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *names])

    return run


def held_out(id_column):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 4 == 2


def predict(docs: DataFrame, trees: Trees, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score added under `names` (replaced, if there).

    Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.drop(*names)
    # numbered columns on the way, since names may hold dots
    numbered = rows.toDF(*[f"_{i}" for i in range(len(rows.columns))])
    schema = T.StructType([*numbered.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return numbered.mapInArrow(_score(shared, f"_{rows.columns.index(text_col)}", names), schema).toDF(*rows.columns, *names)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score; learned from the rows that aren't held out.

    Texts are coded byte by byte as they are.  Ties between languages go to the first in alphabetical order.  Repeated
    rows each return a row; other columns, whatever their names, are ignored.
    """
    trees = train(docs.filter(~held_out(docs[id_col])), id_col, text_col, lang_col)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return predict(rows, trees).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
