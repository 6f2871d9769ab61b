"""License scan: an exact set-similarity join of text blocks with license templates by containment.

A text is cut into overlapping blocks of words, so that every run of `stride` words lies in one block as a whole; the stride
follows the template's length.  A block meets a template if it holds at least the template's share of its distinct words.
Words are put in one order over the whole corpus, rarest first.  Then a block that meets a template of n words, of which it
must hold m, holds one of the template's first n - m + 1 words (prefix filter); it has at least m words that any template has
(length filter); and where the first common word stands i-th in the template and j-th in the block, both have at least m
words left from there (positional filter).  Only what passes all three is counted in full.

Phrases are templates of which all words are wanted; a block that holds them is then read for places where they stand one
after another.  Words that no template has are left out of blocks: they can't be common words.  Templates are a bounded
parameter, so the join's index goes to all tasks and no text is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8_rows, with_id, id_back

#: Phrases and their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Label, wording, and the share of its distinct words that a block must hold.
TEMPLATES = [
    ("agpl", "gnu affero general public license", 1.0),
    ("apache-2.0", "apache license version 2 0", 1.0),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("cc-by-nc", "cc by nc", 1.0),
    ("cc-by-nd", "creative commons attribution noderivatives", 1.0),
    ("cc-by-sa", "cc by sa", 1.0),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", 0.8),
    ("gpl-3.0", "gnu general public license version 3", 1.0),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    ("lgpl", "gnu lesser general public license", 1.0),
    ("mit", "under the mit license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
]
STRIDE = 16
#: Bytes of words: 0-9, a-z and all beyond ASCII.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORDS).split()


def stride_of(n: int) -> int:
    """The least of 16, 32, 64 and so on that holds n words and a quarter more."""
    s = STRIDE
    while s < 1.25 * n:
        s *= 2
    return s


class Index:
    """Templates as sorted arrays of word numbers, and the words that lead to them.  Numbers follow the corpus's order."""

    def __init__(self, phrases: list, templates: list, counts: dict[bytes, int] | None = None):
        wanted = [(label, words_of(text.encode()), 1.0, True) for label, text in phrases] + [(label, words_of(text.encode()), share, False) for label, text, share in templates]
        wanted = [t for t in wanted if t[1]]
        order = sorted({w for t in wanted for w in t[1]}, key=lambda w: ((counts or {}).get(w, 0), w))
        self.names = order
        self.number = {w: i for i, w in enumerate(order)}
        self.labels = [t[0] for t in wanted]
        self.tokens = [np.unique([self.number[w] for w in t[1]]) for t in wanted]
        self.least = [max(1, ceil(t[2] * len(tokens) - 1e-9)) for t, tokens in zip(wanted, self.tokens)]
        self.strides = [stride_of(len(t[1])) for t in wanted]
        self.phrase = [np.array([self.number[w] for w in t[1]]) if t[3] else None for t in wanted]
        self.leads: dict[int, list[int]] = defaultdict(list)
        for t, (tokens, least) in enumerate(zip(self.tokens, self.least)):
            for w in tokens[: len(tokens) - least + 1].tolist():
                self.leads[w].append(t)
        self.probe = np.zeros(len(order) + 1, bool)  # the last place is for words of no template, numbered -1
        self.probe[list(self.leads)] = True

    def numbers(self, text: bytes) -> np.ndarray:
        """The number of every word of a text of any length, -1 for words of no template."""
        text = text.lower().translate(_WORDS)
        out, at = [], 0
        while at < len(text):  # a piece at a time: a long text's words are never held together
            to = text.find(b" ", at + PIECE)
            words = text[at : to if to > 0 else None].split()
            out.append(np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words)))
            at = to if to > 0 else len(text)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def blocks(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, block, share) of all blocks that meet a template, by template and block."""
        found = set()
        for p in np.flatnonzero(self.probe[words]).tolist():
            for t in self.leads[int(words[p])]:
                b = p // self.strides[t]
                found |= {(t, b), (t, b - 1)} if b else {(t, b)}
        out = []
        for t, b in sorted(found):
            tokens, least, s = self.tokens[t], self.least[t], self.strides[t]
            block = np.unique(words[b * s : (b + 2) * s])
            block = block[np.searchsorted(block, 0) :]
            if len(block) < least:
                continue
            place = np.minimum(np.searchsorted(block, tokens), len(block) - 1)
            common = block[place] == tokens
            first = int(common.argmax())
            if not common[first] or min(len(tokens) - first, len(block) - int(place[first])) < least:
                continue
            if (n := int(common.sum())) >= least:
                out.append((t, b, n / len(tokens)))
        return out

    def places(self, t: int, b: int, words: np.ndarray) -> list[int]:
        """Where the phrase's words stand one after another, of starts in the block's first half; other starts are the next block's."""
        phrase, s = self.phrase[t], self.strides[t]
        part = words[b * s : b * s + s + len(phrase) - 1]
        starts = len(part) - len(phrase) + 1
        if starts <= 0:
            return []
        return (b * s + np.flatnonzero(np.logical_and.reduce([part[i : i + starts] == w for i, w in enumerate(phrase)]))).tolist()


def frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> dict[bytes, int]:
    """How often each word of a template stands in all texts; one row a word of the templates."""

    def count(batches):
        total = np.zeros(len(index.names) + 1, np.int64)
        for b in batches:
            for text in utf8_rows(b.column("text")):
                if text:
                    total += np.bincount(index.numbers(text) + 1, minlength=len(total))
        used = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[1:][used], pa.int64())], ["word", "n"])

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {index.names[r.word]: r.n for r in rows.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list | None = None, templates: list | None = None, most_words: int = 1 << 20) -> DataFrame:
    """Per row of docs: id, n_words, places array<struct<label, word>>, blocks array<struct<label, start, words, share>>.

    places are all starts of phrases (in words from 0), blocks all text blocks that hold a template's share of its words.
    phrases: (label, wording); templates: (label, wording, share).  Words are runs of 0-9, a-z (A-Z lower-cased) and code
    points beyond ASCII.  A null text is empty, a null id stays null, rows that repeat an id are scanned each, other
    columns are ignored.  The templates' words, `most_words` at most, go to all tasks; with more it raises, and the caller
    scans with parts of the templates: each template's result is its own.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    index = Index(phrases, templates)
    if len(index.names) > most_words:
        raise ValueError(f"the templates have {len(index.names)} words, over {most_words}: scan with parts of them")
    index = Index(phrases, templates, frequencies(docs, index, text_col))

    def run(batches):
        for b in batches:
            n, places, blocks = [], [], []
            for text in utf8_rows(b.column("text")):
                words = index.numbers(text or b"")
                hits = index.blocks(words)
                n.append(len(words))
                places.append([{"label": index.labels[t], "word": p} for t, k, _ in hits if index.phrase[t] is not None for p in index.places(t, k, words)])
                blocks.append([{"label": index.labels[t], "start": k * index.strides[t], "words": min(2 * index.strides[t], len(words) - k * index.strides[t]), "share": share} for t, k, share in hits if index.phrase[t] is None])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(places, PLACES), pa.array(blocks, BLOCKS)], ["id", "n_words", "places", "blocks"])

    out = with_id(docs, id_col, text=text_col).mapInArrow(run, "id long, n_words long, places array<struct<label: string, word: long>>, blocks array<struct<label: string, start: long, words: long, share: double>>")
    return out.select(id_back(id_col), "n_words", "places", "blocks")


PLACES = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    """score: the largest share of a template that a block of the text holds, 1 with a phrase, 0 with neither."""
    base, own = F.col("places.label"), F.col("blocks.label")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    phrase = F.when(F.size("places") > 0, 1.0).otherwise(0.0)
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.greatest(phrase, F.coalesce(F.array_max("blocks.share"), F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """The same by definition: all blocks against all templates."""
    index = Index(PHRASES, TEMPLATES)
    rows, base = [], []
    for label, tokens, least, s, phrase in zip(index.labels, index.tokens, index.least, index.strides, index.phrase):
        if phrase is None:
            rows.append(f"('{label}', {[index.names[t].decode() for t in tokens]}, {least}, {s})")
        else:
            base.append(f"('{label}', {[index.names[t].decode() for t in phrase]})")
    return f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        phrase(label, toks) AS (VALUES {', '.join(base)}),
        template(label, toks, least, stride) AS (VALUES {', '.join(rows)}),
        place AS (SELECT doc_id, label, i - 1 AS word FROM w, phrase, unnest(range(1, len(words) + 1)) AS t(i) WHERE words[i] = toks[1] AND words[i:i + len(toks) - 1] = toks),
        block AS (SELECT doc_id, stride, list_distinct(words[b * stride + 1:(b + 2) * stride]) AS held
            FROM w, (SELECT DISTINCT stride FROM template), unnest(range(0, CAST(ceil(len(words) / stride) AS BIGINT))) AS t(b)),
        hit AS (SELECT doc_id, label, len(list_intersect(held, toks)) / len(toks) AS share FROM block JOIN template USING (stride) WHERE len(list_intersect(held, toks)) >= least),
        p AS (SELECT doc_id, count(*) AS n, min(word) AS low, max(word) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY doc_id),
        h AS (SELECT doc_id, max(share) AS share FROM hit GROUP BY doc_id),
        a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION ALL SELECT doc_id, label FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word, coalesce(p.labels, '') AS base_labels,
            coalesce(a.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
        FROM w LEFT JOIN p USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN a USING (doc_id)"""


SQL = _sql()
