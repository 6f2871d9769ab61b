"""The library's functions for SQL users, under one register(spark)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metric import Words, budget
from .automaton import Patterns
from .text import PREFIXES, RETRIEVAL_MARKS, TATWEEL, VARIANTS
from .tokens import key_tokens

_DROP, _FOLD = re.compile(f"[{TATWEEL}]|[{RETRIEVAL_MARKS}]"), str.maketrans(*VARIANTS)
_WORD, _ARABIC = re.compile(r"[^\W_]+"), re.compile("[ء-غف-ي]+")


def _retrieval_key(text: str) -> str:
    bare = _DROP.sub(lambda m: "" if m[0] == TATWEEL or unicodedata.category(m[0])[0] == "M" else m[0], unicodedata.normalize("NFC", text))
    return " ".join(unicodedata.normalize("NFC", bare).translate(_FOLD).split())


def _groups(text: str) -> list[list[str]]:
    """Each word of the retrieval key with what remains after each known prefix, if that has three letters."""
    out = []
    for word in _WORD.findall(_retrieval_key(text).lower()):
        rest = [word[len(p) :] for p in PREFIXES if word.startswith(p) and len(word) - len(p) >= 3] if _ARABIC.fullmatch(word) else []
        out.append(list(dict.fromkeys([word, *rest])))
    return out


class Windows:
    """Windows of a text that equal one of some records or lie within its budget of word edits."""

    def __init__(self, records: list[tuple[int, list[str]]], least: int = 3):
        self.records = {}
        for item, words in sorted(records):
            self.records.setdefault(tuple(words), item)
        self.words = list(self.records)
        self.exact, self.least = Patterns(self.words), least
        #: By word, the near candidates that it leads to: (record, place in it, budget).
        self.leads: dict[str, list[tuple[int, int, int]]] = {}
        often: dict[str, int] = {}
        for w in self.words:
            for x in w:
                often[x] = often.get(x, 0) + 1
        for k, w in enumerate(self.words):
            if len(w) >= least:
                most = budget(len(w) + budget(len(w) + 3))
                for q in sorted(range(len(w)), key=lambda i: (often[w[i]], w[i], i))[: most + 1]:
                    self.leads.setdefault(w[q], []).append((k, q, most))
        sizes = {n for w in self.words for n in range(max(1, len(w) - 2), len(w) + 3)}
        self.sizes = sorted(n for n in sizes if n >= least)

    def find(self, text: str) -> Iterator[tuple[int, int, str, int, int]]:
        """(start, end, classification, item, distance): exact windows, and of the others each with its nearest record."""
        tokens = key_tokens(text)
        words = [t[0] for t in tokens]
        equal = {(at, len(self.words[k])): k for at, k in self.exact.find(words)}
        for (at, n), k in equal.items():
            yield tokens[at][1], tokens[at + n - 1][2], "VERBATIM", self.records[self.words[k]], 0
        tried = {(k, at - q + d) for at, w in enumerate(words) for k, q, most in self.leads.get(w, ()) for d in range(-most, most + 1)}
        best: dict[tuple[int, int], tuple] = {}
        for k, start in tried:
            record = self.words[k]
            own = Words(record)
            for n in self.sizes:
                if 0 <= start <= len(words) - n and abs(n - len(record)) <= (most := budget(max(n, len(record)))) and (start, n) not in equal:
                    d = own.distance(words[start : start + n])
                    if d <= most:
                        found = (d, abs(n - len(record)), self.records[record])
                        best[start, n] = min(best.get((start, n), found), found)
        for (at, n), (d, _, item) in best.items():
            yield tokens[at][1], tokens[at + n - 1][2], "NEAR_MISS", item, d


def register(spark: SparkSession) -> None:
    """norm_ar, nfc, alias_groups, comparison_words and word_distance, each on Arrow batches; null gives null."""

    def one(name: str, kind: str, body) -> None:
        spark.udf.register(name, F.pandas_udf(lambda s: s.map(body, na_action="ignore"), kind))

    one("norm_ar", "string", _retrieval_key)
    one("nfc", "string", lambda x: unicodedata.normalize("NFC", x))
    one("alias_groups", "array<array<string>>", _groups)
    one("comparison_words", "array<string>", lambda x: [w for w, _, _ in key_tokens(x)])

    @F.pandas_udf("int")
    def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else Words(list(x)).distance(list(y)) for x, y in zip(a, b)], dtype="Int32")

    spark.udf.register("word_distance", word_distance)


def register_windows(spark: SparkSession, records: DataFrame, name: str = "match_windows", most_words: int = 1_000_000) -> None:
    """A table function name(text) for LATERAL joins: rows (start, end, classification, item_id, distance) of the windows of a text
    that quote or nearly quote records(item_id, rw).

    The records travel with the function, so they may have `most_words` words at most; with more it raises, and
    operators.detect, which joins by shuffle, is the way.
    """
    size = records.agg(F.sum(F.size("rw"))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the records have {size} words, over {most_words}: use detect() instead")
    held = [(r.item_id, list(r.rw)) for r in records.select("item_id", "rw").collect()]
    built: list[Windows] = []

    @F.udtf(returnType="start: int, end: int, classification: string, item_id: long, distance: int")
    class MatchWindows:
        def eval(self, text: str):
            if text is not None:
                if not built:
                    built.append(Windows(held))
                yield from built[0].find(text)

    spark.udtf.register(name, MatchWindows)
