"""Words of the comparison key with their places in the original text."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _FOLDED, comparable_text, token_lists

_CHUNK = regex.compile(r"[^\s\x1c-\x1f]+")  # the key takes the separators for white space too
#: Signs of which each gives one place of the key, its folded form; with white space between them, and with what else may stand there.
_SINGLE = "!-~¡-§©«¬®°±¶·»¿-įıĴ-ľŁ-ňŊ-žء-غف-ي،؛؟٠-٬‐‒-‖‘-‟"
_SINGLES, _SPACED = re.compile(f"[{_SINGLE}]+"), re.compile(f"[{_SINGLE} \n\t\r]*")
_PIECE = regex.compile(rf"(?s)([{_SINGLE}]+(?![\p{{M}}\p{{Cf}}]))|.[\p{{M}}\p{{Cf}}]*")
#: Vowel signs, which compose with no letter; and chunks with signs that are neither these nor single.
_VOWELS = "\u064b-\u0652"
_ODD = re.compile(rf"(?<!\S)[{_SINGLE}{_VOWELS}]*+\S+")
#: Of signs that no odd chunk has, of which none is beyond the ideographic space: what each is in a word, and which stand in words.
_LETTER = {fold: np.array([ord(chr(table.get(i, i)).lower()[0]) for i in range(0x3001)], "<u4") for fold, table in _FOLDED.items()}
_INSIDE = np.array([chr(i).isalnum() for i in range(0x3001)])
_WORD = re.compile(r"[^\W_]+")
_PLAIN = re.compile(r"[A-Za-z0-9]+")


@lru_cache(1 << 16)
def _key(cluster: str, fold: bool) -> str:
    return comparable_text(cluster, fold)


def key_tokens(text: str, fold: bool = True) -> list[tuple[str, int, int]]:
    """(word, start, end) of a text: words of the comparison key, lower-cased, with offsets in code points, end exclusive.

    Marks belong to the letter before them.  A character that expands to several letters, or to several words, gives all of
    them its own place.
    """
    if text.isascii():
        return [(m[0].lower(), m.start(), m.end()) for m in _PLAIN.finditer(text)]
    table = _FOLDED[fold]
    if _SPACED.fullmatch(text):
        return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text.translate(table))]
    out = []
    for chunk in _CHUNK.finditer(text):
        start, end = chunk.span()
        if _SINGLES.fullmatch(text, start, end):
            out += [(m[0].lower(), start + m.start(), start + m.end()) for m in _WORD.finditer(chunk[0].translate(table))]
            continue
        key, places = [], []
        # signs that give one place each, or a character with the marks and format characters on it
        for c in _PIECE.finditer(text, start, end):
            if c[1]:
                key.append(c[1].translate(table))
                places += [(i, i + 1) for i in range(*c.span())]
            else:
                value = _key(c[0], fold)
                key.append(value)
                places += [c.span()] * len(value)
        out += [(m[0].lower(), places[m.start()][0], places[m.end() - 1][1]) for m in _WORD.finditer("".join(key))]
    return out


@lru_cache(1 << 15)
def _short(chunk: str, fold: bool) -> list[tuple[str, int, int]]:
    return key_tokens(chunk, fold)


def key_token_lists(texts: pa.Array, fold: bool = True) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
    """Words, starts and ends of the key_tokens of each text (none for a null) as lists.

    The texts are read as lines, all signs at once: those that give one place each, and the vowel signs on them, which the key
    drops.  Chunks with other signs are worked out on their own.
    """
    texts = [t or "" for t in texts.to_pylist()]
    lines = "\n".join([*texts, ""])
    odd = [(m.start(), m[0]) for m in _ODD.finditer(lines)]
    if odd:
        lines = _ODD.sub(lambda m: " " * len(m[0]), lines)
    signs = np.frombuffer(lines.encode("utf-32-le"), "<u4")
    at = np.flatnonzero((signs < ord(_VOWELS[0])) | (signs > ord(_VOWELS[-1]))).astype(np.int32)
    letters = _LETTER[fold][signs[at]]
    inside = _INSIDE[letters]
    edge = np.diff(inside, prepend=False, append=False)
    first, last = np.flatnonzero(edge)[::2], np.flatnonzero(edge)[1::2]
    start, end = at[first], at[last]  # up to the next sign that is no vowel sign; the last line's end follows all words
    letters = letters[inside]
    byte = np.append(np.int32(0), np.cumsum(np.int8(1) + (letters > 0x7F) + (letters > 0x7FF), dtype=np.int32))  # in UTF-8
    bounds = byte[np.cumsum(np.append(0, last - first))]
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(letters.tobytes().decode("utf-32-le").encode()))
    if odd:
        more = [(w, at + a, at + b) for at, chunk in odd for w, a, b in (_short(chunk, fold) if len(chunk) <= 64 else key_tokens(chunk, fold))]
        start, end = (np.append(own, np.array([x[i] for x in more], np.int64)) for i, own in ((1, start), (2, end)))
        order = np.argsort(start, kind="stable")
        words, start, end = pa.concat_arrays([words, pa.array([x[0] for x in more], pa.string())]).take(pa.array(order)), start[order], end[order]
    line = np.cumsum([0, *(len(t) + 1 for t in texts)])
    ends = np.searchsorted(start, line)
    own = np.repeat(line[:-1], np.diff(ends))
    return tuple(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (words, pa.array(start - own, pa.int32()), pa.array(end - own, pa.int32())))


def comparison_tokens(c: Column, fold: bool = True) -> Column:
    """Array of (word, start, end): the comparison key's words with their places in the text; null stays null."""

    @F.arrow_udf("array<struct<word:string,start:int,end:int>>")
    def places(texts: pa.Array) -> pa.Array:
        return token_lists(texts, lambda t: key_tokens(t, fold))

    return places(c)
