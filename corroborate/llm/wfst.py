"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The normaliser (leading space, spaces as U+2581, extra spaces), the pieces and the byte fallback are compiled once.
Composed with a text they give a lattice: places of the text as states, pieces as weighted arcs.  The result is the shortest
path in the tropical semiring (weights add along a path, the least wins), found place by place.

A unigram model's arc weighs its piece's negative score.  A BPE model's pieces carry no cost of their own; there the lattice
is composed with an acceptor of neighbours, whose weight is infinite where a merge across the border would come before the
merges that complete the two pieces, and nothing elsewhere.  It is compiled from merge ranks: for each piece the symbols at
its left and right edge while it is being merged, and the least score that has to be reached before each edge changes.  The
paths that are left are BPE results.

The lattice is cut where no piece can cross (before a space, at letters that no longer piece holds), and each distinct cut
is solved once while it stays in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_rows

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INF = float("inf")
#: Fixed value: how much less an unknown letter scores than the worst piece.
UNKNOWN_PENALTY = 10.0


def read_model(path: str) -> dict:
    """Pieces of a SentencePiece model file as plain values; the driver reads it, tasks get it by broadcast (a few MB at most)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    if t.model_type not in (UNIGRAM, BPE) or not n.escape_whitespaces or t.treat_whitespace_as_suffix or len(n.precompiled_charsmap) > 4:
        raise ValueError("only unigram and BPE models with an identity character map are compiled")
    if t.model_type == BPE and not t.byte_fallback:
        raise ValueError("a BPE model needs byte fallback")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    return {"kind": t.model_type, "prefix": n.add_dummy_prefix, "tidy": n.remove_extra_whitespaces, "bytes": t.byte_fallback, "pieces": pieces}


class Transducer:
    def __init__(self, model: dict, cache: int = 500_000):
        self.prefix, self.tidy, self.most, self.kind = model["prefix"], model.get("tidy", False), cache, model.get("kind", BPE)
        pieces = model["pieces"]
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.byte = {int(p[3:5], 16): i.to_bytes(4, "little") for i, (p, _, kind) in enumerate(pieces) if kind == BYTE} if model.get("bytes", True) else {}
        self.unknown = next((i.to_bytes(4, "little") for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), b"\0\0\0\0")
        self.out = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() if kind in (NORMAL, USER) else " \u2047 ".encode() if kind == UNKNOWN else b"" for p, _, kind in pieces]
        self.user = {p: i.to_bytes(4, "little") for i, (p, _, kind) in enumerate(pieces) if kind == USER}
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        #: For each piece its symbols at an edge while it is merged, each with the score that ends it.
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        if self.kind == BPE:
            #: The pieces that their own letters merge into, with their ids.
            self.whole = {p: i.to_bytes(4, "little") for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL and self._edges(p)}
        else:
            best, worst = max([0.0, *self.score.values()]), min(self.score.values(), default=0.0)  # scores below zero give a user's piece no malus
            self.whole = {p: i.to_bytes(4, "little") for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
            self.weight = {p: np.float32(-s) for p, s in self.score.items()} | {p: np.float32(0.1 - len(p.encode()) * best) for p in self.user}
            self.letter = np.float32(UNKNOWN_PENALTY - worst)
        self.starts = {p[:n] for p in self.whole for n in range(1, len(p) + 1)}
        self.cut = self._cuts()
        self.frozen = re.compile("|".join(re.escape(p) for p in sorted(self.user, key=len, reverse=True))) if self.user and self.kind == BPE else None

    def _cuts(self) -> re.Pattern:
        """Splits a text where no piece crosses: before spaces and at line ends."""
        joined = [p for p in self.whole if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            return re.compile(r"(?s).+")
        line = "" if any("\n" in p for p in joined) else "\n"
        return re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+|{line or MARK}")

    def merged(self, text: str, events: list | None = None) -> list[str]:
        """The pieces that merging letters by score, then from the left, gives; events: (score, left place, right end) of each merge."""
        part: list = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            s, i, j, a, b = heapq.heappop(heap)
            if part[i] != a or part[j] != b or right[i] != j:
                continue
            part[i], part[j] = a + b, None
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            if events is not None:
                events.append((-s, i, right[i]))
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def _edges(self, piece: str) -> bool:
        """Compiles a piece's edges; false if its letters don't merge into it."""
        events: list = []
        if self.merged(piece, events) != [piece]:
            return False
        n = len(piece)
        for side, symbol in (("left", piece[0]), ("right", piece[-1])):
            out, least = [], INF
            for score, i, j in events:
                least = min(least, score)
                if (i == 0) if side == "left" else (j == n):
                    out.append((symbol, least))
                    symbol, least = piece[i:j], INF
            getattr(self, side)[piece] = [*out, (symbol, -INF)]
        return True

    def border(self, a: str, b: str) -> float:
        """The acceptor's weight of piece b after piece a: infinite if a merge across their border comes before both are whole."""
        if a not in self.whole:
            return 0.0
        one, two, score, i, j = self.right[a], self.left[b], self.score, 0, 0
        while True:
            (x, s), (y, t) = one[i], two[j]
            cross = score.get(x + y)
            if cross is not None and cross > s and cross >= t:  # of equal scores the left one merges first
                weight = INF
                break
            if s == t == -INF:
                weight = 0.0
                break
            if s >= t:
                i += 1
            else:
                j += 1
        if len(self.pairs) > self.most:
            self.pairs.clear()
        self.pairs[a, b] = weight
        return weight

    def _arcs(self, text: str, i: int) -> list[str]:
        """Pieces that start at a place; a letter without a piece stands alone."""
        starts, whole, out = self.starts, self.whole, []
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece not in starts:
                break
            if piece in whole:
                out.append(piece)
        if text[i] not in whole:
            out.append(text[i])
        return out

    def shortest(self, text: str) -> list[str]:
        """Pieces on the shortest path, place by place: for each state (place, last piece; one state a place for unigram models)
        its least weight and where it comes from."""
        n, whole = len(text), self.whole
        if self.kind == UNIGRAM:
            cost, back = [np.float32(0)] + [np.float32(INF)] * n, [""] * (n + 1)  # as precise as the scores
            for i in range(n):
                here = cost[i]
                for piece in self._arcs(text, i):
                    j, total = i + len(piece), here + self.weight.get(piece, self.letter)
                    if total < cost[j]:
                        cost[j], back[j] = total, piece
            path = []
            while n:
                path.append(back[n])
                n -= len(back[n])
            return path[::-1]
        # each piece weighs one, so that of several finite paths the one with fewest pieces wins
        starts, known, border = self.starts, self.pairs.get, self.border
        states: list = [None] * (n + 1)
        states[0] = [("", 0, None)]
        for i in range(n):
            here = states[i]
            if here is None:
                continue
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece not in whole:
                    if j == i + 1:
                        best = min(here, key=lambda x: x[1]) if len(here) > 1 else here[0]
                        states[j] = [*(states[j] or ()), (piece, best[1] + 1, best)]
                    if piece not in starts:
                        break
                    continue
                best = None
                for state in here:
                    last = state[0]
                    weight = known((last, piece))
                    if weight is None:
                        weight = border(last, piece)
                    if weight == 0.0 and (best is None or state[1] < best[1]):
                        best = state
                if best is not None:
                    new = (piece, best[1] + 1, best)
                    if states[j] is None:
                        states[j] = [new]
                    else:
                        states[j].append(new)
        ends = states[n]
        state, path = (min(ends, key=lambda x: x[1]) if len(ends) > 1 else ends[0]), []
        while state[2] is not None:
            path.append(state[0])
            state = state[2]
        return path[::-1]

    def finite(self, text: str) -> list[str] | None:
        """The one path of finite weight, found depth first with long pieces first; states from which every path is infinite are
        left at once and not entered again.  None if there is none."""
        n, whole, starts, known, border = len(text), self.whole, self.starts, self.pairs.get, self.border
        dead, path, ways = set(), [], []
        i, last = 0, ""
        while i < n:
            if len(ways) == len(path):  # arcs of a state that is entered for the first time
                arcs = []
                for j in range(i + 1, n + 1):
                    piece = text[i:j]
                    if piece in whole:
                        arcs.append(piece)
                    elif piece not in starts:
                        break
                if text[i] not in whole:
                    arcs.insert(0, text[i])
                ways.append(arcs)
            arcs = ways[-1]
            while arcs:
                piece = arcs.pop()
                weight = known((last, piece)) if piece in whole else 0.0
                if weight is None:
                    weight = border(last, piece)
                if weight == 0.0 and (i + len(piece), piece) not in dead:
                    path.append(piece)
                    i += len(piece)
                    last = piece
                    break
            else:
                if not path:
                    return None
                dead.add((i, last))
                ways.pop()
                i -= len(path.pop())
                last = path[-1] if path else ""
        return path

    def _solve(self, cut: str) -> bytes:
        whole = self.whole
        if self.kind == BPE:
            if cut in whole:
                return whole[cut]
        # letters of one score in a row may leave several finite paths: these are weighed place by place
        single = self.kind == BPE and not cut.startswith(MARK * 2)
        pieces = (self.finite(cut) if single else None) or self.shortest(cut)
        if self.byte:
            return b"".join([whole[p] if p in whole else b"".join([self.byte[x] for x in p.encode()]) for p in pieces])
        return b"".join([whole.get(p, self.unknown) for p in pieces])

    def normalised(self, text: str) -> str:
        if self.tidy:
            text = re.sub(" +", " ", text.strip(" "))
        return ((MARK if self.prefix and text else "") + text).replace(" ", MARK)

    def _fused(self, ids: bytes) -> bytes:
        """Unknown letters in a row are one."""
        n = np.frombuffer(ids, "<i4")
        unknown = n == int.from_bytes(self.unknown, "little")
        return n[~(unknown & np.concatenate([[False], unknown[:-1]]))].tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        text = self.normalised(text)
        if self.frozen:  # a user's own pieces stand as they are, the longest first
            out, at = [], 0
            for m in self.frozen.finditer(text):
                out += [self._plain(text[at : m.start()]), self.user[m[0]]]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        ids = self._plain(text)
        return ids if self.byte else self._fused(ids)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        cuts = self.cut.findall(text)
        cache = self.cache
        new = set(cuts).difference(cache)
        if len(cache) + len(new) > self.most:
            cache.clear()
            new = set(cuts)
        if len(new) > self.most:  # a text of its own size of distinct cuts
            return b"".join(map(self._solve, cuts))
        for c in new:
            cache[c] = self._solve(c)
        ids = b"".join(map(cache.__getitem__, cuts))
        for c in new:
            if len(c) > 256:
                del cache[c]
        return ids

    def decode(self, ids: bytes) -> bytes:
        """The text of ids; bytes that aren't UTF-8 stay as they are."""
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist())).replace(MARK.encode(), b" ")
        return text[1:] if self.prefix and text.startswith(b" ") else text


RESULT = "ids array<int>, n_ids int, n_bytes_ids int, ids_sha256 string, decoded string, same boolean"


def _lists(ids) -> pa.Array:
    """Lists of numbers from their bytes, null for None."""
    ends = np.concatenate([[0], np.cumsum([len(x or b"") // 4 for x in ids])]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in ids], pa.bool_()))


def _run(shared, keep_ids: bool, keep_text: bool):
    def run(batches):
        t: Transducer = shared.value  # with its cache, a worker's tasks share it
        fallback = [int.from_bytes(x, "little") for x in t.byte.values()] or [-1]
        low, high = min(fallback), max(fallback)
        for b in slices(batches):
            rows = []
            for text in utf8_rows(b.column("text")):
                if text is None:
                    rows.append((None,) * 6)
                    continue
                ids = t.encode(text.decode())
                back = t.decode(ids)
                n = np.frombuffer(ids, "<i4")
                rows.append((ids if keep_ids else None, len(n), int(((n >= low) & (n <= high)).sum()), hashlib.sha256(ids).hexdigest(), back.decode("utf-8", "replace") if keep_text else None, back == text))
            ids, *columns = zip(*rows) if rows else [[]] * 6
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(ids), *[pa.array(c, k) for c, k in zip(columns, types)]], ["id", "ids", "n_ids", "n_bytes_ids", "ids_sha256", "decoded", "same"])

    return run


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Per row: id, ids, n_ids, n_bytes_ids (from byte fallback), ids_sha256 (of the ids as little-endian 32-bit numbers), decoded, same (decoded equals the text).

    A null text gives nulls, an empty one no ids.  With byte fallback and no removal of extra spaces `same` is false only for
    texts that hold U+2581 itself, which decodes to a space.  Repeated rows each return a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Transducer(read_model(model_path)))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_run(shared, keep_ids, keep_text), "id long, " + RESULT).withColumnRenamed("id", id_col)
