"""External induced suffix sorting of one shard, with common-prefix values.

The text lies in a file.  Left-most S suffixes are cut into substrings, which an external sort names; the names form a text
of their own, sorted by recursion (in memory once it fits), and its common-prefix values give those of the left-most S suffixes.  Two inductions
follow: the first takes suffixes in ascending order and puts every L-type predecessor on a priority queue, the second
takes them in descending order and does the same with S-type predecessors.

A queue's tuple is (first symbol, rank of the suffix it comes from, position, common prefix with the tuple before it of
the same symbol).  The common prefix of two tuples of one symbol is one more than the least common prefix between the
ranks they come from.  Queues, seeds and names are held in memory up to a budget and in files of the task's scratch folder
beyond it, so a shard may be far larger than memory.  Only `cap` symbols of a prefix count: suffixes that agree on so many
may stand in any order, but next to each other.
"""

from __future__ import annotations

import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np

RECORD = np.dtype([("key", "<u8"), ("pos", "<i8"), ("lcp", "<u2")])
TUPLE = np.dtype([("pos", "<i8"), ("lcp", "<u2")])
FRONT = 1 << 16
SHARES = 8  # of the memory: each tape and queue has one
NAME_BYTES = 100  # of memory for each name that is sorted there


def scratch() -> tempfile.TemporaryDirectory:
    """A folder of the task's own, where Spark's Python workers put what they spill; it goes with the task."""
    return tempfile.TemporaryDirectory(dir=(os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0])


class Tape:
    """A growing array, in a file beyond `budget` bytes."""

    def __init__(self, dtype, folder: str, budget: int):
        self.dtype, self.folder, self.budget = np.dtype(dtype), folder, budget
        self.parts: list[np.ndarray] = []
        self.size, self.file, self.n = 0, None, 0

    def put(self, values: np.ndarray) -> None:
        self.parts.append(np.asarray(values, self.dtype))
        self.n += len(values)
        self.size += self.parts[-1].nbytes
        if self.size > self.budget:
            self._flush()

    def _flush(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
        for p in self.parts:
            np.ascontiguousarray(p).tofile(self.file)
        self.parts, self.size = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        self._flush()
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


def blank(n: int, dtype, folder: str, budget: int, fill: int = 0) -> np.ndarray:
    """An array of n equal values, in a file if it is larger than `budget` bytes."""
    if n * np.dtype(dtype).itemsize <= budget:
        return np.full(n, fill, dtype)
    out = np.memmap(tempfile.TemporaryFile(dir=folder), dtype, "w+", shape=(n,))
    if fill:
        for at in range(0, n, 1 << 20):
            out[at : at + (1 << 20)] = fill
    return out


class Buckets:
    """A priority queue for few symbols: tuples come in the order of their ranks, so each symbol's are kept as they come."""

    def __init__(self, symbols: int, folder: str, budget: int):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.low, self.size, self.folder, self.budget, self.file, self.end = 0, 0, folder, budget, None, 0
        self.open = np.empty(0, TUPLE)

    def push(self, symbol: np.ndarray, rank: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        order = np.argsort(symbol.astype(np.uint16), kind="stable")
        if symbol[order[0]] < self.low:
            if len(self.open):
                self.parts[self.low].insert(0, self.open)
                self.open = self.open[:0]
            self.low = int(symbol[order[0]])
        made = np.empty(len(order), TUPLE)
        made["pos"], made["lcp"] = pos[order], lcp[order]
        symbol = symbol[order]
        edge = np.flatnonzero(np.diff(symbol, prepend=-1)).tolist()
        for a, b in zip(edge, [*edge[1:], len(symbol)]):
            self.parts[symbol[a]].append(made[a:b])
        self.size += made.nbytes
        if self.size > self.budget:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(self.end)
        for parts in self.parts[self.low :]:
            kept: list = []
            for held, some in itertools.groupby(parts, lambda p: isinstance(p, np.ndarray)):
                if held:
                    data = np.concatenate(list(some))
                    data.tofile(self.file)
                    kept.append((self.end, len(data)))
                    self.end += data.nbytes
                else:
                    kept += some
            parts[:] = kept
        self.size = 0

    def first(self) -> int | None:
        """The least symbol that has tuples."""
        while not len(self.open) and self.low < len(self.parts) and not self.parts[self.low]:
            self.low += 1
        return self.low if self.low < len(self.parts) else None

    def peek(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least tuples: symbols, positions, common prefixes; all of one symbol."""
        if self.first() is not None and not len(self.open):
            parts, taken, n = self.parts[self.low], [], 0
            while parts and n < FRONT:
                part = parts.pop(0)
                if isinstance(part, np.ndarray):
                    self.size -= part.nbytes
                else:
                    self.file.seek(part[0])
                    part = np.fromfile(self.file, TUPLE, part[1])
                taken.append(part)
                n += len(part)
            self.open = np.concatenate(taken) if len(taken) > 1 else taken[0] if taken else self.open
        now = self.open[:FRONT]
        return np.full(len(now), self.low), now["pos"], now["lcp"]

    def drop(self, n: int, cut: bool) -> None:
        self.open = self.open[n:]


class Heap:
    """A priority queue for any number of symbols: sorted runs, in files beyond the budget, merged into a short sorted front."""

    def __init__(self, folder: str, budget: int):
        self.front, self.bound = np.empty(0, RECORD), np.uint64(0)
        self.late: list[np.ndarray] = []  # not above the bound, not yet in the front
        self.far: list[np.ndarray] = []
        self.runs: list[np.ndarray] = []
        self.far_size, self.folder, self.budget, self.step = 0, folder, budget, 1024

    def push(self, symbol: np.ndarray, rank: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        made = np.empty(len(symbol), RECORD)
        made["key"] = symbol.astype(np.uint64) << np.uint64(33) | rank.astype(np.uint64)
        made["pos"], made["lcp"] = pos, lcp
        self.put(made)

    def put(self, made: np.ndarray) -> None:
        near = made["key"] <= self.bound
        if near.any():
            self.late.append(made[near])
            made = made[~near]
        if len(made):
            self.far.append(made)
            self.far_size += made.nbytes
            if self.far_size > self.budget:
                self._sort_far()

    def _sort_far(self) -> None:
        run = np.concatenate(self.far)
        self.far, self.far_size = [], 0
        self.runs.append(run[np.argsort(run["key"])])
        held = [r for r in self.runs if not isinstance(r, np.memmap)]
        if len(held) > 12:
            merged = np.concatenate(held)
            held = [merged[np.argsort(merged["key"], kind="stable")]]
        size = sum(r.nbytes for r in held)
        if size > self.budget:
            merged = np.concatenate(held)
            tape = Tape(RECORD, self.folder, 0)
            tape.put(merged[np.argsort(merged["key"], kind="stable")])
            held = [tape.array()]
        self.runs = [r for r in self.runs if isinstance(r, np.memmap)] + held

    def _refill(self) -> None:
        if self.far:
            self._sort_far()
        self.runs = [r for r in self.runs if len(r)]
        if not self.runs:
            return
        step = max(64, min(FRONT, 8 * self.step) // len(self.runs))
        self.bound = min((r["key"][step - 1] for r in self.runs if len(r) > step), default=max(r["key"][-1] for r in self.runs))
        taken = []
        for i, r in enumerate(self.runs):
            n = int(np.searchsorted(r["key"][: step + 1], self.bound, "right")) if len(r) > step else int(np.searchsorted(r["key"], self.bound, "right"))
            taken.append(np.array(r[:n]))
            self.runs[i] = r[n:]
        front = np.concatenate(taken)
        self.front = front[np.argsort(front["key"], kind="stable")] if len(taken) > 1 else front

    def first(self) -> int | None:
        if self.late:
            late = np.concatenate(self.late)
            late = late[np.argsort(late["key"])]
            self.front = np.insert(self.front, np.searchsorted(self.front["key"], late["key"]), late)
            self.late = []
        if not len(self.front):
            self._refill()
        return int(self.front["key"][0] >> np.uint64(33)) if len(self.front) else None

    def peek(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.first()
        now = self.front[: self.step]
        return (now["key"] >> np.uint64(33)).astype(np.int64), now["pos"], now["lcp"]

    def drop(self, n: int, cut: bool) -> None:
        self.step = max(128, 2 * n) if cut else min(1 << 15, 2 * self.step)
        self.front = self.front[n:]


class _History:
    """Least common prefix between any past rank and now: for each value below cap, the last rank whose value isn't larger."""

    def __init__(self, cap: int):
        self.cap, self.last = cap, np.full(cap, -1, np.int64)

    def since(self, ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.last, ranks, "right")

    def add(self, base: int, lcp: np.ndarray) -> None:
        at = np.full(self.cap + 1, -1, np.int64)
        at[lcp] = np.arange(len(lcp))
        at = np.maximum.accumulate(at)[: self.cap]
        self.last = np.where(at >= 0, base + at, self.last)


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low:high], low < high."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def _runs(text: np.ndarray, pos: np.ndarray, cap: int) -> np.ndarray:
    """How often each position's symbol is repeated from there on, up to cap."""
    symbol, out, live = text[pos], np.ones(len(pos), np.int64), np.arange(len(pos))
    for k in range(1, cap):
        live = live[pos[live] + k < len(text)]
        live = live[text[pos[live] + k] == symbol[live]]
        if not len(live):
            break
        out[live] += 1
    return out


def _induce(text: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, top: int, descending: bool, cap: int, folder: str, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, common prefix with the one before, is a seed) in order, from seeds in order; their symbols' own tuples come first."""
    queue = Buckets(top + 1, folder, budget) if top < 1024 else Heap(folder, budget)
    last = blank(top + 1, np.int64, folder, budget, -1)
    history, base, at = _History(cap), 0, 0
    before = (-1, -1, True)  # symbol, position and kind of the last tuple
    ahead, ahead_at = np.empty(0, np.int64), 0  # symbols of the seeds from ahead_at on

    def way(symbols):
        return top - symbols.astype(np.int64) if descending else symbols.astype(np.int64)

    while True:
        if at - ahead_at >= len(ahead) and at < len(seeds):
            ahead, ahead_at = way(text[seeds[at : at + FRONT]]), at
        own, next_seeds = queue.first(), ahead[at - ahead_at :]
        if own is None and not len(next_seeds):
            return
        symbol, pos, lcp = queue.peek() if own is not None else (next_seeds[:0],) * 3
        # a symbol's seeds come after all its tuples; neither side may run ahead of what isn't seen yet
        n_own, n_seeds = len(symbol), len(next_seeds)
        if n_seeds and at + n_seeds < len(seeds):
            n_own = int(np.searchsorted(symbol, next_seeds[-1], "right"))
        if own is not None:
            n_seeds = int(np.searchsorted(next_seeds, symbol[-1] if len(symbol) else own))
        if own is not None and not n_seeds and len(next_seeds) and not n_own:
            n_own = int(np.searchsorted(symbol, next_seeds[0], "right"))
        symbol, pos, lcp = symbol[:n_own], pos[:n_own], lcp[:n_own].astype(np.int64)
        is_seed = np.zeros(n_own, bool)
        if n_seeds:
            seed_pos, seed_symbol = np.asarray(seeds[at : at + n_seeds]), next_seeds[:n_seeds]
            seed_value = np.asarray(seed_lcp[at : at + n_seeds]).astype(np.int64)
            symbol, pos, lcp = np.concatenate([symbol, seed_symbol]), np.concatenate([pos, seed_pos]), np.concatenate([lcp, seed_value])
            is_seed = np.concatenate([is_seed, np.ones(n_seeds, bool)])
            if n_own:
                order = np.argsort(2 * symbol + is_seed, kind="stable")
                symbol, pos, lcp, is_seed = symbol[order], pos[order], lcp[order], is_seed[order]
        source = np.flatnonzero(pos > 0)
        target = way(text[pos[source] - 1])
        fit = (target > symbol[source]) | (target == symbol[source]) & ~is_seed[source]
        source, target = source[fit], target[fit]
        # only so many come before all that they add
        least = np.full(len(symbol), np.iinfo(np.int64).max)
        least[source] = 2 * target
        late = np.flatnonzero(np.minimum.accumulate(least)[:-1] < 2 * symbol[1:] + is_seed[1:])
        if len(late):
            n = int(late[0]) + 1
            symbol, pos, lcp, is_seed = symbol[:n], pos[:n], lcp[:n], is_seed[:n]
            keep = int(np.searchsorted(source, n))
            source, target = source[:keep], target[:keep]
        used = int(is_seed.sum())
        at += used
        queue.drop(len(symbol) - used, bool(len(late)))
        # where a symbol's first seed meets its last tuple
        prev_symbol, prev_pos, prev_seed = np.append(before[0], symbol[:-1]), np.append(before[1], pos[:-1]), np.append(before[2], is_seed[:-1])
        seam = np.flatnonzero(is_seed & ~prev_seed & (prev_symbol == symbol))
        if len(seam):
            lcp[seam] = np.minimum(_runs(text, prev_pos[seam], cap), _runs(text, pos[seam], cap))
        if len(source):
            order = np.argsort(target.astype(np.uint16) if top < 1024 else target, kind="stable")
            s, t = source[order], target[order]
            new = np.diff(t, prepend=-1) != 0
            value = np.zeros(len(s), np.int64)
            same = np.flatnonzero(~new)
            value[same] = _least_between(lcp, s[same - 1] + 1, s[same] + 1)
            head = np.flatnonzero(new)
            old = last[t[head]]
            value[head] = np.where(old < 0, -1, np.minimum(np.minimum.accumulate(lcp)[s[head]], history.since(old)))
            last[t[np.append(head[1:], len(t)) - 1]] = base + s[np.append(head[1:], len(s)) - 1]
            made = np.empty(len(s), np.int64)
            made[order] = np.minimum(value + 1, cap)
            queue.push(target, base + source, pos[source] - 1, made)
        history.add(base, lcp)
        base += len(symbol)
        before = (int(symbol[-1]), int(pos[-1]), bool(is_seed[-1]))
        yield pos, lcp, is_seed


def _lms(text: np.ndarray, folder: str, budget: int) -> np.ndarray:
    """Left-most S positions in the order of the text; its last symbol is the least and nowhere else."""
    n, step = len(text), 1 << 20

    def types(low: int, rising: bool) -> np.ndarray:
        """Which of a chunk's positions are S, from the type of the position after it."""
        change = np.sign(np.diff(np.asarray(text[low : min(n, low + step + 1)]).astype(np.int64)))[::-1]
        at = np.maximum.accumulate(np.where(change != 0, np.arange(len(change)), -1))
        return np.where(at >= 0, change[at] > 0, rising)[::-1]

    after, tape = [True], Tape(np.int64, folder, budget)
    lows = list(range(0, n - 1, step))
    for low in reversed(lows):
        after.append(bool(types(low, after[-1])[0]))
    for low, rising in zip(lows, after[-2::-1]):
        s = types(low, rising)
        tape.put(low + 1 + np.flatnonzero(np.append(s[1:], rising) & ~s))
    return tape.array()


def _named(text: np.ndarray, lms: np.ndarray, top: int, cap: int, folder: str, budget: int) -> tuple[np.ndarray, bool]:
    """Each left-most S substring's name, in the order of the text: names are ordered as the substrings; and whether all differ.

    Substrings are sorted by as many symbols as fit in a key; those that still agree go to the next round.  Ends rank last.
    """
    bits, m = (top + 2).bit_length(), len(lms)
    names = blank(m, np.int64, folder, budget)
    end = np.uint64((1 << bits) - 1)
    live, read, distinct = None, 0, 0
    while True:
        group_bits = m.bit_length() if read else 0
        per = max(1, min(7, (63 - group_bits) // bits))
        heap = Heap(folder, budget)
        for at in range(0, m if live is None else len(live), 1 << 18):
            i = np.arange(at, min(m, at + (1 << 18))) if live is None else np.asarray(live[at : at + (1 << 18)])
            start = np.asarray(lms[i])
            stop = np.where(i + 1 < m, lms[np.minimum(i + 1, m - 1)], start) + 1
            key = names[i].astype(np.uint64) if read else np.zeros(len(i), np.uint64)
            for k in range(read, read + per):
                p = start + k
                key = key << np.uint64(bits) | np.where(p < stop, text[np.minimum(p, len(text) - 1)].astype(np.uint64) + np.uint64(1), end)
            made = np.empty(len(i), RECORD)
            made["key"], made["pos"], made["lcp"] = key, i, 0
            heap.put(made)
        left = Tape(np.int64, folder, budget)
        place, group_at, sub_at, last_key, last_group = 0, 0, 0, None, None
        heap.step = 1 << 15
        while heap.first() is not None:
            now = heap.front
            heap.front = heap.front[:0]
            key, i = now["key"], now["pos"]
            group = (key >> np.uint64(per * bits)).astype(np.int64) if read else np.zeros(len(key), np.int64)
            new_sub = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            new_group = np.concatenate([[last_group is None or group[0] != last_group], group[1:] != group[:-1]])
            here = place + np.arange(len(key))
            sub = np.maximum.accumulate(np.where(new_sub, here, sub_at))
            whole = np.maximum.accumulate(np.where(new_group, here, group_at))
            names[i] = group + sub - whole
            distinct += int(new_sub.sum()) - (int(new_group.sum()) if read else 0)
            more = (key & end) != end
            if read + per < cap:
                alone = new_sub & np.append(new_sub[1:], False)
                left.put(i[more & ~alone])
            place, group_at, sub_at, last_key, last_group = place + len(key), int(whole[-1]), int(sub[-1]), key[-1], int(group[-1])
        live, read = left.array(), read + per
        if not len(live):
            return names, distinct == m


def _prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Length up to cap of the common prefixes at a and b, of which `known` is sure."""
    out, live = np.minimum(known, cap), np.flatnonzero(known < cap)
    while len(live):
        p, q = a[live] + out[live], b[live] + out[live]
        inside = np.flatnonzero((p < len(text)) & (q < len(text)))
        live = live[inside[text[p[inside]] == text[q[inside]]]]
        out[live] += 1
        live = live[out[live] < cap]
    return out


def _sorted_names(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion, for names that fit in memory: all suffixes in ascending order and how many names neighbours share.

    Ranks by 1, 2, 4, ... names, until they cover `cap` of the text's symbols (a substring is at least two long) or all differ.
    """
    ranks = [np.unique(names, return_inverse=True)[1]]
    while len(ranks[-1]) and ranks[-1].max() + 1 < len(names) and 1 << len(ranks) <= 2 * cap:
        step, now = 1 << len(ranks) - 1, ranks[-1]
        after = np.zeros(len(now), np.int64)
        after[:-step] = now[step:] + 1
        ranks.append(np.unique(now * (len(now) + 1) + after, return_inverse=True)[1])
    order = np.argsort(ranks[-1], kind="stable")
    low, high, shared = order[:-1], order[1:], np.zeros(max(0, len(order) - 1), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        p, q = low + shared, high + shared
        inside = np.flatnonzero(np.maximum(p, q) < len(names))
        shared[inside[ranks[k][p[inside]] == ranks[k][q[inside]]]] += 1 << k
    return order, np.append(0, shared)


def _ascending(chunks: Iterator[tuple], kind: bool, folder: str, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks' positions and common prefixes written down; kind: only the seeds or only the others."""
    pos, lcp = Tape(np.int64, folder, budget), Tape(np.int64, folder, budget)
    for p, c, is_seed in chunks:
        keep = is_seed == kind
        pos.put(p[keep])
        lcp.put(c[keep])
    return pos.array(), lcp.array()


def _turned(pos: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in the other direction: a common prefix belongs to the second of its pair."""
    return pos[::-1], np.concatenate([[0], lcp[:0:-1]]) if not isinstance(lcp, np.memmap) else _Shifted(lcp)


class _Shifted:
    """lcp[:0:-1] after a zero, read from its file as needed."""

    def __init__(self, lcp: np.ndarray):
        self.lcp = lcp

    def __getitem__(self, part: slice) -> np.ndarray:
        n = len(self.lcp)
        low, high = part.start, min(part.stop, n)
        values = np.asarray(self.lcp[n - high + 1 : n - low + 1])[::-1]
        return np.concatenate([[0], values]) if low == 0 else values


def descending_suffixes(text: np.ndarray, top: int, cap: int, folder: str, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All suffixes but the last symbol's, in descending order: (positions, common prefix with the one before, unused).

    text ends in a 0 that is nowhere else; `top` is its largest symbol, `cap` at most 65,000.
    """
    lms = _lms(text, folder, budget)
    if not len(lms):
        return
    names, distinct = _named(text, lms, top, cap, folder, budget)
    m = len(lms)
    order = blank(m, np.int64, folder, budget)
    known = blank(m, np.int64, folder, budget)
    if distinct:
        for at in range(0, m, 1 << 20):
            order[names[at : at + (1 << 20)]] = np.arange(at, min(m, at + (1 << 20)))
    elif m * NAME_BYTES <= budget * SHARES:
        order, known = _sorted_names(np.asarray(names), cap)
    else:
        order[0] = m - 1
        at = m
        for pos, lcp, _ in descending_suffixes(names, m, cap, folder, budget):
            order[at - len(pos) : at] = pos[::-1]
            # a value belongs to the larger suffix of its pair, which is the one before in this direction
            high = np.arange(at, at - len(pos), -1)
            keep = high < m
            known[high[keep]] = lcp[keep]
            at -= len(pos)
    seeds, seed_lcp = Tape(np.int64, folder, budget), Tape(np.int64, folder, budget)
    for at in range(0, m, 1 << 18):
        i = np.asarray(order[at : at + (1 << 18)])
        p = np.asarray(lms[i])
        prev = np.concatenate([[order[at - 1] if at else i[0]], i[:-1]])
        same = np.asarray(known[at : at + (1 << 18)])  # so many whole substrings agree: both are as long up to there
        ahead = np.minimum(prev + same, m - 1)
        lcp = _prefixes(text, lms[prev], p, lms[ahead] - lms[prev], cap)
        if at == 0:
            lcp[0] = 0
        seeds.put(p)
        seed_lcp.put(lcp)
    first = _induce(text, seeds.array(), seed_lcp.array(), top, False, cap, folder, budget)
    large, large_lcp = _turned(*_ascending(first, False, folder, budget))
    yield from _induce(text, large, large_lcp, top, True, cap, folder, budget)


class Shard:
    """Segments put together on disk; which of their windows of `width` bytes start more than once among them."""

    def __init__(self, width: int, memory_bytes: int):
        self.width, self.budget, self.folder = width, memory_bytes // SHARES, scratch()
        self.text, self.ends, self.n = Tape(np.uint16, self.folder.name, self.budget), Tape(np.int64, self.folder.name, self.budget), 0

    def add(self, segments: list[bytes]) -> None:
        """Segments follow each other with a 1 between them; bytes are symbols 2 to 257."""
        if segments:
            sizes = np.array([len(s) + 1 for s in segments])
            data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 2
            ends = np.cumsum(sizes)
            data[ends - 1] = 1
            self.text.put(data)
            self.ends.put(self.n + ends - 1)
            self.n += int(ends[-1])

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of repeated windows, as places in the text put together: starts and ends, none crossing segments."""
        self.text.put(np.zeros(1, np.uint16))
        text, ends = self.text.array(), self.ends.array()
        hit, last = blank(len(text), bool, self.folder.name, self.budget), np.empty(0, np.int64)
        for pos, lcp, _ in descending_suffixes(text, 257, self.width, self.folder.name, self.budget):
            agree = lcp >= self.width
            both = np.concatenate([last, pos])
            marked = np.zeros(len(both), bool)
            marked[len(last) :] = agree
            if len(last):
                marked[:-1] |= agree
            else:
                marked[:-1] |= agree[1:]
            at = both[marked]
            hit[at[ends[np.searchsorted(ends, at)] - at >= self.width]] = True  # windows that cross segments don't count
            last = pos[-1:].copy()
        starts, stops = Tape(np.int64, self.folder.name, self.budget), Tape(np.int64, self.folder.name, self.budget)
        held = False
        for at in range(0, len(text), 1 << 20):
            part = np.asarray(hit[at : at + (1 << 20)])
            change = np.flatnonzero(np.diff(part, prepend=held))
            up = part[change]
            starts.put(at + change[up])
            stops.put(at + change[~up])
            held = bool(part[-1])
        return starts.array(), stops.array()

    def close(self) -> None:
        self.folder.cleanup()


def repeated_windows(segments: list[bytes], width: int, memory_bytes: int = 64 << 20) -> list[np.ndarray]:
    """For each segment, which of its windows of `width` bytes start anywhere else in the segments."""
    shard = Shard(width, memory_bytes)
    shard.add(segments)
    starts, stops = shard.repeated()
    hit = np.zeros(shard.n + 1, np.int64)
    np.add.at(hit, starts, 1)
    np.add.at(hit, stops, -1)
    hit = np.cumsum(hit) > 0
    ends = np.cumsum([len(s) + 1 for s in segments])
    shard.close()
    return [hit[e - 1 - len(s) : e - 1][: max(0, len(s) - width + 1)] for s, e in zip(segments, ends)]
