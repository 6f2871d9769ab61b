"""Many patterns in one pass: a trie of sequences with failure links."""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable, Iterator, Sequence


class Patterns:
    """Finds all of a set of patterns, sequences of words or of characters, in a sequence, reading each element once."""

    def __init__(self, patterns: Iterable[Sequence[Hashable]]):
        self.patterns = [tuple(p) for p in patterns]
        self.next: list[dict] = [{}]
        self.ends: list[list[int]] = [[]]
        for i, pattern in enumerate(self.patterns):
            if not pattern:
                continue
            node = 0
            for x in pattern:
                if x not in self.next[node]:
                    self.next[node][x] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                node = self.next[node][x]
            self.ends[node].append(i)
        # back[node]: the longest proper suffix of the node's path that is a path; said[node]: the next one at which a pattern ends
        self.back, self.said = [0] * len(self.next), [0] * len(self.next)
        open_ = deque(self.next[0].values())
        while open_:
            node = open_.popleft()
            for x, child in self.next[node].items():
                self.back[child] = self.step(self.back[node], x)
                open_.append(child)
            back = self.back[node]
            self.said[node] = back if self.ends[back] else self.said[back]

    def step(self, node: int, x: Hashable) -> int:
        while node and x not in self.next[node]:
            node = self.back[node]
        return self.next[node].get(x, 0)

    def find(self, sequence: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence, by its end."""
        node = 0
        for at, x in enumerate(sequence, 1):
            node = hit = self.step(node, x)
            while hit:
                for i in self.ends[hit]:
                    yield at - len(self.patterns[i]), i
                hit = self.said[hit]


def grouped(patterns: Sequence[Sequence[Hashable]], most: int) -> list[list[int]]:
    """Numbers of patterns in groups of at most `most` elements together, so that no automaton outgrows what a task may be sent."""
    out: list[list[int]] = []
    size = most + 1
    for i, p in enumerate(patterns):
        if size + len(p) > most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(p)
    return out
