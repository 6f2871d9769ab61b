"""Nearest records by word edits: a metric tree over the records, dealt out by leaves.

The upper part of the tree is fitted on a bounded sample: a node's vantage record splits records by their distance to it, at
the median.  Every record walks down to a leaf and leaves its distances to the vantage records on its way; their least and
largest at each leaf give a lower bound for any text by the triangle inequality.  A text first searches its own leaf, then
every leaf whose bound does not exceed what was found.  Within a leaf records stand in a Burkhard-Keller tree, pruned by the
same inequality.  Leaves meet texts by a join on the leaf, in parts where many texts or records share one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import kept, slices

#: Word edits allowed up to a length, and beyond the last.
BUDGETS, BEYOND = ((4, 1), (10, 2)), 3


def budget(n: int) -> int:
    return next((b for size, b in BUDGETS if n <= size), BEYOND)


class Words:
    """A text's words as bits of whole numbers, so that an edit distance takes a few operations for each word of the other text."""

    def __init__(self, words: Sequence[str]):
        self.n = len(words)
        self.at: dict[str, int] = {}
        for i, w in enumerate(words):
            self.at[w] = self.at.get(w, 0) | 1 << i

    def distance(self, other: Sequence[str]) -> int:
        """Edits of whole words between both texts."""
        if not self.n:
            return len(other)
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        for w in other:
            same = self.at.get(w, 0)
            diagonal = ((((same & up) + up) ^ up) | same | down) & full
            rise, fall = down | (full & ~(diagonal | up)), up & diagonal
            score += bool(rise & high) - bool(fall & high)
            rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
            up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        return score


class Vantage:
    """The upper tree.  A node is (record, radius, near child, far child); a child is a node's number or, if negative, leaf -1 - child."""

    def __init__(self, sample: list[list[str]], leaf_rows: float):
        self.nodes: list[list] = []
        self.leaves = 0
        self.root = self._grow(sorted(sample), max(leaf_rows, 2.0))

    def _grow(self, rows: list, most: float) -> int:
        if len(rows) > most:
            at = len(rows) // 2
            own = Words(rows[at])
            far = [own.distance(r) for r in rows]
            radius = sorted(far)[len(far) // 2]
            near = [r for r, d in zip(rows, far) if d <= radius]
            rest = [r for r, d in zip(rows, far) if d > radius]
            if rest:
                node = len(self.nodes)
                self.nodes.append([rows[at], radius, None, None])
                self.nodes[node][2], self.nodes[node][3] = self._grow(near, most), self._grow(rest, most)
                return node
        self.leaves += 1
        return -self.leaves

    def home(self, words: Sequence[str]) -> tuple[int, list[int], list[int]]:
        """The leaf of a text, and the nodes passed with its distances to their records."""
        own, node, passed, far = Words(words), self.root, [], []
        while node >= 0:
            record, radius, near, rest = self.nodes[node]
            d = own.distance(record)
            passed.append(node)
            far.append(d)
            node = near if d <= radius else rest
        return -1 - node, passed, far

    def within(self, words: Sequence[str], limit: int, reach: dict[int, dict[int, tuple[int, int]]]) -> list[int]:
        """Leaves that may hold a record at most `limit` edits away; reach[leaf][node] is the leaf's least and largest distance."""
        own, known = Words(words), {}
        out = []
        for leaf, nodes in reach.items():
            for node, (low, high) in nodes.items():
                if node not in known:
                    known[node] = own.distance(self.nodes[node][0])
                if known[node] - high > limit or low - known[node] > limit:
                    break
            else:
                out.append(leaf)
        return out


class Tree:
    """Burkhard-Keller tree of (record number, words)."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.rows, self.children = rows, [{} for _ in rows]
        for i in range(1, len(rows)):
            own, node = Words(rows[i][1]), 0
            while True:
                d = own.distance(rows[node][1])
                if d not in self.children[node]:
                    self.children[node][d] = i
                    break
                node = self.children[node][d]

    def nearest(self, words: Sequence[str], best: tuple | None) -> tuple | None:
        """The least of (far, distance, length difference, record, length), where far is 0 within the budget of the longer text, else 1."""
        own, open_ = Words(words), [0] if self.rows else []
        while open_:
            node = open_.pop()
            item, record = self.rows[node]
            d = own.distance(record)
            near = own.n > 0 and d <= budget(max(own.n, len(record)))
            found = (0 if near else 1, d, abs(own.n - len(record)), item, len(record))
            best = found if best is None else min(best, found)
            # a record within its budget goes before all others, however near they are
            limit = best[1] if best[0] == 0 else max(best[1], BEYOND)
            open_ += [child for edge, child in self.children[node].items() if abs(edge - d) <= limit]
        return best


_FOUND = "far int, distance int, gap int, item_id long, m int"


def nearest_records(texts: DataFrame, records: DataFrame, leaf_rows: int = 2000, sample_rows: int = 10_000, part_rows: int = 2000) -> DataFrame:
    """(dw, item_id, distance, gap, m, near) for every row of texts(dw), distinct arrays of words: its nearest record, records(item_id, rw, m).

    Records within the budget of the longer text go first (near), then by distance, length difference and item_id.  Texts
    and records need share no word; a text without words is nearest to the shortest record.  No records: item_id is null.
    The upper tree is fitted on about `sample_rows` records drawn by a hash; every record is searched, exactly.
    """
    spark = texts.sparkSession
    texts, records = kept(texts.select("dw"), "asked-words"), kept(records.select("item_id", "rw", "m"), "tree-records")
    total = records.count()
    share = F.pmod(F.xxhash64("rw"), F.lit(1 << 20)) < int(min(1.0, sample_rows / max(total, 1)) * (1 << 20))
    sample = [list(r.rw) for r in records.filter(share).select("rw").collect()]
    top = spark.sparkContext.broadcast(Vantage(sample, leaf_rows * max(len(sample), 1) / max(total, 1)))

    def place(batches):
        for b in slices(batches, 1024):
            found = [top.value.home(w) for w in b.column("rw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("rw"), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.list_(pa.int32()))], ["item_id", "rw", "leaf", "nodes", "far"])

    leaves = kept(records.select("item_id", "rw").mapInArrow(place, "item_id long, rw array<string>, leaf int, nodes array<int>, far array<int>"), "tree-leaves")
    bounds = leaves.select("leaf", F.posexplode("nodes").alias("at", "node"), "far").groupBy("leaf", "node").agg(F.min(F.expr("far[at]")).alias("low"), F.max(F.expr("far[at]")).alias("high")).collect()  # leaves times depth
    reach: dict[int, dict] = {r.leaf: {} for r in leaves.select("leaf").distinct().collect()}
    for r in bounds:
        reach[r.leaf][r.node] = (r.low, r.high)
    spans = spark.sparkContext.broadcast(reach)
    row_parts = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * leaf_rows)).alias("row_parts"))

    def ask(first: bool):
        def run(batches):
            for b in slices(batches, 1024):
                rows, leaf = [], []
                for i, w in enumerate(b.column("dw").to_pylist()):
                    home = top.value.home(w)[0]
                    if first:
                        visit = [home] if home in spans.value else []
                    else:
                        far, d = (b.column(c)[i].as_py() for c in ("far", "distance"))
                        limit = (d if far == 0 else max(d, BEYOND)) if d is not None else 1 << 30
                        visit = [x for x in top.value.within(w, limit, spans.value) if x != home]
                    rows += [i] * len(visit)
                    leaf += visit
                yield pa.RecordBatch.from_arrays([c.take(pa.array(rows, pa.int64())) for c in b.columns] + [pa.array(leaf, pa.int32())], [*b.schema.names, "leaf"])

        return run

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        tree = Tree(list(zip(held.column("item_id").to_pylist(), held.column("rw").to_pylist())))
        out = [(w, *found) for w, b in zip(asked.column("dw").to_pylist(), asked.column("b").to_pylist()) if (found := tree.nearest(w, tuple(b.values()) if b else None)) is not None]
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("dw", "far", "distance", "gap", "item_id", "m"), columns, (pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))})

    def met(asked: DataFrame) -> DataFrame:
        asked = kept(asked, "asked-leaves")
        sizes = asked.groupBy("leaf").agg(F.ceil(F.count("*") / part_rows).alias("ask_parts")).join(row_parts, "leaf")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = asked.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("dw"), "ask_parts").alias("ap"), each("row_parts").alias("rp"), "dw", "b")
        right = leaves.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("rw"), "row_parts").alias("rp"), each("ask_parts").alias("ap"), "item_id", "rw")
        key = ["leaf", "ap", "rp"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, f"dw array<string>, {_FOUND}")

    best = F.min(F.struct("far", "distance", "gap", "item_id", "m")).alias("b")
    none = F.lit(None).cast(f"struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>").alias("b")
    own = met(texts.select("dw", none).mapInArrow(ask(True), f"dw array<string>, b struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>, leaf int"))
    own = kept(texts.join(own.groupBy("dw").agg(best), "dw", "left"), "own-leaf")
    kind = f"dw array<string>, b struct<{_FOUND.replace(' ', ':').replace(',:', ',')}>, far int, distance int, leaf int"
    others = met(own.select("dw", "b", "b.far", "b.distance").mapInArrow(ask(False), kind).select("dw", "b", "leaf"))
    every = own.select("dw", "b").unionByName(others.groupBy("dw").agg(best)).filter("b is not null").groupBy("dw").agg(F.min("b").alias("b"))
    return texts.join(every, "dw", "left").select("dw", "b.item_id", "b.distance", "b.gap", "b.m", F.coalesce(F.col("b.far") == 0, F.lit(False)).alias("near"))
