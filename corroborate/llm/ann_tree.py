"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is then put into its leaf.  A query walks the tree with a priority queue
of nodes, nearest centre first, and so orders the leaves.  How many leaves it visits is calibrated: for some queries the
true neighbours are found by brute force over all rows, and the visits widen until the leaves visited hold the wanted
share of them.  Queries then meet rows in bins of neighbouring leaves, large bins in salted parts.

Equal vectors are indexed once with their smallest k + 1 identifiers; no others can be among the k nearest of anything.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


class Tree:
    """Nodes in an array; centres[i] of node i; children[i] a list, empty for a leaf."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, branch: int = 8, seed: int = 7):
        self.centres, self.children = [sample.mean(0)], [[]]
        rng = np.random.default_rng(seed)
        open_ = [(0, sample)]
        while open_:
            node, rows = open_.pop()
            if len(rows) <= max(leaf_rows, 1):
                continue
            centres, label = _kmeans(rows, min(branch, len(rows)), rng)
            parts = [rows[label == c] for c in range(len(centres))]
            if max(map(len, parts)) == len(rows):
                continue
            for c, part in zip(centres, parts):
                if len(part):
                    self.children[node].append(len(self.centres))
                    self.centres.append(c)
                    self.children.append([])
                    open_.append((self.children[node][-1], part))
        self.centres = np.array(self.centres)

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def bins(self, sizes: dict[int, int], most: int) -> dict[int, int]:
        """Leaves, from left to right, put together until a bin would hold more than `most` rows."""
        out, name, n, open_ = {}, 0, 0, [0]
        while open_:
            node = open_.pop()
            open_ += self.children[node][::-1]
            if not self.children[node] and sizes.get(node):
                if n and n + sizes[node] > most:
                    name, n = name + 1, 0
                out[node] = name
                n += sizes[node]
        return out

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into, nearest centre by nearest centre."""
        out = np.zeros(len(rows), np.int64)
        open_ = [(0, np.arange(len(rows)))]
        while open_:
            node, at = open_.pop()
            out[at] = node
            if self.children[node] and len(at):
                near = _squares(rows[at], self.centres[self.children[node]]).argmin(1)
                open_ += [(child, at[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int | None = None) -> list[int]:
        """Leaves in the order of a best-bin-first walk."""
        out, queue = [], [(0.0, 0)]
        while queue and (most is None or len(out) < most):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(node)
                continue
            for d, child in zip(((self.centres[self.children[node]] - query) ** 2).sum(1).tolist(), self.children[node]):
                heapq.heappush(queue, (d, child))
        return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    label = _squares(rows, centres).argmin(1)
    for _ in range(rounds):
        for c in range(k):
            if (label == c).any():
                centres[c] = rows[label == c].mean(0)
        label = _squares(rows, centres).argmin(1)
    return centres, label


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _nearest(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k nearest rows (ties to the smaller id) and their distances."""
    d = np.sqrt(((rows - query) ** 2).sum(1))
    if len(d) > k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        at = np.arange(len(d))
    at = at[np.lexsort((ids[at], d[at]))][:k]
    return at, d[at]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part: vectors not null, not zero, all components finite, of the commonest length."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (size.n if size else -1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97, leaf_rows: int = 256, sample_rows: int = 20_000, calibrate: int = 100, part_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query found, nearest first, ties to the smaller id;
    score is the Euclidean distance in double precision.

    Vectors that are null, zero, of another length than most or hold null or non-finite components take no part, nor do null
    ids; of rows that repeat an id each is a candidate.  A query's id is asked once, with the smallest of its vectors that take
    part in `vectors`, and no row of that id is its neighbour.  Fewer than k other rows: all of them.  Other columns are
    ignored.  The tree is fitted on about `sample_rows` rows drawn by a hash of the id, the visits on about `calibrate`
    queries; every row is indexed.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], empty)
    least = Window.partitionBy("v").orderBy("id")
    indexed = rows.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).drop("n")
    draw = lambda df, n, of: df.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, n / max(of, 1)) * (1 << 30))))
    sample = np.array([r.v for r in draw(rows, sample_rows, total).select("v").collect()] or [rows.first().v])
    tree = spark.sparkContext.broadcast(Tree(sample, max(8.0, leaf_rows * len(sample) / total)))

    def put(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(tree.value.leaf_of(_matrix(b.column("v"))) if b.num_rows else [], pa.int64())], ["id", "v", "leaf"])

    index = written(indexed.mapInArrow(put, "id long, v array<double>, leaf long"), "index")
    ids = queries.select(queries[id_col].cast("long").alias("query")).distinct()
    asked = written(rows.join(ids, rows["id"] == ids["query"]).groupBy("query").agg(F.min("v").alias("v")), "asked")
    n_asked = asked.count()
    visits = _calibrate(index, draw(asked.withColumnRenamed("query", "id"), calibrate, n_asked), tree, k, recall)

    # neighbouring leaves share a bin of about part_rows rows, so that a query gets one short list from a bin
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}  # one row for each leaf of the tree
    bins = tree.value.bins(sizes, part_rows)
    where = spark.sparkContext.broadcast(bins)
    held: dict[int, int] = {}
    for leaf, n in sizes.items():
        held[bins[leaf]] = held.get(bins[leaf], 0) + n
    placed = spark.createDataFrame([(leaf, bins[leaf], -(-held[bins[leaf]] // (2 * part_rows))) for leaf in sizes], "leaf long, bin long, row_parts long")

    def walk(batches):
        for b in batches:
            rows_, bins_, lists = [], [], []
            for i, q in enumerate(_matrix(b.column("v")) if b.num_rows else []):
                by: dict[int, list[int]] = {}
                for leaf in tree.value.visits(q, visits):
                    if leaf in where.value:
                        by.setdefault(where.value[leaf], []).append(leaf)
                rows_ += [i] * len(by)
                bins_ += by
                lists += by.values()
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(rows_, pa.int64())), b.column("v").take(pa.array(rows_, pa.int64())), pa.array(bins_, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["query", "v", "bin", "leaves"])

    walked = written(asked.mapInArrow(walk, "query long, v array<double>, bin long, leaves array<long>"), "walked")
    per_bin = placed.select("bin", "row_parts").distinct().join(walked.groupBy("bin").agg(F.ceil(F.count("*") / part_rows).alias("query_parts")), "bin")
    parts = F.broadcast(written(per_bin, "parts"))  # fewer rows than the tree has leaves
    spread = lambda p: F.explode(F.sequence(F.lit(0).cast("long"), F.col(p) - 1))
    left = walked.join(parts, "bin").select("query", "v", "leaves", "bin", F.pmod(F.xxhash64("query"), "query_parts").alias("qp"), spread("row_parts").alias("rp"))
    right = index.join(F.broadcast(placed.select("leaf", "bin")), "leaf").join(parts, "bin").select("id", "v", "leaf", "bin", F.pmod(F.xxhash64("id"), "row_parts").alias("rp"), spread("query_parts").alias("qp"))

    def meet(_, asks: pa.Table, have: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if asks.num_rows and have.num_rows:
            have = have.sort_by("leaf")
            q, v = (_matrix(t.column("v").combine_chunks()) for t in (asks, have))
            ids, leaf = have.column("id").to_numpy(), have.column("leaf").to_numpy()
            for query, x, leaves in zip(asks.column("query").to_pylist(), q, asks.column("leaves").to_pylist()):
                low, high = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(low, high)])
                at = at[ids[at] != query]
                best, d = _nearest(x, v[at], ids[at], k)
                out[0] += [query] * len(best)
                out[1] += ids[at][best].tolist()
                out[2] += d.tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    keys = ["bin", "qp", "rp"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrate(index: DataFrame, some: DataFrame, tree, k: int, recall: float) -> int:
    """Leaves to visit so that they hold the wanted share of the true neighbours of some queries."""
    tests = some.collect()  # about as many as asked for, whatever the table's size
    if not tests:
        return tree.value.leaves()
    shared = index.sparkSession.sparkContext.broadcast(([r.id for r in tests], np.array([r.v for r in tests])))

    def brute(batches):
        ids, queries = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            rows, names, leaf = _matrix(b.column("v")), b.column("id").to_numpy(), b.column("leaf").to_numpy()
            out = []
            for i, q in zip(ids, queries):
                other = np.flatnonzero(names != i)
                at, d = _nearest(q, rows[other], names[other], k)
                out += zip([i] * len(at), names[other[at]].tolist(), leaf[other[at]].tolist(), d.tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query", "id", "leaf", "d"])

    true = index.mapInArrow(brute, "query long, id long, leaf long, d double")
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).filter(F.col("rank") <= k).collect()
    order = {i: {leaf: n for n, leaf in enumerate(tree.value.visits(np.array(q)), 1)} for i, q in tests}
    needed = np.sort([order[r.query][r.leaf] for r in true]) if true else np.array([1])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
