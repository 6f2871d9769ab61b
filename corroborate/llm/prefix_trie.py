"""Prefix trie of conversations: sparse-table range minima over sorted common-prefix lengths.

A turn is two 64-bit hashes of (role, text) and its place, so texts are read once and never shuffled.  Equal conversations
become one row with a weight.  The rows are sorted by their turns and dealt in ranges to shards.  In a shard, a sparse table
holds the minima of the common-prefix lengths of neighbouring rows; every prefix of every row searches how far left and how
far right the minimum stays at its depth.  Those intervals are the trie's nodes: members, leaves and tokens under a node are
sums over its interval, and the smallest member is a range minimum.  A node whose interval meets a shard's edge is
completed by its parts in other shards, which carry the same key: depth and the exclusive or of its turns' hashes.

A row holds what a conversation shares with another one, and at most `chunk` turns more; what follows is a path of its own,
worked out from the turns.  Places and running sums are by ranges too, so one conversation may hold any share of the turns.
Equality rests on 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .spelling import CRC_TABLE, crc_sql

KEY = ["depth", "k1", "k2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def running(rows: DataFrame, key: str, order: list, **sums) -> DataFrame:
    """rows with a running aggregate under each name of `sums`, (aggregate, column), within `key` in the given order.

    Ranges of (key, order) are summed each for itself and get what earlier ranges of the same key hold, so that a key with
    any share of the rows is spread over tasks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    whole = rows.groupBy("_part", key).agg(*[f(c).alias(f"_{n}") for n, (f, c) in sums.items()])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = whole.select("_part", key, *[f(f"_{n}").over(earlier).alias(f"_{n}") if f is not F.count else F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n, (f, _) in sums.items()])
    so_far = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("*", *[f(c).over(so_far).alias(n) for n, (f, c) in sums.items()]).join(before, ["_part", key])
    join = {n: F.col(n).bitwiseXOR(F.coalesce(f"_{n}", F.lit(0))) if f is F.bit_xor else F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n, (f, _) in sums.items()}
    return out.withColumns(join).drop("_part", *[f"_{n}" for n in sums])


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key, words): every turn with its place from 1 in its conversation, a digest of (role, text) and its number of words.

    Turns are ordered by turn, null first, then by digest; null role or text is empty; rows without a conversation are left out.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].alias("turn"), key.alias("key"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")).filter("conv is not null")
    return running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("key")], pos=(F.count, "key")).drop("turn")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings, and all their names, from turns(conv, pos, key, words).

    Conversation c has the first h turns of conversation c - c % family (all if fewer), then its own after the first h, where
    h is the unsigned crc32 of c in decimal modulo `most`.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most))
    convs = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % family)
    convs = written(convs, "convs")
    heads = turns.filter(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "key", "words")
    named = convs.join(convs.select(F.col("conv").alias("base"), F.col("own").alias("held")), "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken"))
    first = named.filter("taken > 0").withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken")))).join(heads, ["base", "pos"]).select("conv", "pos", "key", "words")
    own = turns.withColumn("h", h).filter("pos > h").join(named.select("conv", "taken"), "conv").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words")
    return first.union(own), convs.select("conv")


# --- one shard ------------------------------------------------------------------------------------------------------


class Minima:
    """Sparse table: level j holds the minima of 2^j values from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values)]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of [low, high) for each pair, none empty."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for j in np.unique(level):
            at = level == j
            out[at] = np.minimum(self.levels[j][low[at]], self.levels[j][high[at] - (1 << j)])
        return out

    def reach_right(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The first place from `at` on whose value is below floor, by binary search; the number of values if there is none."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            may = np.flatnonzero(at + (1 << j) <= len(self.levels[0]))
            may = may[self.levels[j][at[may]] >= floor[may]]
            at[may] += 1 << j
        return at

    def reach_left(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The least place from which all values up to `at` (without it) are at least floor."""
        at = at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            may = np.flatnonzero(at >= 1 << j)
            may = may[self.levels[j][at[may] - (1 << j)] >= floor[may]]
            at[may] -= 1 << j
        return at


class Shard:
    """Sorted rows and their prefixes.  Prefix p is of row `row[p]` and depth `depth[p]`; depth 0 comes first in each row."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("at")
        turns = rows.column("turns").combine_chunks()
        size = np.diff(turns.offsets.to_numpy()) // 2
        flat = turns.flatten().to_numpy().reshape(-1, 2)
        self.n, self.size = len(size), size
        self.start = np.concatenate([[0], np.cumsum(size + 1)])
        self.row = np.repeat(np.arange(self.n), size + 1)
        self.depth = np.arange(len(self.row)) - self.start[self.row]
        full = np.zeros((len(self.row), 2), np.int64)
        full[self.depth > 0] = flat
        total = np.bitwise_xor.accumulate(full, 0)
        self.key = total ^ total[self.start[self.row]]  # at depth 0 nothing is added, so that is the sum of all rows before
        self.words = np.zeros(len(self.row), np.int64)
        self.words[self.depth > 0] = rows.column("words").combine_chunks().flatten().to_numpy()
        self.w, self.least, self.extra = (rows.column(c).to_numpy() for c in ("w", "conv", "extra"))
        self.common = np.zeros(max(self.n - 1, 0), np.int64)
        open_ = np.arange(self.n - 1)
        for d in range(1, int(size.max(initial=0)) + 1):
            open_ = open_[(size[open_] >= d) & (size[open_ + 1] >= d)]
            open_ = open_[(full[self.start[open_] + d] == full[self.start[open_ + 1] + d]).all(1)]
            if not len(open_):
                break
            self.common[open_] = d
        minima = Minima(self.common)
        left = minima.reach_left(self.row, self.depth)
        self.high = minima.reach_right(self.row, self.depth) + 1
        self.nodes = np.flatnonzero(left == self.row)  # each interval is found by all its rows; the first one stands for it

    def sums(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of a value of each row over the intervals of the prefixes `at`."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.high[at]] - total[self.row[at]]

    def crossing(self, before: int, after: int) -> np.ndarray:
        """Nodes that go on in the shard before (it shares `before` turns with the first row) or after."""
        at = self.nodes
        return at[((self.row[at] == 0) & (self.depth[at] <= before)) | ((self.high[at] == self.n) & (self.depth[at] <= after))]


def _edges(shard: tuple, rows: pa.Table, edge: pa.Table) -> pa.Table:
    """Nodes that other shards share, with their members here."""
    s = Shard(rows)
    at = s.crossing(edge.column("before")[0].as_py(), edge.column("after")[0].as_py())
    return pa.table({"shard": pa.array([shard[0].as_py()] * len(at), pa.int64()), "depth": s.depth[at], "k1": s.key[at, 0], "k2": s.key[at, 1], "w": s.sums(s.w, at)})


def _nodes(shard: tuple, rows: pa.Table, shared: pa.Table) -> pa.Table:
    """All nodes with what this shard adds to them.  shared: nodes that other shards hold too, their members and first shard."""
    s = Shard(rows)
    at = s.nodes
    w = s.sums(s.w, at)
    n, mine = w.copy(), np.ones(len(at), bool)
    place = {k: i for i, k in enumerate(zip(s.depth[at].tolist(), s.key[at, 0].tolist(), s.key[at, 1].tolist()))} if shared.num_rows else {}
    after = 0
    for depth, k1, k2, whole, first, next_ in zip(*(shared.column(c).to_pylist() for c in ("depth", "k1", "k2", "whole", "first", "after"))):
        i = place[depth, k1, k2]
        n[i], mine[i], after = whole, first == shard[0].as_py(), next_
    own = np.zeros(len(s.row), np.int64)
    own[at] = (n - 1) * s.words[at] * mine  # a node's tokens count once, in its first shard
    total = np.concatenate([[0], np.cumsum(own)])
    of_row = total[s.start[1:]] - total[s.start[:-1]] + s.extra
    # of the node's own row only prefixes from its depth on lie under it; other rows own nothing above it
    saved = s.sums(of_row, at) - (total[at] - total[s.start[s.row[at]]])
    leaf = (np.append(s.common, after) < s.size).astype(np.int64)
    up = np.maximum(at - 1, 0)
    root = s.depth[at] == 0
    parent = [pa.array(s.key[up, i], mask=root) for i in (0, 1)]
    least = Minima(s.least).of(s.row[at], s.high[at]) if len(at) else s.least
    return pa.table({"depth": s.depth[at], "k1": s.key[at, 0], "k2": s.key[at, 1], "p1": parent[0], "p2": parent[1], "w": w, "conv": least, "leaves": s.sums(leaf, at), "saved": saved})


def _shared_by_neighbours(batches):
    for b in batches:
        out = []
        for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist()):
            d = next((i for i, (x, y) in enumerate(zip(low or [], high or [])) if x != y), min(len(low or []), len(high or [])))
            out.append(d // 2 if low is not None and high is not None else -1)
        yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(out, pa.int64())], ["shard", "common"])


# --- member lists ---------------------------------------------------------------------------------------------------


def _pieces(batches):
    """Sorted rows (key, conv) become comma-joined pieces of some 64 KB."""
    held: list[str] = []
    size, key, first = 0, None, None
    out: list = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in (*KEY, "conv"))):
            if row[:3] != key or size > 1 << 16:
                if held:
                    out.append((*key, first, ",".join(held)))
                held, size, key, first = [], 0, row[:3], row[3]
            held.append(str(row[3]))
            size += len(held[-1]) + 1
        if len(out) >= 256:
            yield _batch(out, "piece")
            out = []
    if held:
        out.append((*key, first, ",".join(held)))
    yield _batch(out, "piece")


def _batch(rows: list[tuple], last: str) -> pa.RecordBatch:
    names = [*KEY, "first", last] if last == "piece" else [*KEY, last]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == last else pa.int64()) for n, c in zip(names, columns)], names)


def _digests(batches):
    """Pieces of a key, one after another, go through one hash; nothing else of them is held."""
    key, h = None, None
    for b in batches:
        out = []
        for *k, piece in zip(*(b.column(c).to_pylist() for c in (*KEY, "piece"))):
            if k == key:
                h.update(b"," + piece.encode())
            else:
                if key:
                    out.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256(piece.encode())
        yield _batch(out, "ends")
    if key:
        yield _batch([(*key, h.hexdigest())], "ends")


def _member_digests(members: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends): SHA-256 of the numbers, in order and comma-joined, of the conversations that end in a node."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*KEY, "conv"]
    pieces = members.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, piece string")
    return pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends string")


# --- the trie -------------------------------------------------------------------------------------------------------


def trie(turns: DataFrame, convs: DataFrame, chunk: int = 64, shard_turns: int = 200_000) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns(conv, pos, key, words) are the turns of the conversations convs(conv), pos from 1 without gaps; a conversation
    without turns is a member of the root only.  No conversation: no node.
    """
    spark = turns.sparkSession
    sums = [F.count("*").alias("depth"), F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2")]
    x = lambda at: F.xxhash64(F.substring("key", at, 8), "pos")
    turns = written(turns.select("conv", "pos", x(1).alias("x1"), x(9).alias("x2"), "words"), "turns")
    whole = turns.groupBy("conv").agg(*sums)
    members = written(convs.distinct().join(whole, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in KEY]), "members")
    alike = written(members.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("w")), "alike")
    long_ = alike.filter(F.col("depth") > chunk).select("conv", "w", "depth")
    tail = running(turns.join(long_, "conv"), "conv", [F.col("pos")], k1=(F.bit_xor, "x1"), k2=(F.bit_xor, "x2"), so_far=(F.sum, "words"))
    tail = written(tail, "tail")
    marks = tail.filter(F.col("pos") % chunk == 0).select("conv", "pos", "k1", "k2")
    several = marks.groupBy("pos", "k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keeps = marks.join(several, ["pos", "k1", "k2"]).groupBy("conv").agg(F.max("pos").alias("shared"))
    ends = tail.filter("pos = depth").select("conv", F.col("so_far").alias("all_words"))
    # a conversation's row ends one chunk after the last mark that it shares
    keeps = written(long_.join(ends, "conv").join(keeps, "conv", "left").select("conv", "all_words", F.least("depth", F.coalesce("shared", F.lit(0)) + chunk).alias("keep")), "keeps")
    tail = tail.join(keeps, "conv").withColumn("rest", F.col("w") - 1)
    extra = tail.filter("pos = keep").select("conv", (F.col("rest") * (F.col("all_words") - F.col("so_far"))).alias("extra"))
    paths = tail.filter("pos > keep").select(F.col("pos").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "w", "conv", F.lit(1).cast("long").alias("leaves"), (F.col("rest") * (F.col("all_words") - F.col("so_far") + F.col("words"))).alias("saved"))

    ranked = alike.join(keeps.select("conv", "keep"), "conv", "left").join(extra, "conv", "left").select("conv", "w", F.coalesce("keep", "depth").alias("keep"), F.coalesce("extra", F.lit(0)).alias("extra"))
    held = turns.join(ranked.select("conv", "keep"), "conv").filter("pos <= keep").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "x1", "x2", "words"))).alias("t"))
    rows = ranked.join(held, "conv", "left").select("conv", "w", "extra", F.coalesce(F.flatten(F.transform("t", lambda r: F.array(r["x1"], r["x2"]))), F.array().cast("array<long>")).alias("turns"), F.coalesce(F.col("t.words"), F.array().cast("array<long>")).alias("words"))
    rows = written(rows, "rows")
    load = rows.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-load // shard_turns))
    rows = written(rows.repartitionByRange(parts, "turns").sortWithinPartitions("turns").withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("shard", F.shiftright("at", 33))

    outer = written(rows.groupBy("shard").agg(F.min_by("turns", "at").alias("first"), F.max_by("turns", "at").alias("last")), "outer")  # a row for each shard
    order = Window.orderBy("shard")
    both = outer.select("shard", F.lag("last").over(order).alias("low"), F.col("first").alias("high"))
    common = written(both.mapInArrow(_shared_by_neighbours, "shard long, common long"), "common")
    edges = written(common.select("shard", F.col("common").alias("before"), F.coalesce(F.lead("common").over(order), F.lit(-1)).cast("long").alias("after")), "edges")
    cut = rows.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_edges, "shard long, depth long, k1 long, k2 long, w long")
    cut = written(cut, "cut")
    full = cut.groupBy(*KEY).agg(F.sum("w").alias("whole"), F.min("shard").alias("first"))
    shared = cut.drop("w").join(full, KEY).join(edges.select("shard", "after"), "shard")
    found = rows.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_nodes, "depth long, k1 long, k2 long, p1 long, p2 long, w long, conv long, leaves long, saved long")
    nodes = found.union(paths).groupBy(*KEY).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.sum("w").alias("w"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes = written(nodes, "nodes")
    under = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("children"))
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent"))
    out = nodes.join(under, KEY, "left").join(_member_digests(members), KEY, "left").join(over, ["depth", "p1", "p2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("w").alias("n_convs"), F.coalesce("children", F.lit(0)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(written(turns_of(table(spark, sf_dir, "conversations")), "turns")))


SQL = f"""
    WITH {CRC_TABLE},
    own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    held AS (SELECT c, count(*) AS n FROM own GROUP BY c),
    conv AS (SELECT a.c, a.c - a.c % 20 AS base, {crc_sql("CAST(a.c AS VARCHAR)")} % 4 AS h FROM held a, crc),
    named AS (SELECT v.c, base, h, least(h, coalesce(n, 0)) AS taken FROM conv v LEFT JOIN held b ON b.c = v.base),
    turns AS (SELECT v.c, o.pos, o.role, o.text FROM named v JOIN own o ON o.c = v.base AND o.pos <= h
        UNION ALL SELECT v.c, o.pos - h + taken, o.role, o.text FROM named v JOIN own o ON o.c = v.c AND o.pos > h),
    seq AS (SELECT v.c, list({{'r': role, 't': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS s FROM named v LEFT JOIN turns USING (c) GROUP BY v.c),
    prefix AS MATERIALIZED (SELECT c, d, coalesce(len(s), 0) = d AS ends, CASE WHEN d = 0 THEN '' ELSE sha256(CAST(s[1:d] AS VARCHAR)) END AS k, CASE WHEN d > 0 THEN CASE WHEN d = 1 THEN '' ELSE sha256(CAST(s[1:d - 1] AS VARCHAR)) END END AS up,
        CASE WHEN d = 0 THEN 0 ELSE len(list_filter(string_split_regex(s[d].t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS words FROM seq, unnest(range(0, coalesce(len(s), 0) + 1)) AS t(d)),
    node AS MATERIALIZED (SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS tokens,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM prefix GROUP BY d, k),
    child AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
    full_ AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN child USING (d, k)),
    below AS (SELECT DISTINCT a.d, a.k, n.d AS nd, n.k AS nk, n.tokens, n.n_children FROM prefix a JOIN prefix b ON a.c = b.c AND b.d >= a.d JOIN full_ n ON n.d = b.d AND n.k = b.k),
    tree AS (SELECT d, k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(tokens) AS BIGINT) AS saved_tokens FROM below GROUP BY d, k)
    SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM full_ n JOIN tree USING (d, k) LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.up"""
