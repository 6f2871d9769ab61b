"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words one edit apart have letter counts whose squared distance is at most two, and lengths that differ by at most one.
Words of a length are cut into blocks by how many letters of each of a few classes they hold; an edit moves at most one
letter in and one out, so a word's neighbours lie in the same block or in one whose counts differ by one letter added or
one exchanged.  Large blocks are cut into tiles.  For each tile and each tile of a neighbouring block one matrix product
of letter counts gives all squared distances; pairs at most two apart are verified letter by letter.

A class is a set of letters; letters beyond the commonest share a column of the counts, which only leaves more pairs to
verify.  How many classes there are follows the number of words and changes no result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

COLUMNS = 64
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _runs(text: str, least: int) -> Counter:
    """The runs [A-Za-z\\u00C0-\\u00FF]+ of at least `least` code points, A-Z lower-cased, as Latin-1 bytes, with their number."""
    return Counter(w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= least)


def _damaged(name: str, run: bytes, every: int) -> bytes:
    h = zlib.crc32(f"{name}:{run.decode('latin-1')}".encode())
    return run[: (k := h % len(run))] + run[k + 1 :] if h % every == 0 else run


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, damage: int = 31, most_held: int = 1 << 19) -> DataFrame:
    """(word, n): the runs [A-Za-z\\u00C0-\\u00FF]+ of all texts, A-Z lower-cased, with the number of their occurrences.

    Where `damage` divides h, the unsigned crc32 of `<id>:<run>`, the run first loses its code point h % length (0: no run
    does).  Words have at least `least_length` code points after that and `least_count` occurrences.  A null text has no
    runs; a null id is the empty string in h; every row of a repeated id counts.  A task counts `most_held` words at a time.
    """

    def count(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text")):
                for run, n in _runs(text.as_py() or "", least_length).items():
                    w = _damaged("" if i is None else i, run, damage) if damage else run
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) >= most_held:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- blocks ---------------------------------------------------------------------------------------------------------


def _codes(letters: str, size: int) -> np.ndarray:
    """Code points of words of one length that stand one after another, a row each."""
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)


class Alphabet:
    """The commonest letters' columns; other letters share the last one.  A column belongs to a class, and so do other letters."""

    def __init__(self, letters: list[str], classes: int):
        self.columns = {ord(c): i for i, c in enumerate(letters[: COLUMNS - 1])}
        self.known = np.array(sorted(self.columns), np.uint32)
        self.at = np.array([self.columns[c] for c in sorted(self.columns)], np.int64)
        self.classes = classes

    def column(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(codes.shape, COLUMNS - 1)
        place = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[place] == codes, self.at[place], COLUMNS - 1)

    def block(self, word: str) -> str:
        """Letters of each class, comma-joined.  Classes take columns in turns, back and forth, so that they are of like weight."""
        k, n = self.classes, [0] * self.classes
        for c in word:
            i = self.columns.get(ord(c), ord(c))
            n[i % k if i // k % 2 == 0 else k - 1 - i % k] += 1
        return ",".join(map(str, n))

    def counts(self, words: np.ndarray) -> np.ndarray:
        at = self.column(words) + np.arange(len(words))[:, None] * COLUMNS
        return np.bincount(at.ravel(), minlength=len(words) * COLUMNS).reshape(-1, COLUMNS)


def hosts_of(block: str) -> list[str]:
    """The block itself, those with one letter more, and those with a letter of a class moved to an earlier class.

    So of two neighbouring blocks one, and only one, is a host of the other.
    """
    n = list(map(int, block.split(",")))
    out = [n]
    for i in range(len(n)):
        out.append([x + (j == i) for j, x in enumerate(n)])
        out += [[x + (j == i) - (j == k) for j, x in enumerate(n)] for k in range(i + 1, len(n)) if n[k]]
    return [",".join(map(str, x)) for x in out]


def near_pairs(host: np.ndarray, guest: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two arrays of code points, words of equal length or the host's one longer, that are one edit apart."""
    longer = host.shape[1] - guest.shape[1]
    exact = np.float32 if host.shape[1] <= 2000 else np.float64  # four times the squared length is still a whole number in it
    h, g = alphabet.counts(host).astype(exact), alphabet.counts(guest).astype(exact)
    # [-2h, |h|^2, 1] times [g, 1, |g|^2] is |h|^2 - 2hg + |g|^2
    left = np.hstack([-2 * h, (h * h).sum(1, keepdims=True), np.ones((len(h), 1), exact)])
    right = np.hstack([g, np.ones((len(g), 1), exact), (g * g).sum(1, keepdims=True)])
    close = np.flatnonzero((left @ right.T) < (1.5 if longer else 2.5))
    a, b = close // len(g), close % len(g)
    near = [np.zeros(0, bool)]
    for at in range(0, len(a), 1 << 16):  # bounds the memory of the letters compared
        x, y = host[a[at : at + (1 << 16)]], guest[b[at : at + (1 << 16)]]
        if longer:
            head = np.minimum.accumulate(x[:, :-1] == y, 1).sum(1)
            tail = np.minimum.accumulate((x[:, 1:] == y)[:, ::-1], 1).sum(1)
            near.append(head + tail >= guest.shape[1])
        else:
            near.append((x != y).sum(1) == 1)
    near = np.concatenate(near)
    return a[near], b[near]


def links(words: DataFrame, tile: int = 1024) -> DataFrame:
    """(word, near, near_n) for every ordered pair of different words of words(word, n), each once, that one inserted, deleted or
    replaced code point tells apart; an empty word takes no part."""
    words = words.filter("word is not null and word <> ''")
    total = words.count()
    classes = max(2, min(8, round(math.log2(max(total, 2)) / 3)))
    letters = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(COLUMNS - 1).collect()
    alphabet = Alphabet([r.c for r in letters if r.c], classes)

    def put(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([alphabet.block(w) for w in b.column("word").to_pylist()], pa.string()), b.column("word"), b.column("n")], ["block", "word", "n"])

    def beside(batches):
        for b in batches:
            pairs = [(x, y) for x in b.column("guest").to_pylist() for y in hosts_of(x)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["guest", "host"])

    placed = written(words.select("word", "n").mapInArrow(put, "block string, word string, n long"), "blocks")
    sizes = written(placed.groupBy("block").agg(F.ceil(F.count("*") / tile).alias("tiles")), "sizes")
    # merge joins: blocks and their pairs grow with the words, and what makes the pairs has no size that Spark could know
    cut = placed.join(sizes.hint("merge"), "block").withColumn("tile", F.pmod(F.xxhash64("word"), "tiles"))
    rows = F.sort_array(F.collect_list(F.struct("word", "n")))  # some `tile` words each
    tiles = cut.groupBy("block", "tile").agg(rows.alias("rows"))
    tiles = written(tiles.select("block", "tile", F.array_join("rows.word", "").alias("letters"), F.col("rows.n").alias("ns")), "tiles")
    pairs = sizes.select(F.col("block").alias("guest")).mapInArrow(beside, "guest string, host string").join(sizes.withColumnRenamed("block", "host").hint("merge"), "host")
    guests = tiles.select(F.col("block").alias("guest"), F.col("tile").alias("guest_tile"), F.col("letters").alias("guests"), F.col("ns").alias("guest_ns")).join(pairs.hint("merge"), "guest")
    guests = guests.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).filter("guest <> host or guest_tile <= tile")
    meet = guests.join(tiles.select(F.col("block").alias("host"), "tile", F.col("letters").alias("hosts"), F.col("ns").alias("host_ns")).hint("merge"), ["host", "tile"])
    meet = meet.select("host", "tile", "hosts", "host_ns", "guests", "guest_ns", F.expr("guest = host and guest_tile = tile").alias("same"))

    def search(batches):
        for b in batches:
            hosts, host_ns, guests, guest_ns, same = (b.column(c) for c in ("hosts", "host_ns", "guests", "guest_ns", "same"))
            keys = list(zip(b.column("host").to_pylist(), b.column("tile").to_pylist()))
            sizes = [n.as_py() for n in pc.list_value_length(guest_ns)]
            at = 0
            while at < b.num_rows:  # guests of one host that lie together, some 16 tiles at most
                to, held = at + 1, sizes[at]
                while to < b.num_rows and keys[to] == keys[at] and held + sizes[to] <= 16 * tile:
                    held, to = held + sizes[to], to + 1
                yield from _met(hosts[at].as_py(), host_ns[at].values.to_numpy(), [(guests[i].as_py(), guest_ns[i].values.to_numpy(), same[i].as_py()) for i in range(at, to)], alphabet)
                at = to

    return meet.mapInArrow(search, "word string, near string, near_n long")


def _met(host: str, host_ns: np.ndarray, guests: list[tuple], alphabet: Alphabet):
    """The pairs of a host's words and its guests', both ways.  Of guests that are the host's own words each pair counts once."""
    size = len(host) // len(host_ns)
    for longer in (0, 1):
        some = [g for g in guests if len(g[0]) // len(g[1]) == size - longer]
        if not some or size == longer:
            continue
        letters, ns, own = "".join(g[0] for g in some), np.concatenate([g[1] for g in some]), np.repeat([g[2] for g in some], [len(g[1]) for g in some])
        first = np.flatnonzero(own)[0] if own.any() else 0
        a, g = near_pairs(_codes(host, size), _codes(letters, size - longer), alphabet)
        fresh = ~own[g] | (a < g - first)
        a, g = a[fresh], g[fresh]
        if len(a):
            x = [host[i * size : (i + 1) * size] for i in a.tolist()]
            y = [letters[i * (size - longer) : (i + 1) * (size - longer)] for i in g.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x + y), pa.array(y + x), pa.array(np.concatenate([ns[g], host_ns[a]]), pa.int64())], ["word", "near", "near_n"])


def group(words: DataFrame, times: int = 10, tile: int = 1024) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of words(word, n); words are distinct and not null.

    form is the near word of largest n, ties to the smallest in code-point order, if its n is at least `times` the word's n.
    root is where forms end that are followed from the word, the word itself if it has none.  Counts rise along forms, so that
    a path is no longer than their logarithm; what is left of all paths halves in each round.
    """
    words = written(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = links(words, tile).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = F.coalesce(-F.col("best.minus") >= F.lit(times) * F.col("n"), F.lit(False))
    out = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.minus")).alias("form_n"))
    out = written(out, "forms")
    step = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        nxt = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(step.join(nxt.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not step.filter("moved").head(1):
            break
        step = step.select("word", "root")
    return out.join(step.select("word", "root").hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group(words_of(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


#: crc32 of a string whose letters are below U+0100, from a table that is worked out by its polynomial.
CRC_TABLE = "crc(t) AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"


def crc_sql(text: str) -> str:
    of = f"flatten(list_transform(list_filter(string_split({text}, ''), lambda x: x <> ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), unicode(x) - 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {of}), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295)"


SQL = f"""
    WITH RECURSIVE {CRC_TABLE},
    run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 7 GROUP BY ALL),
    hashed AS (SELECT run, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM counted, crc),
    damaged AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
    word AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    less AS MATERIALIZED (SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM word, unnest(range(0, length(word))) AS t(i)),
    pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
    out AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM word w LEFT JOIN best USING (word)),
    path AS (SELECT word, word AS at FROM out UNION ALL SELECT p.word, o.form FROM path p JOIN out o ON o.word = p.at WHERE o.form IS NOT NULL)
    SELECT o.*, p.at AS root FROM out o JOIN path p USING (word) JOIN out e ON e.word = p.at AND e.form IS NULL"""
