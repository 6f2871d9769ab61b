"""SimHash near-duplicates: pigeonring candidates, Hamming check, connected components.

A fingerprint's 64 bits form a ring of five segments.  If two fingerprints differ in at most four bits, some segment
starts a chain whose first segment is equal and whose first two together differ in at most one bit (the proportional
budgets 0.8 and 1.6).  One side is looked up by the two segments as they are, the other by all values of the chain within
the budgets; what meets gets the full Hamming check.

Equal fingerprints are one row from the start.  A chain value that more than `dense` fingerprints share would give all
pairs of a large group of near copies.  Such fingerprints go another exact way: two fingerprints differ in at most four
bits exactly if some 64-bit value lies within two bits of both, so each names all 2,081 values within two bits of it and is
linked to the smallest fingerprint that names the same value.  That is linear in the group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, utf8_rows, with_id, written
from .components import components

BITS, WITHIN = 64, 4
#: (shift, width) of the ring's segments.
RING = [(51, 13), (38, 13), (25, 13), (12, 13), (0, 12)]


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42, step: int = 1 << 16) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], gaps + 1])[:n].tolist()
    ends = np.concatenate([gaps, [len(line)]])[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, step):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + step], ends[at : at + step])], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) for every row."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([fingerprint(t, shingle) for t in utf8_rows(b.column("text"))], pa.int64())], ["id", "fp"])

    return with_id(docs, id_col, text=text_col).mapInArrow(run, "id long, fp long")


def _segment(i: int, fp="fp"):
    shift, width = RING[i % len(RING)]
    return F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(flips, base, second):
    return F.transform(flips, lambda x: base + second.bitwiseXOR(x))


def _chains(fps: DataFrame, near: bool) -> DataFrame:
    """(key, fp) for each start on the ring; near: also for each second segment that differs in one bit."""
    every = []
    for i in range(len(RING)):
        width = RING[(i + 1) % len(RING)][1]
        flips = F.array(*[F.lit(x).cast("long") for x in ([0] + [1 << k for k in range(width)] * near)])
        every.append(_keys(flips, F.lit(i << 26).cast("long") + F.shiftleft(_segment(i), 13), _segment(i + 1)))
    return fps.select(F.explode(F.concat(*every)).alias("key"), "fp")


def _named(fps: DataFrame) -> DataFrame:
    """(value, fp) for all values within two bits of each fingerprint."""
    one = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    first = fps.select("fp", F.posexplode(one).alias("p", "x"))
    return first.select("fp", F.explode(F.transform(F.filter(F.transform(one, lambda y, q: F.struct(q.alias("q"), y.alias("y"))), lambda z: (z["q"] > F.col("p")) | ((F.col("p") == 0) & (z["q"] == 0))), lambda z: F.col("fp").bitwiseXOR(F.col("x")).bitwiseXOR(z["y"]))).alias("value"))


def links(fps: DataFrame, dense: int = 64) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all that differ in at most four bits; not all pairs."""
    index, probe = _chains(fps, False), _chains(fps, True)
    crowded = written(index.groupBy("key").count().filter(F.col("count") > dense).select("key"), "crowded")
    quiet = index.join(crowded, "key", "left_anti").toDF("key", "a")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= WITHIN
    # Spark sizes an exploded table by the rows that went in: without the hints it would gather the keys or values on the driver
    pairs = quiet.join(probe.toDF("key", "b").hint("merge"), "key").filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    packed = written(probe.join(crowded, "key", "left_semi").select("fp").distinct(), "packed")
    values = _named(packed)
    least = values.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("value", "a")
    stars = values.withColumnRenamed("fp", "b").join(least.hint("merge"), "value").filter("a < b").select("a", "b").distinct()
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id that links lead to, the row's own included).

    Null and blank texts have fingerprint zero and are linked like any other; fewer words than a shingle make one shingle.
    Rows that repeat an id each return a row.  A null id is larger than all others and stays null, also as component_id
    of a class of nulls.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = written(components(links(distinct.select("fp"))), "roots").withColumnRenamed("node", "fp")
    classed = distinct.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = classed.groupBy("root").agg(F.min("least").alias("component"))
    by_print = classed.join(smallest.hint("merge"), "root").select("fp", "component")
    component = F.when(F.col("component") != 2**63 - 1, F.col("component"))
    return prints.join(by_print.hint("merge"), "fp").select(id_back(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
