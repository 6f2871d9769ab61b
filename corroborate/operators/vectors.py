"""Vector scoring and rank fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import kept
from .ranks import ranked_by_range


def unit(c):
    """The vector at length one; null if it has a null or non-finite part or no length."""
    v = c.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm > 0), F.transform(v, lambda x: x / norm))


def cosine_hits(queries: DataFrame, vectors: DataFrame, floor: float = 0.25, block: int = 1024, top_k: int | None = None, whole: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all pairs with cosine >= floor; queries(query_id, v), vectors(doc_id, v).

    With top_k only pairs come out that are among a query's top_k of their batch, in the order of `ranked`; so the top_k of all
    are among them, and what a query gives is bounded by the batches, not by the vectors.  Of queries in whole(query_id) all come out.

    Queries travel in blocks of `block`; each block meets each batch of vectors once, as a matrix product, and only what
    reaches the floor comes out.
    """
    asked = queries.select("query_id", unit(F.col("v")).alias("v")).filter("v is not null")
    free = None if whole is None else whole.select("query_id", F.lit(True).alias("free")).distinct()
    asked = asked.withColumn("free", F.lit(False)) if free is None else asked.join(free, "query_id", "left")
    rows = vectors.select("doc_id", unit(F.col("v")).alias("v")).filter("v is not null")
    out = None
    n = max(1, -(-asked.count() // block))
    for i in range(n):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()  # about `block` rows
        shared = queries.sparkSession.sparkContext.broadcast(([r.query_id for r in part], np.array([r.v for r in part]), np.array([bool(r.free) for r in part], bool)))

        def score(batches, shared=shared):
            ids, matrix, free = shared.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if v.shape[1] == matrix.shape[1]:
                    s = v @ matrix.T
                    r, q = np.nonzero(s >= floor)
                    if top_k is not None and len(r):
                        order = np.lexsort((b.column("doc_id").to_numpy()[r], -np.round(s[r, q], 9), q))
                        r, q = r[order], q[order]
                        first = np.flatnonzero(np.diff(q, prepend=-1))
                        keep = (np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < top_k) | free[q]
                        r, q = r[keep], q[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[q]), b.column("doc_id").take(pa.array(r)), pa.array(s[r, q])], ["query_id", "doc_id", "score"])

        found = rows.mapInArrow(score, "query_id long, doc_id long, score double")
        out = found if out is None else out.union(found)
    return out


def ranked(hits: DataFrame, top_k: int | None = None, whole: DataFrame | None = None) -> DataFrame:
    """Adds rank within each query: by score rounded to nine places, then doc_id; whole lists are ranked by ranges, and so are
    with a top_k those of the queries in whole(query_id)."""
    order = (F.desc(F.round("score", 9)), F.col("doc_id"))
    if top_k is not None and whole is not None:
        hits = kept(hits, "hits")
        return ranked(hits.join(whole, "query_id", "left_semi")).unionByName(ranked(hits.join(whole, "query_id", "left_anti"), top_k))
    if top_k is None:
        return ranked_by_range(hits, "query_id", *order)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= top_k)


def fuse(lexical: DataFrame, semantic: DataFrame, top_k: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank): (query_id, doc_id, score, rank)."""
    every = lexical.select("query_id", "doc_id", "rank").unionByName(semantic.select("query_id", "doc_id", "rank"))
    return ranked(every.groupBy("query_id", "doc_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score")), top_k)
