"""Retrieval queries: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.index import best_over_queries, bm25, build_index, token_overlap
from ..operators.vectors import cosine_hits, fuse, ranked
from .common import aliases_sql, arabic_key_sql, decomposed, table


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, sf_dir, **more):
    return bm25(_asked(spark, sf_dir), build_index(table(spark, sf_dir, "documents"), domain_col="lang").kept(), **more)


def _result(df):
    return df.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark, sf_dir):
    return _result(_lexical(spark, sf_dir, top_k=10))


def bm25_floor_overlap(spark, sf_dir):
    out = _lexical(spark, sf_dir, top_k=5, floor=0.25, domain="en", best="score", min_terms=3)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("overlap", 6).alias("overlap"))


def bm25_delta_equals_rebuild(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = build_index(docs.filter("lang = 'en'")).kept().append(build_index(docs.filter("lang <> 'en' OR lang IS NULL")).kept())
    return _result(bm25(_asked(spark, sf_dir), index, top_k=10))


def title_token_overlap(spark, sf_dir):
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("title_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    return token_overlap(_asked(spark, sf_dir), titles).select("query_id", "title_id", "shared", F.col("rank").cast("long").alias("rank"))


def multi_query_best(spark, sf_dir):
    """A conversation's turns of the user are its queries; benchmark items are the records."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    queries = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    hits = bm25(queries, build_index(table(spark, sf_dir, "benchmark"), "item_id").kept(), top_k=None)
    out = best_over_queries(hits.withColumn("conv_id", F.floor(F.col("query_id") / 1000)), "conv_id", 3)
    return out.select("conv_id", F.col("doc_id").alias("item_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _vectors_asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))


def _semantic(spark, sf_dir, **more):
    rows, queries = table(spark, sf_dir, "embeddings"), _vectors_asked(spark, sf_dir)
    return cosine_hits(queries, rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), 0.25, **more)


def vector_topk(spark, sf_dir):
    return _result(ranked(_semantic(spark, sf_dir, top_k=5), 5))


def hybrid_rrf(spark, sf_dir):
    """Items and documents that share numbers with vectors, ranked by words and by vectors.

    Of a query with one list alone the five best fused are the list's first five; those with both are ranked whole.  Where a
    number repeats, a list may hold it twice and its places add up, so all lists are ranked whole.
    """
    numbers = [table(spark, sf_dir, name).select(F.col(key).alias("id")) for name, key in (("documents", "doc_id"), ("benchmark", "item_id"), ("embeddings", "vec_id"))]
    if any(ids.groupBy("id").count().filter("count > 1").limit(1).count() for ids in numbers):
        out = fuse(_lexical(spark, sf_dir, top_k=None), ranked(_semantic(spark, sf_dir)), 5)
    else:
        both = _asked(spark, sf_dir).select("query_id").join(_vectors_asked(spark, sf_dir), "query_id", "left_semi").distinct()
        semantic = ranked(_semantic(spark, sf_dir, top_k=5, whole=both), 5, whole=both)
        out = fuse(_lexical(spark, sf_dir, top_k=5, whole=both), semantic, 5)
    return out.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def arabic_bm25(spark, sf_dir):
    """Items and documents in Arabic spelling, with marks and decomposed letters: words meet by their best alias."""
    index = build_index(table(spark, sf_dir, "documents"), spelt=decomposed).kept()
    return _result(bm25(_asked(spark, sf_dir).withColumn("text", decomposed(F.col("text"))), index, top_k=10))


def alias_words(spark, sf_dir):
    """Per document in Arabic spelling: its words, all their aliases, and a hash of the distinct ones."""
    held = build_index(table(spark, sf_dir, "documents"), spelt=decomposed).held
    n_aliases = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    return held.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_aliases.alias("n_aliases"), F.md5(F.array_join(F.sort_array("terms"), " ").cast("binary")).alias("aliases_md5"))


QUERIES = {f.__name__: f for f in (arabic_bm25, alias_words, bm25_topk, bm25_floor_overlap, bm25_delta_equals_rebuild, title_token_overlap, multi_query_best, vector_topk, hybrid_rrf)}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(docs: str, queries: str, tail: str, extra: str = "") -> str:
    return f"""
        WITH d AS ({docs}), q AS ({queries}),
        w AS (SELECT doc_id, unnest(words) AS term FROM d),
        p AS (SELECT term, doc_id, count(*) AS tf FROM w GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
        t AS (SELECT query_id, len(list_distinct(words)) AS asked, unnest(list_distinct(words)) AS term FROM q),
        scored AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d.words) / mean))) AS score,
            count(*) / greatest(max(asked), 3) AS overlap3
            FROM t JOIN p USING (term) JOIN f USING (term) JOIN d ON d.doc_id = p.doc_id, s {extra} GROUP BY query_id, p.doc_id)
        {tail}"""


_DOCS = f"SELECT doc_id, lang, {_WORDS.format('text')} AS words FROM documents"
_ITEMS = f"SELECT item_id AS query_id, {_WORDS.format('text')} AS words FROM benchmark"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)"
_TOP10 = f"SELECT query_id, doc_id, round(score, 6) AS score, {_RANK} AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10"
_COSINE = """u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
        semantic AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS score
            FROM u a, u b WHERE a.vec_id % 50 = 0 AND score >= 0.25)"""

_ARABIC_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

SQL = {
    "alias_words": f"""
        WITH d AS (SELECT doc_id, {_ARABIC_WORDS.format(arabic_key_sql('text'))} AS w FROM documents),
        a AS (SELECT doc_id, len(w) AS n, flatten(list_transform(w, lambda x: {aliases_sql('x')})) AS a FROM d)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(len(a), 0) AS BIGINT) AS n_aliases, md5(coalesce(array_to_string(list_sort(list_distinct(a)), ' '), '')) AS aliases_md5 FROM a""",
    "arabic_bm25": f"""
        WITH d AS (SELECT doc_id, {_ARABIC_WORDS.format(arabic_key_sql('text'))} AS words FROM documents),
        q AS (SELECT item_id AS query_id, {_ARABIC_WORDS.format(arabic_key_sql('text'))} AS words FROM benchmark),
        w AS (SELECT doc_id, unnest(words) AS word FROM d),
        a AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
        p AS (SELECT doc_id, term, sum(n) AS tf FROM (SELECT doc_id, n, unnest({aliases_sql('word')}) AS term FROM a) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
        g AS (SELECT DISTINCT query_id, unnest(list_distinct(words)) AS word FROM q),
        t AS (SELECT query_id, word, unnest({aliases_sql('word')}) AS term FROM g),
        h AS (SELECT query_id, word, p.doc_id, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, len(d.words) / mean AS share FROM t JOIN p USING (term) JOIN f USING (term) JOIN d ON d.doc_id = p.doc_id, s),
        b AS (SELECT query_id, word, doc_id, (max(struct_pack(tf := tf, idf := idf, score := idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * share))))).score AS score FROM h GROUP BY query_id, word, doc_id),
        scored AS (SELECT query_id, doc_id, sum(score) AS score FROM b GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "bm25_topk": _bm25_sql(_DOCS, _ITEMS, _TOP10),
    "bm25_delta_equals_rebuild": _bm25_sql(_DOCS, _ITEMS, _TOP10),
    "bm25_floor_overlap": _bm25_sql(_DOCS, _ITEMS, f"SELECT query_id, doc_id, round(score, 6) AS score, round(overlap3, 6) AS overlap FROM scored WHERE overlap3 >= 0.25 QUALIFY {_RANK} <= 5", "WHERE lang = 'en'"),
    "title_token_overlap": f"""
        WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS word FROM benchmark),
        t AS (SELECT DISTINCT page_id AS title_id, unnest({_WORDS.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS word FROM pages),
        s AS (SELECT query_id, title_id, count(*) AS shared FROM q JOIN t USING (word) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, title_id) AS rank FROM s QUALIFY rank <= 2""",
    "multi_query_best": _bm25_sql(
        f"SELECT item_id AS doc_id, {_WORDS.format('text')} AS words FROM benchmark",
        f"SELECT conv_id * 1000 + turn AS query_id, {_WORDS.format('text')} AS words FROM conversations WHERE role = 'user'",
        """, best AS (SELECT query_id // 1000 AS conv_id, doc_id AS item_id, max(score) AS score FROM scored GROUP BY ALL)
        SELECT conv_id, item_id, round(score, 6) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM best QUALIFY rank <= 3""",
    ),
    "vector_topk": f"WITH {_COSINE} SELECT query_id, doc_id, round(score, 6) AS score, {_RANK} AS rank FROM semantic QUALIFY rank <= 5",
    "hybrid_rrf": _bm25_sql(
        _DOCS,
        _ITEMS,
        f""", {_COSINE},
        lists AS (SELECT query_id, doc_id, {_RANK} AS rank FROM scored UNION ALL SELECT query_id, doc_id, {_RANK} AS rank FROM semantic),
        fused AS (SELECT query_id, doc_id, sum(1 / (60 + rank)) AS score FROM lists GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 9) AS score, {_RANK} AS rank FROM fused QUALIFY rank <= 5""",
    ),
}
