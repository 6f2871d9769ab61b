"""Benchmark items as protected records, documents as texts to scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import kept
from ..functions.text import shingles, words
from ..operators import detect, spans
from .common import ARABIC, LATIN, arabic, both_words, table


def exact_window_hits(spark, sf_dir):
    return spans.exact_windows(*both_words(spark, sf_dir)).select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"))


def near_window_hits(spark, sf_dir):
    return spans.near_windows(*both_words(spark, sf_dir)).select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n"), F.col("distance").cast("long").alias("distance"))


def span_resolution(spark, sf_dir):
    docs, records = both_words(spark, sf_dir)
    exact = kept(spans.exact_windows(docs, records), "exact")  # read three times
    out = spans.resolve(exact, spans.near_windows(docs, records), records)
    return out.select("doc_id", "item_id", "start", "n", "classification")


def excerpt_hits(spark, sf_dir):
    return spans.excerpts(*both_words(spark, sf_dir))


def marked_spans(spark, sf_dir):
    out = spans.marked_spans(table(spark, sf_dir, "documents"))
    return out.groupBy("doc_id", "marker").agg(F.count("*").alias("n"), F.sum(F.length("span")).cast("long").alias("chars"))


def shingle_leak(spark, sf_dir):
    """Documents whose 3-word runs are found in records, with the number of distinct runs and of records.

    Records are grouped by run, so that a run gives a document one row, however many records hold it.
    """
    run = lambda rows, key: rows.select(key, words(F.col("text")).alias("w")).select(key, F.explode(F.array_distinct(shingles(F.col("w")))).alias("run"))
    records = run(table(spark, sf_dir, "benchmark"), "item_id").groupBy("run").agg(F.collect_set("item_id").alias("items"))
    hits = run(table(spark, sf_dir, "documents").repartition("doc_id"), "doc_id").join(records, "run")
    hits = kept(hits, "run-hits")  # counted twice
    runs = hits.groupBy("doc_id").agg(F.countDistinct("run").alias("runs"))
    held = hits.select("doc_id", F.explode("items").alias("item_id")).distinct().groupBy("doc_id").agg(F.count("*").alias("records"))
    return runs.join(held, "doc_id")


def span_effects(spark, sf_dir):
    """Near misses of the records of odd number, which stand for the protected domain, in documents whose level is their language's."""
    docs, records = both_words(spark, sf_dir)
    found = spans.resolve(kept(spans.exact_windows(docs, records), "exact"), spans.near_windows(docs, records), records)
    found = found.withColumn("domain", F.when(F.col("item_id") % 2 == 1, "quran").otherwise("other"))
    levels = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "D").otherwise("A").alias("level"))
    return spans.span_effects(found, levels, "quran")


def marked_classes(spark, sf_dir):
    """Texts between quotation marks, and each benchmark item cut short or with other words, classified against the items."""
    items = table(spark, sf_dir, "benchmark")
    w = F.split("text", " ")
    n = F.col("item_id")
    cut = F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - n % 5, F.lit(1))), " ")
    swapped = F.array_join(F.transform(w, lambda x, i: F.when((n % 3 == 0) & (i % 4 == 1), F.lit("zzz")).otherwise(x)), " ")
    quoted = spans.marked_spans(table(spark, sf_dir, "documents")).select(F.lit(None).cast("long").alias("span_id"), "span")
    made = items.select(n.alias("span_id"), F.when(n % 2 == 0, cut).otherwise(swapped).alias("span"))
    records = kept(spans.record_words(items), "record-words")
    out = detect.classify_marked(made.unionByName(quoted), records)
    return out.select("span_id", "classification", "item_id", F.col("distance").cast("long").alias("distance"), "partial")


#: Attribution formulas in the documents' languages.
FORMULAS = ["that is", "this was", "que la", "por el", "in die", "pour la"]


def _found(spark, sf_dir):
    return kept(detect.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), FORMULAS), "findings")


def detect_findings(spark, sf_dir):
    """All findings of the documents against the benchmark's items, from the texts on."""
    return _found(spark, sf_dir)


def detections(spark, sf_dir):
    """Status, numbers of findings and effects of every document; items of odd number are the protected domain's."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    required = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 50 + 1).alias("item_id"))
    levels = docs.select("doc_id", F.when(F.col("lang") == "en", "D").otherwise("A").alias("level"))
    domains = items.select("item_id", F.when(F.col("item_id") % 2 == 1, "quran").otherwise("other").alias("domain"))
    return detect.detections(docs, _found(spark, sf_dir), items, required, levels, domains, "quran")


def formula_places(spark, sf_dir):
    """Where attribution formulas stand in the documents, in key words from 0, found by one automaton."""
    texts = detect.tokens(table(spark, sf_dir, "documents").repartition("doc_id"), carry=False)
    return detect.phrase_places(texts, [f.split() for f in FORMULAS]).select("doc_id", F.col("phrase").cast("long").alias("phrase"), F.col("at").cast("long").alias("at"))


def key_word_places(spark, sf_dir):
    """Each document's words of the comparison key, and the sums of their places, over the text spelt with Arabic letters, marks
    and compatibility forms."""
    t = detect.tokens(table(spark, sf_dir, "documents").repartition("doc_id").select("doc_id", arabic(F.col("text")).alias("text")), carry=False)
    total = lambda places: F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("doc_id", F.size("dw").cast("long").alias("n"), total("starts").alias("starts"), total("ends").alias("ends"), F.md5(F.array_join("dw", " ").cast("binary")).alias("words_md5"))


def detection_status(spark, sf_dir):
    docs, records = both_words(spark, sf_dir)
    found = spans.exact_windows(docs, records)
    required = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 50 + 1).alias("item_id"))
    return spans.detection_status(table(spark, sf_dir, "documents"), found, records, required)


QUERIES = {f.__name__: f for f in (exact_window_hits, near_window_hits, span_resolution, excerpt_hits, marked_spans, shingle_leak, span_effects, marked_classes, detection_status, detect_findings, detections, formula_places, key_word_places)}

_W = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_EXACT = rf"""d AS (SELECT doc_id, {_W} AS dw FROM documents), r AS (SELECT min(item_id) AS item_id, {_W} AS rw FROM benchmark GROUP BY {_W}),
        p AS (SELECT doc_id, dw, unnest(range(1, len(dw) + 1)) AS start FROM d),
        s AS (SELECT doc_id, start, dw, dw[start] AS w FROM p),
        e AS (SELECT doc_id, item_id, start, CAST(len(rw) AS BIGINT) AS n FROM s JOIN r ON s.w = rw[1] WHERE dw[start:start + len(rw) - 1] = rw)"""


def _runs_sql(n: int, tail: str) -> str:
    return rf"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), r AS (SELECT item_id, {_W} AS w FROM benchmark),
        dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
        rr AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {n - 1}], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM r WHERE len(w) > {n if n == 5 else 0}))
        {tail}"""


SQL = {
    "exact_window_hits": f"WITH {_EXACT} SELECT * FROM e",
    "excerpt_hits": _runs_sql(5, "SELECT doc_id, item_id, count(*) AS shared FROM dr JOIN rr USING (run) WHERE len(string_split(run, ' ')) = 5 GROUP BY ALL"),
    "shingle_leak": _runs_sql(3, "SELECT doc_id, count(DISTINCT run) AS runs, count(DISTINCT item_id) AS records FROM dr JOIN rr USING (run) GROUP BY doc_id"),
    "marked_spans": """
        WITH s AS (SELECT doc_id, 'guillemets' AS marker, unnest(regexp_extract_all(text, '(?s)«(.*?)»', 1)) AS span FROM documents
            UNION ALL SELECT doc_id, 'curly', unnest(regexp_extract_all(text, '(?s)“(.*?)”', 1)) FROM documents
            UNION ALL SELECT doc_id, 'straight', unnest(regexp_extract_all(text, '(?s)"(.*?)"', 1)) FROM documents)
        SELECT doc_id, marker, count(*) AS n, CAST(sum(length(span)) AS BIGINT) AS chars FROM s GROUP BY ALL""",
    "detection_status": f"""WITH {_EXACT}, lost AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 50 + 1 NOT IN (SELECT item_id FROM r)), n AS (SELECT doc_id, count(*) AS findings FROM e GROUP BY doc_id)
        SELECT doc_id, CASE WHEN NOT EXISTS (SELECT 1 FROM r) THEN 'INDEX_EMPTY' WHEN doc_id IN (SELECT doc_id FROM lost) THEN 'UNRESOLVED' ELSE 'RAN' END AS status, coalesce(findings, 0) AS findings
        FROM documents LEFT JOIN n USING (doc_id)""",
    # the same classes by comparing every span with every record: words become letters, those that a record has not one other letter
    "marked_classes": rf"""WITH r AS (SELECT min(item_id) AS item_id, {_W} AS rw FROM benchmark GROUP BY {_W} HAVING len({_W}) > 0),
        quoted AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)«(.*?)»', 1)) AS text FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?s)“(.*?)”', 1)) FROM documents
            UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '(?s)"(.*?)"', 1)) FROM documents),
        split AS (SELECT item_id AS n, string_split(text, ' ') AS w FROM benchmark),
        made AS (SELECT n AS span_id, CASE WHEN n % 2 = 0 THEN array_to_string(w[1:greatest(len(w) - n % 5, 1)], ' ')
            ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN n % 3 = 0 AND (i - 1) % 4 = 1 THEN 'zzz' ELSE x END), ' ') END AS text FROM split),
        every AS (SELECT span_id, {_W} AS dw FROM made UNION ALL SELECT NULL, {_W} FROM quoted),
        pair AS (SELECT dw, item_id, rw, len(dw) AS n, len(rw) AS m, list_transform(dw, lambda x: CASE WHEN list_contains(rw, x) THEN chr(40 + CAST(list_position(rw, x) AS INT)) ELSE '#' END) AS s,
            list_transform(rw, lambda x: chr(40 + CAST(list_position(rw, x) AS INT))) AS o, CASE WHEN len(dw) < 5 THEN 0 WHEN len(dw) <= 10 THEN 2 ELSE 3 END AS b FROM (SELECT DISTINCT dw FROM every), r),
        far AS (SELECT *, levenshtein(array_to_string(s, ''), array_to_string(o, '')) AS d, CASE WHEN greatest(n, m) <= 4 THEN 1 WHEN greatest(n, m) <= 10 THEN 2 ELSE 3 END AS allowed FROM pair),
        whole AS (SELECT dw, min(struct_pack(k := CASE WHEN d = 0 THEN 0 WHEN n > 0 AND d <= allowed THEN 1 ELSE 2 END, d := d, gap := abs(n - m), item_id := item_id)) AS w FROM far GROUP BY dw),
        cut AS (SELECT dw, item_id, levenshtein(array_to_string(s, ''), array_to_string(o[i:i + n - 1], '')) AS d, b FROM pair, unnest(range(1, m - n + 2)) AS t(i)
            WHERE n >= 3 AND m > n + b AND len(list_intersect(dw, rw)) >= greatest(1, n - b)),
        part AS (SELECT dw, min(struct_pack(d := d, item_id := item_id)) AS p FROM cut WHERE d <= b GROUP BY dw),
        judged AS (SELECT dw, CASE WHEN w.k = 0 THEN 'VERBATIM' WHEN w.k = 1 THEN 'NEAR_MISS' WHEN p.d = 0 THEN 'VERBATIM' WHEN p IS NOT NULL THEN 'NEAR_MISS' ELSE 'UNRELATED' END AS classification,
            CASE WHEN w.k < 2 OR p IS NULL THEN w.item_id ELSE p.item_id END AS item_id, CASE WHEN w.k < 2 OR p IS NULL THEN w.d ELSE p.d END AS distance, w.k = 2 AND p IS NOT NULL AS partial FROM whole LEFT JOIN part USING (dw))
        SELECT span_id, classification, item_id, CAST(distance AS BIGINT) AS distance, partial FROM every JOIN judged USING (dw)""",
    "formula_places": rf"""WITH d AS (SELECT doc_id, {_W} AS w FROM documents), f(phrase, toks) AS (VALUES {', '.join(f"({i}, {f.split()})" for i, f in enumerate(FORMULAS))})
        SELECT doc_id, CAST(phrase AS BIGINT) AS phrase, i - 1 AS at FROM d, f, unnest(range(1, len(w) + 1)) AS t(i) WHERE w[i] = toks[1] AND w[i:i + len(toks) - 1] = toks""",
    "key_word_places": rf"""WITH a AS (SELECT doc_id, replace(replace(translate(lower(coalesce(text, '')), '{LATIN}0123456789', '{ARABIC}٠١٢٣٤٥٦٧٨٩'), 'ز', 'زَ'), 'م', 'ﻻ') AS t FROM documents),
        -- each letter by itself: one key letter, none for a mark, two for the ligature; marks belong to the letter before
        c AS (SELECT doc_id, list_filter(string_split(t, ''), lambda x: x <> '') AS c FROM a),
        k AS (SELECT doc_id, i, c[i] AS x, translate(CASE c[i] WHEN 'ﻻ' THEN 'لا' WHEN 'َ' THEN '' ELSE nfc_normalize(c[i]) END, 'أإآٱىة٠١٢٣٤٥٦٧٨٩', 'اااايه0123456789') AS y FROM c, unnest(range(1, len(c) + 1)) AS t(i)),
        l AS (SELECT *, x = 'َ' OR regexp_full_match(y, '[\p{{L}}\p{{N}}]+') AS inside FROM k),
        g AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS word FROM l),
        w AS (SELECT doc_id, word, min(i) - 1 AS a, max(i) AS b, lower(string_agg(y, '' ORDER BY i)) AS y FROM g WHERE inside GROUP BY ALL)
        SELECT d.doc_id, count(word) AS n, CAST(coalesce(sum(a), 0) AS BIGINT) AS starts, CAST(coalesce(sum(b), 0) AS BIGINT) AS ends, md5(coalesce(string_agg(y, ' ' ORDER BY word), '')) AS words_md5
        FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id""",
}
