"""One query for each operator of this folder, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from . import ann_tree, cotraining, decontaminate, langid, licenses, prefix_trie, spelling, warc, wfst
from .licenses import op11_license_scan
from .line_dedup import remove_repeated_lines
from .prefix_trie import op13_prefix_trie
from .simhash import near_duplicates
from .spelling import op12_spelling_variants
from .suffix_dedup import remove_repeated_bytes
from .substring_dedup import remove_repeated_windows

#: A public tokenizer's model; the path is a parameter of the operator.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"), width=50, digest=True)
    return out.selectExpr("doc_id", "n_words", "n_removed", "kept AS kept_sha256")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(table(spark, sf_dir, "documents"), digest=True)
    return out.selectExpr("doc_id", "n_lines", "n_dropped", "kept AS kept_sha256")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_kmeans_tree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_tree.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_lsa_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_cotraining_quality, op2_ppm_langid, op3_substring_dedup, op4_line_dedup, op5_sentencepiece_wfst, op6_suffix_dedup, op7_simhash_near_dedup, op8_warc_chunks, op9_lsa_decontaminate, op10_kmeans_tree_ann, op11_license_scan, op12_spelling_variants, op13_prefix_trie)}

SQL = {
    "op3_substring_dedup": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
        least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
        hit AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, unnest(range(0, 50)) AS t(k)),
        g AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN g USING (doc_id)""",
    "op4_line_dedup": """
        WITH l AS (SELECT doc_id, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS t(i)),
        k AS (SELECT doc_id, i, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE last > doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE last IS NULL OR last <= doc_id), '')) AS kept_sha256
        FROM k LEFT JOIN often USING (key) GROUP BY doc_id""",
    "op8_warc_chunks": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op11_license_scan": licenses.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
