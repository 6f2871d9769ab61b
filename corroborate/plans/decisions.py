"""Rule tables, gates, validation and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import norm_ar, shingles, words
from ..operators import evaluation as ev
from ..operators import gates, rules, spans, validate
from .common import both_words, table

CUES = [("D", ["idiot|clown|moron"]), ("C", ["license"]), ("B", ["token|the and"])]


def level_floor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rules.level_floor(F.lower(norm_ar(F.col("text"))), CUES).alias("level"))


def _proposals(spark, sf_dir):
    """Labels as a model's proposals: quality and toxic give its level, the document's number its confidence."""
    out = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return out.select("doc_id", "source", "lang", "n_chars", "quality", "toxic", F.when(F.col("lang") == "de", "B").when(F.col("lang") == "fr", "C").otherwise("A").alias("floor"), F.when(F.col("toxic") == 1, "D").when(F.col("quality") == 0, "C").when(F.col("quality") == 1, "A").alias("proposed"), (F.col("doc_id") % 100 / 100).alias("confidence"))


def level_ratchet(spark, sf_dir):
    out = _proposals(spark, sf_dir).withColumn("r", rules.resolve_level(F.col("floor"), F.col("proposed"), F.col("confidence")))
    return out.withColumn("q", rules.resolve_level(F.col("floor"), F.col("proposed"), F.col("confidence"), routing=True)).select("doc_id", "r.level", "r.status", F.col("q.level").alias("routing_level"))


def _facts(spark, sf_dir):
    d = F.col("doc_id")
    level = F.element_at(F.array(*map(F.lit, rules.LEVELS)), (d % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(d.alias("claim_id"), level.alias("level"), (F.col("n_chars") % 4).cast("int").alias("evidence"), (F.col("n_chars") % 3).cast("int").alias("positions"), (d % 3 == 0).alias("disagreement"), (d % 5 == 0).alias("gap"), (d % 7 == 0).alias("near_miss"), F.when(d % 3 == 1, "CONFIRMS").when(d % 3 == 2, "CONTRADICTS").alias("proposal"), (d % 100 / 100).alias("confidence"), (F.col("n_chars") % 100 / 100).alias("overlap"))


def state_first_match(spark, sf_dir):
    return rules.decide_states(spark, _facts(spark, sf_dir)).select("claim_id", "level", F.col("rule_order").cast("long").alias("rule_order"), "state")


def alignment_first_match(spark, sf_dir):
    return rules.decide_alignment(spark, _facts(spark, sf_dir)).select("claim_id", "rule_id", "alignment")


def request_restriction(spark, sf_dir):
    claims = level_floor(spark, sf_dir).withColumn("request", F.floor(F.col("doc_id") / 4))
    return rules.restrict_requests(claims, "request").select("doc_id", "request", "level")


def fragment_merge(spark, sf_dir):
    """Turns, one after the other, as spans of their conversation; turns of at most 40 words are fragments of the one before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations").withColumn("start", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    turns = turns.select("conv_id", "start", (F.col("start") + F.length("text")).alias("end"), F.size(words("text")).alias("n"))
    out = rules.merge_fragments(turns, "conv_id", "start", "end", F.col("n") <= 40)
    return out.select("conv_id", "claim_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "parts")


def _corpus(spark, sf_dir):
    """Documents as corpus rows: some rows break one rule or another by their number."""
    d, t = F.col("doc_id"), F.col("text")
    rows = table(spark, sf_dir, "documents").select(F.when(d % 97 == 0, F.lit(0)).otherwise(d).alias("corpus_id"), F.col("lang").alias("domain"), F.col("source").alias("source_id"), F.concat(F.lit("https://"), F.when(d % 41 == 0, "other.example").otherwise(F.concat("source", F.lit(".example"))), F.when(d % 43 == 0, "/a/../b").otherwise("/a/b")).alias("source_url"), F.when(d % 53 == 0, "  ").otherwise(t).alias("text_ar"), F.trim(F.regexp_replace(t, r"\s+", " ")).alias("text_normalized"), F.when(d % 59 == 0, d - 1000000).when(d % 61 == 0, d - 61).alias("translation_of"), F.when(d % 67 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(d % 71 == 0, "pending").otherwise("open").alias("license"), F.sha2(F.when(d % 73 == 0, F.concat(t, F.lit("x"))).otherwise(t), 256).alias("checksum_sha256"), F.when(d % 79 != 0, "owner").alias("approved_by"))
    sources = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_id")).agg(F.array_sort(F.collect_set("lang")).alias("domains")).filter("source_id <> 'src3'")
    return rows, sources.select("source_id", F.filter("domains", lambda x: (x != "es") | ~F.col("source_id").isin("src4", "src5")).alias("domains"), F.array(F.concat("source_id", F.lit(".example"))).alias("hosts"), F.lit("open").alias("license"), (F.col("source_id") != "src6").alias("ingestion_allowed"), (F.col("source_id") != "src7").alias("redistribution_allowed"))


def corpus_violations(spark, sf_dir):
    rows, sources = _corpus(spark, sf_dir)
    out = validate.corpus_violations(rows, sources, ["en", "fr", "de", "es"], need_redistribution=True)
    return out.groupBy("row_id", "rule").agg(F.count("*").alias("n"))


def register_equality(spark, sf_dir):
    docs, sources = _corpus(spark, sf_dir)
    return validate.unregistered(docs, sources, "source_id")


def checksum_dups(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return out.filter("copies > 1")


def conflicting_duplicates(spark, sf_dir):
    """Documents whose source and length no other document shares; those that share them go."""
    return gates.without_conflicts(table(spark, sf_dir, "documents"), ["source", "n_chars"]).select("doc_id", "source", "n_chars")


def twin_peers(spark, sf_dir):
    return gates.twin_peers(table(spark, sf_dir, "documents"), F.md5(F.lower(norm_ar(F.col("text")))), "doc_id", "source")


def received_registry(spark, sf_dir):
    rows, sources = _corpus(spark, sf_dir)
    out = gates.authorised(rows.select("corpus_id", "source_id", "domain", "source_url"), sources, F.try_parse_url("source_url", F.lit("HOST")))
    return out.groupBy("source_id", "permitted").agg(F.count("*").alias("n"))


def quote_verification(spark, sf_dir):
    """Each benchmark item cites itself, some with changed white space, other words or an unknown number."""
    items = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    cited = items.select(i.alias("claim_id"), F.when(i % 11 == 0, i + 1000000).otherwise(i).alias("item_id"), F.when(i % 3 == 1, F.concat(F.lit("  "), "text", F.lit(" "))).when(i % 3 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).alias("quote"))
    return gates.verified_quotes(cited, items, norm_ar).select("claim_id", "verdict")


def dependency_closure(spark, sf_dir):
    found = spans.exact_windows(*both_words(spark, sf_dir))
    return gates.closed_dependencies(found, table(spark, sf_dir, "benchmark").filter("item_id % 4 <> 0").select("item_id"))


def own_record_leak(spark, sf_dir):
    """3-word runs of documents found in records, the record with the document's own number exempt."""
    run = lambda name, key, out: table(spark, sf_dir, name).select(F.col(key).alias(out), words(F.col("text")).alias("w")).select(out, F.explode(F.array_distinct(shingles(F.col("w")))).alias("run"))
    own = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), F.col("item_id").alias("record_id"))
    return gates.leaks(run("documents", "doc_id", "text_id"), run("benchmark", "item_id", "record_id"), own)


def _cases(spark, sf_dir):
    """Labels expect, simple rules observe."""
    seen = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(True).alias("seen"), (F.col("n_chars") > 300).cast("int").alias("got_quality"), F.col("text").rlike("idiot|stupid|clown").cast("int").alias("got_toxic"))
    out = table(spark, sf_dir, "labels").join(seen, "doc_id", "left").withColumn("observed", F.coalesce("seen", F.lit(False)))
    return out.drop("seen")


def _fields():
    return {n: (F.col(n), F.col(f"got_{n}")) for n in ("quality", "toxic")}


def _checks(spark, sf_dir):
    return ev.equality_checks(_cases(spark, sf_dir), "doc_id", _fields())


def eval_checks(spark, sf_dir):
    return _checks(spark, sf_dir)


def eval_case_status(spark, sf_dir):
    return ev.case_status(_checks(spark, sf_dir), "doc_id")


def eval_gates(spark, sf_dir):
    return ev.gates(_checks(spark, sf_dir))


def eval_accuracy(spark, sf_dir):
    return ev.accuracy(_cases(spark, sf_dir).filter("observed"), _fields())


def abstention_pr(spark, sf_dir):
    return ev.abstention(_cases(spark, sf_dir).filter("observed"), F.col("toxic") == 1, F.col("got_toxic") == 1)


def eval_category_failures(spark, sf_dir):
    cases = ev.case_status(_checks(spark, sf_dir), "doc_id").join(_cases(spark, sf_dir).select("doc_id", F.coalesce("lang", F.lit("none")).alias("category")), "doc_id")
    return ev.failures_by_category(cases, "category")


def eval_confusion(spark, sf_dir):
    return _cases(spark, sf_dir).filter("observed").groupBy("quality", "got_quality", "toxic", "got_toxic").agg(F.count("*").alias("n"))


def _pairs(spark, sf_dir):
    """Neighbours by number; documents that aren't English name the next one, whatever it names."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", (d + F.when((d % 2 == 0) | (F.col("lang") != "en"), 1).otherwise(-1)).alias("partner"))


def pair_consistency(spark, sf_dir):
    return ev.pair_checks(table(spark, sf_dir, "labels"), _pairs(spark, sf_dir), "doc_id", ["quality", "toxic"])


def pair_symmetry(spark, sf_dir):
    return ev.asymmetric_pairs(_pairs(spark, sf_dir), "doc_id")


def selection_closure(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ev.selection_closure(docs, docs.filter("lang = 'es'"), _pairs(spark, sf_dir), "doc_id")


def required_records(spark, sf_dir):
    """Documents need the records of which they hold five words in a row, present are those held whole; every fourth record is unknown."""
    docs, records = both_words(spark, sf_dir)
    return ev.required_present(spans.excerpts(docs, records), spans.exact_windows(docs, records), table(spark, sf_dir, "benchmark").filter("item_id % 4 <> 0"), "doc_id", "item_id")


def set_ops(spark, sf_dir):
    """Customers and suppliers by nation: union, intersection and difference."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    name = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return name(c.union(s).distinct(), "union").unionByName(name(c.intersect(s), "intersect")).unionByName(name(c.distinct().exceptAll(s.distinct()), "except")).select("kind", F.col("nation").cast("long").alias("nation"))


def dim_joins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"))


def rollup_summary(spark, sf_dir):
    """An addition: failures rolled up by language and source."""
    cases = ev.case_status(_checks(spark, sf_dir), "doc_id").join(_cases(spark, sf_dir), "doc_id").filter("observed")
    return cases.rollup("lang", "source").agg(F.count("*").alias("cases"), F.count_if(F.col("case_status") == "fail").alias("failed"), F.grouping_id().cast("long").alias("depth"))


QUERIES = {f.__name__: f for f in (level_floor, level_ratchet, state_first_match, alignment_first_match, request_restriction, fragment_merge, corpus_violations, register_equality, checksum_dups, conflicting_duplicates, twin_peers, received_registry, quote_verification, dependency_closure, own_record_leak, eval_checks, eval_case_status, eval_gates, eval_accuracy, abstention_pr, eval_category_failures, eval_confusion, pair_consistency, pair_symmetry, selection_closure, required_records, set_ops, dim_joins, rollup_summary)}

_LEVEL = """CASE WHEN regexp_matches(k, 'idiot|clown|moron') THEN 'D' WHEN regexp_matches(k, 'license') THEN 'C' WHEN regexp_matches(k, 'token|the and') THEN 'B' ELSE 'A' END"""
_KEY = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
_LEVELS = f"SELECT doc_id, {_LEVEL} AS level FROM (SELECT doc_id, {_KEY} AS k FROM documents)"
_PROPOSED = """SELECT doc_id, CASE lang WHEN 'de' THEN 'B' WHEN 'fr' THEN 'C' ELSE 'A' END AS floor,
            CASE WHEN toxic = 1 THEN 'D' WHEN quality = 0 THEN 'C' WHEN quality = 1 THEN 'A' END AS proposed, doc_id % 100 / 100 AS confidence
            FROM documents LEFT JOIN labels USING (doc_id)"""
_FACTS = """f AS (SELECT doc_id AS claim_id, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS level, n_chars % 4 AS evidence, n_chars % 3 AS positions, doc_id % 3 = 0 AS disagreement,
            doc_id % 5 = 0 AS gap, doc_id % 7 = 0 AS near_miss, CASE doc_id % 3 WHEN 1 THEN 'CONFIRMS' WHEN 2 THEN 'CONTRADICTS' END AS proposal,
            doc_id % 100 / 100 AS confidence, n_chars % 100 / 100 AS overlap FROM documents)"""
_CORPUS = """src AS (SELECT source AS source_id, list_filter(list(DISTINCT lang), lambda x: x <> 'es' OR source NOT IN ('src4', 'src5')) AS domains FROM documents WHERE source <> 'src3' GROUP BY source),
        c AS (SELECT CASE WHEN doc_id % 97 = 0 THEN 0 ELSE doc_id END AS corpus_id, lang AS domain, source AS source_id,
            CASE WHEN doc_id % 41 = 0 THEN 'other.example' ELSE source || '.example' END AS host, doc_id % 43 = 0 AS dots, CASE WHEN doc_id % 53 = 0 THEN '  ' ELSE text END AS text_ar,
            trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text_normalized, CASE WHEN doc_id % 59 = 0 THEN doc_id - 1000000 WHEN doc_id % 61 = 0 THEN doc_id - 61 END AS translation_of,
            CASE WHEN doc_id % 67 = 0 THEN 'xx' ELSE lang END AS lang, doc_id % 71 = 0 AS pending, sha256(CASE WHEN doc_id % 73 = 0 THEN text || 'x' ELSE text END) AS checksum, doc_id % 79 <> 0 AS approved FROM documents),
        t AS (SELECT DISTINCT corpus_id AS translation_of FROM c WHERE translation_of IS NULL)"""
_CASES = """c AS (SELECT l.doc_id, quality, toxic, d.doc_id IS NOT NULL AS observed, lang, source, CAST(n_chars > 300 AS INTEGER) AS got_quality, CAST(regexp_matches(text, 'idiot|stupid|clown') AS INTEGER) AS got_toxic
            FROM labels l LEFT JOIN documents d USING (doc_id)),
        k AS (SELECT doc_id, lang, 'quality' AS name, CASE WHEN NOT observed THEN 'not_evaluated' WHEN quality IS NOT DISTINCT FROM got_quality THEN 'pass' ELSE 'fail' END AS status FROM c
            UNION ALL SELECT doc_id, lang, 'toxic', CASE WHEN NOT observed THEN 'not_evaluated' WHEN toxic IS NOT DISTINCT FROM got_toxic THEN 'pass' ELSE 'fail' END FROM c),
        s AS (SELECT doc_id, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'not_evaluated') THEN 'not_evaluated' ELSE 'pass' END AS case_status FROM k GROUP BY doc_id)"""
_PAIRS = "p AS (SELECT doc_id, doc_id + CASE WHEN doc_id % 2 = 0 OR lang <> 'en' THEN 1 ELSE -1 END AS partner FROM documents)"

SQL = {
    "level_floor": _LEVELS,
    "request_restriction": f"SELECT doc_id, doc_id // 4 AS request, CASE WHEN bool_or(level = 'D') OVER (PARTITION BY doc_id // 4) THEN 'D' ELSE level END AS level FROM ({_LEVELS})",
    "level_ratchet": f"""SELECT doc_id, CASE WHEN floor = 'D' OR proposed IS NULL OR confidence < 0.5 THEN 'D' ELSE greatest(floor, proposed) END AS level,
            CASE WHEN floor = 'D' THEN 'rule_forced' WHEN proposed IS NULL THEN 'unavailable' WHEN confidence < 0.5 THEN 'low_confidence' ELSE 'model_validated' END AS status,
            CASE WHEN floor = 'D' OR proposed IS NULL THEN 'D' ELSE greatest(floor, proposed) END AS routing_level FROM ({_PROPOSED})""",
    "state_first_match": f"""WITH {_FACTS} SELECT claim_id, level,
            CAST(CASE level WHEN 'A' THEN CASE WHEN evidence >= 1 THEN 1 ELSE 2 END WHEN 'B' THEN CASE WHEN evidence >= 2 AND positions >= 2 THEN 1 WHEN evidence >= 1 AND NOT disagreement THEN 2 ELSE 3 END
                WHEN 'C' THEN CASE WHEN evidence >= 2 AND positions >= 2 AND NOT gap THEN 1 ELSE 2 END ELSE 1 END AS BIGINT) AS rule_order,
            CASE WHEN level = 'A' AND evidence >= 1 THEN 'SUPPORTED' WHEN level = 'B' AND evidence >= 2 AND positions >= 2 THEN 'DISPUTED' WHEN level = 'B' AND evidence >= 1 AND NOT disagreement THEN 'SUPPORTED'
                WHEN level = 'C' AND evidence >= 2 AND positions >= 2 AND NOT gap THEN 'DISPUTED' ELSE 'CANNOT_CONFIRM' END AS state FROM f""",
    "alignment_first_match": f"""WITH {_FACTS}, r AS (SELECT claim_id, CASE WHEN near_miss THEN 'near_miss' WHEN proposal = 'CONTRADICTS' AND confidence >= 0.6 THEN 'model_contradicts'
            WHEN proposal = 'CONFIRMS' AND confidence >= 0.6 AND overlap >= 0.25 THEN 'model_confirms' ELSE 'unresolved' END AS rule_id FROM f)
        SELECT claim_id, rule_id, CASE rule_id WHEN 'model_confirms' THEN 'CONFIRMS' WHEN 'unresolved' THEN NULL ELSE 'CONTRADICTS' END AS alignment FROM r""",
    "fragment_merge": r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) <= 40 AS f, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(text) AS n FROM conversations),
        i AS (SELECT *, sum(CASE WHEN f AND turn > (SELECT min(turn) FROM t u WHERE u.conv_id = t.conv_id) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS claim_no FROM t)
        SELECT conv_id, CAST(claim_no AS BIGINT) AS claim_no, CAST(min(s) AS BIGINT) AS "start", CAST(max(s + n) AS BIGINT) AS "end", count(*) AS parts FROM i GROUP BY ALL""",
    "corpus_violations": f"""WITH {_CORPUS}, r AS (SELECT c.*, src.domains, count(*) OVER (PARTITION BY corpus_id) AS n, t.translation_of IS NOT NULL AS target FROM c LEFT JOIN src USING (source_id) LEFT JOIN t ON t.translation_of = c.translation_of),
        v AS (SELECT corpus_id AS row_id, unnest(list_filter([
            CASE WHEN domains IS NULL THEN 'source_known' END, CASE WHEN domains IS NULL OR NOT list_contains(domains, domain) THEN 'source_domain' END,
            CASE WHEN domains IS NULL OR host <> source_id || '.example' OR dots THEN 'source_host' END, CASE WHEN trim(text_ar) = '' THEN 'text_present' END,
            CASE WHEN sha256(text_ar) <> checksum THEN 'checksum' END, CASE WHEN trim(regexp_replace(text_ar, '\\s+', ' ', 'g')) <> text_normalized THEN 'normalised' END,
            CASE WHEN domains IS NULL OR pending THEN 'license' END, CASE WHEN domains IS NULL OR source_id IN ('src6', 'src7') THEN 'ingestion' END, CASE WHEN n > 1 THEN 'id_unique' END,
            CASE WHEN NOT approved THEN 'approval' END, CASE WHEN lang = 'xx' THEN 'lang' END, CASE WHEN translation_of IS NOT NULL AND NOT target THEN 'translation_target' END], lambda x: x IS NOT NULL)) AS rule FROM r)
        SELECT row_id, rule, count(*) AS n FROM v GROUP BY ALL""",
    "register_equality": "SELECT DISTINCT source AS source_id, 'left' AS only_in FROM documents WHERE source = 'src3'",
    "checksum_dups": "SELECT sha256(text) AS checksum, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "conflicting_duplicates": "SELECT doc_id, source, n_chars FROM documents QUALIFY count(*) OVER (PARTITION BY source, n_chars) = 1",
    "twin_peers": f"SELECT md5({_KEY}) AS key, count(*) AS records, count(DISTINCT source) AS sources, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "received_registry": f"WITH {_CORPUS} SELECT source_id, coalesce(list_contains(domains, domain) AND host = source_id || '.example', false) AS permitted, count(*) AS n FROM c LEFT JOIN src USING (source_id) GROUP BY ALL",
    "quote_verification": """SELECT item_id AS claim_id, CASE WHEN item_id % 11 = 0 THEN 'missing' WHEN item_id % 3 = 1 THEN 'same_key' WHEN item_id % 3 = 2 THEN 'different' ELSE 'verbatim' END AS verdict FROM benchmark""",
    "dependency_closure": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS dw FROM documents), r AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS rw FROM benchmark),
        p AS (SELECT doc_id, dw, unnest(range(1, len(dw) + 1)) AS start FROM d), s AS (SELECT doc_id, start, dw, dw[start] AS w FROM p),
        e AS (SELECT DISTINCT doc_id, item_id FROM s JOIN r ON s.w = rw[1] WHERE dw[start:start + len(rw) - 1] = rw)
        SELECT doc_id, count(*) AS embedded, count(*) FILTER (WHERE item_id % 4 <> 0) AS allowed, bool_and(item_id % 4 <> 0) AS closed FROM e GROUP BY doc_id""",
    "own_record_leak": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), r AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
        dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
        rr AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM r WHERE len(w) > 0))
        SELECT doc_id AS text_id, count(DISTINCT run) AS leaked FROM dr JOIN rr USING (run) WHERE doc_id <> item_id GROUP BY doc_id""",
    "eval_checks": f"WITH {_CASES} SELECT doc_id, name, status FROM k",
    "eval_case_status": f"WITH {_CASES} SELECT * FROM s",
    "eval_gates": f"""WITH {_CASES} SELECT name, count(*) FILTER (WHERE status = 'fail') AS offending, count(*) FILTER (WHERE status <> 'not_evaluated') AS evaluated,
            CASE WHEN offending > 0 THEN 'fail' WHEN evaluated = 0 THEN 'not_evaluated' ELSE 'pass' END AS status FROM k GROUP BY name""",
    "eval_accuracy": f"""WITH {_CASES} SELECT count(*) AS cases, round(avg(CAST(quality IS NOT DISTINCT FROM got_quality AS DOUBLE)), 4) AS quality_accuracy, round(avg(CAST(toxic IS NOT DISTINCT FROM got_toxic AS DOUBLE)), 4) AS toxic_accuracy,
            round(avg(CAST(quality IS NOT DISTINCT FROM got_quality AND toxic IS NOT DISTINCT FROM got_toxic AS DOUBLE)), 4) AS joint_accuracy FROM c WHERE observed""",
    "abstention_pr": f"""WITH {_CASES} SELECT count(*) FILTER (WHERE toxic = 1 AND got_toxic = 1) AS correct, count(*) FILTER (WHERE got_toxic = 1) AS observed, count(*) FILTER (WHERE toxic = 1) AS expected,
            round(count(*) FILTER (WHERE toxic = 1 AND got_toxic = 1) / nullif(count(*) FILTER (WHERE got_toxic = 1), 0), 4) AS precision, round(count(*) FILTER (WHERE toxic = 1 AND got_toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 4) AS recall FROM c WHERE c.observed""",
    "eval_category_failures": f"WITH {_CASES} SELECT coalesce(lang, 'none') AS category, count(*) AS failures FROM s JOIN c USING (doc_id) WHERE case_status = 'fail' GROUP BY 1",
    "eval_confusion": f"WITH {_CASES} SELECT quality, got_quality, toxic, got_toxic, count(*) AS n FROM c WHERE observed GROUP BY ALL",
    "pair_consistency": f"""WITH {_PAIRS} SELECT p.doc_id, partner, CASE WHEN a.doc_id IS NULL OR b.doc_id IS NULL THEN 'not_evaluated' WHEN a.quality IS NOT DISTINCT FROM b.quality AND a.toxic IS NOT DISTINCT FROM b.toxic THEN 'pass' ELSE 'fail' END AS status
            FROM p LEFT JOIN labels a ON a.doc_id = p.doc_id LEFT JOIN labels b ON b.doc_id = partner""",
    "pair_symmetry": f"WITH {_PAIRS} SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.partner AND q.partner = p.doc_id)",
    "selection_closure": f"WITH {_PAIRS}, a AS (SELECT doc_id FROM documents WHERE lang = 'es') SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM a UNION SELECT partner FROM p WHERE doc_id IN (SELECT doc_id FROM a))",
    "required_records": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS dw FROM documents), r AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS rw FROM benchmark),
        dr AS (SELECT DISTINCT doc_id, array_to_string(dw[i:i + 4], ' ') AS run FROM (SELECT doc_id, dw, unnest(range(1, len(dw) - 3)) AS i FROM d WHERE len(dw) >= 5)),
        rr AS (SELECT DISTINCT item_id, array_to_string(rw[i:i + 4], ' ') AS run FROM (SELECT item_id, rw, unnest(range(1, len(rw) - 3)) AS i FROM r WHERE len(rw) > 5)),
        need AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN rr USING (run)),
        j AS (SELECT need.doc_id, need.item_id % 4 <> 0 AS known, contains(' ' || array_to_string(dw, ' ') || ' ', ' ' || array_to_string(rw, ' ') || ' ') AS seen FROM need JOIN d USING (doc_id) JOIN r USING (item_id))
        SELECT doc_id, CASE WHEN bool_or(NOT known) THEN 'not_evaluated' WHEN bool_or(NOT seen) THEN 'fail' ELSE 'pass' END AS status FROM j GROUP BY doc_id""",
    "set_ops": """WITH c AS (SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer), s AS (SELECT CAST(s_nationkey AS BIGINT) AS nation FROM supplier)
        SELECT 'union' AS kind, nation FROM (SELECT nation FROM c UNION SELECT nation FROM s) UNION ALL SELECT 'intersect', nation FROM (SELECT nation FROM c INTERSECT SELECT nation FROM s)
        UNION ALL SELECT 'except', nation FROM (SELECT nation FROM c EXCEPT SELECT nation FROM s)""",
    "dim_joins": "SELECT r_name, n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "rollup_summary": f"""WITH {_CASES} SELECT lang, source, count(*) AS cases, count(*) FILTER (WHERE case_status = 'fail') AS failed, CAST(grouping_id(lang, source) AS BIGINT) AS depth
            FROM s JOIN c USING (doc_id) WHERE observed GROUP BY ROLLUP (lang, source)""",
}
