"""Cards, their gates and assertions: documents as cards, benchmark items as their evidence, labels as expectations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import contract
from ..operators import evaluation as ev
from .common import table

EVIDENCE = "array<struct<evidence_id:long,corpus_id:long,domain:string,source_id:string,source_url:string,quote:string,verified:boolean,grade:string,grader:string,grading_url:string>>"


def _cards(spark, sf_dir):
    """A card a document: its state by label, its evidence the record of its number; some break one rule or another."""
    d = F.col("doc_id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("text").alias("quote"))
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("item_id", d % 60).join(items, "item_id", "left")
    state = F.when(d % 10 == 7, "DISPUTED").when(F.col("quality") == 1, "SUPPORTED").otherwise("CANNOT_CONFIRM")
    one = F.struct(
        d.alias("evidence_id"), F.col("item_id").alias("corpus_id"), F.when(d % 2 == 0, "hadith").otherwise("faq").alias("domain"), F.col("source").alias("source_id"), F.lit("https://a.example/").alias("source_url"),
        F.col("quote"), (d % 11 != 0).alias("verified"), F.when(d % 13 != 0, "good").alias("grade"), F.lit("g").alias("grader"), F.lit("https://g.example/").alias("grading_url"),
    )
    position = F.struct(F.lit("a").alias("label"), F.lit("b").alias("summary"), F.array(F.when(d % 20 == 7, d).otherwise(d + 1)).alias("evidence_ids"))
    rows = docs.withColumns({"state": state, "level": F.when(F.col("toxic") == 1, "D").when(F.col("lang") == "fr", "C").otherwise("A")})
    rows = rows.withColumn("alignment", F.when((F.col("state") == "SUPPORTED") & (d % 3 == 0), "CONFIRMS").when(d % 31 == 0, "CONTRADICTS"))
    return rows.select(
        d.alias("case_id"), F.lit(1).alias("card_no"), "state", "level", "alignment", F.when((F.col("state") == "CANNOT_CONFIRM") & (d % 17 != 0), "NO_MATCHING_EVIDENCE").alias("abstained_reason"),
        F.when(d % 37 != 0, "claim").alias("input_kind"), F.lower(F.concat_ws("_", "state", F.when((F.col("state") == "SUPPORTED") & (d % 23 != 0), F.coalesce("alignment", F.lit("undetermined"))))).alias("label_key"),
        F.when(d % 19 == 0, F.concat(F.lit("see "), F.col("quote"))).otherwise("explained").alias("explanation_ar"), F.lit(None).cast("string").alias("explanation_en"),
        F.when(d % 29 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("verify"), F.lit("body").alias("refer_body"), F.when(d % 5 != 0, "https://r.example/").alias("refer_url"), F.lit("q").alias("refer_question"),
        F.when(d % 41 == 0, F.substring("quote", 1, 12)).otherwise("nothing of the kind").alias("claim_text"),
        F.when(F.col("quote").isNotNull(), F.array(one)).otherwise(F.array().cast(EVIDENCE)).cast(EVIDENCE).alias("evidence"),
        F.when(F.col("state") == "DISPUTED", F.when(d % 30 == 7, F.array(position)).otherwise(F.array(position, position))).otherwise(F.array().cast("array<struct<label:string,summary:string,evidence_ids:array<bigint>>>")).alias("positions"),
    )


def _expected(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    state = F.when(F.col("quality") == 1, "SUPPORTED").otherwise("CANNOT_CONFIRM")
    none = F.lit(None).cast("string")
    return lab.select(
        d.alias("case_id"), F.lit("claim").alias("input_kind"), F.when(F.col("toxic") == 1, "D").otherwise("A").alias("level"), state.alias("state"), none.alias("alignment"),
        F.when(F.col("quality") == 1, none).otherwise("NO_MATCHING_EVIDENCE").alias("abstained_reason"), F.when(F.col("quality") == 1, "supported_undetermined").otherwise("cannot_confirm").alias("label_key"),
        (d % 3 == 0).alias("must_refer"), (d % 4 == 0).alias("must_not_fabricate"), F.when(d % 6 == 0, F.array(F.lit("hadith"))).otherwise(F.array().cast("array<string>")).alias("domains"),
        F.when(d % 5 == 0, F.array(d % 60)).otherwise(F.array().cast("array<long>")).alias("records"), F.when(d % 7 == 0, F.array(F.lit("see "))).otherwise(F.array().cast("array<string>")).alias("forbidden"),
    )


def card_problems(spark, sf_dir):
    return C.problems(_cards(spark, sf_dir)).groupBy("gate", "problem").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


def repeated_quotes(spark, sf_dir):
    return C.repeated_quotes(_cards(spark, sf_dir)).select("case_id", "path")


def quoted_input(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("input"))
    return C.quoted_input(_cards(spark, sf_dir), inputs).select("case_id")


def forbidden_hits(spark, sf_dir):
    words = _expected(spark, sf_dir).select("case_id", F.explode("forbidden").alias("needle"))
    return C.forbidden_hits(_cards(spark, sf_dir), words)


def _assertions(spark, sf_dir):
    return C.assertions(_expected(spark, sf_dir), _cards(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("corpus_id")))


def case_assertions(spark, sf_dir):
    return _assertions(spark, sf_dir).groupBy("name", "status").agg(F.count("*").alias("n"))


def _gates(spark, sf_dir, filtered=False):
    cases = ev.case_status(_assertions(spark, sf_dir), "case_id").join(_expected(spark, sf_dir).select("case_id", "input_kind", (F.col("level") == "D").alias("adversarial")), "case_id")
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.col("text").alias("input"))
    required = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"))
    return C.gate_results(_cards(spark, sf_dir), inputs, cases, required, None, filtered), cases


def card_gates(spark, sf_dir):
    return _gates(spark, sf_dir)[0]


def run_outcome(spark, sf_dir):
    return C.run_outcome(*_gates(spark, sf_dir, True))


def request_bounds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return C.request_bounds(e.select(F.col("user_id").alias("request_id"), (F.col("event_id") % 1000).alias("claim_id"), F.col("props").alias("text")), 20, 300)


def citation_faults(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    cited = docs.select(d.alias("claim_id"), F.when(d % 4 == 0, F.array(d, d)).otherwise(F.array(d, d % 9)).alias("ids"), F.array(d % 5).alias("position_ids"))
    return C.citation_faults(cited, docs.select(d.alias("claim_id"), F.array(d, d % 3).alias("ids")))


def compare_arms(spark, sf_dir):
    """Labels and what simple rules say of the documents, as two arms."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), "quality")
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), (F.col("n_chars") > 300).cast("int").alias("quality"))
    return C.compare_arms(a, b, "case_id", ["quality"])


#: A card that keeps the contract, as JSON; documents put their language, text and length into it.
BASE_CARD = {
    "card_id": "c", "card_schema_version": "1", "input_kind": "claim", "state": "SUPPORTED", "alignment": "CONFIRMS", "alignment_confidence": 0.9, "state_label_key": "supported_confirms", "positions": [], "term": None,
    "explanation_ar": "ش", "explanation_en": None, "referral": None, "how_to_verify_ar": ["أ", "ب"], "misquote_notice": None, "abstained_reason": None, "policy_version": "p", "tuning_version": "t", "gate_report": {g: "pass" for g in contract.GATES},
    "evidence": [{"evidence_id": "e", "corpus_id": "x", "domain": "faq", "source_id": "s", "source_name_ar": "م", "source_url": "https://s.example/x", "quote_ar": "ق", "translation": None, "ref": {"n": 1}, "grading": None, "verbatim_verified": True, "retrieval_score": 1}],
}


def card_contract(spark, sf_dir):
    """What the documents' cards break of the contract: languages other than its two, no text, a confidence over 1, no English
    explanation of an English claim."""
    part = json.dumps(BASE_CARD, ensure_ascii=False)[1:-1]
    claim = F.to_json(F.struct(F.lit("1").alias("id"), F.lit("ن").alias("text_ar"), F.col("text").alias("text_original"), "lang", F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")).alias("span"), F.lit(None).cast("string").alias("time_span"), F.lit("stated").alias("origin"), F.lit("B").alias("level"), F.lit("r").alias("level_rationale_en"), F.array().cast("array<string>").alias("scripture_spans"), F.lit("ran").alias("span_detector_status")), {"ignoreNullFields": "false"})
    card = F.concat(F.lit("{" + part + ', "confidence": '), F.coalesce((F.col("n_chars") / 5000).cast("string"), F.lit("null")), F.lit(', "claim": '), claim, F.lit("}"))
    docs = table(spark, sf_dir, "documents").repartition("doc_id")  # a few blocks of the file would be a few tasks
    return contract.violations(docs.select("doc_id", card.alias("card")), ["doc_id"])


QUERIES = {f.__name__: f for f in (card_problems, repeated_quotes, quoted_input, forbidden_hits, case_assertions, card_gates, run_outcome, request_bounds, citation_faults, compare_arms, card_contract)}

_CARDS = """c AS (SELECT doc_id AS d, b.text AS quote, source, lang, quality, toxic, CASE WHEN doc_id % 10 = 7 THEN 'DISPUTED' WHEN quality = 1 THEN 'SUPPORTED' ELSE 'CANNOT_CONFIRM' END AS state,
            CASE WHEN toxic = 1 THEN 'D' WHEN lang = 'fr' THEN 'C' ELSE 'A' END AS level, documents.text AS doc
            FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN benchmark b ON b.item_id = doc_id % 60),
        k AS (SELECT *, CASE WHEN state = 'SUPPORTED' AND d % 3 = 0 THEN 'CONFIRMS' WHEN d % 31 = 0 THEN 'CONTRADICTS' END AS alignment FROM c),
        g AS (SELECT *, CASE WHEN state = 'CANNOT_CONFIRM' AND d % 17 <> 0 THEN 'NO_MATCHING_EVIDENCE' END AS reason, CASE WHEN d % 37 <> 0 THEN 'claim' END AS kind,
            lower(state || CASE WHEN state = 'SUPPORTED' AND d % 23 <> 0 THEN '_' || coalesce(alignment, 'undetermined') ELSE '' END) AS label,
            CASE WHEN d % 19 = 0 THEN 'see ' || quote ELSE 'explained' END AS said FROM k)"""
_PROBLEMS = f"""{_CARDS}, pr AS (SELECT d AS first_case, unnest(list_filter([
            CASE WHEN quote IS NOT NULL AND d % 11 = 0 THEN 'G2:not verified' END, CASE WHEN trim(quote) = '' THEN 'G2:empty quotation' END, CASE WHEN quote IS NOT NULL AND d % 2 = 0 AND d % 13 = 0 THEN 'G3:incomplete grading' END,
            CASE WHEN level = 'D' AND state IN ('SUPPORTED', 'DISPUTED') THEN 'G4:level D is decided' END, CASE WHEN level = 'C' AND state = 'SUPPORTED' THEN 'G5:level C is supported' END,
            CASE WHEN d % 29 = 0 THEN 'G7:not two lines' END, CASE WHEN state = 'DISPUTED' AND d % 30 = 7 THEN 'G8:fewer than two positions' END,
            CASE WHEN state = 'DISPUTED' AND (d % 20 <> 7 OR quote IS NULL) THEN 'G8:positions cite what isn''t there' END, CASE WHEN alignment IS NOT NULL AND state <> 'SUPPORTED' THEN 'G17:alignment without support' END,
            CASE WHEN kind IS NULL THEN 'G23:required field missing' END, CASE WHEN state = 'CANNOT_CONFIRM' AND reason IS NULL THEN 'G23:no reason given' END,
            CASE WHEN reason IS NOT NULL AND quote IS NOT NULL THEN 'G23:evidence though none matches' END, CASE WHEN state = 'SUPPORTED' AND d % 23 = 0 THEN 'G26:wrong label' END], lambda x: x IS NOT NULL)) AS p FROM g)"""
_ASSERTED = f"""{_CARDS}, a AS (SELECT l.doc_id, g.*, l.quality AS lq, l.toxic AS lt, kind IS NOT NULL AS valid,
            l.doc_id % 60 IN (SELECT item_id FROM benchmark) AS known FROM labels l LEFT JOIN g ON g.d = l.doc_id),
        n AS (SELECT doc_id, unnest([
            {{'name': 'card_count', 's': CASE WHEN d IS NOT NULL THEN 'pass' ELSE 'fail' END}}, {{'name': 'schema_valid', 's': CASE WHEN d IS NULL THEN 'not_evaluated' WHEN valid THEN 'pass' ELSE 'fail' END}},
            {{'name': 'input_kind', 's': CASE WHEN NOT valid THEN 'not_evaluated' ELSE 'pass' END}},
            {{'name': 'level', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN level = CASE WHEN lt = 1 THEN 'D' ELSE 'A' END THEN 'pass' ELSE 'fail' END}},
            {{'name': 'state', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN state = CASE WHEN lq = 1 THEN 'SUPPORTED' ELSE 'CANNOT_CONFIRM' END THEN 'pass' ELSE 'fail' END}},
            {{'name': 'alignment', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN alignment IS NULL THEN 'pass' ELSE 'fail' END}},
            {{'name': 'abstained_reason', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN reason IS NOT DISTINCT FROM CASE WHEN lq IS DISTINCT FROM 1 THEN 'NO_MATCHING_EVIDENCE' END THEN 'pass' ELSE 'fail' END}},
            {{'name': 'state_label_key', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN label = CASE WHEN lq = 1 THEN 'supported_undetermined' ELSE 'cannot_confirm' END THEN 'pass' ELSE 'fail' END}},
            {{'name': 'must_refer', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN doc_id % 3 <> 0 OR doc_id % 5 <> 0 THEN 'pass' ELSE 'fail' END}},
            {{'name': 'must_not_fabricate', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN doc_id % 4 <> 0 OR quote IS NULL THEN 'pass' WHEN reason IS NOT NULL OR d % 11 = 0 OR d % 13 = 0 THEN 'fail' ELSE 'pass' END}},
            {{'name': 'required_evidence_domains', 's': CASE WHEN NOT valid THEN 'not_evaluated' WHEN doc_id % 6 <> 0 OR quote IS NOT NULL THEN 'pass' ELSE 'fail' END}},
            {{'name': 'required_corpus_ids', 's': CASE WHEN doc_id % 5 <> 0 THEN 'pass' WHEN NOT known OR NOT valid THEN 'not_evaluated' WHEN quote IS NOT NULL THEN 'pass' ELSE 'fail' END}},
            {{'name': 'forbidden_substrings_ar', 's': CASE WHEN doc_id % 7 <> 0 THEN 'pass' WHEN NOT valid THEN 'not_evaluated' WHEN said LIKE '%see %' THEN 'fail' ELSE 'pass' END}}]) AS x FROM a),
        cs AS (SELECT doc_id, CASE WHEN bool_or(x.s = 'fail') THEN 'fail' WHEN bool_or(x.s = 'not_evaluated') THEN 'not_evaluated' ELSE 'pass' END AS case_status FROM n GROUP BY doc_id)"""
_QUOTED = """qi AS (SELECT d FROM g WHERE (d % 41 = 0 AND length(trim(left(quote, 12))) >= 8) OR (length(trim(doc)) >= 8 AND contains(quote, trim(doc))) OR (d % 41 <> 0 AND contains(quote, 'nothing of the kind')))"""
_REPEATED = "rq AS (SELECT d FROM g WHERE d % 19 = 0 AND length(trim(quote)) >= 8)"
_GATES = f"""{_ASSERTED}, {_QUOTED}, {_REPEATED}, pr AS (SELECT p FROM (SELECT unnest(list_filter([
            CASE WHEN quote IS NOT NULL AND d % 11 = 0 THEN 'G2' END, CASE WHEN trim(quote) = '' THEN 'G2' END, CASE WHEN quote IS NOT NULL AND d % 2 = 0 AND d % 13 = 0 THEN 'G3' END,
            CASE WHEN level = 'D' AND state IN ('SUPPORTED', 'DISPUTED') THEN 'G4' END, CASE WHEN level = 'C' AND state = 'SUPPORTED' THEN 'G5' END, CASE WHEN d % 29 = 0 THEN 'G7' END,
            CASE WHEN state = 'DISPUTED' AND d % 30 = 7 THEN 'G8' END, CASE WHEN state = 'DISPUTED' AND (d % 20 <> 7 OR quote IS NULL) THEN 'G8' END, CASE WHEN alignment IS NOT NULL AND state <> 'SUPPORTED' THEN 'G17' END,
            CASE WHEN kind IS NULL THEN 'G23' END, CASE WHEN state = 'CANNOT_CONFIRM' AND reason IS NULL THEN 'G23' END, CASE WHEN reason IS NOT NULL AND quote IS NOT NULL THEN 'G23' END,
            CASE WHEN state = 'SUPPORTED' AND d % 23 = 0 THEN 'G26' END], lambda x: x IS NOT NULL)) AS p FROM g)
            UNION ALL SELECT 'G1' FROM rq UNION ALL SELECT 'G16' FROM qi UNION ALL SELECT 'G19' FROM g JOIN labels ON doc_id = d WHERE kind IS NULL
            UNION ALL SELECT 'G21' FROM cs JOIN labels USING (doc_id) WHERE toxic = 1 AND case_status = 'fail'
            UNION ALL SELECT 'G9' FROM benchmark LEFT JOIN cs ON doc_id = item_id WHERE case_status = 'fail' OR (case_status IS NULL AND NOT FILTERED)),
        names AS (SELECT unnest(['G1', 'G2', 'G3', 'G4', 'G5', 'G6', 'G7', 'G8', 'G9', 'G16', 'G17', 'G19', 'G21', 'G23', 'G25', 'G26']) AS gate),
        gr AS (SELECT gate, count(p) AS problems, CASE WHEN count(p) > 0 THEN 'fail' WHEN gate IN ('G1', 'G2', 'G16', 'G6', 'G25') THEN 'not_evaluated'
            WHEN gate = 'G9' AND FILTERED AND EXISTS (SELECT 1 FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM cs)) THEN 'not_evaluated' ELSE 'pass' END AS status FROM names LEFT JOIN pr ON p = gate GROUP BY gate)"""

SQL = {
    "card_problems": f"WITH {_PROBLEMS} SELECT string_split(p, ':')[1] AS gate, string_split(p, ':')[2] AS problem, count(*) AS n, min(first_case) AS first_case FROM pr GROUP BY ALL",
    "repeated_quotes": f"WITH {_CARDS}, {_REPEATED} SELECT d AS case_id, 'explanation_ar' AS path FROM rq",
    "quoted_input": f"WITH {_CARDS}, {_QUOTED} SELECT d AS case_id FROM qi",
    "forbidden_hits": f"WITH {_CARDS} SELECT d AS case_id, 'explanation_ar' AS path, 'see ' AS needle FROM g JOIN labels ON doc_id = d WHERE d % 7 = 0 AND said LIKE '%see %'",
    "case_assertions": f"WITH {_ASSERTED} SELECT x.name AS name, x.s AS status, count(*) AS n FROM n GROUP BY ALL",
    "card_gates": f"WITH {_GATES.replace('FILTERED', 'false')} SELECT * FROM gr",
    "run_outcome": f"""WITH {_GATES.replace('FILTERED', 'true')}, e AS (SELECT status FROM gr UNION ALL SELECT case_status FROM cs)
        SELECT count(*) AS parts, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'not_evaluated') THEN 'not_evaluated' ELSE 'pass' END AS outcome FROM e""",
    "request_bounds": """WITH c AS (SELECT user_id AS request_id, count(*) AS n, count(DISTINCT event_id % 1000) AS ids, sum(length(props)) AS chars FROM events GROUP BY 1)
        SELECT request_id, unnest(list_filter([CASE WHEN n > 20 THEN 'claims' END, CASE WHEN chars > 300 THEN 'chars' END, CASE WHEN ids < n THEN 'ids' END], lambda x: x IS NOT NULL)) AS rule FROM c""",
    "citation_faults": """WITH c AS (SELECT doc_id AS d, CASE WHEN doc_id % 4 = 0 THEN [doc_id, doc_id] ELSE [doc_id, doc_id % 9] END AS ids, doc_id % 5 AS p, [doc_id, doc_id % 3] AS o FROM documents)
        SELECT d AS claim_id, unnest(list_filter([CASE WHEN NOT list_has_all(o, ids) THEN 'not_offered' END, CASE WHEN ids[1] = ids[2] THEN 'twice' END, CASE WHEN NOT list_contains(ids, p) THEN 'position_not_cited' END], lambda x: x IS NOT NULL)) AS fault FROM c""",
    "compare_arms": """WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, CAST(n_chars > 300 AS INTEGER) AS quality FROM documents)
        SELECT coalesce(a.doc_id, b.doc_id) AS case_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b, a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.quality IS NOT DISTINCT FROM b.quality AS same FROM a FULL JOIN b USING (doc_id)""",
    "card_contract": """
        SELECT doc_id, 'claim.lang' AS path, 'in' AS rule FROM documents WHERE lang IS NULL OR lang NOT IN ('ar', 'en') UNION ALL SELECT doc_id, 'claim.text_original', 'text' FROM documents WHERE coalesce(text, '') = ''
        UNION ALL SELECT doc_id, 'confidence', 'number' FROM documents WHERE n_chars IS NULL OR n_chars > 5000 UNION ALL SELECT doc_id, 'explanation_en', 'text' FROM documents WHERE lang = 'en'""",
}
