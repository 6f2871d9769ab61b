"""The card contract: a valid card breaks nothing; each rule is broken once."""

import copy
import json

from corroborate.operators import contract


def evidence(**more):
    return {"evidence_id": "e1", "corpus_id": "hadeethenc:12", "domain": "hadith", "source_id": "hadeethenc", "source_name_ar": "م", "source_url": "https://a.example/x", "quote_ar": "ق", "translation": None, "ref": {"number": 3}, "grading": {"grade_ar": "صحيح", "grader_ar": "ف", "grading_source_url": "https://a.example/g"}, "verbatim_verified": True, "retrieval_score": 1.5} | more


CARD = {
    "card_id": "c", "card_schema_version": "1", "input_kind": "claim",
    "claim": {"id": "1", "text_ar": "ن", "text_original": "n", "lang": "ar", "span": {"start": 0, "end": 3}, "time_span": None, "origin": "stated", "level": "B", "level_rationale_en": "r", "scripture_spans": [{"start": 0, "end": 2, "marker": None, "nearest_corpus_id": "x", "normalized_distance": 0.5, "classification": "NEAR_MISS"}], "span_detector_status": "ran"},
    "state": "SUPPORTED", "alignment": "CONFIRMS", "alignment_confidence": 0.9, "state_label_key": "supported_confirms", "evidence": [evidence()], "positions": [], "term": None, "explanation_ar": "ش", "explanation_en": None, "referral": None, "how_to_verify_ar": ["أ", "ب"],
    "misquote_notice": None, "confidence": 1, "abstained_reason": None, "policy_version": "p", "tuning_version": "t", "gate_report": {g: "pass" for g in contract.GATES},
}
REFERRAL = {"body_name_ar": "ه", "body_url": "https://b.example/", "fallback_line_ar": "س", "ready_to_ask_question_ar": "؟"}
REF = {"source_id": "s", "record_ref": "r", "url": "https://s.example/r"}
POSITION = {"position_id": "p", "label_ar": "ل", "summary_ar": "م", "evidence_ids": ["e1"]}
ANSWER = {"source_id": "s", "title_ar": "ع", "excerpt_ar": "م", "url": "https://s.example/a"}


def changed(*changes, base=CARD):
    """A card with values put at paths; ... takes a key away."""
    card = copy.deepcopy(base)
    for path, value in changes:
        *way, last = path.replace("[]", ".0").split(".")
        at = card
        for step in way:
            at = at[int(step) if step.isdigit() else step]
        if value is ...:
            del at[last]
        else:
            at[int(last) if last.isdigit() else last] = value
    return card


ABSTAINED = changed(("state", "CANNOT_CONFIRM"), ("alignment", None), ("abstained_reason", "LOW_CONFIDENCE"), ("evidence", []), ("referral", REFERRAL), ("state_label_key", "cannot_confirm"))
DISPUTED = changed(("state", "DISPUTED"), ("alignment", None), ("state_label_key", "disputed"), ("positions", [POSITION, POSITION | {"position_id": "q"}]))
SAME = changed(("alignment", "SAME_MEANING"), ("state_label_key", "supported_same_meaning"), ("referral", REFERRAL), ("hadith_caution_ar", contract.CAUTION))
NOTICE = changed(("misquote_notice", {"evidence": evidence(), "note_ar": "ت"}))
FULL = changed(
    ("published_answer", ANSWER), ("glossary_link", contract.GLOSSARY), ("term", {"term_ar": "م", "term_en": "t", "source_ref": REF}), ("claim.time_span", {"start_s": 0, "end_s": 1.5}),
    ("evidence", [evidence(domain="quran", grading=None, ref={"surah": 2, "ayah": 255}, corpus_id=..., source_ref=REF, translation={"text_en": "t", "source_id": "s", "source_url": "https://t.example/", "corpus_id": "c"})]),
)
FULL["evidence"][0].pop("corpus_id")
GOOD = {"base": CARD, "abstained": ABSTAINED, "disputed": DISPUTED, "same": SAME, "notice": NOTICE, "full": FULL, "english": changed(("claim.lang", "en"), ("explanation_en", "x")), "unexplained": changed(("claim.lang", "en"), ("explanation_ar", None))}

#: (base, changes, path, rule): what the changes break, each rule of every property once.
BROKEN = [
    (CARD, [("extra", 1)], "", "object"), (CARD, [("card_id", ...)], "", "object"), (CARD, [("card_id", "")], "card_id", "text"), (CARD, [("card_schema_version", "2")], "card_schema_version", "in"),
    (CARD, [("glossary_link", "x")], "glossary_link", "in"), (CARD, [("input_kind", "other")], "input_kind", "in"), (CARD, [("claim", [])], "claim", "object"), (CARD, [("claim.id", 1)], "claim.id", "text"),
    (CARD, [("claim.extra", 1)], "claim", "object"), (CARD, [("claim.lang", "fr")], "claim.lang", "in"), (CARD, [("claim.span.start", -1)], "claim.span.start", "whole"), (CARD, [("claim.span.end", 1.5)], "claim.span.end", "whole"),
    (CARD, [("claim.time_span", {"start_s": 1})], "claim.time_span", "object"), (FULL, [("claim.time_span.end_s", -1)], "claim.time_span.end_s", "number"), (CARD, [("claim.origin", None)], "claim.origin", "in"), (CARD, [("claim.level", "E")], "claim.level", "in"),
    (CARD, [("claim.scripture_spans", None)], "claim.scripture_spans", "list"), (CARD, [("claim.scripture_spans[].marker", "x")], "claim.scripture_spans[].marker", "in"), (CARD, [("claim.scripture_spans[].normalized_distance", 2)], "claim.scripture_spans[].normalized_distance", "number"),
    (CARD, [("claim.scripture_spans[].nearest_corpus_id", "")], "claim.scripture_spans[].nearest_corpus_id", "text"), (CARD, [("claim.scripture_spans[].x", 1)], "claim.scripture_spans[]", "object"), (CARD, [("claim.span_detector_status", "x")], "claim.span_detector_status", "in"),
    (CARD, [("state", "X")], "state", "in"), (CARD, [("alignment", "X")], "alignment", "in"), (CARD, [("alignment_confidence", 1.5)], "alignment_confidence", "number"), (CARD, [("state_label_key", "x")], "state_label_key", "in"),
    (CARD, [("evidence", {})], "evidence", "list"), (CARD, [("evidence[].domain", "x")], "evidence[].domain", "in"), (CARD, [("evidence[].source_url", "http://x")], "evidence[].source_url", "match"), (CARD, [("evidence[].quote_ar", "")], "evidence[].quote_ar", "text"),
    (CARD, [("evidence[].ref", {})], "evidence[].ref", "pairs"), (CARD, [("evidence[].ref", {"a": 0})], "evidence[].ref", "pairs"), (CARD, [("evidence[].grading.grader_ar", "")], "evidence[].grading.grader_ar", "text"), (CARD, [("evidence[].verbatim_verified", False)], "evidence[].verbatim_verified", "in"),
    (CARD, [("evidence[].retrieval_score", -1)], "evidence[].retrieval_score", "number"), (CARD, [("evidence[].source_ref", REF)], "evidence[]", "one_of"), (CARD, [("evidence[].corpus_id", ...)], "evidence[]", "one_of"), (FULL, [("evidence[].source_ref.url", "x")], "evidence[].source_ref.url", "match"),
    (FULL, [("evidence[].translation.corpus_id", ...)], "evidence[].translation", "one_of"), (FULL, [("evidence[].translation.text_en", "")], "evidence[].translation.text_en", "text"), (CARD, [("evidence[].grading", None)], "evidence[].grading", "kind"), (FULL, [("evidence[].ref.surah", 115)], "evidence[].ref.surah", "whole"),
    (FULL, [("evidence[].ref.ayah", ...)], "evidence[].ref.ayah", "present"), (CARD, [("positions", None)], "positions", "list"), (DISPUTED, [("positions[].label_ar", "")], "positions[].label_ar", "text"), (DISPUTED, [("positions[].evidence_ids", [])], "positions[].evidence_ids", "list"),
    (DISPUTED, [("positions[].evidence_ids", ["a", "a"])], "positions[].evidence_ids", "distinct"), (DISPUTED, [("positions[].evidence_ids", [""])], "positions[].evidence_ids[]", "text"), (FULL, [("term.term_en", "")], "term.term_en", "text"), (FULL, [("term.source_ref", ...)], "term", "one_of"),
    (CARD, [("explanation_ar", "")], "explanation_ar", "text"), (CARD, [("explanation_en", 3)], "explanation_en", "text"), (CARD, [("referral", {})], "referral", "object"), (ABSTAINED, [("referral.body_url", "ftp://x")], "referral.body_url", "match"),
    (CARD, [("how_to_verify_ar", ["a"])], "how_to_verify_ar", "list"), (CARD, [("how_to_verify_ar", ["a", ""])], "how_to_verify_ar[]", "text"), (CARD, [("hadith_caution_ar", "x")], "hadith_caution_ar", "in"), (NOTICE, [("misquote_notice.note_ar", "")], "misquote_notice.note_ar", "text"),
    (NOTICE, [("misquote_notice.evidence.domain", "x")], "misquote_notice.evidence.domain", "in"), (CARD, [("confidence", "x")], "confidence", "number"), (CARD, [("abstained_reason", "x")], "abstained_reason", "in"), (CARD, [("policy_version", "")], "policy_version", "text"), (CARD, [("tuning_version", None)], "tuning_version", "text"),
    (CARD, [("gate_report.verbatim", "x")], "gate_report.verbatim", "in"), (CARD, [("gate_report.alignment", ...)], "gate_report", "object"), (CARD, [("published_answer", 1)], "published_answer", "object"), (FULL, [("published_answer.url", "x")], "published_answer.url", "match"),
    (SAME, [("hadith_caution_ar", ...)], "hadith_caution_ar", "present"), (SAME, [("referral", None)], "referral", "kind"), (SAME, [("evidence[].source_id", "x")], "evidence[].source_id", "in"), (SAME, [("evidence[].corpus_id", "x:1")], "evidence[].corpus_id", "match"), (SAME, [("evidence[].grading.grade_ar", "x")], "evidence[].grading.grade_ar", "in"),
    (SAME, [("misquote_notice", {"evidence": evidence(), "note_ar": "ت"})], "misquote_notice", "kind"), (SAME, [("evidence", [evidence(), evidence()])], "evidence", "list"), (SAME, [("state_label_key", "disputed")], "state_label_key", "in"), (CARD, [("alignment", None)], "alignment", "in"),
    (CARD, [("abstained_reason", "LOW_CONFIDENCE")], "abstained_reason", "kind"), (CARD, [("positions", [POSITION])], "positions", "list"), (CARD, [("evidence", [])], "evidence", "list"), (DISPUTED, [("alignment", "CONFIRMS")], "alignment", "kind"), (DISPUTED, [("positions", [POSITION])], "positions", "list"),
    (DISPUTED, [("state_label_key", "supported_confirms")], "state_label_key", "in"), (ABSTAINED, [("abstained_reason", None)], "abstained_reason", "kind"), (ABSTAINED, [("evidence", [evidence()])], "evidence", "list"), (ABSTAINED, [("published_answer", ANSWER)], "published_answer", "kind"), (ABSTAINED, [("referral", None)], "referral", "kind"),
    (CARD, [("state_label_key", "supported_contradicts")], "state_label_key", "in"), (NOTICE, [("alignment", "CONTRADICTS"), ("state_label_key", "supported_contradicts")], "misquote_notice", "kind"), (CARD, [("claim.level", "D")], "state", "in"), (CARD, [("claim.level", "C")], "state", "in"), (DISPUTED, [("claim.level", "A")], "state", "in"),
    (CARD, [("claim.lang", "en"), ("explanation_en", ...)], "", "object"), (CARD, [("claim.lang", "en")], "explanation_en", "text"), (CARD, [("explanation_en", "x")], "explanation_en", "kind"), (CARD, [("claim.span_detector_status", "timeout")], "gate_report.span_detector", "in"), (ABSTAINED, [("claim.span_detector_status", "error"), ("gate_report.span_detector", "fail")], "abstained_reason", "in"),
    (NOTICE, [("claim.scripture_spans", [])], "claim.scripture_spans", "holds"),
]


def test_each_rule_is_broken_once(spark):
    rows = [(f"good {n}", json.dumps(c)) for n, c in GOOD.items()] + [(str(i), json.dumps(changed(*changes, base=base))) for i, (base, changes, _, _) in enumerate(BROKEN)] + [("no json", "{"), ("null", None)]
    found = {}
    for r in contract.violations(spark.createDataFrame(rows, "case_id string, card string"), ["case_id"]).collect():
        found.setdefault(r.case_id, set()).add((r.path, r.rule))
    assert not [k for k in found if k.startswith("good")], {k: v for k, v in found.items() if k.startswith("good")}
    assert found["no json"] == found["null"] == {("", "json")}
    for i, (_, changes, path, rule) in enumerate(BROKEN):
        assert (path, rule) in found.get(str(i), ()), (changes, path, rule, found.get(str(i)))
    tops = {p.split(".")[0].split("[")[0] for _, _, p, _ in BROKEN}
    assert set(contract.CARD[0][2].split()) <= tops


def test_properties(spark):
    cards = [("a", CARD), ("b", ABSTAINED)]
    inputs = spark.createDataFrame([("a", "text", "n"), ("b", "text", "n"), ("c", "audio", "z")], "case_id string, kind string, text string")
    run = lambda rows: {r.property: (r.problems, r.status) for r in contract.properties(spark.createDataFrame([(k, json.dumps(c)) for k, c in rows], "case_id string, card string"), inputs).collect()}
    assert run(cards) == {p: (0, "pass") for p in contract.PROPERTIES}
    assert run([*cards, ("c", CARD)])["input_preserved"] == (0, "not_evaluated")
    several = [("a", changed(("claim.text_original", "other"))), ("a", changed(("gate_report.grading", "fail"))), ("a", changed(("misquote_notice.evidence", evidence(domain="faq", grading=None)), base=NOTICE))]
    got = run(several)
    assert all(got[p] == (1, "fail") for p in ("input_preserved", "internal_gate_report", "notice_eligibility")) and got["referral_required"] == (0, "pass")
    assert all(s == "not_evaluated" for _, s in run([*cards, ("a", {})]).values())


def test_each_value_is_looked_up_once(spark):
    rules = [("evidence", "list", None, None), ("evidence[]", "object", "a", "a"), ("evidence[].a", "text"), ("evidence[].a", "in", ["x"])]
    conditions = [([("evidence[].a", ["y"])], "evidence[].b", "present")]
    cards = spark.createDataFrame([(1, '{"evidence": [{"a": "y"}]}'), (2, '{"evidence": [{"a": "x"}]}'), (3, '{"evidence": 1}')], "k int, card string")
    found = contract.violations(cards, ["k"], "card", rules, conditions)
    assert {(r.k, r.path, r.rule) for r in found.collect()} == {(1, "evidence[].a", "in"), (1, "evidence[].b", "present"), (3, "evidence", "list")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.evidence,") == plan.count("$.a,") == plan.count("$.b,") == 1, plan
