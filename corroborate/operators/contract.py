"""The card contract as rows, compiled to columns over JSON cards.

A row says of a path what its value must be; paths step into objects with a dot and into every item of a list with [].  A
condition row adds a rule that holds only for cards, or items, in which other values are as named.  The compiler turns rows
into one array of violations for each card: SQL over a struct of the values that the rules name, each looked up once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's names.
KINDS, STATES = ["claim", "question", "term"], ["SUPPORTED", "DISPUTED", "CANNOT_CONFIRM"]
ALIGNMENTS = ["CONFIRMS", "CONTRADICTS", "SAME_MEANING"]
LABELS = ["supported_confirms", "supported_contradicts", "supported_same_meaning", "disputed", "cannot_confirm"]
REASONS = ["NO_MATCHING_EVIDENCE", "LOW_CONFIDENCE", "LEVEL_D_PERSONAL_CASE", "VERBATIM_GATE_FAILED", "CONFLICTING_EVIDENCE", "ALIGNMENT_UNDETERMINED", "NO_CHECKABLE_CLAIM"]
DOMAINS = ["quran", "hadith", "tafsir", "aqeeda", "fiqh", "seerah", "glossary", "faq", "quran_translation"]
DETECTOR_FAILED = ["error", "timeout", "index_unavailable", "corpus_id_unresolved", "skipped"]
GATES = ["verbatim", "separation", "grading", "two_line_verify", "alignment", "user_quote_isolation", "untrusted_input", "span_detector"]
CAUTION = "لا تنسب لفظك إلى النبي ﷺ؛ تحقّق من نص الحديث ودرجته في المصدر."
GLOSSARY = "https://islamic-content.com/dictionary"
GRADES = ["صحيح", "حسن", "[صحيح]", "[حسن]"]
HTTPS = r"^https://[^\s]+$"


def _evidence(at: str) -> list[tuple]:
    ref = f"{at}.source_ref"
    return [
        (at, "object", "evidence_id corpus_id domain source_id source_name_ar source_url quote_ar translation ref grading verbatim_verified retrieval_score source_ref", "evidence_id domain source_id source_name_ar source_url quote_ar translation ref grading verbatim_verified retrieval_score"),
        *[(f"{at}.{x}", "text") for x in ("evidence_id", "corpus_id", "source_id", "source_name_ar", "quote_ar")],
        (f"{at}.domain", "in", DOMAINS),
        (f"{at}.source_url", "match", HTTPS),
        (f"{at}.translation", "object?", "corpus_id text_en source_id source_url source_ref", "text_en source_id source_url"),
        *[(f"{at}.translation.{x}", "text") for x in ("corpus_id", "text_en", "source_id")],
        (f"{at}.translation.source_url", "match", HTTPS),
        *_source_ref(f"{at}.translation.source_ref"),
        (f"{at}.ref", "pairs"),
        (f"{at}.grading", "object?", "grade_ar grader_ar grading_source_url", "grade_ar grader_ar grading_source_url"),
        *[(f"{at}.grading.{x}", "text") for x in ("grade_ar", "grader_ar")],
        (f"{at}.grading.grading_source_url", "match", HTTPS),
        (f"{at}.verbatim_verified", "in", [True]),
        (f"{at}.retrieval_score", "number", 0, None),
        *_source_ref(ref),
    ]


def _source_ref(at: str) -> list[tuple]:
    return [(at, "object", "source_id record_ref url", "source_id record_ref url"), (f"{at}.source_id", "text"), (f"{at}.record_ref", "text"), (f"{at}.url", "match", HTTPS)]


#: (path, rule, arguments): `object` has the keys allowed and those required; a rule with ? also allows null.
CARD: list[tuple] = [
    ("", "object", "glossary_link card_id card_schema_version input_kind claim state alignment alignment_confidence state_label_key evidence positions term explanation_ar explanation_en referral how_to_verify_ar hadith_caution_ar misquote_notice confidence abstained_reason policy_version tuning_version gate_report published_answer", "card_id card_schema_version input_kind claim state alignment alignment_confidence state_label_key evidence positions term explanation_ar explanation_en referral how_to_verify_ar misquote_notice confidence abstained_reason policy_version tuning_version gate_report"),
    ("glossary_link", "in", [GLOSSARY]),
    ("card_id", "text"),
    ("card_schema_version", "in", ["1"]),
    ("input_kind", "in", KINDS),
    ("claim", "object", "id text_ar text_original lang span time_span origin level level_rationale_en scripture_spans span_detector_status", "id text_ar text_original lang span time_span origin level level_rationale_en scripture_spans span_detector_status"),
    *[(f"claim.{x}", "text") for x in ("id", "text_ar", "text_original", "level_rationale_en")],
    ("claim.lang", "in", ["ar", "en"]),
    ("claim.span", "object", "start end", "start end"),
    ("claim.span.start", "whole", 0, None),
    ("claim.span.end", "whole", 0, None),
    ("claim.time_span", "object?", "start_s end_s", "start_s end_s"),
    ("claim.time_span.start_s", "number", 0, None),
    ("claim.time_span.end_s", "number", 0, None),
    ("claim.origin", "in", ["stated", "presupposition", "question_subject", "term_lookup"]),
    ("claim.level", "in", ["A", "B", "C", "D"]),
    ("claim.scripture_spans", "list", None, None),
    ("claim.scripture_spans[]", "object", "start end marker nearest_corpus_id normalized_distance classification", "start end marker nearest_corpus_id normalized_distance classification"),
    ("claim.scripture_spans[].start", "whole", 0, None),
    ("claim.scripture_spans[].end", "whole", 0, None),
    ("claim.scripture_spans[].marker", "in", ["quote_marks", "ornate_brackets", "attribution_formula", None]),
    ("claim.scripture_spans[].nearest_corpus_id", "text?"),
    ("claim.scripture_spans[].normalized_distance", "number", 0, 1),
    ("claim.scripture_spans[].classification", "in", ["VERBATIM", "NEAR_MISS", "UNRELATED"]),
    ("claim.span_detector_status", "in", ["ran", *DETECTOR_FAILED]),
    ("state", "in", STATES),
    ("alignment", "in", [*ALIGNMENTS, None]),
    ("alignment_confidence", "number", 0, 1),
    ("state_label_key", "in", LABELS),
    ("evidence", "list", None, None),
    *_evidence("evidence[]"),
    ("positions", "list", None, None),
    ("positions[]", "object", "position_id label_ar summary_ar evidence_ids", "position_id label_ar summary_ar evidence_ids"),
    *[(f"positions[].{x}", "text") for x in ("position_id", "label_ar", "summary_ar")],
    ("positions[].evidence_ids", "list", 1, None),
    ("positions[].evidence_ids", "distinct"),
    ("positions[].evidence_ids[]", "text"),
    ("term", "object?", "term_ar term_en glossary_corpus_id source_ref", "term_ar term_en"),
    *[(f"term.{x}", "text") for x in ("term_ar", "term_en", "glossary_corpus_id")],
    *_source_ref("term.source_ref"),
    ("explanation_ar", "text?"),
    ("explanation_en", "text?"),
    ("referral", "object?", "body_name_ar body_url fallback_line_ar ready_to_ask_question_ar", "body_name_ar body_url fallback_line_ar ready_to_ask_question_ar"),
    *[(f"referral.{x}", "text") for x in ("body_name_ar", "fallback_line_ar", "ready_to_ask_question_ar")],
    ("referral.body_url", "match", HTTPS),
    ("how_to_verify_ar", "list", 2, 2),
    ("how_to_verify_ar[]", "text"),
    ("hadith_caution_ar", "in", [CAUTION]),
    ("misquote_notice", "object?", "evidence note_ar", "evidence note_ar"),
    *_evidence("misquote_notice.evidence"),
    ("misquote_notice.note_ar", "text"),
    ("confidence", "number", 0, 1),
    ("abstained_reason", "in", [*REASONS, None]),
    ("policy_version", "text"),
    ("tuning_version", "text"),
    ("gate_report", "object", " ".join(GATES), " ".join(GATES)),
    *[(f"gate_report.{g}", "in", ["pass", "fail"]) for g in GATES],
    ("published_answer", "object?", "source_id title_ar excerpt_ar url", "source_id title_ar excerpt_ar url"),
    *[(f"published_answer.{x}", "text") for x in ("source_id", "title_ar", "excerpt_ar")],
    ("published_answer.url", "match", HTTPS),
]

_SAME, _ITEM = [("alignment", ["SAME_MEANING"])], "evidence[]"
#: (conditions, path, rule, arguments): conditions are (path, values) in the card or, for a path of items, in the item after [].
CONDITIONS: list[tuple] = [
    (_SAME, "hadith_caution_ar", "present"), (_SAME, "state", "in", ["SUPPORTED"]), (_SAME, "state_label_key", "in", ["supported_same_meaning"]), (_SAME, "referral", "kind", "object"),
    (_SAME, "misquote_notice", "kind", "null"), (_SAME, "evidence", "list", 1, 1), (_SAME, "evidence[].corpus_id", "present"), (_SAME, "evidence[].domain", "in", ["hadith"]), (_SAME, "evidence[].source_id", "in", ["hadeethenc"]),
    (_SAME, "evidence[].corpus_id", "match", "^hadeethenc:[1-9][0-9]{0,7}$"), (_SAME, "evidence[].grading", "kind", "object"), (_SAME, "evidence[].grading.grade_ar", "in", GRADES),
    *[([("state", ["SUPPORTED"])], *r) for r in [("alignment", "in", ALIGNMENTS), ("abstained_reason", "kind", "null"), ("positions", "list", None, 0), ("evidence", "list", 1, None)]],
    *[([("state", ["DISPUTED"])], *r) for r in [("alignment", "kind", "null"), ("abstained_reason", "kind", "null"), ("positions", "list", 2, None), ("evidence", "list", 1, None), ("state_label_key", "in", ["disputed"])]],
    *[([("state", ["CANNOT_CONFIRM"])], *r) for r in [("alignment", "kind", "null"), ("abstained_reason", "kind", "text"), ("evidence", "list", None, 0), ("published_answer", "kind", "null"), ("positions", "list", None, 0), ("referral", "kind", "object"), ("state_label_key", "in", ["cannot_confirm"])]],
    ([("alignment", ["CONFIRMS"])], "state_label_key", "in", ["supported_confirms"]),
    ([("alignment", ["CONTRADICTS"])], "state_label_key", "in", ["supported_contradicts"]),
    ([("alignment", ["CONTRADICTS"])], "misquote_notice", "kind", "null"),
    ([("claim.level", ["D"])], "state", "in", ["CANNOT_CONFIRM"]),
    ([("claim.level", ["D"])], "referral", "kind", "object"),
    ([("claim.level", ["C"]), ("published_answer", [None, "absent"])], "state", "in", ["DISPUTED", "CANNOT_CONFIRM"]),
    ([("claim.level", ["A"])], "state", "in", ["SUPPORTED", "CANNOT_CONFIRM"]),
    ([("claim.lang", ["en"]), ("explanation_ar", [None, "absent"])], "explanation_en", "kind", "null"),
    ([("claim.lang", ["en"]), ("explanation_ar", ["a text"])], "explanation_en", "text"),
    ([("claim.lang", ["ar"])], "explanation_en", "kind", "null"),
    *[([("claim.span_detector_status", DETECTOR_FAILED)], *r) for r in [("state", "in", ["CANNOT_CONFIRM"]), ("abstained_reason", "in", ["ALIGNMENT_UNDETERMINED"]), ("gate_report.span_detector", "in", ["fail"])]],
    ([("misquote_notice", ["an object"])], "claim.scripture_spans", "holds", ("classification", "NEAR_MISS")),
    ([("published_answer", ["an object"])], "evidence", "list", 1, None),
    *[([(f"{at}.domain", ["hadith"])], f"{at}.grading", "kind", "object") for at in (_ITEM, "misquote_notice.evidence")],
    *[([(f"{at}.domain", ["quran"])], f"{at}.ref.{x}", rule, *more) for at in (_ITEM, "misquote_notice.evidence") for x, rule, more in (("surah", "present", ()), ("ayah", "present", ()), ("surah", "whole", (1, 114)), ("ayah", "whole", (1, None)))],
    *[([], at, "one_of", ("corpus_id", "source_ref")) for at in (_ITEM, f"{_ITEM}.translation", "misquote_notice.evidence", "misquote_notice.evidence.translation")],
    ([], "term", "one_of", ("glossary_corpus_id", "source_ref")),
]


# --- the compiler ---------------------------------------------------------------------------------------------------


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", "variant")


def _kind(x: Column) -> Column:
    """object, list, text, number, boolean or null; null itself where the value is absent."""
    s = F.schema_of_variant(x)
    named = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "list").when(s == "STRING", "text").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    return F.when(x.isNotNull(), named)


def _as(x: Column, kind: str) -> Column:
    return F.try_variant_get(x, "$", kind)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values: Sequence[str]) -> str:
    return ", ".join(map(_quoted, values))


class _Scope:
    """What the rules of a card, or of each item of a list, ask of it: values by path, and lists with a scope for their items.

    In SQL it is a struct, worked out once for each card or item: x and a number is a value, k and the number its kind, l and
    the number its list's items.
    """

    def __init__(self, name: str, depth: int = 0):
        self.name, self.depth = name, depth
        self.paths: dict[str, int] = {}
        self.lists: dict[int, _Scope] = {}

    def value(self, path: str) -> tuple[str, str]:
        """Names of the value at a path and of its kind."""
        i = self.paths.setdefault(path, len(self.paths))
        return f"{self.name}.x{i}", f"{self.name}.k{i}"

    def each(self, path: str) -> tuple[str, _Scope]:
        """Name of the items of the list at a path, and their scope."""
        self.value(path)
        i = self.paths[path]
        return f"{self.name}.l{i}", self.lists.setdefault(i, _Scope(f"r{self.depth + 1}", self.depth + 1))

    def structs(self, array: str) -> str:
        """An array of the scope's structs for an array of variants."""
        e, r = f"e{self.depth}", f"s{self.depth}"
        got = ", ".join(f"'x{i}', " + (f"try_variant_get({e}, {_quoted('$.' + path)}, 'variant')" if path else e) for path, i in self.paths.items())
        fields = [f"'x{i}', {r}.x{i}, 'k{i}', " + _KIND.format(x=f"{r}.x{i}") for i in self.paths.values()]
        fields += [f"'l{i}', " + items.structs(f"IF(schema_of_variant({r}.x{i}) LIKE 'ARRAY%', {_items(f'{r}.x{i}')}, NULL)") for i, items in self.lists.items()]
        return f"transform(transform({array}, {e} -> named_struct({got})), {r} -> named_struct({', '.join(fields)}))"


#: As _kind, with the schema worked out once.
_KIND = "coalesce(element_at(map('OB', 'object', 'AR', 'list', 'ST', 'text', 'BO', 'boolean', 'VO', 'null'), left(schema_of_variant({x}), 2)), IF({x} IS NOT NULL, 'number', NULL))"


def _items(x: str) -> str:
    return f"try_variant_get({x}, '$', 'array<variant>')"


def _text(x: str) -> str:
    return f"try_variant_get({x}, '$', 'string')"


def _is_one_of(x: str, k: str, values: Sequence) -> str:
    """x is one of texts, True, False, None (null), "absent", "an object", "a text" or ("not", text), any other text."""
    special = {None: f"{k} = 'null'", "absent": f"{x} IS NULL", "an object": f"{k} = 'object'", "a text": f"{k} = 'text'"}
    texts = [v for v in values if isinstance(v, str) and v not in special]
    tests = [f"({k} = 'text' AND {_text(x)} IN ({_texts(texts)}))"] if texts else []
    for v in values:
        if isinstance(v, bool):
            tests.append(f"({k} = 'boolean' AND try_variant_get({x}, '$', 'boolean') = {str(v).lower()})")
        elif isinstance(v, tuple):
            tests.append(f"({k} = 'text' AND {_text(x)} <> {_quoted(v[1])})")
        elif v in special:
            tests.append(f"({special[v]})")
    return f"coalesce({' OR '.join(tests) or 'false'}, false)"


def _within(n: str, low, high) -> str:
    return " AND ".join([*([] if low is None else [f"{n} >= {low}"]), *([] if high is None else [f"{n} <= {high}"])]) or "true"


def _breaks(x: str, k: str, rule: str, args: tuple) -> str:
    """Whether a present value breaks a rule; an absent one breaks `present` only."""
    if rule == "present":
        return f"{x} IS NULL"
    optional = rule.endswith("?")
    rule = rule.rstrip("?")
    if rule == "text":
        good = f"{k} = 'text' AND length({_text(x)}) >= 1"
    elif rule == "filled":
        good = f"{k} = 'text' AND length(trim({_text(x)})) >= 1"
    elif rule == "match":
        good = f"{k} = 'text' AND {_text(x)} RLIKE {_quoted(args[0])}"
    elif rule == "in":
        good = _is_one_of(x, k, args[0])
    elif rule == "kind":
        good = f"{k} = {_quoted(args[0])}"
    elif rule in ("number", "whole"):
        n = f"try_variant_get({x}, '$', 'double')"
        good = f"{k} = 'number' AND {_within(n, *args)}" + (f" AND {n} = floor({n})" if rule == "whole" else "")
    elif rule == "list":
        good = f"{k} = 'list' AND {_within(f'size({_items(x)})', *args)}"
    elif rule == "distinct":
        texts = f"try_variant_get({x}, '$', 'array<string>')"
        good = f"size(array_distinct({texts})) = size({texts})"
    elif rule == "holds":
        good = f"exists({_items(x)}, y -> coalesce(try_variant_get(y, {_quoted('$.' + args[0][0])}, 'string') = {_quoted(args[0][1])}, false))"
    elif rule == "one_of":
        held = " + ".join(f"IF(try_variant_get({x}, {_quoted('$.' + key)}, 'variant') IS NOT NULL, 1, 0)" for key in args[0])
        good = f"{k} <> 'object' OR {held} = 1"
    elif rule == "pairs":
        values, kind = f"map_values(try_variant_get({x}, '$', 'map<string,variant>'))", _KIND.format(x="y")
        n = "try_variant_get(y, '$', 'double')"
        good = f"{k} = 'object' AND size({values}) >= 1 AND forall({values}, y -> ({kind} = 'text' AND length({_text('y')}) >= 1) OR ({kind} = 'number' AND {n} >= 1 AND {n} = floor({n})))"
    elif rule == "object":
        keys = f"map_keys(try_variant_get({x}, '$', 'map<string,variant>'))"
        allowed, needed = (f"array({_texts(a.split())})" for a in args)
        good = f"{k} = 'object' AND size(array_except({keys}, {allowed})) = 0 AND size(array_except({needed}, {keys})) = 0"
    else:
        raise ValueError(f"no such rule: {rule}")
    if optional:
        good = f"({good}) OR {k} = 'null'"
    return f"{x} IS NOT NULL AND NOT coalesce({good}, false)"


def _broken(scope: _Scope, path: str, rule: str, args: tuple, when: list[tuple]) -> str:
    """Whether any value at a path breaks a rule in a card or item in which the conditions hold."""
    head, items, rest = path.partition("[]")
    here = [c for c in when if not (items and c[0].startswith(f"{head}[]"))]
    there = [(p.removeprefix(f"{head}[]").lstrip("."), values) for p, values in when if items and p.startswith(f"{head}[]")]
    tests = [_is_one_of(*scope.value(p), values) for p, values in here]
    if items:
        array, inner = scope.each(head)
        tests.append(f"exists({array}, {inner.name} -> {_broken(inner, rest.lstrip('.'), rule, args, there)})")
    else:
        tests.append(_breaks(*scope.value(path), rule, args))
        if rule == "present" and "." in path:  # what lacks the object breaks other rules
            tests.append(f"{scope.value(path.rpartition('.')[0])[1]} = 'object'")
    return f"coalesce({' AND '.join(f'({t})' for t in tests)}, false)"


def violations(cards: DataFrame, keys: Sequence[str], json_col: str = "card", contract: Sequence[tuple] = CARD, conditions: Sequence[tuple] = CONDITIONS) -> DataFrame:
    """(keys, path, rule): what each card, a JSON text, breaks of the contract and of its conditions, each once.

    A text that is no JSON, or null, breaks rule json at the empty path.  An object's rule covers its keys: unknown ones and
    missing ones; values at paths that are absent break nothing else but `present`.
    """
    card = _Scope("_c")
    every = [((), *r) for r in contract] + list(conditions)
    tests = [(path, rule, _broken(card, path, rule, tuple(args), list(when))) for when, path, rule, *args in every]
    named = [f"IF(_v IS NOT NULL AND {test}, named_struct('path', {_quoted(path)}, 'rule', {_quoted(rule.rstrip('?'))}), NULL)" for path, rule, test in tests]
    named.append("IF(_v IS NULL, named_struct('path', '', 'rule', 'json'), NULL)")
    rows = cards.select(*keys, F.try_parse_json(F.col(json_col)).alias("_v"))
    # each value is looked up once, whatever the number of rules on it
    rows = rows.select(*keys, "_v", F.expr(f"element_at({card.structs('array(_v)')}, 1)").alias("_c"))
    # in groups, so that no generated expression grows with the whole contract
    groups = [named[i : i + 40] for i in range(0, len(named), 40)]
    found = rows.select(*keys, F.array_distinct(F.concat(*[F.expr(f"array_compact(array({', '.join(g)}))") for g in groups])).alias("_broken"))
    # an inner generator would be given a filter on the array, which works all of it out once more, with every value looked up for each rule
    return found.select(*keys, F.inline_outer("_broken")).filter("path IS NOT NULL")


PROPERTIES = ["notice_eligibility", "referral_required", "alignment_confidence_present", "internal_gate_report", "explanation_en_presence", "input_preserved"]


def properties(cards: DataFrame, inputs: DataFrame, case_col: str = "case_id", json_col: str = "card") -> DataFrame:
    """(property, problems, status) of the six properties of cards that no gate has; inputs(case_id, kind, text).

    All are open (not_evaluated) if any card breaks the contract; input_preserved also if a card's input is no text and no
    other problem was found.
    """
    from .evaluation import FAIL, OPEN, PASS

    rows = cards.select(F.col(case_col).alias("case_id"), json_col).join(inputs.select("case_id", F.col("kind").alias("_kind"), F.col("text").alias("_text")), "case_id", "left").withColumn("_v", F.try_parse_json(json_col))
    text = lambda path: F.try_variant_get("_v", f"$.{path}", "string")
    is_a = lambda path, kind: F.coalesce(_kind(_get(F.col("_v"), path)) == kind, F.lit(False))
    level, state, english = text("claim.level"), text("state"), text("claim.lang") == "en"
    notice = is_a("misquote_notice", "object")
    spans = F.coalesce(_as(_get(F.col("_v"), "claim.scripture_spans"), "array<variant>"), F.array().cast("array<variant>"))
    near = F.exists(spans, lambda e: F.coalesce(F.try_variant_get(e, "$.classification", "string") == "NEAR_MISS", F.lit(False)))
    failed = F.exists(F.map_values(_as(_get(F.col("_v"), "gate_report"), "map<string,string>")), lambda x: x == "fail")
    tests = {
        "notice_eligibility": notice & (~((level == "D") | (text("misquote_notice.evidence.domain") == "hadith")) | ((state == "SUPPORTED") & (text("alignment") == "CONTRADICTS")) | ~near),
        "referral_required": ((state == "CANNOT_CONFIRM") | (level == "D")) & ~is_a("referral", "object"),
        "alignment_confidence_present": ~is_a("alignment_confidence", "number"),
        "internal_gate_report": failed & state.isin("SUPPORTED", "DISPUTED"),
        "explanation_en_presence": english != is_a("explanation_en", "text"),
        "input_preserved": (F.col("_kind") == "text") & ~text("claim.text_original").eqNullSafe(F.col("_text")),
    }
    unchecked = F.coalesce(F.col("_kind") != "text", F.lit(True))
    counts = rows.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()], F.count_if(unchecked).alias("_unchecked"))
    bad = violations(cards, [case_col], json_col).agg(F.count("*").alias("_bad"))
    one = counts.crossJoin(bad)  # one row each
    status = lambda n: F.when(F.col("_bad") > 0, OPEN).when(F.col(n) > 0, FAIL).when(F.lit(n == "input_preserved") & (F.col("_unchecked") > 0), OPEN).otherwise(PASS)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).alias("problems"), status(n).alias("status")) for n in PROPERTIES])))
