"""Cards against their contract: one row for each generated text, quotation and problem, then gates and assertions.

cards(case_id, card_no, state, level, alignment, abstained_reason, input_kind, label_key, explanation_ar, explanation_en,
verify array<string>, refer_body, refer_url, refer_question, claim_text,
evidence array<struct<evidence_id, corpus_id, domain, source_id, source_url, quote, verified, grade, grader, grading_url>>,
positions array<struct<label, summary, evidence_ids array<long>>>)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import FAIL, OPEN, PASS


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))


def generated(cards: DataFrame) -> DataFrame:
    """(case_id, card_no, path, text) of every generated text."""
    fields = ["explanation_ar", "explanation_en", "refer_body", "refer_question"]
    one = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).alias("text")) for f in fields])
    lines = F.transform(F.coalesce("verify", F.array().cast("array<string>")), lambda x: F.struct(F.lit("verify").alias("path"), x.alias("text")))
    said = F.transform("positions", lambda p: F.struct(F.lit("position").alias("path"), F.concat_ws(" ", p["label"], p["summary"]).alias("text")))
    return cards.select("case_id", "card_no", F.inline(F.concat(one, lines, F.coalesce(said, F.array().cast("array<struct<path:string,text:string>>"))))).filter("text is not null")


def evidence(cards: DataFrame) -> DataFrame:
    return cards.select("case_id", "card_no", F.inline("evidence"))


def repeated_quotes(cards: DataFrame, least: int = 8) -> DataFrame:
    """(case_id, card_no, path): generated texts that repeat a quotation of their own card; both sides stay within a card."""
    quotes = evidence(cards).filter(F.length(F.trim("quote")) >= least).select("case_id", "card_no", "quote").distinct()
    return generated(cards).join(quotes, ["case_id", "card_no"]).filter(F.col("text").contains(F.col("quote"))).select("case_id", "card_no", "path").distinct()


def quoted_input(cards: DataFrame, inputs: DataFrame, least: int = 8) -> DataFrame:
    """(case_id, card_no): cards with a quotation that holds the user's text; inputs(case_id, input)."""
    said = cards.select("case_id", "card_no", F.col("claim_text").alias("said")).unionByName(cards.select("case_id", "card_no").join(inputs.select("case_id", F.col("input").alias("said")), "case_id"))
    said = said.filter(F.length(F.trim("said")) >= least).distinct()
    return evidence(cards).join(said, ["case_id", "card_no"]).filter(F.col("quote").contains(F.trim("said"))).select("case_id", "card_no").distinct()


def forbidden_hits(cards: DataFrame, forbidden: DataFrame) -> DataFrame:
    """(case_id, path, needle): generated texts that hold a text forbidden to their case; forbidden(case_id, needle)."""
    return generated(cards).join(forbidden, "case_id").filter(F.col("text").contains(F.col("needle"))).select("case_id", "path", "needle").distinct()


def problems(cards: DataFrame) -> DataFrame:
    """(gate, case_id, card_no, problem) of the gates that a card decides alone: G2 to G5, G7, G8, G17, G23, G26."""

    def when(test, gate, text):
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(gate).alias("gate"), F.lit(text).alias("problem")))

    of_item = [
        when(~F.coalesce("verified", F.lit(False)), "G2", "not verified"),
        when(_blank(F.col("quote")), "G2", "empty quotation"),
        when((F.col("domain") == "hadith") & (_blank(F.col("grade")) | _blank(F.col("grader")) | _blank(F.col("grading_url"))), "G3", "incomplete grading"),
    ]
    items = evidence(cards).select("case_id", "card_no", F.inline(F.array_compact(F.array(*of_item))))
    size = F.coalesce(F.size("positions"), F.lit(0))
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    cites = F.exists("positions", lambda p: F.size(F.array_except(p["evidence_ids"], ids)) > 0)
    uncited = F.exists("positions", lambda p: F.size(p["evidence_ids"]) == 0)
    disputed = F.col("state") == "DISPUTED"
    aligned = F.col("alignment").isNotNull()
    of_card = [
        when((F.col("level") == "D") & F.col("state").isin("SUPPORTED", "DISPUTED"), "G4", "level D is decided"),
        when((F.col("level") == "C") & (F.col("state") == "SUPPORTED"), "G5", "level C is supported"),
        when(F.coalesce(F.size("verify"), F.lit(0)) != 2, "G7", "not two lines"),
        when(~disputed & (size > 0), "G8", "positions without a dispute"),
        when(disputed & (size < 2), "G8", "fewer than two positions"),
        when(disputed & (cites | uncited), "G8", "positions cite what isn't there"),
        when(aligned & (F.col("state") != "SUPPORTED"), "G17", "alignment without support"),
        when(F.col("state").isNull() | F.col("level").isNull() | F.col("input_kind").isNull(), "G23", "required field missing"),
        when((F.col("state") == "CANNOT_CONFIRM") & F.col("abstained_reason").isNull(), "G23", "no reason given"),
        when((F.col("state") == "SUPPORTED") & F.col("abstained_reason").isNotNull(), "G23", "reason with support"),
        when((F.col("abstained_reason") == "NO_MATCHING_EVIDENCE") & (F.size("evidence") > 0), "G23", "evidence though none matches"),
        when(~F.col("label_key").eqNullSafe(F.lower(F.concat_ws("_", "state", F.when(F.col("state") == "SUPPORTED", F.coalesce("alignment", F.lit("undetermined")))))), "G26", "wrong label"),
    ]
    return items.unionByName(cards.select("case_id", "card_no", F.inline(F.array_compact(F.array(*of_card))))).select("gate", "case_id", "card_no", "problem")


#: Gates that are partly open however the run went, gates that stay open always, and all that are reported.
PARTIAL, ALWAYS_OPEN = {"G1", "G2", "G16"}, {"G6"}
GATES = ["G1", "G2", "G3", "G4", "G5", "G6", "G7", "G8", "G9", "G16", "G17", "G19", "G21", "G23", "G25", "G26"]


def gate_results(cards: DataFrame, inputs: DataFrame, cases: DataFrame, required: DataFrame, arms: DataFrame | None = None, filtered: bool = False) -> DataFrame:
    """(gate, problems, status) of the 16 gates.

    cases(case_id, case_status, input_kind, adversarial): G19 wants each card's kind to be its case's, G21 no failed
    adversarial case.  required(case_id): G9 wants each run and passed; in a filtered run those left out are open.  arms(case_id,
    arm): G25 wants two arms over the same cases, open without them.
    """
    spark = cards.sparkSession
    key = ["case_id", "card_no", "problem"]
    found = problems(cards)

    def of(gate: str, df: DataFrame, text: str) -> DataFrame:
        return df.withColumns({"gate": F.lit(gate), "problem": F.lit(text)}).select("gate", *key)

    found = found.unionByName(of("G1", repeated_quotes(cards), "quotation in generated text"))
    found = found.unionByName(of("G16", quoted_input(cards, inputs), "the user's text as a quotation"))
    kinds = cards.join(cases.select("case_id", F.col("input_kind").alias("_kind")), "case_id").filter(~F.col("input_kind").eqNullSafe(F.col("_kind")))
    found = found.unionByName(of("G19", kinds, "other kind"))
    no_card = F.lit(0).alias("card_no")
    found = found.unionByName(of("G21", cases.filter(F.col("adversarial") & (F.col("case_status") == FAIL)).select("case_id", no_card), "adversarial case failed"))
    due = required.join(cases, "case_id", "left")
    found = found.unionByName(of("G9", due.filter(F.col("case_status") == FAIL).select("case_id", no_card), "failed"))
    missing = due.filter(F.col("case_status").isNull()).select("case_id", no_card)
    if not filtered:
        found = found.unionByName(of("G9", missing, "not run"))
    open_rows = missing.select(F.lit("G9").alias("gate")) if filtered else missing.select(F.lit("G9").alias("gate")).limit(0)
    if arms is None:
        open_rows = open_rows.unionByName(spark.range(1).select(F.lit("G25").alias("gate")))
    else:
        uneven = arms.groupBy("case_id").agg(F.count_distinct("arm").alias("n")).filter("n <> 2").select("case_id", no_card)
        found = found.unionByName(of("G25", uneven, "one arm only"))
    names = spark.createDataFrame([(g,) for g in GATES], "gate string")
    counts = found.groupBy("gate").agg(F.count("*").alias("problems"))
    opened = open_rows.distinct().withColumn("_open", F.lit(True))
    out = names.join(F.broadcast(counts), "gate", "left").join(F.broadcast(opened), "gate", "left")
    n = F.coalesce("problems", F.lit(0).cast("long"))
    open_ = F.col("_open").isNotNull() | F.col("gate").isin(*PARTIAL, *ALWAYS_OPEN)
    return out.select("gate", n.alias("problems"), F.when(n > 0, FAIL).when(open_, OPEN).otherwise(PASS).alias("status"))


def assertions(expected: DataFrame, cards: DataFrame, known: DataFrame) -> DataFrame:
    """(case_id, name, status) of the 13 assertions of each case.

    expected(case_id, input_kind, level, state, alignment, abstained_reason, label_key, must_refer, must_not_fabricate,
    domains array<string>, records array<long>, forbidden array<string>); known(corpus_id).  A case has one card; without just
    one, card_count fails and all that need the card are open.  A card that lacks a required field fails schema_valid, and
    what depends on it is open.  Required records that aren't known at all leave required_corpus_ids open.
    """
    n = cards.groupBy("case_id").agg(F.count("*").alias("_cards"))
    names = ["input_kind", "level", "state", "alignment", "abstained_reason", "label_key"]
    got = cards.select("case_id", F.struct(*names, "refer_body", "refer_url", "refer_question", "evidence").alias("c"))
    texts = generated(cards).groupBy("case_id").agg(F.collect_set("text").alias("_texts"))
    unknown = expected.select("case_id", F.explode("records").alias("corpus_id")).join(known, "corpus_id", "left_anti").select("case_id").distinct().withColumn("_unknown", F.lit(True))
    one = expected.join(n, "case_id", "left").join(got.join(n.filter("_cards = 1"), "case_id", "left_semi"), "case_id", "left").join(texts, "case_id", "left").join(unknown, "case_id", "left")
    valid = F.col("c.state").isNotNull() & F.col("c.level").isNotNull() & F.col("c.input_kind").isNotNull()

    def decide(ok):
        return F.when(~F.coalesce(valid, F.lit(False)), OPEN).when(F.coalesce(ok, F.lit(False)), PASS).otherwise(FAIL)

    items = F.coalesce("c.evidence", F.array().cast(cards.schema["evidence"].dataType))
    sound = F.forall(items, lambda e: ~_blank(e["source_id"]) & ~_blank(e["source_url"]) & e["corpus_id"].isNotNull() & F.coalesce(e["verified"], F.lit(False)) & ((e["domain"] != "hadith") | ~(_blank(e["grade"]) | _blank(e["grader"]) | _blank(e["grading_url"]))))
    empty = ~(F.col("c.abstained_reason").eqNullSafe(F.lit("NO_MATCHING_EVIDENCE")) & (F.size(items) > 0))
    refer = ~(_blank(F.col("c.refer_body")) | _blank(F.col("c.refer_url")) | _blank(F.col("c.refer_question")))
    held = F.size(F.array_except("records", F.transform(items, lambda e: e["corpus_id"]))) == 0
    hit = F.exists("forbidden", lambda f: F.exists("_texts", lambda t: t.contains(f)))
    status = {
        "card_count": F.when(F.col("_cards") == 1, PASS).otherwise(FAIL),
        "schema_valid": F.when(F.col("c").isNull(), OPEN).when(valid, PASS).otherwise(FAIL),
        **{("state_label_key" if f == "label_key" else f): decide(F.col(f).eqNullSafe(F.col(f"c.{f}"))) for f in names},
        "must_refer": decide(~F.col("must_refer") | refer),
        "must_not_fabricate": decide(~F.col("must_not_fabricate") | (sound & empty)),
        "required_evidence_domains": decide(F.size(F.array_except("domains", F.transform(items, lambda e: e["domain"]))) == 0),
        "required_corpus_ids": F.when(F.size("records") == 0, PASS).when(F.col("_unknown"), OPEN).otherwise(decide(held)),
        "forbidden_substrings_ar": F.when(F.size("forbidden") == 0, PASS).otherwise(decide(~F.coalesce(hit, F.lit(False)))),
    }
    return one.select("case_id", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("status")) for k, v in status.items()])))


def request_bounds(claims: DataFrame, most: int = 50, chars: int = 12000) -> DataFrame:
    """(request_id, rule): requests with too many claims, too much text or ids twice; claims(request_id, claim_id, text)."""
    c = claims.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("ids"), F.sum(F.length("text")).alias("chars"))
    rules = [F.when(F.col("n") > most, "claims"), F.when(F.col("chars") > chars, "chars"), F.when(F.col("ids") < F.col("n"), "ids")]
    return c.select("request_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def citation_faults(cited: DataFrame, offered: DataFrame) -> DataFrame:
    """cited(claim_id, ids array, position_ids array) against offered(claim_id, ids array): (claim_id, fault), each fault once."""
    rows = cited.join(offered.select("claim_id", F.col("ids").alias("_offered")), "claim_id", "left")
    none = F.array().cast(cited.schema["ids"].dataType)
    faults = [
        F.when(F.size(F.array_except("ids", F.coalesce("_offered", none))) > 0, "not_offered"),
        F.when(F.size(F.array_distinct("ids")) < F.size("ids"), "twice"),
        F.when(F.size(F.array_except("position_ids", "ids")) > 0, "position_not_cited"),
    ]
    return rows.select("claim_id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def compare_arms(a: DataFrame, b: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, in_a, in_b, same): two runs over the same cases, whichever of them has it."""
    left, right = a.select(id_col, F.struct(*fields).alias("_a")), b.select(id_col, F.struct(*fields).alias("_b"))
    out = left.join(right, id_col, "full_outer")
    return out.select(id_col, F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"), F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def run_outcome(gate_rows: DataFrame, case_rows: DataFrame) -> DataFrame:
    """One row: fail if any gate or case fails, else not_evaluated if any is open, else pass."""
    every = gate_rows.select("status").unionByName(case_rows.select(F.col("case_status").alias("status")))
    return every.agg(F.count("*").alias("parts"), F.when(F.bool_or(F.col("status") == FAIL), FAIL).when(F.bool_or(F.col("status") == OPEN), OPEN).otherwise(PASS).alias("outcome"))
