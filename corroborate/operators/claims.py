"""Claims and their candidates: routing, nominations, relevance, ordered choice, and what a card says in the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_groups, content_overlap, relocated


def topic_queries(claims: DataFrame, phrases: DataFrame, key: Column) -> DataFrame:
    """claims(claim_id, topics) -> (claim_id, query): the phrases of a claim's distinct topics, in order of topic; none if they
    hold the claim's own key.  phrases(topic, phrase) is a dimension."""
    asked = claims.select("claim_id", key.alias("_key"), F.explode(F.array_distinct("topics")).alias("topic"))
    said = asked.join(phrases, "topic").groupBy("claim_id", "_key").agg(F.array_sort(F.collect_set(F.struct("topic", "phrase"))).alias("p"))
    query = F.array_join(F.array_distinct(F.transform("p", lambda x: x["phrase"])), " ")
    return said.select("claim_id", F.when(~query.contains(F.col("_key")), query).alias("query"))


def routed(claims: DataFrame, indexes: dict[str, DataFrame], restricted: str = "D") -> DataFrame:
    """claims(claim_id, kind, level) with the rows of their kind's index(claim_id, corpus_id, display, domain); restricted claims
    and blank displays get none."""
    out = None
    for kind, index in indexes.items():
        own = claims.filter((F.col("kind") == kind) & ~F.col("level").eqNullSafe(F.lit(restricted))).select("claim_id")
        rows = own.join(index.filter(F.length(F.trim("display")) > 0), "claim_id").select("claim_id", "corpus_id", "display", "domain", F.lit(kind).alias("route"))
        out = rows if out is None else out.unionByName(rows)
    return out


def searched(claims: DataFrame, indexes: dict[str, DataFrame], search: Callable[[DataFrame, DataFrame], DataFrame], restricted: str = "D") -> DataFrame:
    """(claim_id, corpus_id, route): routed, where `search` finds (claim_id, corpus_id) for some claims in some rows of an index,
    so that what is restricted or blank is never searched; index(corpus_id, display, ...)."""
    out = None
    for kind, index in indexes.items():
        own = claims.filter((F.col("kind") == kind) & ~F.col("level").eqNullSafe(F.lit(restricted)))
        rows = search(own, index.filter(F.length(F.trim("display")) > 0)).select("claim_id", "corpus_id", F.lit(kind).alias("route"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_scores(nominated: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Nominated rows with their score, 0 where there is none."""
    return nominated.join(scores.select(*keys, "score"), keys, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def unambiguous(aliases: DataFrame, alias: str = "alias", record: str = "corpus_id") -> DataFrame:
    """(alias, record) of the aliases that name one record only."""
    return aliases.groupBy(alias).agg(F.min(record).alias(record), F.count_distinct(record).alias("_n")).filter("_n = 1").drop("_n")


def offered(nominated: DataFrame, found: DataFrame, claim: str, record: str, most_found: int = 50, most: int = 5) -> DataFrame:
    """(claim, record, place): nominated records first, then the best of those found, each once; at most `most` a claim."""
    best = Window.partitionBy(claim).orderBy(F.desc("score"), record)
    capped = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most_found)
    every = nominated.select(claim, record, F.lit(0).alias("_p"), F.lit(0).alias("_r")).unionByName(capped.select(claim, record, F.lit(1).alias("_p"), "_r"))
    first = every.groupBy(claim, record).agg(F.min(F.struct("_p", "_r")).alias("o"))
    place = F.row_number().over(Window.partitionBy(claim).orderBy("o", record))
    return first.withColumn("place", place).filter(F.col("place") <= most).select(claim, record, "place")


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, each key once: from the first part that has it (parts hold a key once)."""
    every = None
    for i, p in enumerate(parts):
        rows = p.withColumn("_part", F.lit(i))
        every = rows if every is None else every.unionByName(rows)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_part"))
    return every.withColumn("_n", first).filter("_n = 1").drop("_n", "_part")


def spans_in_claims(spans: DataFrame, claims: DataFrame, text_id: str) -> DataFrame:
    """(text_id, claim_id, start, end): spans that lie within a claim of the same text."""
    c = claims.select(text_id, "claim_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(c, text_id).filter((F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))).select(text_id, "claim_id", "start", "end")


def outside_marked(windows: DataFrame, marked: DataFrame, text_id: str, same: list[str]) -> DataFrame:
    """Windows that lie in no marked finding of the same class and record."""
    keys = [text_id, *same]
    m = marked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return windows.join(m, on, "left_anti")


def positions_in_order(chosen: DataFrame, claim: str) -> DataFrame:
    """chosen(claim, position, place, record): each position's first record that no position before it has taken; ids used once.

    Which record a position takes depends on those before it, so the choice is a fold over a claim's rows in order.
    """
    rows = chosen.groupBy(claim).agg(F.array_sort(F.collect_list(F.struct("position", "place", "record"))).alias("rows"))
    kind = "array<struct<position:long,record:long>>"

    def step(done, r):
        held = F.exists(done, lambda d: (d["position"] == r["position"]) | (d["record"] == r["record"]))
        new = F.array(F.struct(r["position"].cast("long").alias("position"), r["record"].cast("long").alias("record")))
        return F.when(held, done).otherwise(F.concat(done, new))

    return rows.select(claim, F.inline(F.aggregate("rows", F.array().cast(kind), step)))


def claims_repaired(claims: DataFrame) -> DataFrame:
    """claims(request_id, text, source_text, start, end, origin): offsets set right; a source that isn't in the text makes the
    claim the whole text; of claims with the same span the first origin stays."""
    place = relocated(F.col("text"), F.col("source_text"), F.col("start"), F.col("end"))
    rows = claims.withColumn("_p", place)
    whole = F.col("_p").isNull()
    rows = rows.select(
        "request_id",
        "origin",
        F.when(whole, 0).otherwise(F.col("_p.start")).alias("start"),
        F.when(whole, F.length("text")).otherwise(F.col("_p.end")).alias("end"),
        whole.alias("ungrounded"),
    )
    return rows.groupBy("request_id", "start", "end").agg(F.min("origin").alias("origin"), F.bool_and("ungrounded").alias("ungrounded"), F.count("*").alias("copies"))


def relevant(selected: DataFrame, question: Column, record: Column, compose: bool = True) -> DataFrame:
    """Selected rows whose record shares a content word with the question, or has the same words."""
    # columns of their own: composition may go to Python, which no lambda can hold
    both = selected.withColumns({"_asked": alias_groups(question, compose), "_held": alias_groups(record, compose)})
    asked, held = F.col("_asked"), F.col("_held")
    return both.filter(content_overlap(asked, held) | (F.flatten(asked) == F.flatten(held))).drop("_asked", "_held")


# Why a card says nothing, in the order in which reasons are tried, and its label.
ABSTENTIONS = [
    (1, "restricted", "LEVEL_RESTRICTED"),
    (2, "detector_error", "DETECTOR_UNAVAILABLE"),
    (3, "no_evidence", "NO_MATCHING_EVIDENCE"),
    (4, "refused", "EVIDENCE_REFUSED"),
    (5, "undecided", "INSUFFICIENT_AGREEMENT"),
]


def abstention_reason(facts: dict[str, Column]) -> Column:
    """The first reason that holds, null if none does; facts by name, nulls count as false."""
    out = F.lit(None).cast("string")
    for _, name, label in reversed(ABSTENTIONS):
        if name in facts:
            out = F.when(F.coalesce(facts[name], F.lit(False)), label).otherwise(out)
    return out


def publisher_answers(candidates: DataFrame, claim: str, record: str) -> DataFrame:
    """candidates(claim, record, kind, score, title_share, mentions): the answer that a publisher's own index gives, if any: a
    question's whose title matches before a term's that the text names, then by score and record."""
    rank = F.when((F.col("kind") == "faq") & (F.col("title_share") >= 0.6), 1).when((F.col("kind") == "glossary") & F.col("mentions"), 2).when(F.col("kind") == "faq", 3)
    rows = candidates.withColumn("branch", rank).filter("branch is not null")
    order = Window.partitionBy(claim).orderBy("branch", F.desc("score"), record)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(claim, record, "branch")


def term_block(term: Column, equivalent: Column, text: Column) -> Column:
    """Struct(term, equivalent, attested): a term with its publisher's equivalent, attested if the text holds it; null without a term."""
    said = F.coalesce(text.contains(term), F.lit(False))
    return F.when(F.length(F.trim(term)) > 0, F.struct(term.alias("term"), F.nullif(F.trim(equivalent), F.lit("")).alias("equivalent"), said.alias("attested")))


def label_kind(label: Column, text: Column) -> Column:
    """exact if the text holds the label itself, else same_meaning; null without a label."""
    return F.when(label.isNull(), None).when(F.coalesce(text.contains(label), F.lit(False)), "exact").otherwise("same_meaning")


def state_label(state: Column, alignment: Column) -> Column:
    """The label's key of a state and, for supported claims, its alignment."""
    return F.lower(F.concat_ws("_", state, F.when(state == "SUPPORTED", F.coalesce(alignment, F.lit("undetermined")))))


def correction_cards(claims: DataFrame, near: DataFrame) -> DataFrame:
    """claims(claim_id, level) with near(claim_id, corpus_id, distance, start): the record that a near quotation should have been;
    the nearest, then the first.  Level D has no correction."""
    best = near.groupBy("claim_id").agg(F.min_by("corpus_id", F.struct("distance", "start", "corpus_id")).alias("corpus_id"))
    return claims.filter(~F.col("level").eqNullSafe(F.lit("D"))).join(best, "claim_id").select("claim_id", "corpus_id", F.lit("CONTRADICTS").alias("alignment"))


def state_facts(evidence: DataFrame, positions: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(claim_id, level) with how much evidence and how many positions each has; evidence may come counted, as n."""
    e = evidence.groupBy("claim_id").agg((F.sum("n") if "n" in evidence.columns else F.count("*")).alias("evidence"))
    p = positions.groupBy("claim_id").agg(F.count_distinct("position").alias("positions"))
    none = F.lit(0).cast("long")
    return claims.join(e, "claim_id", "left").join(p, "claim_id", "left").withColumns({"evidence": F.coalesce("evidence", none), "positions": F.coalesce("positions", none)})
