"""Provenance gates over received records and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def authorised(received: DataFrame, registry: DataFrame, host: Column) -> DataFrame:
    """received(source_id, domain, ...) with `permitted`: its source is registered for the domain and the host.

    registry(source_id, hosts array, domains array) is a dimension; Spark broadcasts it if it is small enough.
    """
    known = registry.select("source_id", "hosts", "domains")
    out = received.withColumn("_host", host).join(known, "source_id", "left")
    return out.withColumn("permitted", F.coalesce(F.array_contains("domains", F.col("domain")) & F.array_contains("hosts", F.col("_host")), F.lit(False))).drop("_host", "hosts", "domains")


def without_conflicts(received: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was received once; a key received twice goes altogether, equal rows too.  Null keys are keys like others."""
    counted = received.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    same = None
    for k in keys:
        test = received[k].eqNullSafe(counted[k])
        same = test if same is None else same & test
    return received.join(counted, same, "left_semi")


def conflict_counts(received: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Keys received with one content only, and how often; a key with two contents goes altogether."""
    return received.groupBy(*keys).agg(F.count_distinct(content).alias("_n"), F.count("*").alias("copies")).filter("_n = 1").drop("_n")


def twin_peers(records: DataFrame, key: Column, id_col: str, source_col: str) -> DataFrame:
    """Per text key: how many records and sources hold it, first and last id; only keys of more than one source."""
    out = records.select(key.alias("key"), id_col, source_col).groupBy("key")
    return out.agg(F.count("*").alias("records"), F.countDistinct(source_col).alias("sources"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).filter("sources > 1")


def closed_dependencies(findings: DataFrame, authorised_ids: DataFrame, text_col: str = "doc_id", record_col: str = "item_id") -> DataFrame:
    """Per text: number of embedded records, how many are authorised, and whether all are."""
    ok = authorised_ids.select(F.col(record_col), F.lit(True).alias("_ok")).distinct()
    every = findings.select(text_col, record_col).distinct().join(ok, record_col, "left")
    return every.groupBy(text_col).agg(F.count("*").alias("embedded"), F.count("_ok").alias("allowed"), F.bool_and(F.col("_ok").isNotNull()).alias("closed"))


def verified_quotes(cited: DataFrame, records: DataFrame, key) -> DataFrame:
    """cited(claim_id, item_id, quote) with verdict: missing (no such record), verbatim, same_key or different."""
    out = cited.join(records.select("item_id", F.col("text").alias("_text")), "item_id", "left")
    verdict = F.when(F.col("_text").isNull(), "missing").when(F.col("quote") == F.col("_text"), "verbatim").when(key(F.col("quote")) == key(F.col("_text")), "same_key").otherwise("different")
    return out.withColumn("verdict", verdict).drop("_text")


def leaks(prose: DataFrame, source: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Per text: shingles found in source records other than its own; prose(text_id, run), source(record_id, run), own(text_id, record_id).

    A run counts if more records hold it than records of the text's own; so a run that many records hold meets a text once,
    as a number.
    """
    held = source.distinct()
    hits = prose.distinct().join(held.groupBy("run").agg(F.count("*").alias("_held")), "run")
    if own is not None:
        exempt = own.distinct().join(held, "record_id").groupBy("text_id", "run").agg(F.count("*").alias("_own"))
        hits = hits.join(exempt, ["text_id", "run"], "left").filter(F.col("_held") > F.coalesce("_own", F.lit(0)))
    return hits.groupBy("text_id").agg(F.count("*").alias("leaked"))


def twin_pairs(records: DataFrame, key: Column, id_col: str, source_col: str) -> DataFrame:
    """(id, peer): records of equal text keys from other sources.  A key's records meet per source's first record, so no group gives all its pairs."""
    rows = records.select(key.alias("key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    first = rows.groupBy("key", "source").agg(F.min("id").alias("peer")).withColumnRenamed("source", "peer_source")
    return rows.join(first, "key").filter("source <> peer_source").select("id", "peer", "peer_source")


def authorised_layers(received: DataFrame, registry: DataFrame, text: Column, most: int = 12000) -> DataFrame:
    """received(request_id, source_id, domain, ref, url, ...) with `key` live:{source}:{ref} and `use`: quote, or scan_only for
    rows that fail the registry, have no text or too long a text, or share their request's key with another row."""
    out = authorised(received, registry, F.try_parse_url("url", F.lit("HOST")))
    key = F.concat_ws(":", F.lit("live"), "source_id", "ref")
    count = received.groupBy("request_id", "source_id", "ref").agg(F.count("*").alias("_n"))
    out = out.join(count, ["request_id", "source_id", "ref"])
    good = F.col("permitted") & F.length(F.trim(text)).between(1, most) & (F.col("_n") == 1)
    return out.withColumns({"key": key, "use": F.when(F.coalesce(good, F.lit(False)), "quote").otherwise("scan_only")}).drop("_n")


def verified_evidence(cited: DataFrame, records: DataFrame, registry: DataFrame, key) -> DataFrame:
    """cited(claim_id, corpus_id, quote, source_id, source_url) with the first reason that refuses it, or ok: unknown_record,
    different_text, other_source, incomplete_grading, host_not_permitted.

    records(corpus_id, domain, source_id, text, grade, grader); registry(source_id, hosts, domains).
    """
    r = records.select("corpus_id", F.col("domain").alias("_domain"), F.col("source_id").alias("_source"), F.col("text").alias("_text"), F.col("grade").alias("_grade"), F.col("grader").alias("_grader"))
    out = cited.join(r, "corpus_id", "left").join(registry.select("source_id", F.col("hosts").alias("_hosts")), "source_id", "left")
    filled = F.coalesce(F.length(F.trim("_grade")) > 0, F.lit(False)) & F.coalesce(F.length(F.trim("_grader")) > 0, F.lit(False))
    verdict = (
        F.when(F.col("_domain").isNull(), "unknown_record")
        .when(~((F.col("quote") == F.col("_text")) | (key(F.col("quote")) == key(F.col("_text")))), "different_text")
        .when(~F.col("source_id").eqNullSafe(F.col("_source")), "other_source")
        .when((F.col("_domain") == "hadith") & ~filled, "incomplete_grading")
        .when(~F.coalesce(F.array_contains("_hosts", F.try_parse_url("source_url", F.lit("HOST"))), F.lit(False)), "host_not_permitted")
        .otherwise("ok")
    )
    return out.withColumn("verdict", verdict).drop("_domain", "_source", "_text", "_grade", "_grader", "_hosts")


def dependency_records(findings: DataFrame, twins: DataFrame) -> DataFrame:
    """(text_id, record_id): the records that a text's embedded spans need, and their twins of other sources."""
    own = findings.select("text_id", "record_id").distinct()
    peers = own.join(twins.select(F.col("id").alias("record_id"), "peer"), "record_id").select("text_id", F.col("peer").alias("record_id"))
    return own.union(peers).distinct()


def published_answers(evidence: DataFrame) -> DataFrame:
    """evidence(claim_id, corpus_id, verdict, kind, title, title_leaks, source_name): verified answers with a title that is safe to show."""
    rows = evidence.filter("verdict = 'ok' AND kind = 'faq'")
    safe = F.when(~F.coalesce("title_leaks", F.lit(True)) & (F.length(F.trim("title")) > 0), F.col("title"))
    return rows.select("claim_id", "corpus_id", F.coalesce(safe, "source_name").alias("title"))
