"""Constraint validation of a corpus against its source dimensions: violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_https, norm_ar, url_is_clean, url_of_source


def rule_rows(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(row_id, rule) for each rule that doesn't hold; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(df[id_col].alias("row_id"), F.explode(broken).alias("rule"))


def corpus_violations(corpus: DataFrame, sources: DataFrame, langs: list[str], pending_allowed: bool = False, need_redistribution: bool = False, compose: bool = True) -> DataFrame:
    """Rules on corpus(corpus_id, domain, source_id, source_url, text_ar, text_normalized, text_en, translation_of, lang, license,
    checksum_sha256, approved_by) and sources(source_id, domains, hosts, license, ingestion_allowed, redistribution_allowed)."""
    s = sources.select("source_id", F.col("domains").alias("s_domains"), F.col("hosts").alias("s_hosts"), F.col("license").alias("s_license"), F.col("ingestion_allowed").alias("s_ingest"), F.col("redistribution_allowed").alias("s_redistribute"))
    rows = corpus.join(s, "source_id", "left").withColumn("_n", F.count("*").over(Window.partitionBy("corpus_id")))
    targets = corpus.filter("translation_of IS NULL").select(F.col("corpus_id").alias("translation_of"), F.lit(True).alias("_target")).distinct()
    rows = rows.join(targets, "translation_of", "left")
    rules = {
        "source_known": F.col("s_domains").isNotNull(),
        "source_domain": F.array_contains("s_domains", F.col("domain")),
        "source_host": F.array_contains("s_hosts", F.try_parse_url("source_url", F.lit("HOST"))) & url_is_clean(F.col("source_url")),
        "text_present": F.length(F.trim("text_ar")) > 0,
        "checksum": F.sha2("text_ar", 256) == F.col("checksum_sha256"),
        "normalised": norm_ar(F.col("text_ar"), compose) == F.col("text_normalized"),
        "license": (F.col("license") == F.col("s_license")) & (F.lower("license") != "pending"),
        "ingestion": F.col("s_ingest") & (F.col("s_redistribute") | F.lit(not need_redistribution)),
        "id_unique": F.col("_n") == 1,
        "approval": F.col("approved_by").isNotNull() & (F.lit(pending_allowed) | (F.col("approved_by") != "pending")),
        "lang": F.col("lang").isin(langs),
        "translation_target": F.col("translation_of").isNull() | F.col("_target"),
    }
    return rule_rows(rows, "corpus_id", rules)


def unregistered(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Values of one side that the other lacks, with the side that has them; empty if the sets are equal."""
    a, b = left.select(col).distinct(), right.select(col).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def require_clean(df: DataFrame, violations: DataFrame, id_col: str, quarantine: bool = False) -> DataFrame:
    """The table if nothing is violated; with quarantine, its rows that violate nothing."""
    bad = violations.select(F.col("row_id").alias(id_col)).distinct()
    if quarantine:
        return df.join(bad, id_col, "left_anti")
    if bad.limit(1).count():
        raise ValueError("the table violates its constraints")
    return df


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def _cleared(license_: Column) -> Column:
    return _filled(license_) & ~F.lower(F.trim(license_)).isin("pending", "unknown")


def contract_violations(corpus: DataFrame, sources: DataFrame, register: DataFrame, graders: list[str], graded: str = "hadith", need_redistribution: bool = True, public_display: bool = False, pending_allowed: bool = False, reviewers: tuple[str, ...] = ("owner",), needs_english: tuple[str, ...] = (), langs: tuple[str, ...] = ("ar", "en"), compose: bool = True) -> DataFrame:
    """(row_id, rule): a corpus against sources and licence register, all rules.

    corpus(corpus_id, domain, source_id, source_name, source_url, text, text_normalized, text_en, checksum, checksum_en,
    license, license_url, approved_by, lang, retrieved_at, ref map<string,string>, translation_of,
    grading struct<grade, grader, source_id, url>); sources(source_id, domains, entry_url, license_status, ingestion_allowed,
    redistribution_allowed, public_display_allowed); register(source_id, domain, license, license_url).  The grading's source is
    a source in its own right, so both tables are joined a second time for it.
    """
    fields = ["domains", "entry_url", "license_status", "ingestion_allowed", "redistribution_allowed", "public_display_allowed"]

    def role(prefix: str, key: str) -> DataFrame:
        s = sources.select(F.col("source_id").alias(key), F.struct(*fields).alias(f"{prefix}s"))
        r = register.select(F.col("source_id").alias(key), F.struct("domain", "license", "license_url").alias(f"{prefix}r"))
        return s.join(r, key, "left")

    rows = corpus.withColumns({"_grader": F.col("grading.source_id"), "_n": F.count("*").over(Window.partitionBy("corpus_id"))})
    rows = rows.join(role("_", "source_id"), "source_id", "left").join(role("_g", "_grader"), "_grader", "left")
    targets = corpus.filter("domain = 'quran'").select(F.col("corpus_id").alias("translation_of"), F.lit(True).alias("_target")).distinct()
    rows = rows.join(targets, "translation_of", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    spread = lambda who: yes(f"{who}.redistribution_allowed") | F.lit(not need_redistribution)
    shown = lambda who: yes(f"{who}.redistribution_allowed") | yes(f"{who}.public_display_allowed")
    in_class = F.col("domain") == graded
    complete = _filled(F.col("grading.grade")) & _filled(F.col("grading.grader")) & is_https(F.col("grading.url"))
    provenance = (
        F.col("_grader").isin(graders)
        & url_of_source(F.col("grading.url"), F.col("_gs.entry_url"), section=True)
        & F.array_contains("_gs.domains", graded)
        & (F.col("_gr.domain") == graded)
        & (F.col("_gs.license_status") == "confirmed")
        & yes("_gs.ingestion_allowed")
        & spread("_gs")
        & _cleared(F.col("_gr.license"))
        & is_https(F.col("_gr.license_url"))
    )
    same_license = (F.col("license") == F.col("_r.license")) & (F.col("license_url") == F.col("_r.license_url"))
    rules = {
        "source_domain": F.array_contains("_s.domains", F.col("domain")) & (F.col("domain") == F.col("_r.domain")),
        "source_url": url_of_source(F.col("source_url"), F.col("_s.entry_url")),
        "grading_complete": ~in_class | complete,
        "grading_provenance": ~in_class | provenance,
        "text_present": _filled(F.col("text")),
        "checksum": F.sha2("text", 256) == F.col("checksum"),
        "english_checksum": F.col("text_en").isNull() | (F.sha2("text_en", 256) == F.col("checksum_en")),
        "normalised": norm_ar(F.col("text"), compose) == F.col("text_normalized"),
        "license": _cleared(F.col("license")) & is_https(F.col("license_url")) & same_license,
        "clearance": (F.col("_s.license_status") == "confirmed") & yes("_s.ingestion_allowed") & spread("_s"),
        "public_display": F.lit(not public_display) | (shown("_s") & (~in_class | shown("_gs"))),
        "id_unique": _filled(F.col("corpus_id").cast("string")) & (F.col("_n") == 1),
        "approval": F.col("approved_by").isin(*reviewers, *(["pending"] if pending_allowed else [])),
        "fields": _filled(F.col("source_name")) & _filled(F.col("retrieved_at")) & F.col("lang").isin(*langs),
        "ref": (F.size("ref") > 0) & F.forall(F.map_entries("ref"), lambda e: _filled(e["key"]) & _filled(e["value"]) & ~F.coalesce(e["value"].try_cast("long") <= 0, F.lit(False))),
        "english": ~F.col("domain").isin(*needs_english) | _filled(F.col("text_en")),
        "translation_target": F.col("translation_of").isNull() | yes("_target"),
    }
    return rule_rows(rows, "corpus_id", rules)


def pair_binding(domain: Column, source_id: Column, surah: Column, ayah: Column, matching: Column, display: Column, text: Column, key: Column, ref: Column, corpus_id: Column, checksum: Column, checksum_display: Column, source: str, compose: bool = True) -> Column:
    """Whether a verse's two spellings are bound to its text, key, place, id and checksums; true where no field of the pair is there."""
    none = surah.isNull() & ayah.isNull() & matching.isNull() & display.isNull() & checksum_display.isNull()
    ok = (
        (domain == "quran")
        & (source_id == source)
        & _filled(matching)
        & _filled(display)
        & (matching == text)
        & (key == norm_ar(matching, compose))
        & surah.between(1, 114)
        & (ayah >= 1)
        & (F.size(ref) == 2)
        & (F.try_element_at(ref, F.lit("surah")) == surah.cast("string"))
        & (F.try_element_at(ref, F.lit("ayah")) == ayah.cast("string"))
        & (corpus_id == F.concat_ws(":", F.lit("quran"), surah, ayah))
        & (checksum == F.sha2(matching, 256))
        & (checksum_display == F.sha2(display, 256))
    )
    return none | F.coalesce(ok, F.lit(False))
