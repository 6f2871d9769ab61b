"""Expectations against outcomes: long-form checks, statuses, metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, OPEN = "pass", "fail", "not_evaluated"


def equality_checks(joined: DataFrame, id_col: str, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(id, name, status): each field's expectation against what was observed, null-safe; not evaluated where nothing was observed."""
    seen = F.col("observed") if "observed" in joined.columns else F.lit(True)
    status = lambda want, got: F.when(~seen, OPEN).when(want.eqNullSafe(got), PASS).otherwise(FAIL)
    return joined.select(id_col, F.inline(F.array(*[F.struct(F.lit(n).alias("name"), status(w, g).alias("status")) for n, (w, g) in fields.items()])))


def case_status(checks: DataFrame, id_col: str) -> DataFrame:
    """Any failure fails a case; else anything open leaves it open; else it passes."""
    any_ = lambda s: F.bool_or(F.col("status") == s)
    return checks.groupBy(id_col).agg(F.when(any_(FAIL), FAIL).when(any_(OPEN), OPEN).otherwise(PASS).alias("case_status"))


def gates(checks: DataFrame, filtered: bool = False) -> DataFrame:
    """(name, offending, evaluated, status): a gate fails with any failure; a partial run without one is not evaluated."""
    out = checks.groupBy("name").agg(F.count_if(F.col("status") == FAIL).alias("offending"), F.count_if(F.col("status") != OPEN).alias("evaluated"))
    return out.withColumn("status", F.when(F.col("offending") > 0, FAIL).when((F.col("evaluated") == 0) | F.lit(filtered), OPEN).otherwise(PASS))


def accuracy(joined: DataFrame, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row: the share of matches of each field, and of all at once; null without rows."""
    hit = {n: w.eqNullSafe(g) for n, (w, g) in fields.items()}
    every = None
    for h in hit.values():
        every = h if every is None else every & h
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    return joined.agg(F.count("*").alias("cases"), *[share(h).alias(f"{n}_accuracy") for n, h in hit.items()], share(every).alias("joint_accuracy"))


def abstention(joined: DataFrame, wanted: Column, got: Column) -> DataFrame:
    """One row: precision and recall of abstaining; null where there is nothing to divide by."""
    both, seen, due = F.count_if(wanted & got), F.count_if(got), F.count_if(wanted)
    ratio = lambda n: F.round(both / F.nullif(n, F.lit(0)), 4)
    return joined.agg(both.alias("correct"), seen.alias("observed"), due.alias("expected"), ratio(seen).alias("precision"), ratio(due).alias("recall"))


def failures_by_category(cases: DataFrame, category: str) -> DataFrame:
    return cases.filter(F.col("case_status") == FAIL).groupBy(category).agg(F.count("*").alias("failures"))


def pair_checks(cards: DataFrame, pairs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """pairs(id, partner) with status: both cards' fields equal, null-safe; not evaluated if either is missing."""
    left = cards.select(F.col(id_col), F.struct(*fields).alias("_a"))
    right = cards.select(F.col(id_col).alias("partner"), F.struct(*fields).alias("_b"))
    out = pairs.join(left, id_col, "left").join(right, "partner", "left")
    return out.select(id_col, "partner", F.when(F.col("_a").isNull() | F.col("_b").isNull(), OPEN).when(F.col("_a") == F.col("_b"), PASS).otherwise(FAIL).alias("status"))


def asymmetric_pairs(pairs: DataFrame, id_col: str) -> DataFrame:
    """Pairs without their mirror image."""
    mirror = pairs.select(F.col("partner").alias(id_col), F.col(id_col).alias("partner"))
    return pairs.join(mirror, [id_col, "partner"], "left_anti")


def selection_closure(cases: DataFrame, asked: DataFrame, pairs: DataFrame, id_col: str) -> DataFrame:
    """Asked cases and their partners."""
    partners = pairs.join(asked, id_col, "left_semi").select(F.col("partner").alias(id_col))
    return cases.join(asked.select(id_col).union(partners).distinct(), id_col, "left_semi")


def required_present(required: DataFrame, present: DataFrame, known: DataFrame, id_col: str, need: str) -> DataFrame:
    """Per case: not evaluated if any required value isn't known at all; else fail if one is absent; else pass."""
    seen = present.select(id_col, need, F.lit(True).alias("_seen")).distinct()
    exists = known.select(need, F.lit(True).alias("_known")).distinct()
    out = required.join(seen, [id_col, need], "left").join(exists, need, "left")
    missing = F.bool_or(F.col("_seen").isNull() & F.col("_known").isNotNull())
    unknown = F.bool_or(F.col("_known").isNull())
    return out.groupBy(id_col).agg(F.when(unknown, OPEN).when(missing, FAIL).otherwise(PASS).alias("status"))
