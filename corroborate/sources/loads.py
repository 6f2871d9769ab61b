"""Loads that tie a scan, its rules and a mode together, cases with their contract, and the report of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import kept
from ..operators import contract
from ..operators.evaluation import FAIL, OPEN, PASS
from ..operators.validate import contract_violations, require_clean
from .corpus import _strict, numbered_lines, parsed_lines, read_artifact, read_jsonl

#: The fields of a corpus record.
CORPUS = """corpus_id string, domain string, source_id string, source_name_ar string, source_url string, text_ar string, text_normalized string, text_en string, translation_of string,
    ref map<string,string>, grading struct<grade_ar:string,grader_ar:string,grading_source_id:string,grading_source_url:string>, lang string, license string, license_url string, retrieved_at string,
    checksum_sha256 string, checksum_en_sha256 string, approved_by string"""
GRADERS = ["dorar", "hadeethenc"]


def _as_corpus(records: DataFrame) -> DataFrame:
    """Records under the names that contract_violations reads."""
    grading = F.when(F.col("grading").isNotNull(), F.struct(*[F.col(f"grading.{a}").alias(b) for a, b in (("grade_ar", "grade"), ("grader_ar", "grader"), ("grading_source_id", "source_id"), ("grading_source_url", "url"))]))
    named = {"source_name_ar": "source_name", "text_ar": "text", "checksum_sha256": "checksum", "checksum_en_sha256": "checksum_en"}
    return records.withColumn("grading", grading).withColumnsRenamed(named)


def _checked(found: tuple[DataFrame, DataFrame], sources: DataFrame, register: DataFrame, quarantine: bool, **mode) -> DataFrame:
    records, bad = kept(found[0], "corpus"), found[1]
    if not quarantine and bad.limit(1).count():
        raise ValueError("the file has lines that are no records")
    broken = contract_violations(_as_corpus(records), sources, register, **mode)
    out = require_clean(records, broken, "corpus_id", quarantine)
    if not out.limit(1).count():
        raise ValueError("the corpus is empty")
    return out


def load_corpus(spark: SparkSession, path: str, sources: DataFrame, register: DataFrame, allow_pending_review: bool = False, require_redistribution: bool = True, require_public_display: bool = False, graders: list[str] = GRADERS, quarantine: bool = False, **more) -> DataFrame:
    """The corpus at path, one row a record with file and line, if no line and no record breaks a rule in this mode; else ValueError.

    Modes: records whose review is pending may pass; sources must, or need not, allow redistribution; what is shown must be
    allowed for public display.  With quarantine the records that break nothing are returned, and lines that are no records
    are left out; without any record it raises all the same.
    """
    return _checked(read_jsonl(spark, path, CORPUS), sources, register, quarantine, graders=graders, pending_allowed=allow_pending_review, need_redistribution=require_redistribution, public_display=require_public_display, **more)


def load_private_corpus(spark: SparkSession, path: str, manifest: dict, sources: DataFrame, register: DataFrame, allow_pending_review: bool = False, require_public_display: bool = True, graders: list[str] = GRADERS, pair_of: str = "kfc-mushaf", **more) -> tuple[DataFrame, str]:
    """(records, version) of one plain, gzip or xz file bound to a manifest of `sha256`, of its decompressed bytes, and `corpus_version`.

    It is at most 64 MB, the documented bound of such artifacts.  Verses of the source `pair_of` need both of their spellings.
    ValueError for another hash, a manifest of other keys or form, or whatever load_corpus refuses; redistribution isn't asked for.
    """
    import re

    if set(manifest) != {"sha256", "corpus_version"} or not all(isinstance(v, str) for v in manifest.values()) or not re.fullmatch("[0-9a-f]{64}", manifest["sha256"]) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", manifest["corpus_version"]):
        raise ValueError("the manifest has another form")
    content = kept(read_artifact(spark, path), "artifact")
    if [r.sha256 for r in content.select("sha256").limit(2).collect()] != [manifest["sha256"]]:
        raise ValueError("the artifact isn't what its manifest says")
    check = F.pandas_udf(lambda s: s.map(_strict), "string")
    text = F.regexp_replace(F.col("content").cast("string"), r"\n\z", "")
    lines = content.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\n")).alias("line", "value"))
    lines = lines.select("file", (F.col("line") + 1).cast("long").alias("line"), "value", check("value").alias("rule"))
    pair = "sura_no int, aya_no int, aya_text_emlaey string, aya_text_unicode string, checksum_unicode_sha256 string"
    found = parsed_lines(lines, f"{CORPUS}, {pair}")
    records = kept(found[0], "private")
    needed = [c.split()[0] for c in pair.split(", ")]
    if records.filter((F.col("domain") == "quran") & (F.col("source_id") == pair_of) & F.exists(F.array(*[F.col(c).isNull() for c in needed]), lambda x: x)).limit(1).count():
        raise ValueError("a verse lacks one of its spellings")
    out = _checked((records, found[1]), sources, register, False, graders=graders, pending_allowed=allow_pending_review, need_redistribution=False, public_display=require_public_display, **more)
    return out, manifest["corpus_version"]


# --- cases ----------------------------------------------------------------------------------------------------------

_KEYS = "case_id origin category input expect rubric_en notes_en reviewed_by needs_sharia_review g9_countable blocked_reason_en paired_case_id"
_EXPECT = "input_kind level state alignment abstained_reason state_label_key must_refer must_not_fabricate required_evidence_domains required_corpus_ids forbidden_substrings_ar forbidden_behaviors"
_LISTS = ["required_evidence_domains", "required_corpus_ids", "forbidden_substrings_ar", "forbidden_behaviors"]
#: What a case is, as rows of contract.violations.
CASE = [
    ("", "object", _KEYS, _KEYS), ("case_id", "filled"), ("origin", "in", ["brief", "team"]), ("category", "in", ["safety", "redteam", "injection", "control"]), ("rubric_en", "filled"), ("notes_en", "filled"),
    ("input", "object", "text lang kind", "text lang kind"), ("input.text", "filled"), ("input.lang", "in", ["ar", "en"]), ("input.kind", "in", ["text", "link", "audio", "image"]),
    ("expect", "object", _EXPECT, _EXPECT), ("expect.input_kind", "in", contract.KINDS), ("expect.level", "in", ["A", "B", "C", "D"]), ("expect.state", "in", contract.STATES),
    ("expect.state_label_key", "in", ["supported_confirms", "supported_contradicts", "disputed", "cannot_confirm"]), ("expect.must_refer", "kind", "boolean"), ("expect.must_not_fabricate", "kind", "boolean"),
    *[(f"expect.{x}", "list", None, None) for x in _LISTS], *[(f"expect.{x}[]", "filled") for x in _LISTS],
    ("reviewed_by", "filled"), ("needs_sharia_review", "kind", "boolean"), ("g9_countable", "kind", "boolean"), ("paired_case_id", "filled?"),
]
CASE_CONDITIONS = [
    ([("expect.state", ["SUPPORTED"])], "expect.alignment", "in", ["CONFIRMS", "CONTRADICTS"]), ([("expect.state", [("not", "SUPPORTED")])], "expect.alignment", "kind", "null"),
    ([("expect.state", ["CANNOT_CONFIRM"])], "expect.abstained_reason", "in", contract.REASONS), ([("expect.state", [("not", "CANNOT_CONFIRM")])], "expect.abstained_reason", "kind", "null"),
    ([("reviewed_by", ["pending"])], "needs_sharia_review", "in", [True]), ([("reviewed_by", [("not", "pending")])], "needs_sharia_review", "in", [False]),
    ([("g9_countable", [True])], "blocked_reason_en", "kind", "null"), ([("g9_countable", [False])], "blocked_reason_en", "filled"),
]


def read_test_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, violations) of a test set in JSON lines: cases(file, line, case_id, paired_case_id, value), value the case as text;
    violations(file, line, path, rule).

    Blank lines are nothing.  Besides the case contract with its implications and review flags: an id stands once
    (repeated_case_id), and a pair's halves are there (pair_missing), are two (self_pair) and name each other (pair_one_way).
    A file without a case breaks rule empty.
    """
    lines = kept(numbered_lines(spark, path, _strict).filter("rule is null or rule <> 'blank'"), "case-lines")
    place = ["file", "line"]
    wrong = lines.filter("rule is not null").select(*place, F.lit("").alias("path"), "rule")
    good = lines.filter("rule is null")
    v = F.parse_json("value")
    cases = good.select(*place, F.try_variant_get(v, "$.case_id", "string").alias("case_id"), F.try_variant_get(v, "$.paired_case_id", "string").alias("paired_case_id"), "value")
    bad = contract.violations(good, place, "value", CASE, CASE_CONDITIONS)
    named = lambda rows, p, rule: rows.select(*place, F.lit(p).alias("path"), F.lit(rule).alias("rule"))
    several = cases.groupBy("case_id").count().filter("count > 1 and case_id is not null").select("case_id")
    halves = cases.select(F.col("case_id").alias("paired_case_id"), F.col("paired_case_id").alias("_back"), F.lit(True).alias("_there")).dropDuplicates(["paired_case_id"])
    pairs = cases.filter("paired_case_id is not null").join(halves, "paired_case_id", "left")
    out = wrong.unionByName(bad).unionByName(named(cases.join(several, "case_id", "left_semi"), "case_id", "repeated_case_id"))
    for test, rule in ((F.col("paired_case_id") == F.col("case_id"), "self_pair"), (F.col("_there").isNull(), "pair_missing"), (F.col("_there") & ~F.col("_back").eqNullSafe(F.col("case_id")) & (F.col("paired_case_id") != F.col("case_id")), "pair_one_way")):
        out = out.unionByName(named(pairs.filter(test), "paired_case_id", rule))
    empty = lines.select("file").distinct().join(good.select("file").distinct(), "file", "left_anti").join(wrong.filter("rule = 'empty'").select("file"), "file", "left_anti")
    return cases, out.unionByName(empty.select("file", F.lit(None).cast("long").alias("line"), F.lit("").alias("path"), F.lit("empty").alias("rule")))


# --- the report -----------------------------------------------------------------------------------------------------


def write_report(path: str, cases: DataFrame, checks: DataFrame, gates: DataFrame, properties: DataFrame, metrics: DataFrame, arm: str, most: int | None = None) -> DataFrame:
    """Writes the run's report below path and returns its summary, one row (arm, generated_at, cases, failing, open, outcome).

    cases(case_id, case_status, ...), checks(case_id, name, status, detail), gates(gate, status, problems), properties(property,
    status, problems), metrics one row.  `cases` holds each case with its checks, nested; `gates`, `properties`, `metrics` and
    `summary` the other parts, all as JSON; `markdown` the same to read, in order of the cases' ids.  With `most` only the first
    so many cases by id are reported, and the outcome is of those.  Whatever fails fails the run; so does an open case.
    """
    first = cases.orderBy("case_id") if most is None else cases.orderBy("case_id").limit(most)
    said = checks.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("name", "status", "detail"))).alias("assertions"))
    nested = kept(first.join(said, "case_id", "left"), "report-cases")
    nested.orderBy("case_id").write.json(f"{path}/cases")
    for name, rows in (("gates", gates), ("properties", properties), ("metrics", metrics)):
        rows.write.json(f"{path}/{name}")
    spark = cases.sparkSession
    gate_rows, property_rows, metric_rows = (spark.read.schema(x.schema).json(f"{path}/{n}") for n, x in (("gates", gates), ("properties", properties), ("metrics", metrics)))
    tests = nested.select(F.inline("assertions"))
    statuses = tests.select("status").unionByName(gate_rows.select("status")).unionByName(property_rows.select("status"))
    failing = statuses.agg(F.count_if(F.col("status") == FAIL).alias("failing"))
    seen = nested.agg(F.count("*").alias("cases"), F.count_if(F.col("case_status") == OPEN).alias("open"), F.count_if(F.col("case_status") == FAIL).alias("failed"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    outcome = F.when((F.col("failing") > 0) | (F.col("open") > 0) | (F.col("failed") > 0), FAIL).otherwise(PASS)
    summary = seen.crossJoin(failing).select(F.lit(arm).alias("arm"), now.alias("generated_at"), "cases", "failing", "open", outcome.alias("outcome"))  # one row each
    summary = kept(summary, "summary")
    summary.write.json(f"{path}/summary")

    def part(rows: DataFrame, number: int, key, *lines) -> DataFrame:
        every = rows.select(F.lit(number).alias("part"), key.alias("key"), F.posexplode(F.flatten(F.array(*lines))).alias("line", "value"))
        return every.filter("value is not null")

    line = lambda *c: F.array(F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in c]))
    text = F.lit
    head = part(summary, 0, text(""), line(text("# Run of "), F.col("arm"), text(": "), F.col("outcome")), line(text("")), line(text("Generated: "), F.col("generated_at")), line(F.col("cases"), text(" cases, "), F.col("failing"), text(" failing checks, "), F.col("open"), text(" open cases")), line(text("")), line(text("## Metrics")))
    lines = [head]
    for c in metrics.columns:
        lines.append(part(metric_rows, 1, text(c), line(text(f"- {c}: "), F.col(f"`{c}`"))))
    lines.append(part(summary, 2, text(""), line(text("")), line(text("## Cases"))))
    shown = F.transform(F.coalesce("assertions", F.array().cast(nested.schema["assertions"].dataType)), lambda a: F.concat_ws(" ", F.concat(F.lit("- "), a["name"], F.lit(":")), a["status"], a["detail"]))
    lines.append(part(nested, 3, F.col("case_id").cast("string"), line(text("### "), F.col("case_id"), text(": "), F.col("case_status")), shown))
    for number, title, rows, key in ((4, "Gates", gate_rows, "gate"), (6, "Properties", property_rows, "property")):
        lines.append(part(summary, number, text(""), line(text("")), line(text(f"## {title}"))))
        lines.append(part(rows, number + 1, F.col(key), line(text("- "), F.col(key), text(": "), F.col("status"), text(" ("), F.col("problems"), text(")"))))
    whole = lines[0]
    for more in lines[1:]:
        whole = whole.unionByName(more)
    whole.orderBy("part", "key", "line").select("value").write.text(f"{path}/markdown")
    return summary


# --- collections that go on -----------------------------------------------------------------------------------------


def resumed(spark: SparkSession, path: str, schema: str, discovered: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, pending, violations) of a collection that was broken off: what has landed at path as JSON lines, each id once, the
    first by file and line; the discovered ids that haven't; and what lines break.

    The last line of a file may be torn: if it is no JSON it is rule torn, and its id is pending.  Records without an id are
    violations (no_id), repeated ones (repeated_id) are left out.
    """
    lines = kept(numbered_lines(spark, path, _strict), "landed")
    last = lines.groupBy("file").agg(F.max("line").alias("line")).withColumn("_last", F.lit(True))
    torn = F.when((F.col("rule") == "not_json") & F.col("_last"), "torn").otherwise(F.col("rule"))
    records, bad = parsed_lines(lines.join(last, ["file", "line"], "left").select("file", "line", "value", torn.alias("rule")), schema)
    records = kept(records, "landed-records")
    named = records.filter(F.col(id_col).isNotNull())
    first = named.groupBy(id_col).agg(F.min(F.struct("file", "line")).alias("_at"))
    place = [F.col("_at.file").alias("file"), F.col("_at.line").alias("line"), F.col(id_col)]
    once = named.join(first.select(*place), ["file", "line", id_col], "left_semi")
    again = named.join(first.select(*place), ["file", "line", id_col], "left_anti")
    bad = bad.unionByName(records.filter(F.col(id_col).isNull()).select("file", "line", F.lit("no_id").alias("rule"))).unionByName(again.select("file", "line", F.lit("repeated_id").alias("rule")))
    return once, discovered.select(id_col).distinct().join(once.select(id_col), id_col, "left_anti"), bad
