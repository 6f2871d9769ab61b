"""Loads by mode, test cases with their implications, and the report of a run."""

import copy
import gzip
import hashlib
import json
import lzma

import pytest

from corroborate.operators import contract  # noqa: F401
from corroborate.sources import loads


def record(**more):
    text = "نص"
    out = {
        "corpus_id": "faq:1", "domain": "faq", "source_id": "s1", "source_name_ar": "م", "source_url": "https://s.example/a/1", "text_ar": text, "text_normalized": text, "text_en": None, "translation_of": None, "ref": {"number": "1"}, "grading": None, "lang": "ar",
        "license": "cc", "license_url": "https://l.example/", "retrieved_at": "2026-01-01", "checksum_sha256": hashlib.sha256(text.encode()).hexdigest(), "checksum_en_sha256": None, "approved_by": "owner",
    }
    return out | more


@pytest.fixture
def tables(spark):
    sources = spark.createDataFrame([("s1", ["faq"], "https://s.example/a", "confirmed", True, False, True)], "source_id string, domains array<string>, entry_url string, license_status string, ingestion_allowed boolean, redistribution_allowed boolean, public_display_allowed boolean")
    return sources, spark.createDataFrame([("s1", "faq", "cc", "https://l.example/")], "source_id string, domain string, license string, license_url string")


def test_corpus_by_mode(spark, tmp_path, tables):
    rows = [record(), record(corpus_id="faq:2", approved_by="pending"), record(corpus_id="faq:3", checksum_sha256="0")]
    put = lambda name, some, extra="": (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in some) + extra) and str(tmp_path / name)
    one = put("one.jsonl", rows[:1])
    with pytest.raises(ValueError):
        loads.load_corpus(spark, one, *tables)  # the source does not allow redistribution
    assert [r.corpus_id for r in loads.load_corpus(spark, one, *tables, require_redistribution=False).collect()] == ["faq:1"]
    two = put("two.jsonl", rows[:2])
    with pytest.raises(ValueError):
        loads.load_corpus(spark, two, *tables, require_redistribution=False)
    assert loads.load_corpus(spark, two, *tables, require_redistribution=False, allow_pending_review=True).count() == 2
    three = put("three.jsonl", rows, "{\n")
    with pytest.raises(ValueError):
        loads.load_corpus(spark, three, *tables, require_redistribution=False, allow_pending_review=True)
    assert {(r.corpus_id, r.line) for r in loads.load_corpus(spark, three, *tables, require_redistribution=False, quarantine=True).collect()} == {("faq:1", 1)}


def test_private_corpus(spark, tmp_path, tables):
    data = "".join(json.dumps(record(corpus_id=f"faq:{i}")) + "\n" for i in range(3)).encode()
    manifest = {"sha256": hashlib.sha256(data).hexdigest(), "corpus_version": "v1.0"}
    for name, raw in (("plain", data), ("gz", gzip.compress(data)), ("xz", lzma.compress(data))):
        (tmp_path / name).write_bytes(raw)
        out, version = loads.load_private_corpus(spark, str(tmp_path / name), manifest, *tables)
        assert version == "v1.0" and sorted(r.line for r in out.collect()) == [1, 2, 3]
    for wrong in ({"sha256": "0" * 64, "corpus_version": "v"}, manifest | {"x": "y"}, manifest | {"corpus_version": "-"}):
        with pytest.raises(ValueError):
            loads.load_private_corpus(spark, str(tmp_path / "plain"), wrong, *tables)


CASE = {
    "case_id": "c1", "origin": "team", "category": "control", "input": {"text": "t", "lang": "ar", "kind": "text"}, "rubric_en": "r", "notes_en": "n", "reviewed_by": "someone", "needs_sharia_review": False, "g9_countable": True, "blocked_reason_en": None, "paired_case_id": None,
    "expect": {"input_kind": "claim", "level": "A", "state": "SUPPORTED", "alignment": "CONFIRMS", "abstained_reason": None, "state_label_key": "supported_confirms", "must_refer": False, "must_not_fabricate": True, "required_evidence_domains": [], "required_corpus_ids": ["x"], "forbidden_substrings_ar": [], "forbidden_behaviors": []},
}


def case(name, **changes):
    out = copy.deepcopy(CASE) | {"case_id": name}
    for k, v in changes.items():
        a, _, b = k.partition("__")
        if b:
            out[a][b] = v
        else:
            out[a] = v
    return out


def test_cases_and_what_they_break(spark, tmp_path):
    rows = [
        (case("a", paired_case_id="b"), None), (case("b", paired_case_id="a"), None), (case("c", expect__state="CANNOT_CONFIRM", expect__alignment=None, expect__abstained_reason="LOW_CONFIDENCE", expect__state_label_key="cannot_confirm"), None),
        (case("d", reviewed_by="pending", needs_sharia_review=True, g9_countable=False, blocked_reason_en="why"), None),
        (case("e", origin="x"), ("origin", "in")), (case("f", extra=1), ("", "object")), (case("g", input__text=" "), ("input.text", "filled")), (case("h", expect__must_refer="no"), ("expect.must_refer", "kind")),
        (case("i", expect__required_corpus_ids=[""]), ("expect.required_corpus_ids[]", "filled")), (case("j", expect__alignment=None), ("expect.alignment", "in")), (case("k", expect__abstained_reason="LOW_CONFIDENCE"), ("expect.abstained_reason", "kind")),
        (case("l", reviewed_by="pending"), ("needs_sharia_review", "in")), (case("m", needs_sharia_review=True), ("needs_sharia_review", "in")), (case("n", g9_countable=False), ("blocked_reason_en", "filled")), (case("o", blocked_reason_en="x"), ("blocked_reason_en", "kind")),
        (case("p", paired_case_id="p"), ("paired_case_id", "self_pair")), (case("q", paired_case_id="zz"), ("paired_case_id", "pair_missing")), (case("r", paired_case_id="a"), ("paired_case_id", "pair_one_way")), (case("s"), ("case_id", "repeated_case_id")), (case("s"), ("case_id", "repeated_case_id")),
    ]
    (tmp_path / "cases.jsonl").write_text("\n\n".join(json.dumps(r) for r, _ in rows) + "\n")
    (tmp_path / "none.jsonl").write_text("")
    cases, bad = loads.read_test_cases(spark, str(tmp_path))
    assert sorted(r.case_id for r in cases.collect()) == sorted(r["case_id"] for r, _ in rows)
    got = {}
    for r in bad.collect():
        got.setdefault((r.file.rsplit("/", 1)[-1], r.line), set()).add((r.path, r.rule))
    want = {("cases.jsonl", 2 * i + 1): {b} for i, (_, b) in enumerate(rows) if b}
    assert got == want | {("none.jsonl", None): {("", "empty")}}


def test_report(spark, tmp_path):
    cases = spark.createDataFrame([(2, "pass", "x"), (1, "fail", "y"), (10, "pass", "z")], "case_id int, case_status string, category string")
    checks = spark.createDataFrame([(1, "level", "fail", "wanted A"), (1, "state", "pass", None), (2, "level", "pass", None)], "case_id int, name string, status string, detail string")
    gates = spark.createDataFrame([("G1", "pass", 0), ("G2", "not_evaluated", 0)], "gate string, status string, problems int")
    properties = spark.createDataFrame([("referral_required", "pass", 0)], "property string, status string, problems int")
    metrics = spark.createDataFrame([(0.5, 3)], "accuracy double, n int")
    out = loads.write_report(str(tmp_path / "all"), cases, checks, gates, properties, metrics, "arm a").first()
    assert (out.arm, out.cases, out.failing, out.open, out.outcome) == ("arm a", 3, 1, 0, "fail") and out.generated_at.endswith("Z")
    nested = {r.case_id: r for r in spark.read.json(str(tmp_path / "all/cases")).collect()}
    assert [(a.name, a.status) for a in nested[1].assertions] == [("level", "fail"), ("state", "pass")] and nested[2].category == "x"
    parts = sorted((tmp_path / "all/markdown").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).split("\n")
    assert lines[0] == "# Run of arm a: fail" and "- level: fail wanted A" in lines and lines.index("### 1: fail") < lines.index("### 10: pass") < lines.index("### 2: pass") < lines.index("## Gates") < lines.index("- G2: not_evaluated (0)") < lines.index("## Properties")
    some = loads.write_report(str(tmp_path / "some"), cases.filter("case_id > 1"), checks, gates, properties, metrics, "b", most=1).first()
    assert (some.cases, some.outcome) == (1, "pass")


def test_a_collection_that_was_broken_off(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": "y"}\n{"id": 3, "t": "z')  # torn
    (tmp_path / "b.jsonl").write_text('{"id": 2, "t": "again"}\n{bad\n{"t": "none"}\n{"id": 4, "t": "w"}\n')
    found = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "id long")
    records, pending, bad = loads.resumed(spark, str(tmp_path), "id long, t string", found)
    assert sorted((r.id, r.t) for r in records.collect()) == [(1, "x"), (2, "y"), (4, "w")]
    assert sorted(r.id for r in pending.collect()) == [3, 5]
    assert {(r.file[-7:], r.line, r.rule) for r in bad.collect()} == {("a.jsonl", 3, "torn"), ("b.jsonl", 1, "repeated_id"), ("b.jsonl", 2, "not_json"), ("b.jsonl", 3, "no_id")}
