"""The splittable scan: exact line numbers however files are cut, and what each kind of line breaks."""

import json
import random

import pytest

from corroborate.operators import pages
from corroborate.sources import corpus


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    rng = random.Random(3)
    want = {}
    for name in ("a", "b", "c"):
        lines = [rng.choice(["", "x", "é" * rng.randint(1, 30), "y" * rng.randint(0, 200), " \r"]) for _ in range(rng.randint(1, 60))]
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + rng.choice(["", "\n"]), newline="")
        text = (tmp_path / f"{name}.txt").read_bytes().decode()
        want[name] = text.removesuffix("\n").split("\n") if text else []
    out = corpus.numbered_lines(spark, str(tmp_path), lambda v: "blank" if not v.strip() else None)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 5
    got = {}
    for r in out.collect():
        got.setdefault(r.file.rsplit("/", 1)[-1][0], {})[r.line] = (r.value, r.rule)
    for name, lines in want.items():
        expected = {i: (v, None if v.strip() else "blank") for i, v in enumerate(lines, 1)}
        assert got[name] == (expected or {None: (None, "empty")})


def test_what_lines_break(spark, tmp_path, small_splits):
    lines = [b'{"a": 1, "b": "x"}', b'{"a": 1, "a": 2}', b"[1]", b"", b'{"a": NaN}', b'{"a": "\xff"}', b"{", b'{"a": 1, "c": 2}', b'{"a": "x"}', b'{"a": 5}']
    (tmp_path / "one.jsonl").write_bytes(b"\n".join(lines) + b"\n")
    (tmp_path / "two.jsonl").write_bytes(b"")
    (tmp_path / "three.jsonl").write_text("".join(json.dumps({"a": i, "b": "z" * (i % 50)}) + "\n" for i in range(500)))
    records, bad = corpus.read_jsonl(spark, str(tmp_path), "a long, b string")
    broken = {(r.file.rsplit("/", 1)[-1], r.line): r.rule for r in bad.collect()}
    assert broken == {("one.jsonl", 2): "duplicate_key", ("one.jsonl", 3): "not_object", ("one.jsonl", 4): "blank", ("one.jsonl", 5): "not_finite", ("one.jsonl", 6): "not_utf8", ("one.jsonl", 7): "not_json", ("one.jsonl", 8): "unknown_key", ("one.jsonl", 9): "wrong_type", ("two.jsonl", None): "empty"}
    rows = sorted((r.file.rsplit("/", 1)[-1], r.line, r.a) for r in records.collect())
    assert rows == [("one.jsonl", 1, 1), ("one.jsonl", 10, 5), *[("three.jsonl", i + 1, i) for i in range(500)]]


def test_reach(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8), (1, 4)], "src int, dst int")
    out = pages.reachable(spark.createDataFrame([(1,), (1,)], "node int"), edges)
    assert sorted((r.node, r.depth) for r in out.collect()) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert pages.reachable(spark.createDataFrame([], "node int"), edges).count() == 0
