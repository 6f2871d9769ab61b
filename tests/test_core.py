import datetime
import json
import random
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corroborate import plans
from corroborate.functions import sql, text
from corroborate.operators import detect, evaluation, gates, index, pages, ranks, rules, spans, vectors
from corroborate.operators.index import build_index
from corroborate.sources import corpus
from corroborate.streaming import telemetry

SF = "/root/testdata/sf0.001"
SQL_NAMES = sorted(set(plans.queries()) & set(plans.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(repr(tuple(row[cols.index(c)] for c in sorted(cols))) for row in rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def _aliases(word):
    out = [word]
    if all("ء" <= c <= "غ" or "ف" <= c <= "ي" for c in word):
        for p in text.PREFIXES:
            rest = word[len(p) :]
            if word.startswith(p) and len(rest) >= 3 and rest not in out:
                out.append(rest)
    return out


def test_arabic_keys_and_aliases(spark):
    rng = random.Random(5)
    letters = "ابتلكوفهيمنسعأإآىة"
    texts = ["".join(rng.choice(letters + " ًـَ") for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "é آ", "والكتاب بالقلم"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", text.norm_ar(F.col("t")).alias("n"), text.alias_groups(F.col("t")).alias("g")).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].n is None
            continue
        bare = "".join(c for c in unicodedata.normalize("NFC", t) if c != "ـ" and not (unicodedata.category(c)[0] == "M" and (0x610 <= ord(c) <= 0x61A or 0x64B <= ord(c) <= 0x65F or ord(c) == 0x670)))
        want = " ".join(unicodedata.normalize("NFC", bare).translate(str.maketrans(*text.VARIANTS)).split())
        assert got[i].n == want
        import re

        assert got[i].g == [_aliases(w) for w in re.findall(r"[^\W_]+", want.lower())]


def test_comparison_key(spark):
    df = spark.createDataFrame([("ﻻ١٢‏٣ قالَ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.comparison_key(F.col("t"))).collect()] == ["لا123 قال", None]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_distance_and_near_windows(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    records = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14)))) for i in range(8)]
    docs = []
    for d in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        for _ in range(2):
            r = rng.choice(records)[1].split()
            for _ in range(rng.randint(0, 2)):
                r[rng.randrange(len(r))] = rng.choice(vocabulary)
            words += r + [rng.choice(vocabulary)]
        docs.append((d, " ".join(words)))
    dw = spans.document_words(spark.createDataFrame(docs, "doc_id long, text string"))
    rw = spans.record_words(spark.createDataFrame(records, "item_id long, text string"))
    budget = lambda n: 1 if n <= 4 else 2 if n <= 10 else 3
    lengths = {n for _, t in records for n in range(max(1, len(t.split()) - 2), len(t.split()) + 3)}
    exact, near = set(), set()
    for d, t in docs:
        w = t.split()
        for i, r in records:
            r = r.split()
            for n in lengths:
                for s in range(len(w) - n + 1):
                    k = _distance(w[s : s + n], r)
                    if k == 0:
                        exact.add((d, i, s + 1, n))
                    elif n >= 3 and k <= budget(max(n, len(r))) and abs(n - len(r)) <= budget(max(n, len(r))):
                        near.add((d, i, s + 1, n, k))
    assert {tuple(r) for r in spans.exact_windows(dw, rw).collect()} == exact
    assert {tuple(r)[:5] for r in spans.near_windows(dw, rw).collect()} == near
    kept = spans.resolve(spans.exact_windows(dw, rw), spans.near_windows(dw, rw), rw).collect()
    chosen = [r for r in kept if r.classification == "NEAR_MISS"]
    for a in chosen:
        assert not any(a.doc_id == b.doc_id and a.start < b.start + b.n and b.start < a.start + a.n for b in chosen if b is not a)


def test_level_cues_and_ratchet(spark):
    cues = [("D", [r"\bيجوز لي\b", r"\bmay i\b"]), ("B", [r"\bمقارنه\b"])]
    df = spark.createDataFrame([("هل ويجوز لي ذلك",), ("may i eat",), ("مقارنة",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.level_floor(F.lower(text.norm_ar(F.col("t"), False)), cues)).collect()] == ["D", "D", "B", "A", "A"]


def test_evaluation_is_three_valued(spark):
    empty = spark.createDataFrame([], "a int, b int")
    assert evaluation.accuracy(empty, {"x": (F.col("a"), F.col("b"))}).first() == (0, None, None)
    none = evaluation.abstention(empty, F.col("a") == 1, F.col("b") == 1).first()
    assert none.precision is None and none.recall is None


def test_jsonl_violations(spark, tmp_path):
    lines = ['{"case_id": "a", "n": 1}', '{"case_id": "a", "n": 2}', "", '{"n": 1, "n": 2}', '{"n": NaN}', "[1]", "{", '{"case_id": "b", "z": 1}', '{"case_id": "c", "n": "x"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines) + "\n")
    cases, bad = corpus.read_cases(spark, str(tmp_path), "case_id string, n int")
    assert sorted((r.line, r.rule) for r in bad.collect()) == [(1, "repeated_case_id"), (2, "repeated_case_id"), (3, "blank"), (4, "duplicate_key"), (5, "not_finite"), (6, "not_object"), (7, "not_json"), (8, "unknown_key"), (9, "wrong_type")]


def test_register_allowlist_artifact_and_sink(spark, tmp_path):
    (tmp_path / "r.md").write_text("# Register\n\n| source_id | domain |\n|---|---|\n| a | x |\n| b | y |\n")
    assert corpus.read_register(spark, str(tmp_path / "r.md"), ["source_id", "domain"]).count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"source_id": "a", "domains": ["x"]}]}))
    assert corpus.read_allowlist(spark, str(tmp_path / "s.json")).first().source_id == "a"
    import gzip
    import lzma

    for name, raw in (("a", b"text"), ("b", gzip.compress(b"text")), ("c", lzma.compress(b"text"))):
        (tmp_path / name).write_bytes(raw)
        assert bytes(corpus.read_artifact(spark, str(tmp_path / name)).first().content) == b"text"
    with pytest.raises(Exception, match="another hash"):
        corpus.read_artifact(spark, str(tmp_path / "a"), "00").collect()
    rows = spark.createDataFrame([(1, "h", "x"), (2, "h", "y"), (3, "g", "")], "id long, host string, text string")
    out = {r.file: r for r in corpus.write_records(rows, str(tmp_path / "out"), "host", "text", "id").collect()}
    assert (out["h"].records, out["h"].bytes, out["g"].empty) == (2, 2, 1)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _put(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def _drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_windows_drop_late_rows(spark, tmp_path):
    schema = "ts timestamp, stage string, elapsed double"
    for n, rows in enumerate([[(_at(10), "a", 1.0), (_at(20), "a", 3.0)], [(_at(7200), "a", 5.0)], [(_at(7300), "a", 5.0)], [(_at(15), "a", 100.0)], [(_at(14400), "a", 5.0)]]):
        _put(spark, tmp_path / "in", n, rows, schema)
    import os
    import time

    for i, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime)):
        os.utime(f, (time.time() + i * 10 - 100,) * 2)
    out = _drain(telemetry.stage_windows(_stream(spark, tmp_path / "in", schema), "1 hour"), tmp_path, "windows").collect()
    first = [r for r in out if r.window_start == _at(0)]
    assert [(r.events, r.mean_elapsed) for r in first] == [(2, 2.0)]


def test_stream_deadline(spark, tmp_path):
    a, b = "claim_id long, claim_ts timestamp", "claim_id long, card_ts timestamp, state string"
    _put(spark, tmp_path / "claims", 0, [(1, _at(0)), (2, _at(0)), (9, _at(5000))], a)
    _put(spark, tmp_path / "cards", 0, [(1, _at(30), "SUPPORTED"), (2, _at(90), "SUPPORTED"), (9, _at(5010), "SUPPORTED")], b)
    df = telemetry.deadline_join(_stream(spark, tmp_path / "claims", a), _stream(spark, tmp_path / "cards", b), 60)
    out = {r.claim_id: r.state for r in _drain(df, tmp_path, "deadline").collect()}
    assert out[1] == "SUPPORTED" and out[2] == "CHECK_INCOMPLETE"


def test_conflicts_required_and_deadlines(spark):
    received = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, "x"), (None, 2, "y")], "source string, ref int, text string")
    assert {(r.source, r.ref) for r in gates.without_conflicts(received, ["source", "ref"]).collect()} == {("b", 1), (None, 2)}
    need = spark.createDataFrame([(1, 10), (1, 99), (2, 10), (3, 10)], "case_id long, item_id long")
    got = spark.createDataFrame([(3, 10)], "case_id long, item_id long")
    known = spark.createDataFrame([(10,)], "item_id long")
    out = {r.case_id: r.status for r in evaluation.required_present(need, got, known, "case_id", "item_id").collect()}
    assert out == {1: "not_evaluated", 2: "fail", 3: "pass"}
    t0 = datetime.datetime(2024, 1, 1)
    claims = spark.createDataFrame([("c", t0), ("d", t0)], "claim_id string, claim_ts timestamp")
    cards = spark.createDataFrame([("c", t0 + datetime.timedelta(seconds=s), f"s{s}") for s in (5, 9, 90)], "claim_id string, card_ts timestamp, state string")
    assert {(r.claim_id, r.state) for r in telemetry.deadline_join(claims, cards, 60).collect()} == {("c", "s9"), ("d", "CHECK_INCOMPLETE")}


def test_source_urls(spark):
    entry, good = "https://h.example/a", "https://h.example/a/b"
    urls = [good, "http://h.example/a/b", "https://h.example:8443/a/b", "https://h.example:443/a", "https://h.example/ab", "https://h.example/a/../b", "https://u@h.example/a", "https://h.example/a/%2e", "https://other.example/a", None]
    df = spark.createDataFrame([(i, u, entry) for i, u in enumerate(urls)], "i int, u string, e string")
    out = df.select("i", text.url_of_source(F.col("u"), F.col("e")).alias("a"), text.url_of_source(F.col("u"), F.col("e"), True).alias("b"))
    assert [(r.a, r.b) for r in out.orderBy("i").collect()] == [(True, True), (False, False), (False, False), (True, True), (True, False)] + [(False, False)] * 5


def test_first_paragraph_labels_and_stops(spark):
    texts = ["الجواب التفصيلي:\n\nأول السطر\nثان\n\nفقرة", "كلام مفيد. المراجع: كتاب", "a" * 399 + ". tail of it", "x" * 150 + "؛ " + "y" * 300, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(text.first_paragraph(F.col("t"))).collect()]
    assert got == ["أول السطر\nثان", "كلام مفيد.", "a" * 399 + ".", "x" * 150 + "؛", None]


def test_keys_by_definition(spark):
    rng = random.Random(9)
    signs = "abé½ﬁﻻ١۲ًّٕٔـࢗ࢘࢟࣊ࣿأىةـ‏\u00ad \u00a0ٱ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(300)]

    def drop(x):
        return "".join(c for c in x if unicodedata.category(c) != "Cf")

    def key(x):
        marks = ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED), (0x898, 0x89F), (0x8CA, 0x8FF))
        y = "".join(c for c in drop(unicodedata.normalize("NFKC", drop(x))) if c != "ـ" and not (unicodedata.category(c)[0] == "M" and any(a <= ord(c) <= b for a, b in marks)))
        return " ".join(drop(unicodedata.normalize("NFKC", y)).translate(str.maketrans(*text.DIGITS)).translate(str.maketrans(*text.VARIANTS)).split())

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", text.comparison_key(F.col("t")).alias("k")).collect():
        assert r.k == key(r.t), ascii(r.t)


def test_long_word_distance_and_offsets(spark):
    a = [f"w{i}" for i in range(2000)]
    b = a[:700] + ["zz"] + a[701:1500] + a[1501:]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(text.word_distance(F.col("a"), F.col("b"))).first()[0] == 2
    t = spark.createDataFrame([("🙂 ab, قَلَم x",)], "t string").select("t", text.tokens_with_places(F.col("t")).alias("p")).first()
    assert [t.t[x.start : x.end] for x in t.p] == [x.word for x in t.p] == ["ab", "قَلَم", "x"]
    capped = spark.createDataFrame([("é" * 9,), ("a日",), (None,)], "t string").select(text.utf8_cap(F.col("t"), 3)).collect()
    assert [r[0] for r in capped] == ["é", "a", None]


def test_marked_spans_are_classified(spark):
    records = [(1, "one two three four five six"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, "one two three four five six"), (4, "قَالَ الرجل كلاما طيبا")]
    said = ["one two three four five six", "one two three zz five six", "gamma delta epsilon", "completely other words here", "beta gamma delta zz zeta eta", "قال الرجل كلاما طيبا"]
    rec = spans.record_words(spark.createDataFrame(records, "item_id long, text string"))
    marked = spark.createDataFrame(list(enumerate(said)), "span_id long, span string")
    got = {r.span_id: (r.classification, r.item_id, r.distance, r.partial) for r in detect.classify_marked(marked, rec).collect()}
    assert got == {0: ("VERBATIM", 1, 0, False), 1: ("NEAR_MISS", 1, 1, False), 2: ("VERBATIM", 2, 0, True), 3: ("UNRELATED", 4, 4, False), 4: ("UNRELATED", 2, 3, False), 5: ("VERBATIM", 4, 0, False)}


def test_fragments_join_the_claim_before(spark):
    whole = "Is it so? Shame! Another thing"
    rows = [(1, 0, 9, False), (1, 10, 16, True), (1, 17, 30, False), (2, 0, 4, True)]
    df = spark.createDataFrame([(*r, whole) for r in rows], "request long, start int, end int, f boolean, t string")
    out = rules.merge_fragments(df, "request", "start", "end", F.col("f"), F.col("t")).collect()
    assert sorted((r.request, r.start, r.end, r.parts) for r in out) == [(1, 0, 16, 2), (1, 17, 30, 1), (2, 0, 4, 1)]


def test_sql_functions(spark):
    sql.register(spark)
    texts = ["قَلَمٌ  أحمر", "والكتاب ﻻ x_y", "", "café", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("said")
    got = spark.sql("SELECT t, norm_ar(t) AS k, alias_groups(t) AS g, comparison_words(t) AS w, word_distance(comparison_words(t), array('x')) AS d FROM said").collect()
    want = {r.t: r for r in df.select("t", text.norm_ar(F.col("t")).alias("k"), text.alias_groups(F.col("t")).alias("g"), text.comparison_words(F.col("t")).alias("w")).collect()}
    for r in got:
        assert (r.k, r.g, r.w) == (want[r.t].k, want[r.t].g, want[r.t].w)
        assert r.d == (None if r.t is None else _distance(list(r.w), ["x"]))


def test_windows_as_a_table_function(spark):
    rng = random.Random(7)
    records = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 3, 5, 9, 12])))) for i in range(9)]
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))) for i in range(20)] + [(99, None)]
    held = spans.record_words(spark.createDataFrame(records, "item_id long, text string"))
    sql.register_windows(spark, held)
    spark.createDataFrame(docs, "doc_id long, text string").createOrReplaceTempView("texts")
    got = {tuple(r) for r in spark.sql("SELECT doc_id, start, end, classification, item_id, distance FROM texts, LATERAL match_windows(text)").collect()}
    words = spans.document_words(spark.createDataFrame(docs, "doc_id long, text string"))
    exact = spans.exact_windows(words, held)
    best = spans.best_windows(spans.near_windows(words, held), exact)
    place = lambda r: (r.doc_id, 2 * (r.start - 1), 2 * (r.start - 1 + r.n) - 1)
    want = {(*place(r), "VERBATIM", r.item_id, 0) for r in exact.collect()} | {(*place(r), "NEAR_MISS", r.item_id, r.distance) for r in best.collect()}
    assert got == want and len({w[3] for w in want}) == 2
    with pytest.raises(ValueError):
        sql.register_windows(spark, held, most_words=5)


def test_ranks_of_long_lists(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 7 > 0, F.col("id")).alias("k"), (F.col("id") * 37 % 11).alias("v"), "id")
    got = ranks.ranked_by_range(rows, "k", F.desc("v"), "id", parts=7).collect()
    lists = defaultdict(list)
    for r in sorted(got, key=lambda r: (-r.v, r.id)):
        lists[r.k].append(r["rank"])
    assert len(got) == 400 and all(v == list(range(1, len(v) + 1)) for v in lists.values()) and len(lists[1]) > 200


def test_stream_receipts_and_new_items(spark, tmp_path):
    a, b = "request_id long, request_ts timestamp", "request_id long, source_id string, done_ts timestamp, items int"
    _put(spark, tmp_path / "requests", 0, [(1, _at(0)), (2, _at(0)), (9, _at(5000))], a)
    _put(spark, tmp_path / "receipts", 0, [(1, "x", _at(2), 4), (2, "x", _at(9), 4), (9, "x", _at(5001), 1)], b)
    df = telemetry.receipts_in_time(_stream(spark, tmp_path / "requests", a), _stream(spark, tmp_path / "receipts", b), 3)
    out = {r.request_id: r["items"] for r in _drain(df, tmp_path, "receipts").collect()}
    assert out[1] == 4 and out[2] is None
    items = "id long, ts timestamp"
    _put(spark, tmp_path / "items", 0, [(1, _at(0)), (1, _at(1)), (2, _at(2))], items)
    _put(spark, tmp_path / "items", 1, [(1, _at(3)), (3, _at(4))], items)
    new = _drain(telemetry.new_items(_stream(spark, tmp_path / "items", items)), tmp_path, "items").collect()
    assert sorted(r.id for r in new) == [1, 2, 3]


def test_stream_appends_to_the_index(spark, tmp_path):
    schema = "doc_id long, text string"
    rows = [(1, "a b a"), (2, None), (3, "b c"), (4, "والكتاب")]
    _put(spark, tmp_path / "in", 0, rows[:2], schema)
    _put(spark, tmp_path / "in", 1, rows[2:], schema)
    write = telemetry.append_postings(str(tmp_path / "index"), build_index)
    q = _stream(spark, tmp_path / "in", schema).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    whole = build_index(spark.createDataFrame(rows, schema))
    same = lambda df: sorted(map(tuple, df.select("doc_id", "n_words", "term", "tf").collect()), key=repr)
    assert same(spark.read.parquet(str(tmp_path / "index"))) == same(whole.rows)
    assert {r.doc_id: r.n_words for r in whole.lengths.collect()} == {1: 3, 2: 0, 3: 2, 4: 1}
    write(spark.createDataFrame(rows[:2], schema), 0)  # a repeated batch replaces its own rows
    assert spark.read.parquet(str(tmp_path / "index")).filter("doc_id = 1").count() == 3


@pytest.mark.parametrize("name", ["stage_windows", "outside_marked"])
def test_seconds_are_rounded_as_in_sql(spark, tmp_path, name):
    """Half seconds before the end of a window, and at the end of a click's hours; halves go to the even second."""
    start = datetime.datetime(2024, 1, 1, 6)
    after = lambda s: start + datetime.timedelta(seconds=s)
    rows = [(i, after(s), user, kind, 10.0, "{}") for i, (user, kind, s) in enumerate([(1, "click", 0), (1, "view", 1800.6), (2, "click", 0), (2, "view", 1800.5), (3, "click", 0.5), (3, "view", -1799.6), (4, "click", -0.5), (4, "view", -0.4), (5, "view", -0.6)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(repr(row) for row in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_python_holds_the_tokens_of_few_texts_at_a_time():
    import pyarrow as pa

    from corroborate.common import slices

    batch = pa.RecordBatch.from_pydict({"t": [str(i) for i in range(150)]})
    assert [b.num_rows for b in slices([batch])] == [64, 64, 22]
    held = text.token_lists(pa.array(["ab c", None, ""] * 50), lambda t: [(w, 0, len(w)) for w in t.split()], 7)
    assert held.to_pylist()[:3] == [[{"word": "ab", "start": 0, "end": 2}, {"word": "c", "start": 0, "end": 1}], None, []] and len(held) == 150
    assert len(text.token_lists(pa.array([], pa.string()), list)) == 0


ARABIC_ROWS = [(1, "والكتاب بالعلم the cat the"), (2, None), (3, "كتاب، لعلم وكتاب dog"), (4, "the الكتأب cat"), (5, "ـــ"), (6, "لِلعِلم والعلم the dog")]


@pytest.mark.parametrize("best, floor, top", [("tf", 0.0, None), ("score", 0.3, 2)])
def test_scores_of_tables_and_of_joins_are_the_same(spark, monkeypatch, best, floor, top):
    """Terms in every task's table, some documents at a time, or terms that join by shuffle: the same hits."""
    from corroborate.operators import index as I

    docs = spark.createDataFrame(ARABIC_ROWS, "doc_id long, text string").coalesce(1)
    asked = spark.createDataFrame([(7, "كتاب the"), (8, "والعلم dog nowhere"), (9, "")], "query_id long, text string")
    hits = lambda: sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9), round(r.overlap, 9)) for r in I.bm25(asked, I.build_index(docs), top_k=top, best=best, floor=floor).collect())
    monkeypatch.setattr(I, "CELLS", 5)
    tables = hits()
    monkeypatch.setattr(I, "BROADCAST_TERMS", 0)
    assert tables and tables == hits()


def test_words_are_counted_where_documents_lie(spark):
    """Texts are dealt out, and no row for each word is dealt after that; aliases are those of the column."""
    from corroborate.functions import text as T

    docs = spark.createDataFrame(ARABIC_ROWS, "doc_id long, text string")
    index = build_index(docs)
    assert index.held._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    words = T.alias_groups(F.coalesce("text", F.lit("")))
    want = {r.doc_id: Counter(w for g in r.g for w in g) for r in docs.select("doc_id", words.alias("g")).collect()}
    assert {r.doc_id: dict(zip(r.terms, r.tfs)) for r in index.held.collect()} == want
    assert any(len(T.word_aliases(w)) > 1 for w in "والكتاب للعلم".split())
    plan = docs.select(T.retrieval_words(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["spans_in_claims", "dependency_records", "required_records", "correction_cards"])
def test_words_of_documents_are_worked_out_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(lower(" not in plan


def test_python_holds_few_bytes_of_long_texts():
    import pyarrow as pa

    from corroborate.common import slices

    texts = pa.array(["a" * 1000] * 5 + ["b" * 100_000] * 5)
    held = [b.num_rows for b in slices([pa.RecordBatch.from_arrays([texts], ["t"])], 64, 150_000)]
    assert sum(held) == 10 and held[-4:] == [1, 1, 1, 1]
    assert text.text_keys(pa.array(["a", None, ""] * 50), str.upper, 7).to_pylist() == ["A", None, ""] * 50


def test_texts_are_dealt_before_they_are_spelt(spark):
    from corroborate.plans import retrieval

    plan = retrieval.alias_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("translate(") < plan.find("RepartitionByExpression"), plan


def test_key_words_of_documents_leave_python_in_small_batches(spark):
    from corroborate.plans import spans

    plan = spans.key_word_places(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan, plan


@pytest.mark.parametrize("terms", [0, 100_000])
def test_only_queries_with_two_lists_are_ranked_whole(spark, tmp_path, monkeypatch, terms):
    """Of all other queries five rows are kept a batch; the fused result is that of the SQL."""
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    con = duckdb.connect()
    for name, rows, kind in (
        ("documents", [(i, said(12), "en") for i in range(90)], "doc_id long, text string, lang string"),
        ("benchmark", [(i, said(4)) for i in range(3)], "item_id long, text string"),
        ("embeddings", [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(101)], "vec_id long, embedding array<double>"),
    ):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    whole = []

    def noted(hits, *order):
        whole.append({r.query_id for r in hits.select("query_id").distinct().collect()})
        return ranks.ranked_by_range(hits, *order)

    monkeypatch.setattr(vectors, "ranked_by_range", noted)
    monkeypatch.setattr(index, "BROADCAST_TERMS", terms)
    got = sorted(tuple(r) for r in entry.queries()["hybrid_rrf"](spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").collect())
    rel = con.execute(entry.oracle_sql()["hybrid_rrf"])
    assert got == sorted(rel.fetchall()) and len({r[0] for r in got}) == 5
    assert whole == [{0}, {0}]


def test_places_of_a_repeated_vector_add_up(spark, tmp_path):
    """Both rows of a vector that is there twice count, however far down its list they stand."""
    rng = random.Random(6)
    con = duckdb.connect()
    vectors_ = [(i, [1.0, 0.01 * (i + 1)]) for i in range(20)]
    for name, rows, kind in (
        ("documents", [(500 + i, "a b", "en") for i in range(3)], "doc_id long, text string, lang string"),
        ("benchmark", [(7, "b c")], "item_id long, text string"),
        ("embeddings", vectors_ + [(9, [1.0, 0.1 + rng.random() / 1000])], "vec_id long, embedding array<double>"),
    ):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["hybrid_rrf"](spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").collect())
    assert got == sorted(con.execute(entry.oracle_sql()["hybrid_rrf"]).fetchall()) and (0, 9, 1) in {(q, d, r) for q, d, _, r in got}
