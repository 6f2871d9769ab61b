"""Learned and coding operators: held-out accuracy, exact round trips, planted cases, recall."""

import glob
import hashlib
import math
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corroborate.llm import ann_tree, cotraining, decontaminate, langid, queries, warc, wfst

from .test_dedup import ODD, odd_rows

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language_held_out(spark):
    docs = read(spark, "documents")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_code_lengths_are_ppm(monkeypatch):
    """Costs of small models against the definition, over texts that span several pieces."""
    monkeypatch.setattr(langid, "PIECE", 40)
    rng = random.Random(4)
    said = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(6)] for lang, letters in (("x", "ab é"), ("y", "abcd "))}
    rows, counts = {k: ([], [], []) for k in range(3)}, {lang: defaultdict(lambda: defaultdict(int)) for lang in said}
    for i, (lang, texts) in enumerate(said.items()):
        data = [t.encode() for t in texts]
        for code, history, _ in langid._pieces(data, 2):
            for k in range(3):
                keys, n = np.unique(code[history >= k] & langid._mask(k), return_counts=True)
                for column, values in zip(rows[k], (keys.tolist(), [i] * len(keys), n.tolist())):
                    column.extend(values)
        for s in data:
            for j in range(len(s)):
                for k in range(min(2, j) + 1):
                    counts[lang][s[j - k : j]][s[j]] += 1
    merged = {}
    for k, (gram, lang, n) in rows.items():
        total = defaultdict(int)
        for g, i, c in zip(gram, lang, n):
            total[g, i] += c
        merged[k] = np.array([g for g, _ in total], np.uint64), np.array([i for _, i in total]), np.array([*total.values()], float)

    def bits(lang, context, symbol):
        seen = counts[lang].get(context)
        lower = (lambda: bits(lang, context[1:], symbol)) if context else (lambda: 8.0)
        if not seen:
            return lower()
        n, d = sum(seen.values()), len(seen)
        return -np.log2(seen[symbol] / (n + d)) if symbol in seen else -np.log2(d / (n + d)) + lower()

    trees = langid.Trees(["x", "y"], 2, merged)
    asked = ["ab é", "", "zz", "dcba " * 30, "é", "abab" * 25, "½q"]
    got = trees.text_bits([t.encode() for t in asked])
    for t, row in zip(asked, got):
        s = t.encode()
        for lang, have in zip("xy", row):
            assert have == pytest.approx(sum(bits(lang, s[max(0, j - 2) : j], s[j]) for j in range(len(s))))


def test_language_needs_a_letter(spark):
    rows = [(1, "the cat", "en"), (4, "der Hund", "de"), (5, "½ ² Ⅷ 12", None), (6, "ñ", None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out[5].lang_pred == "und" and out[5].score == 0 and out[6].lang_pred != "und"


def test_sentencepiece(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    texts = [r.text for r in read(spark, "documents").select("text").limit(300).collect()]
    texts += ["", " ", "   a  b   ", "Hello  world\n a\tb ½ ﬁ 漢字🙂 x ", "\n\n  x\n   ", "a" * 300, "             many       spaces", None]
    out = wfst.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), queries.PIECE_MODEL).collect()
    for r in out:
        t = texts[r.doc_id]
        if t is None:
            assert r.ids is None and r.same is None
        else:
            assert list(r.ids) == library.encode(t) and r.decoded == t and r.same
            assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(t), "<i4").tobytes()).hexdigest()


@pytest.mark.parametrize("chunk", [64, 1000])
def test_warc_round_trip(spark, chunk):
    rng = random.Random(1)
    parts = ["\r\n\r\nWARC/1.1\r\n", "WARC/1.1", "\r\n", "x" * 30, "é", "WARC/1.1\r\n", "\r", "\n", "a"]
    rows = [(i, f"http://x/{i} y", "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    rows += [(1000, None, None), (1001, "u", ""), (None, "u", "q" * 200), (1002, "u", "z" * 150), (1003, "u", "z" * 150), (1004, None, "z" * 150), (1005, "u", "w" * 50), (1006, "u", "w" * 50)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), chunk_bytes=chunk).collect()}
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    for i, _, h in rows:
        p = (h or "").encode()
        back = first.get(h) if i is not None and len(p) >= 100 and first[h] < i else None
        assert tuple(got[i]) == (i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if back is not None else "response", back)


def test_benchmark_passages_are_found(spark):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    texts, bench = docs.collect(), items.collect()
    planted = {(d.doc_id, b.item_id) for d in texts for b in bench if b.text in d.text}
    assert planted and planted <= set(got)
    clean = {d.doc_id for d in texts} - {i for i, _ in planted}
    assert len({i for i, _ in got} & clean) <= 0.01 * len(clean)


def test_paraphrases_and_subsequence(spark):
    rng = random.Random(4)
    words = [f"term{i}" for i in range(3000)]
    item = " ".join(rng.choice(words) for _ in range(30)) + ". The answer is seventeen green parrots"
    edited = item.split()
    for k in (3, 9, 15, 21):
        edited[k] = "other"
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(40)]
    rows[7] = (7, rows[7][1] + " " + " ".join(edited) + " " + rows[8][1])
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, None), (3, " ")], "item_id long, text string"), common=0.5).collect()
    assert [(r.doc_id, r.item_id) for r in out] == [(7, 1)]
    a, b = [rng.randint(0, 5) for _ in range(40)], [rng.randint(0, 5) for _ in range(50)]
    table = np.zeros((41, 51), int)
    masks = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert decontaminate.subsequence(masks, 40, b) == table[40, 50]


def test_paraphrase_without_rare_words_and_repeated_items(spark):
    rng = random.Random(9)
    words = [f"term{i}" for i in range(300)]
    item = " ".join([f"rare{i}" for i in range(6)] + rng.sample(words, 14)) + "\n" + " ".join(rng.sample(words, 4))
    again, nameless = (" ".join(rng.sample(words, 24)) for _ in range(2))
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(40)]
    rows[7] = (7, rows[7][1] + " " + re.sub(r"rare\d", "other", item))
    rows[8], rows[9] = (8, rows[8][1] + " " + again), (9, rows[9][1] + " " + nameless)
    items = spark.createDataFrame([(1, item), (1, again), (None, nameless)], "item_id long, text string")
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(7, 1), (8, 1), (9, None)} and len(out) == 3


def test_neighbours(spark):
    rows = read(spark, "embeddings")
    out = defaultdict(list)
    for r in ann_tree.search(rows, rows.filter("vec_id % 100 = 0")).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    got = rows.collect()
    ids, x = np.array([r.vec_id for r in got]), np.array([r.embedding for r in got], float)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        found = sorted(out[q])
        assert [r for r, _, _ in found] == list(range(1, 11))
        hit += len(best & {v for _, v, _ in found})
        assert all(s == pytest.approx(d[ids == v][0], abs=1e-12) for _, v, s in found)
    assert hit >= 0.9 * 10 * len(out)


def test_neighbours_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [3.0, 0.0]), (8, [float("inf"), 0.0]), (9, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = ann_tree.search(df, df.filter("vec_id in (0, 1)")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in out] == [(0, 5, 0.0), (0, 6, 0.0), (0, 7, 2.0)]
    assert ann_tree.search(df.filter("vec_id = 1"), df).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist(), "k", 1) for i in range(300)]
    rows += [rows[0], rows[0], (100, rng.normal(size=4).tolist(), "k", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, query long")
    out = defaultdict(list)
    for r in ann_tree.search(df, df.filter("vec_id % 100 = 0"), recall=1.0).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(out) == {0, 100, 200}
    for q, found in out.items():
        own = min(v for i, v, *_ in rows if i == q)
        best = sorted((math.dist(own, v), i) for i, v, *_ in rows if i != q)[:10]
        assert [(i, pytest.approx(s)) for _, i, s in sorted(found)] == [(i, s) for s, i in best]


@pytest.mark.parametrize("n", [2, 6, 12, 60])
def test_cotraining_with_few_labels(spark, n):
    docs = spark.range(80).selectExpr("id AS doc_id", "if(id % 2 = 0, 'good fine words', 'bad poor signs') AS text", "'s' AS source", "'en' AS lang", "id AS weight", "id AS y", "'f' AS fold")
    labels = docs.filter(F.col("doc_id") < n).selectExpr("doc_id", "cast(doc_id % 2 = 0 AS int) AS quality", "0 AS toxic")
    out = cotraining.classify(docs, labels, rounds=1).collect()
    fold = {r.id: r.f for r in spark.range(n).select("id", F.pmod(F.xxhash64(F.col("id"), F.lit("fold")), F.lit(10)).alias("f")).collect()}
    both = {(f < 7, i % 2) for i, f in fold.items()}
    assert len(out) == 80 and (len(both) == 4) == all(r.score is not None for r in out)
    assert len(both) == 4 or all(r.keep and r.score is None for r in out)


def test_cotraining(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    out = cotraining.classify(docs, labels, rounds=1).join(labels, "doc_id").collect()
    good = [r.quality == 1 and r.toxic == 0 for r in out]
    assert sum(r.keep == g for r, g in zip(out, good)) >= 0.85 * len(out)
    none = cotraining.classify(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and all(r.keep and r.score is None for r in none)


def test_cotraining_held_out(spark):
    """A quarter of the labels is kept from the fit; each view and the combination are judged on it."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    out = cotraining.classify(docs, labels.filter(~hidden), rounds=2).join(labels.filter(hidden), "doc_id").collect()
    good = np.array([r.quality == 1 and r.toxic == 0 for r in out])

    def area(scores):
        rank = np.argsort(np.argsort(scores)) + 1
        return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())

    areas = {name: area(np.array([r[name] for r in out])) for name in ("p_text", "p_meta", "score")}
    assert len(out) > 60 and areas["score"] > 0.8 and areas["score"] >= max(areas["p_text"], areas["p_meta"]) - 0.03, areas
    assert np.mean([r.keep == g for r, g in zip(out, good)]) > max(good.mean(), 1 - good.mean()) + 0.05


def test_cotraining_pool_is_every_unlabelled_row(spark, monkeypatch):
    docs = spark.range(12000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'good fine words', 'bad poor signs') AS text", "concat('src', id % 2) AS source", "'en' AS lang")
    labels = docs.filter("doc_id % 5 < 1").selectExpr("doc_id", "cast(doc_id % 2 = 0 AS int) AS quality", "0 AS toxic")
    taught, fit = {}, cotraining._fit

    def seen(rows, view, *args):
        if "id" in rows.columns:
            taught[view] = {r.id for r in rows.filter("weight < 1").select("id").collect()}
        return fit(rows, view, *args)

    monkeypatch.setattr(cotraining, "_fit", seen)
    cotraining.classify(docs, labels, rounds=1, labelled_rows=1000, sure=0.6)
    assert taught["text_view"] == taught["meta_view"] == {i for i in range(12000) if i % 5}


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows("one two three four five six seven. " * 5), ODD)
    said = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(said) == 8 and said[1].lang_pred == said[2].lang_pred == said[4].lang_pred == "und" and said[1].score == 0
    assert wfst.encode_decode(df, queries.PIECE_MODEL).count() == 9
    items = spark.createDataFrame([(1, "one two three four five six seven."), (None, "x")], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.contaminated(df, items).collect()}
    assert found == {None, 3, 6}
    assert decontaminate.keep_clean(df, items).count() == 5
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2, 8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert cotraining.classify(df, labels, rounds=1).count() == 9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert langid.identify(docs).count() == wfst.encode_decode(docs, queries.PIECE_MODEL).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann_tree.search(vectors, vectors).count() == 0
    assert cotraining.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf)
    rel = con.execute(queries.SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, rel.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = read(spark, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        from corroborate.llm.common import written

        docs = written(stage(spark, docs, SF), f"test{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    assert docs.filter(~F.col("same")).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_against_the_library(tmp_path, fallback):
    from sentencepiece import sentencepiece_model_pb2

    rng = random.Random(5)
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
    m.normalizer_spec.add_dummy_prefix = m.normalizer_spec.remove_extra_whitespaces = m.normalizer_spec.escape_whitespaces = True
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))) for _ in range(300)} - {"dcb"}
    rows = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256 * fallback)], (wfst.MARK, -3.3, 1), ("dcb", 0, 4)]
    rows += [(rng.choice([wfst.MARK, "", ""]) + w, -rng.uniform(1, 12), 1) for w in sorted(words)]
    for piece, score, kind in rows:
        added = m.pieces.add()
        added.piece, added.score, added.type = piece, score, kind
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), wfst.Transducer(wfst.read_model(str(path)))
    cost = {i: 0.1 if kind == 4 else -float(s) for i, (_, s, kind) in enumerate(rows)}
    for _ in range(800):
        text = "".join(rng.choice("abcd  éz") for _ in range(rng.randint(0, 30)))
        got, want = np.frombuffer(own.encode(text), "<i4").tolist(), library.encode(text)
        # paths of one weight may be told apart by the last place of a sum
        assert got == want or sum(cost[i] for i in got) == pytest.approx(sum(cost[i] for i in want), abs=1e-4)


def test_runs_of_spaces_by_weight():
    t = wfst.Transducer(wfst.read_model(queries.PIECE_MODEL))
    assert all(t.shortest(wfst.MARK * n) == t.merged(wfst.MARK * n) for n in range(2, 40))


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, lang_pred string, _stage_lang string, _0 string, rest string, kept string"
    line = "this line is long enough to be a repeated one in many documents"
    rows = [(i, f"{line}\nnumber {i} of the texts", "en", "s", 60, "x", "mine") for i in range(6)] + [(7, None, "en", None, None, None, None), (8, "", "de", "s", 0, "y", "z"), (3, f"{line}\nnumber 3 of the texts", "en", "s", 60, "x", "mine"), (None, "der Hund und die Katze", "de", "s", 1, "q", "q")]
    docs = spark.createDataFrame([(*r, "mine", "own", "rest", "kept") for r in rows], kind)
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and {r["lang_pred"] for r in kept.collect()} == {"mine", "q"} and kept.count() == 8
    lines = corpus_pipeline.line_dedup(spark, kept, SF)
    assert lines.columns == docs.columns and sum(line in r.text for r in lines.collect()) == 1
    assert {(r["_stage_lang"], r["_0"], r["rest"], r["kept"]) for r in lines.collect()} == {("mine", "own", "rest", "kept")}
    none = corpus_pipeline.line_dedup(spark, corpus_pipeline.language_id(spark, docs.limit(0), SF), SF)
    assert none.count() == 0
