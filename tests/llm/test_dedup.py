"""Exact operators against brute force, and the defined results for odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corroborate.llm import line_dedup, simhash
from corroborate.llm.components import _large, _small, components
from corroborate.llm.line_dedup import remove_repeated_lines
from corroborate.llm.simhash import fingerprint, links, near_duplicates
from corroborate.llm.substring_dedup import remove_repeated_windows
from corroborate.llm import suffix_dedup
from corroborate.llm.suffix_dedup import remove_repeated_bytes
from corroborate.llm.suffix_sort import descending_suffixes, repeated_windows

ODD = "doc_id long, text string, id long, key string, fp string, digest string, chunk string, gone string, rest string, lang string, source string"


def odd_rows(text):
    other = ("x",) * 7
    rows = [(None, text, 1), (1, None, 1), (2, "", 1), (3, text, 1), (3, text, 1), (4, " \t\n ", 1), (5, "é 🙂\u0085x", 1), (6, text * 40, 1), (7, "a" * 3000, 1)]
    return [r + other + ("s",) for r in rows]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(90)]
    line = " ".join(word() for _ in range(14)).title()
    out = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            a = rng.randint(0, 30)
            words[10:10] = passage[a : a + rng.randint(48, 60)]
        text = " ".join(words)
        if i % 4 == 1:
            text += "\n  " + line + "\t\nend " + str(i)
        out.append((i * 7 % 60, out[i - 10][1] if i % 11 == 10 else text))
    return out


def test_windows(spark, docs):
    got = {r.doc_id: r for r in remove_repeated_windows(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), width=50, chunk_bytes=2000, bucket_windows=300).collect()}
    first = {}
    for i, t in sorted(docs):
        w = t.encode().split()
        gone = set()
        mine = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, k in enumerate(mine):
            if first.get(k, i) < i:
                gone |= set(range(j, j + 50))
        for k in mine:
            first.setdefault(k, i)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), kept)
        assert sum(b - a for a, b in zip(got[i].starts, got[i].ends)) == len(gone)
    assert sum(r.n_removed for r in got.values()) > 0


@pytest.mark.parametrize("filter_bytes", [1 << 14, 256])  # the second saturates, which may change no result
def test_lines(spark, docs, filter_bytes):
    got = {r.doc_id: r for r in remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), filter_bytes=filter_bytes * 8).collect()}
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    for i, t in docs:
        kept = [x for x in t.split("\n") if not (len(held.get(key(x), ())) >= 5 and i != max(held[key(x)]))]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept))
    assert sum(r.n_dropped for r in got.values()) > 5


def test_filters_suspect_every_repeat():
    import numpy as np
    import pyarrow as pa

    a, b = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(300, 700, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([a.tobytes(), b.tobytes()]), pa.array([b"", b""])], ["segment", "seen", "again"])
    twice = np.frombuffer(next(iter(line_dedup._two_filters(1 << 14)([batch]))).column("twice")[0].as_py(), np.uint8)
    both = np.intersect1d(a, b)
    assert line_dedup._holds(twice, line_dedup._places(both, 1 << 14)).all()


def _bytes_expected(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[p : p + width] for t in texts for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        out.append((len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), bytes(x for x, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("common", [False, True])  # the second sends all anchors that repeat by the way of common ones
def test_bytes(spark, docs, common, monkeypatch):
    if common:
        monkeypatch.setattr(suffix_dedup, "COMMON_SHARE", 1 << 60)
    ways = {"common_least": 1, "sample_bytes": 1} if common else {}
    rows = docs + [(900, "xyz" * 200), (901, None), (902, "")]
    got = {r.doc_id: r for r in remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=3000, memory_bytes=500, **ways).collect()}
    for (i, _), (n, removed, spans, kept) in zip(rows, _bytes_expected(rows, 200)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (n, removed, spans, kept)
        assert len(got[i].starts) == spans


def test_suffix_sort():
    rng = random.Random(3)
    for t in range(60):
        parts = [bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(1, 5))]
        width = rng.choice([3, 8, 9, 12])
        seen = Counter(p[i : i + width] for p in parts for i in range(len(p) - width + 1))
        want = [[seen[p[i : i + width]] > 1 for i in range(len(p) - width + 1)] for p in parts]
        assert [list(map(bool, h)) for h in repeated_windows(parts, width, 64 if t % 2 else 1 << 20)] == want


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = root[i], root[j]
                if a != b:
                    root = {k: min(a, b) if v == max(a, b) else v for k, v in root.items()}
    return root


def test_near_duplicates(spark, docs):
    rows = docs + [(100 + i, " ".join(docs[3][1].split()[: 60 + i % 3] + ["tail"] * (i % 4))) for i in range(20)]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: _fingerprint(t) for i, t in rows}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == _roots(prints)


@pytest.mark.parametrize("dense", [0, 3, 64])
def test_links_connect_alike_on_both_ways(spark, dense):
    rng = random.Random(9)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(12)}
    signed = [x - 2**64 if x >> 63 else x for x in prints]
    found = links(spark.createDataFrame([(x,) for x in signed], "fp long"), dense).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in found)
    root = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long") if found else spark.createDataFrame([], "a long, b long")).collect()}
    want = _roots(dict(enumerate(prints)))
    groups = defaultdict(set)
    for k, x in enumerate(prints):
        groups[root.get(x - 2**64 if x >> 63 else x, x)].add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def _broadcasts(df):
    """Lines of the plan that send a table to every task."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


def test_exploded_keys_and_stars_are_not_gathered_on_the_driver(spark, docs, tmp_path):
    fps = spark.createDataFrame([(i * 2**40,) for i in range(200)], "fp long")
    fps.write.parquet(str(tmp_path / "fps"))  # few bytes on disk, as sized by Spark
    stored = spark.read.parquet(str(tmp_path / "fps"))
    # only the crowded keys, written before, may go to every task
    assert all("LeftAnti" in x for x in _broadcasts(links(stored)))
    edges = stored.select(F.col("fp").alias("a"), F.lit(-1).cast("long").alias("b"))
    assert not _broadcasts(_large(edges)) and not _broadcasts(_small(edges))
    assert not _broadcasts(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))


def test_the_pipelines_third_stage_gathers_nothing_on_the_driver(spark, docs):
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, lang string")
    assert not _broadcasts(corpus_pipeline.simhash_dedup(spark, rows, ""))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 400)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[500] == 400


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(120))
    df = spark.createDataFrame(odd_rows(text), ODD)
    w = sorted(remove_repeated_windows(df).collect(), key=str)
    by = defaultdict(list)
    for r in w:
        by[r.doc_id].append(r)
    assert len(w) == 9 and by[1][0].n_words == by[2][0].n_words == 0
    assert [r.n_removed for r in by[3]] == [0, 0] and by[None][0].n_removed == 120  # a null id is the largest
    lines = remove_repeated_lines(df, least=5, documents=2, carry=("lang",)).collect()
    assert len(lines) == 9 and next(r for r in lines if r.doc_id == 1).kept is None and next(r for r in lines if r.doc_id == 2).n_lines == 1
    assert [r.n_dropped for r in lines if r.doc_id == 3] == [1, 1] and next(r for r in lines if r.doc_id is None).n_dropped == 0
    assert all(r.rest.lang == "x" for r in lines)
    odd = df.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("_0", "_rest", "none", "id")])
    for carry in (("_0", "_rest", "none", "id"), ("_0",), ()):
        assert all(r.rest[c] == "mine" for r in remove_repeated_lines(odd, carry=carry).collect() for c in carry)
    cut = remove_repeated_bytes(df, digest=True).collect()
    assert len(cut) == 9 and [r.n_removed == r.n_bytes for r in cut if r.doc_id == 3] == [True, True]
    assert next(r for r in cut if r.doc_id == 1).kept_sha256 == hashlib.sha256(b"").hexdigest()
    near = near_duplicates(df).collect()
    assert len(near) == 9 and {r.component_id for r in near if r.doc_id in (1, 2, 4)} == {1}
    assert fingerprint(None) == fingerprint(b" \n") == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    for f in (remove_repeated_windows, remove_repeated_lines, remove_repeated_bytes, near_duplicates):
        assert f(df).count() == 0
    assert simhash.links(df.select(F.col("doc_id").alias("fp"))).count() == 0


@pytest.mark.parametrize("budget", [0, 100, 1 << 30])  # everything on disk with full recursion, partly, in memory
def test_suffix_order_and_prefixes(tmp_path, budget):
    rng = random.Random(budget)
    for _ in range(60):
        n, symbols, cap = rng.randint(1, 200), rng.choice([1, 2, 5, 50, 2000]), rng.choice([3, 10, 400])
        data = [rng.randint(1, symbols) for _ in range(n)] * rng.choice([1, 1, 3])
        text = np.array([*data, 0])
        got, prefixes = [], []
        for pos, lcp, _ in descending_suffixes(text, int(text.max()), cap, str(tmp_path), budget):
            got += pos.tolist()
            prefixes += lcp.tolist()
        t = text.tolist()
        assert sorted(got) == list(range(len(data)))
        for a, b, have in zip(got, got[1:], prefixes[1:]):
            k = 0
            while k < cap and t[a + k] == t[b + k]:
                k += 1
            assert have == k and (k == cap or t[a + k] > t[b + k])


def test_shard_far_over_memory():
    rng = random.Random(8)
    passage = bytes(rng.choice(b"abcde ") for _ in range(3000))
    parts = [passage[i : i + 300] + bytes(rng.choice(b"abcde ") for _ in range(100)) for i in range(0, 2600, 40)]
    width = 50
    seen = Counter(p[i : i + width] for p in parts for i in range(len(p) - width + 1))
    want = [[seen[p[i : i + width]] > 1 for i in range(len(p) - width + 1)] for p in parts]
    assert [list(map(bool, h)) for h in repeated_windows(parts, width, 2000)] == want  # 26,000 bytes of text


def test_very_long_texts(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    shared = " ".join(rng.choice(words) for _ in range(200))
    long_ = " ".join(rng.choice(words) for _ in range(230_000))
    docs = [(1, shared + " " + long_), (2, "x " + shared)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    by_words = {r.doc_id: r for r in remove_repeated_windows(df).collect()}
    assert by_words[1].n_removed == 0 and by_words[2].n_removed == 200
    by_bytes = {r.doc_id: r for r in remove_repeated_bytes(df).collect()}
    assert by_bytes[2].n_removed >= len(shared) and by_bytes[1].n_removed >= len(shared) and by_bytes[1].n_removed < len(shared) + 50
