"""License scan, spelling variants and prefix trie against brute force, and the defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import licenses, prefix_trie, spelling

CLASH = "id long, word string, n long, key string, block string, lang string, pos long, w long"


# --- license scan ---------------------------------------------------------------------------------------------------


def blocks_by_definition(text, templates):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, wording, share in templates:
        want = set(wording.split())
        s = 16
        while s < 1.25 * len(wording.split()):
            s *= 2
        for b in range(math.ceil(len(words) / s)):
            n = len(want & set(words[b * s : (b + 2) * s]))
            if n >= math.ceil(share * len(want) - 1e-9):
                out.append((label, b * s, n / len(want)))
    return words, sorted(out)


def test_licenses_by_definition(spark):
    rng = random.Random(5)
    templates = [(f"t{i}", " ".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(1, 40))), rng.choice([0.6, 0.8, 1.0])) for i in range(12)]
    phrases = [("x", "a b"), ("y", "a a"), ("z", "c d e")]
    docs = []
    for i in range(40):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.choice([0, 1, 5, 40, 400]))]
        if i % 3 == 0:  # a template with some words left out
            at = rng.randint(0, len(words))
            words[at:at] = [w for w in rng.choice(templates)[1].split() if rng.random() > 0.15]
        docs.append((i, "-".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), phrases=phrases, templates=templates).collect()}
    found = 0
    for i, text in docs:
        words, want = blocks_by_definition(text, templates)
        assert got[i].n_words == len(words)
        assert sorted((b.label, b.start, b.share) for b in got[i].blocks) == want
        places = [(label, p) for label, phrase in phrases for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        assert sorted((p.label, p.word) for p in got[i].places) == sorted(places)
        found += len(want)
    assert found > 50


def test_license_notices_and_odd_rows(spark):
    mit = licenses.TEMPLATES[[t[0] for t in licenses.TEMPLATES].index("mit") + 1][1]
    changed = mit.replace("hereby", "herewith").replace("person", "one")
    texts = [None, "", " \n", mit.title(), changed, "CC-BY", "cc\x00by", "All rights\nreserved, all rights reserved", "x " * 300_000 + "general public license", "É" * 3000, mit, mit]
    rows = [(i if i < 10 else 10, t, 1, "w", 1, "k", "b", "en", 1, 1) for i, t in enumerate(texts)] + [(None, "cc by", 1, "w", 1, "k", "b", "en", 1, 1)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")
    out = licenses.scan(docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and len([r for r in out if r.doc_id == 10 and r.blocks]) == 2
    assert [by[i].n_words for i in (0, 1, 2)] == [0, 0, 0]
    assert {b.label for b in by[3].blocks} == {b.label for b in by[4].blocks} == {"mit"} and by[3].blocks[0].share == 1 > by[4].blocks[0].share
    assert by[5].places == by[None].places and by[5].places[0].label == by[6].places[0].label == "cc-by"
    assert [p.word for p in by[7].places] == [0, 3]
    assert [p.word for p in by[8].places] == [300_000] and by[9].n_words == 1
    assert licenses.scan(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(docs, most_words=3)


def test_license_numbers_across_pieces():
    index = licenses.Index(licenses.PHRASES, licenses.TEMPLATES)
    text = ("All RIGHTS rés " * 150_000).encode()
    assert index.numbers(text).tolist() == [index.number.get(w, -1) for w in licenses.words_of(text)]


# --- spelling -------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words, times=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


@pytest.mark.parametrize("tile", [7, 1024])
def test_spelling_by_definition(spark, tile):
    rng = random.Random(9)
    words = {}
    for _ in range(90):
        w = "".join(rng.choice("abcé") for _ in range(rng.randint(4, 9)))
        words[w] = rng.choice([2, 3, 30, 300])
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(w))
            words.setdefault(rng.choice([w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]]), rng.choice([2, 3, 40]))
    words |= {"字" * 5: 2, "字" * 4 + "語": 2, "𝒳字語字語": 50, "𝒳字語字": 2, "a" * 3000: 2, "a" * 3001: 90, "b" + "a" * 3000: 3}
    words.pop("", None)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group(spark.createDataFrame(list(words.items()), "word string, n long"), tile=tile).collect()}
    assert got == grouped(words)
    assert sum(v[4] != w for w, v in got.items()) > 20 and any(v[4] != v[2] for v in got.values() if v[2])


def test_rare_letters_share_a_column():
    words = ["".join(chr(0x4E00 + 100 * i + j) for j in range(4)) for i in range(40)]
    words += [w[:2] + "x" + w[3:] for w in words]
    alphabet = spelling.Alphabet(list("abc"), 3)
    codes = spelling._codes("".join(words), 4)
    a, b = spelling.near_pairs(codes, codes, alphabet)
    assert {(i, j) for i, j in zip(a.tolist(), b.tolist())} == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_edit(x, y)}


def test_hosts_name_each_pair_of_blocks_once():
    rng = random.Random(3)
    blocks = {tuple(rng.randint(0, 3) for _ in range(4)) for _ in range(120)}
    name = lambda b: ",".join(map(str, b))
    for x in blocks:
        assert name(x) in spelling.hosts_of(name(x))
        for y in blocks - {x}:
            move = sorted(b - a for a, b in zip(x, y))
            beside = [m for m in move if m] in ([1], [-1], [-1, 1])
            assert (name(y) in spelling.hosts_of(name(x))) + (name(x) in spelling.hosts_of(name(y))) == beside


def test_spelling_words_and_odd_rows(spark):
    rng = random.Random(1)
    words = ["Straße" * 2, "aaaaaaaa", "ÀÉÎÕÜßà", "naïveté×", "short", "ABCDEFGH"]
    texts = [None, "", "12 34", *[" ".join(rng.choice(words) + rng.choice(["", "1", "字", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(30)], "x" * 400_000, "x" * 400_000]
    rows = [(i // 2, t) + (1, "w", 1, "k", "b", "en", 1, 1) for i, t in enumerate(texts)] + [(None, "ABCDEFGH abcdefgh") + (1, "w", 1, "k", "b", "en", 1, 1)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")
    want = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.words_of(docs, most_held=3).collect()} == want
    assert spelling.group(spelling.words_of(docs.limit(0))).collect() == []
    assert spelling.group(spark.createDataFrame([("alone", 5)], "word string, n long")).first().root == "alone"


# --- prefix trie ----------------------------------------------------------------------------------------------------


def nodes_by_definition(convs):
    """convs: number -> list of (role, text)."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids.get(k)
            saved[k[:d]] += (len(m) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, ())), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt_by_definition(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def test_trie_by_definition(spark):
    rng = random.Random(4)
    convs = {}
    for c in range(150):
        turns = list(convs[rng.randrange(c)][: rng.randint(0, 12)]) if c and rng.random() < 0.7 else []
        convs[c] = turns + [("u", rng.choice(["a", "b b", "c c c", ""])) for _ in range(rng.choice([0, 0, 1, 3, 9]))]
    rows = [(c, p, hashlib.md5(f"{r}:{t}".encode()).digest(), len(t.split())) for c, turns in convs.items() for p, (r, t) in enumerate(turns, 1)]
    turns = spark.createDataFrame(rows, "conv long, pos long, key binary, words long")
    names = spark.createDataFrame([(c,) for c in convs], "conv long")
    want = nodes_by_definition(convs)
    for chunk, shard in ((64, 200_000), (2, 30)):  # rows cut early, and many small shards
        assert sorted((tuple(r) for r in prefix_trie.trie(turns, names, chunk, shard).collect()), key=str) == want
    assert max(r[1] for r in want) > 10 and sum(r[6] for r in want) > 1000


def test_trie_odd_rows(spark):
    long_ = [(40, i, "user", f"word {i}") for i in range(300)]
    rows = [(1, None, None, "first"), (1, 3, "user", None), (1, 3, "user", None), (1, 1, "a", "x"), (None, 1, "user", "lost"), (2, 0, "user", "\x0b a\tb c  "), (-7, 0, "user", "neg"), (-7, 1, "user", "neg"), (0, 0, "user", "base"), (0, 1, "bot", "base 2")]
    rows += long_ + [(c, t, r, x) for _, t, r, x in long_ for c in (41, 61)] + [(80 + i, 0, "user", "") for i in range(12)]
    extra = (1, "w", 1, "k", "b", "en", 1, 1)
    table = spark.createDataFrame([r + extra for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")
    got = sorted((tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(table.repartition(5)))).collect()), key=str)
    assert got == nodes_by_definition(rebuilt_by_definition(rows))
    assert prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(table.limit(0)))).collect() == []


def test_sparse_table():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 64):
        values = rng.integers(0, 6, n)
        m = prefix_trie.Minima(values)
        at, floor = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(7)))
        right = [next((j for j in range(i, n) if values[j] < f), n) for i, f in zip(at, floor)]
        left = [next((j + 1 for j in range(i - 1, -1, -1) if values[j] < f), 0) for i, f in zip(at, floor)]
        assert m.reach_right(at, floor).tolist() == right and m.reach_left(at, floor).tolist() == left
        low, high = (np.array(x, int) for x in zip(*[(i, j) for i in range(n) for j in range(i + 1, n + 1)])) if n else (np.zeros(0, int),) * 2
        assert m.of(low, high).tolist() == [values[i:j].min() for i, j in zip(low, high)]


def test_running_sums_of_a_hot_key(spark):
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"), (F.col("id") * 7919 % 101).alias("v"))
    total, both, count = Counter(), Counter(), Counter()
    got = {r.o: r for r in prefix_trie.running(rows, "k", [F.col("o")], s=(F.sum, "v"), x=(F.bit_xor, "v"), c=(F.count, "v")).collect()}
    for i in range(500):
        k, v = 1 if i % 3 else i, i * 7919 % 101
        total[k] += v
        both[k] ^= v
        count[k] += 1
        assert (got[i].s, got[i].x, got[i].c) == (total[k], both[k], count[k])
