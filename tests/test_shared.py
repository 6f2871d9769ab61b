import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corroborate.operators import shared

WORDS = ["the", "of", *"abcdefghij"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    said = lambda: [rng.choice(WORDS[: rng.choice([2, 12])]) for _ in range(rng.randint(0, 6))]
    return {i: said() for i in range(60)}, {i: said() for i in range(45)}


@pytest.fixture
def sets(spark, texts, monkeypatch):
    for name, value in {"LEAST": 7, "MOST": 25, "GROUPS": 4, "BLOCK": 11}.items():  # a grid of four by five cells
        monkeypatch.setattr(shared, name, value)
    out = []
    for rows in texts:
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "k long, t string")
        out.append(shared.word_sets(df, "k", F.col("t"), F.col("k") % 3))
    return out


def _scores(texts):
    left, right = texts
    return {(i, j): n for i, a in left.items() for j, b in right.items() if (n := len(set(a) & set(b)))}


def test_pairs_counts_and_given_pairs(texts, sets):
    want = _scores(texts)
    assert sorted((r.id, r.other) for r in shared.sharing(*sets).collect()) == sorted(want)
    assert {r.id: r.n for r in shared.sharing_counts(*sets).collect()} == Counter(i for i, _ in want)
    asked = sets[0].sparkSession.createDataFrame([(i, i % 50) for i in range(70)], "id long, other long")
    assert {(r.id, r.other): r.score for r in shared.shared_of(asked, *sets).collect()} == {k: n for k, n in want.items() if k[1] == k[0] % 50}


@pytest.mark.parametrize("most", [1, 4, 100])
def test_most_shared_by_part(texts, sets, most):
    by = {}
    for (i, j), n in _scores(texts).items():
        by.setdefault((i, j % 3), []).append((-n, j))
    want = sorted((i, j, part, -n) for (i, part), rows in by.items() for n, j in sorted(rows)[:most])
    assert sorted(tuple(r) for r in shared.most_shared(*sets, most).collect()) == want


@pytest.mark.parametrize("name", ["nominated_scores", "offered_records", "publisher_answers", "state_facts", "routed_candidates"])
def test_queries_of_repeated_turns(spark, tmp_path, name):
    """A turn that is there twice is one claim: its words count once."""
    turns = [(c, t, "user", f"the {WORDS[c % 12]} of {WORDS[t]}") for c in range(9) for t in (0, 0, 2)]
    pages = [(i, "u", f"<title>{WORDS[i % 12]} the {WORDS[i % 5]}</title>") for i in range(30)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(repr(row) for row in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


@pytest.mark.parametrize("n, m", [(134_000, 128_000), (800_000, 770_000), (5_000_000, 100), (0, 0), (100, 5_000_000)])
def test_a_grid_copies_few_words(n, m):
    """Cells are bounded, and texts are copied no more often than that and the number of cells ask for."""
    high, wide = shared._shape(n, m, 40.0, 12.0)
    assert -(-n // high) <= shared.MOST and -(-m // wide) <= shared.BLOCK
    assert high * wide >= min(shared.GROUPS, -(-n // shared.LEAST))
    least = max(1, -(-n // shared.MOST)), max(1, -(-m // shared.BLOCK))
    assert (high - least[0]) * (wide - least[1]) <= shared.GROUPS
    assert n * 40 * wide + m * 12 * high <= 13 * max(1, n * 40 + m * 12)
