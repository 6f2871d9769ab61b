"""Requests under a shared deadline: the stream gives what the batch gives, each request once, also after a restart."""

import datetime
import os
import random
import time

import pytest

from corroborate.streaming.progress import progress

SCHEMA = "request_id long, ts timestamp, kind string, name string, state string"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def by_definition(rows, seconds):
    out = {}
    for q in {r[0] for r in rows if r[2] == "ask" and r[0] is not None and r[1] is not None}:
        own = [r for r in rows if r[0] == q and r[1] is not None]
        asked = min(r[1] for r in own if r[2] == "ask")
        end = asked + datetime.timedelta(seconds=seconds)
        own = [r for r in own if asked <= r[1] <= end]
        seal = min([r[1] for r in own if r[2] == "snapshot"], default=end)
        sources = {r[3] for r in own if r[2] == "receipt" and r[3] is not None}
        claims = {r[3] for r in own if r[2] == "claim" and r[1] <= seal and r[3] is not None}
        cards = {}
        for r in sorted((r for r in own if r[2] == "card" and r[1] <= seal and r[3] in claims), key=lambda r: (r[1], r[4] or "")):
            cards[r[3]] = r[4]
        out[q] = (asked, seal, sorted(sources), sorted(cards.items()), sorted(claims - set(cards)))
    return out


def shown(rows):
    return {r.request_id: (r.asked, r.sealed, list(r.sources), [tuple(c) for c in r.cards], list(r.retryable)) for r in rows}


def some_events(rng, requests):
    rows = []
    for q in range(requests):
        start = rng.randint(0, 300)
        rows += [(q, at(start + rng.choice([0, 1, 4])), "ask", None, None) for _ in range(rng.choice([0, 1, 1, 2]))]
        for _ in range(rng.randint(0, 12)):
            kind = rng.choice(["receipt", "claim", "claim", "card", "card", "snapshot", "other"])
            rows.append((q, at(start + rng.randint(-2, 9)), kind, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])))
    return rows


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    for f in folder.glob("*.parquet"):
        if f.name not in put.seen:
            put.seen.add(f.name)
            os.utime(f, (time.time() - 1000 + n * 10,) * 2)


put.seen = set()


def run(spark, folder, out, check):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = progress(events, 5, "2 seconds", keep=60).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).outputMode("append").start()
    q.processAllAvailable()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return states


def test_progress_of_a_batch(spark):
    rng = random.Random(1)
    rows = some_events(rng, 40) + [(None, at(0), "ask", None, None), (99, None, "ask", None, None)]
    out = progress(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert shown(out) == by_definition(rows, 5) and len(out) > 20
    assert progress(spark.createDataFrame([], SCHEMA), 5).count() == 0


def test_progress_of_a_stream_over_restarts(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(2)
    rows = some_events(rng, 25)
    rows.sort(key=lambda r: r[1])
    cuts = [rows[:60], rows[60:130], rows[130:]]
    for k in range(0, 2):  # out of order, within the watermark's two seconds
        a, b = cuts[k][-1], cuts[k + 1][0]
        if (b[1] - a[1]).total_seconds() < 2:
            cuts[k][-1], cuts[k + 1][0] = b, a
    put(spark, tmp_path / "in", 0, cuts[0])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check")
    put(spark, tmp_path / "in", 1, cuts[1])
    put(spark, tmp_path / "in", 2, cuts[2])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check")  # goes on from its checkpoint
    put(spark, tmp_path / "in", 3, [(900, at(1000), "ask", None, None)])
    closed = [r for r in rows if r[2] == "ask"][0][0]
    put(spark, tmp_path / "in", 4, [(closed, at(1001), "card", "a", "late"), (closed, at(1001), "ask", None, None), (901, at(1001), "receipt", "a", None)])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check")
    put(spark, tmp_path / "in", 5, [(902, at(5000), "ask", None, None)])
    put(spark, tmp_path / "in", 6, [(903, at(9000), "ask", None, None)])
    states = run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    names = [r.request_id for r in got]
    want = by_definition(rows, 5)
    assert len(names) == len(set(names)) or sorted(names).count(closed) <= 2
    first = {}
    for r in sorted(got, key=lambda r: r.asked):
        first.setdefault(r.request_id, r)
    assert shown([r for q, r in first.items() if q < 900]) == want
    assert {900, 902} <= set(names) and 901 not in names
    assert states[-1] <= 4  # what was closed or never asked has expired


def test_closed_requests_refuse_what_comes_later(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    batches = [
        [(1, at(-1), "receipt", "early", None), (1, at(1), "receipt", "a", None), (1, at(1), "claim", "c", None)],
        [(1, at(0), "ask", None, None)],  # the ask comes after what it counts
        [(2, at(20), "ask", None, None)],  # the watermark passes the first deadline
        [(1, at(19), "ask", None, None), (1, at(19), "receipt", "b", None), (1, at(19), "card", "c", "late")],
        [(3, at(100), "ask", None, None)],
        [(1, at(200), "ask", None, None)],  # forgotten by now: a request of its own
        [(4, at(300), "ask", None, None)],
        [(5, at(400), "ask", None, None)],
    ]
    for n, rows in enumerate(batches):
        put(spark, tmp_path / "in", n, rows)
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check")
    got = sorted((r.request_id, r.asked, list(r.sources), list(r.retryable)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(1, at(0), ["a"], ["c"]), (1, at(200), [], [])] and [g[0] for g in got[2:]] == [2, 3, 4]
