"""Progress of requests under a shared deadline: receipts of sources and cards of claims count until it passes or a snapshot seals it.

Events are (request_id, ts, kind, name, state).  Kinds: `ask` opens a request, its deadline is the first ask plus the budget;
`receipt` says that source `name` is done; `claim` registers claim `name`; `card` completes claim `name` with `state`;
`snapshot` seals the request.  The seal is the first snapshot at or after the ask, the deadline at the latest.

A batch gives a row for each request that asks; a stream gives the same row once the watermark has passed the deadline, by
keyed state and an event-time timer.  What comes later finds the request closed and is refused; the closed mark, and events of
requests that never ask, expire after a while, so that state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_OUT = "request_id long, asked long, sealed long, sources array<string>, cards array<struct<claim: string, state: string>>, retryable array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def progress(events: DataFrame, seconds: float = 3.0, late: str = "10 seconds", keep: float = 600.0) -> DataFrame:
    """(request_id, asked, sealed, sources, cards, retryable): the sources done by the deadline, each registered claim's last card up
    to the seal (ties by state), and the registered claims without one; all in order of their names.

    A claim counts if registered up to the seal.  Null request ids, times or kinds, and names where one is needed, take no part.
    In a stream, state of a closed or never opened request goes `keep` seconds after its deadline or last event.
    """
    rows = events.filter("request_id is not null and ts is not null and (kind in ('ask', 'snapshot') or (kind in ('receipt', 'claim', 'card') and name is not null))")
    out = _stream(rows, seconds, late, keep) if events.isStreaming else _batch(rows, seconds)
    return out.select("request_id", F.timestamp_micros("asked").alias("asked"), F.timestamp_micros("sealed").alias("sealed"), "sources", "cards", "retryable")


def _batch(rows: DataFrame, seconds: float) -> DataFrame:
    rows = rows.select("request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", "name", "state")
    asks = rows.filter("kind = 'ask'").groupBy("request_id").agg(F.min("us").alias("asked")).withColumn("deadline", F.col("asked") + int(seconds * 1e6))
    known = rows.filter("kind <> 'ask'").join(asks, "request_id").filter("us >= asked and us <= deadline")
    seals = known.filter("kind = 'snapshot'").groupBy("request_id").agg(F.min("us").alias("snapshot"))
    asks = asks.join(seals, "request_id", "left").withColumn("sealed", F.coalesce("snapshot", "deadline")).select("request_id", "asked", "sealed")
    # a request's sources and claims first, each with its events summed, then the request
    names = known.filter("kind <> 'snapshot'").join(asks.select("request_id", "sealed"), "request_id").filter("kind = 'receipt' or us <= sealed")
    names = names.groupBy("request_id", "name").agg(
        F.bool_or(F.col("kind") == "receipt").alias("source"), F.bool_or(F.col("kind") == "claim").alias("claim"),
        F.max(F.when(F.col("kind") == "card", F.struct("us", F.coalesce("state", F.lit("")).alias("key"), "state"))).alias("card"),
    )
    done = F.col("claim") & F.col("card").isNotNull()
    collect = lambda test, value: F.array_sort(F.collect_list(F.when(test, value)))
    per = names.groupBy("request_id").agg(collect(F.col("source"), F.col("name")).alias("sources"), collect(done, F.struct(F.col("name").alias("claim"), F.col("card.state").alias("state"))).alias("cards"), collect(F.col("claim") & F.col("card").isNull(), F.col("name")).alias("retryable"))
    none = {"sources": "array<string>", "cards": "array<struct<claim: string, state: string>>", "retryable": "array<string>"}
    out = asks.join(per, "request_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in none.items()})


class _Progress(StatefulProcessor):
    def __init__(self, seconds: float, keep: float):
        self.budget, self.keep = int(seconds * 1e6), int(keep * 1e3)

    def init(self, handle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "asked long, closed boolean, timer long")
        self.snapshots = handle.getMapState("snapshots", "us long", "n int")
        self.receipts = handle.getMapState("receipts", "name string, us long", "n int")
        self.claims = handle.getMapState("claims", "name string, us long", "n int")
        self.cards = handle.getMapState("cards", "name string, us long, key string", "state string")

    def handleInputRows(self, key, rows, timerValues):
        asked, closed, timer = self.about.get() if self.about.exists() else (None, False, None)
        if closed:
            return
        last = 0
        for r in rows:
            last = max(last, r.us)
            if r.kind == "ask":
                asked = r.us if asked is None else min(asked, r.us)
            elif r.kind == "snapshot":
                self.snapshots.updateValue((r.us,), (1,))
            elif r.kind == "card":
                self.cards.updateValue((r.name, r.us, r.state or ""), (r.state,))
            else:
                (self.receipts if r.kind == "receipt" else self.claims).updateValue((r.name, r.us), (1,))
        when = (asked + self.budget) // 1000 + 1 if asked is not None else last // 1000 + self.keep
        if when != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(when)
        self.about.update((asked, False, when))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        asked, closed, _ = self.about.get() if self.about.exists() else (None, True, None)
        if asked is not None and not closed:
            deadline = asked + self.budget
            sealed = min([k[0] for k in self.snapshots.keys() if asked <= k[0] <= deadline], default=deadline)
            sources = sorted({name for name, us in self.receipts.keys() if asked <= us <= deadline})
            claims = {name for name, us in self.claims.keys() if asked <= us <= sealed}
            cards: dict = {}
            for (name, us, order), (state,) in self.cards.iterator():
                if name in claims and asked <= us <= sealed:
                    cards[name] = max(cards.get(name, (us, order, state)), (us, order, state), key=lambda c: c[:2])
            yield Row(request_id=key[0], asked=asked, sealed=sealed, sources=sources, cards=[Row(claim=n, state=cards[n][2]) for n in sorted(cards)], retryable=sorted(claims - set(cards)))
        for state in (self.snapshots, self.receipts, self.claims, self.cards):
            state.clear()
        if asked is not None and not closed:
            expiry = (asked + self.budget) // 1000 + self.keep
            self.handle.registerTimer(expiry)
            self.about.update((asked, True, expiry))
        else:
            self.about.clear()

    def close(self) -> None:
        pass


def _stream(rows: DataFrame, seconds: float, late: str, keep: float) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # the only store with timers and several states a key
    rows = rows.withWatermark("ts", late).select(F.col("request_id").cast("long").alias("request_id"), "ts", F.unix_micros("ts").alias("us"), "kind", "name", "state")
    return rows.groupBy("request_id").transformWithState(_Progress(seconds, keep), _OUT, "append", "EventTime")
