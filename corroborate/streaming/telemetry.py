"""Request telemetry and deadlines; each function takes a batch or a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Per window and stage: events, mean and largest elapsed; events(ts, stage, elapsed).  Later than `late` is dropped in a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "stage").agg(F.count("*").alias("events"), F.avg("elapsed").alias("mean_elapsed"), F.max("elapsed").alias("max_elapsed"))
    return out.select(F.col("w.start").alias("window_start"), "stage", "events", "mean_elapsed", "max_elapsed")


def request_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", good: tuple = ("completed", "validated")) -> DataFrame:
    """Per request and session: events, failures (outcome not good), total elapsed; events(ts, request_id, outcome, elapsed)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "request_id").agg(F.count("*").alias("events"), F.count_if(~F.col("outcome").isin(*good)).alias("failures"), F.sum("elapsed").alias("elapsed"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "request_id", "events", "failures", "elapsed")


def deadline_join(claims: DataFrame, cards: DataFrame, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """claims(claim_id, claim_ts), each with the last of its cards(claim_id, card_ts, state) within the deadline; else CHECK_INCOMPLETE.

    In a stream, claims come out once the watermark has passed their deadline; the one card a claim is chosen after that, by
    last_cards in foreachBatch or over the written table, since a stream's outer join emits every match.
    """
    right = cards.select(F.col("claim_id").alias("card_id"), "card_ts", "state")
    if claims.isStreaming:
        claims, right = claims.withWatermark("claim_ts", late), right.withWatermark("card_ts", late)
    on = F.expr(f"claim_id = card_id AND card_ts >= claim_ts AND card_ts <= claim_ts + interval {int(seconds)} seconds")
    out = claims.join(right, on, "left_outer").select("claim_id", "claim_ts", "card_ts", F.coalesce("state", F.lit("CHECK_INCOMPLETE")).alias("state"))
    return out if out.isStreaming else last_cards(out)


def last_cards(joined: DataFrame) -> DataFrame:
    """Of a claim's cards the last before its deadline; ties by state."""
    last = joined.groupBy("claim_id", "claim_ts").agg(F.max(F.struct("card_ts", "state")).alias("c"))
    return last.select("claim_id", "claim_ts", "c.card_ts", "c.state")


def receipts_in_time(requests: DataFrame, receipts: DataFrame, seconds: int = 3, late: str = "10 seconds") -> DataFrame:
    """requests(request_id, request_ts) with the sources whose receipts(request_id, source_id, done_ts, items) came within the shared
    budget; a source that came later adds nothing, a request without one gets a row of nulls."""
    right = receipts.select(F.col("request_id").alias("for_request"), "source_id", "done_ts", "items")
    if requests.isStreaming:
        requests, right = requests.withWatermark("request_ts", late), right.withWatermark("done_ts", late)
    on = F.expr(f"request_id = for_request AND done_ts >= request_ts AND done_ts <= request_ts + interval {int(seconds)} seconds")
    return requests.join(right, on, "left_outer").select("request_id", "request_ts", "source_id", "done_ts", "items")


def sealed_progress(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """events(request_id, ts, kind, claim_id), kind card or snapshot -> (request_id, accepted, refused): cards up to a request's first
    snapshot count, later ones are refused.  A batch; streams write their events first and run this over the table."""
    seal = events.filter("kind = 'snapshot'").groupBy("request_id").agg(F.min("ts").alias("sealed"))
    cards = events.filter("kind = 'card'").join(seal, "request_id", "left")
    taken = F.coalesce(F.col("ts") <= F.col("sealed"), F.lit(True))
    return cards.groupBy("request_id").agg(F.count_if(taken).alias("accepted"), F.count_if(~taken).alias("refused"))


def append_postings(index_path: str, build):
    """For foreachBatch: each micro-batch's rows are appended to the index table; build(df) gives an Index.

    A batch that is repeated after a failure overwrites its own folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        build(batch).rows.write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return write


def new_items(items: DataFrame, id_col: str = "id", ts_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each id once, for collections that resume; in a stream within the watermark."""
    if items.isStreaming:
        return items.withWatermark(ts_col, late).dropDuplicatesWithinWatermark([id_col])
    return items.dropDuplicates([id_col])
