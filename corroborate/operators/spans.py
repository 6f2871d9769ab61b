"""Quotation detection: exact, near and excerpt matches of document windows against protected records."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import kept
from ..functions.text import comparison_words, word_budget, word_signs


def record_words(records: DataFrame, id_col: str = "item_id", text_col: str = "text", compose: bool = True) -> DataFrame:
    """(item_id, rw, m): each record's words of the comparison key and their number.  Of records with the same words the first
    stands for all; records without words are left out."""
    out = records.select(records[id_col].alias("item_id"), comparison_words(records[text_col], True, compose).alias("rw"))
    return out.filter(F.size("rw") > 0).groupBy("rw").agg(F.min("item_id").alias("item_id")).select("item_id", "rw", F.size("rw").alias("m"))


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compose: bool = True) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), comparison_words(F.coalesce(docs[text_col], F.lit("")), True, compose).alias("dw"))


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, p, word), p from 1."""
    return docs.select("doc_id", F.posexplode("dw").alias("p", "word")).withColumn("p", F.col("p") + 1)


def _rarest(records: DataFrame, frequency: DataFrame, take) -> DataFrame:
    """Each record's `take` rarest word occurrences by frequency in the documents: (item_id, m, q, word), q from 1."""
    every = records.select("item_id", "m", F.posexplode("rw").alias("q", "word")).join(frequency, "word", "left")
    order = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "word", "q")
    return every.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= take).select("item_id", "m", (F.col("q") + 1).alias("q"), "word")


def _seeds(docs: DataFrame, records: DataFrame, take) -> DataFrame:
    """Places in documents where a record's rare word stands: (doc_id, item_id, m, p, q)."""
    asked = records.select(F.explode("rw").alias("word")).distinct()
    places = _places(docs).join(asked, "word", "left_semi")  # only words that records use
    frequency = places.groupBy("word").agg(F.count("*").alias("n"))
    rarest = kept(_rarest(records, frequency, take), "rarest")  # Spark sees how small it is, and need not shuffle the places
    return places.join(rarest, "word").select("doc_id", "item_id", "m", "p", "q")


def exact_windows(docs: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n): windows of a document's words that equal a record's, start from 1.

    A record's rarest word finds the places; only there are words compared.
    """
    at = _seeds(docs, records, 1).select("doc_id", "item_id", "m", (F.col("p") - F.col("q") + 1).alias("start")).filter("start > 0")
    found = at.join(docs, "doc_id").join(records.select("item_id", "rw"), "item_id").filter(F.slice("dw", F.col("start"), F.col("m")) == F.col("rw"))
    return found.select("doc_id", "item_id", "start", F.col("m").alias("n"))


def near_windows(docs: DataFrame, records: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, item_id, start, n, distance): windows within the word budget of a record, exact ones left out.

    A window within b edits keeps one of any b + 1 of the record's words, b of its places off at most; so the record's
    b + 1 rarest words give all places to compare.  Window and record need `least` words.
    """
    long_ = records.filter(F.col("m") >= least)
    budget = word_budget(F.col("m") + 3)
    seeds = _seeds(docs, long_, budget + 1).withColumn("b", budget)
    starts = seeds.select("doc_id", "item_id", "m", "b", F.explode(F.sequence(F.col("p") - F.col("q") + 1 - F.col("b"), F.col("p") - F.col("q") + 1 + F.col("b"))).alias("start")).filter("start > 0").distinct()
    # lengths within two words of some record's, which is what a scan of all windows would try
    lengths = records.select(F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - 2), F.col("m") + 2)).alias("n")).distinct().filter(F.col("n") >= least)
    # by length, so that records meet only the few lengths within their budget
    sizes = long_.select("m", F.explode(F.sequence(F.greatest(F.lit(least), F.col("m") - 3), F.col("m") + 3)).alias("n")).distinct()
    sizes = sizes.join(lengths, "n").filter(F.abs(F.col("n") - F.col("m")) <= word_budget(F.greatest("n", "m"))).groupBy("m").agg(F.collect_set("n").alias("lengths"), F.max("n").alias("longest"))
    # only the words around a start travel on
    cut = starts.join(sizes, "m").join(docs, "doc_id").select("doc_id", "item_id", "start", "lengths", F.slice("dw", F.col("start"), F.col("longest")).alias("dw"))
    # words become signs once for each start, whatever the number of lengths
    signs = cut.join(long_.select("item_id", "rw"), "item_id").select("doc_id", "item_id", "start", "lengths", F.size("rw").alias("m"), F.size("dw").alias("most"), word_signs(F.col("rw"), F.col("rw")).alias("own"), word_signs(F.col("rw"), F.col("dw")).alias("seen"))
    tried = signs.withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.col("most"))
    near = tried.withColumn("distance", F.levenshtein(F.col("own"), F.substring("seen", F.lit(1), F.col("n")), 3))
    near = near.filter((F.col("distance") > 0) & (F.col("distance") <= word_budget(F.greatest("n", "m"))))
    return near.select("doc_id", "item_id", "start", "n", "distance", F.abs(F.col("n") - F.col("m")).alias("length_difference"))


def best_windows(near: DataFrame, exact: DataFrame) -> DataFrame:
    """One record for each window: the nearest, then by length difference and record; none for windows that equal a record."""
    best = near.groupBy("doc_id", "start", "n").agg(F.min(F.struct("distance", "length_difference", "item_id")).alias("b"))
    open_ = best.join(exact.select("doc_id", "start", "n").distinct(), ["doc_id", "start", "n"], "left_anti")
    return open_.select("doc_id", "b.item_id", "start", "n", "b.distance", "b.length_difference")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows with places, once for each block of the text that they touch."""
    return rows.filter("start < end").withColumn("block", F.explode(F.sequence((F.col("start") / block).cast("long"), ((F.col("end") - 1) / block).cast("long"))))


def unless(left: DataFrame, right: DataFrame, on, block: int = 512) -> DataFrame:
    """Rows of left without an overlapping row of right in the same document (its columns under r_) for which `on` holds.

    Both meet in blocks of the text, so that a document with many places is no single group.
    """
    r = _blocks(right, block).withColumnsRenamed({c: f"r_{c}" for c in [*right.columns, "block"]})
    overlap = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("block") == F.col("r_block")) & (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    bad = _blocks(left, block).join(r, overlap & on, "left_semi").drop("block").distinct()
    return left.join(bad, left.columns, "left_anti")


def choose(hits: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of hits(doc_id, start, end, ...) those that overlap none chosen before, taken by `order`.

    A sweep over a document's starts cuts its hits into clusters that no overlap joins; the choice is made in each cluster,
    against the chosen places in a sorted list, of which only the neighbours can overlap.
    """
    so_far = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("start") >= F.coalesce(F.max("end").over(so_far), F.lit(-1))).cast("int")
    running = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clusters = hits.withColumn("_opens", opens).withColumn("_cluster", F.sum("_opens").over(running)).drop("_opens")
    columns = hits.columns

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        keep = []
        rows = rows.sort_values(list(order), kind="stable")
        for at, a, b in zip(rows.index, rows["start"], rows["end"]):
            i = bisect_right(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                insort(taken, (a, b))
                keep.append(at)
        return rows.loc[keep, columns]

    return clusters.groupBy("doc_id", "_cluster").applyInPandas(take, hits.schema)


def resolve(exact: DataFrame, near: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n, classification): exact hits, and near ones that survive.

    A near hit that overlaps an exact hit of a record at least as long goes; of the rest those stay that overlap none chosen
    before, by distance, length difference, number of words, start and record.
    """
    near = best_windows(near, exact).withColumn("end", F.col("start") + F.col("n"))
    size = records.select("item_id", "m")
    verbatim = exact.join(size, "item_id").select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), "m")
    rest = unless(near.join(size, "item_id"), verbatim, F.col("r_m") >= F.col("m"))
    chosen = choose(rest, ["distance", "length_difference", "n", "start", "item_id"]).select("doc_id", "item_id", "start", "n")
    return exact.select("doc_id", "item_id", "start", "n", F.lit("VERBATIM").alias("classification")).unionByName(chosen.withColumn("classification", F.lit("NEAR_MISS")))


#: Quote pairs and their names.
QUOTES = [("«", "»", "guillemets"), ("“", "”", "curly"), ('"', '"', "straight")]


def marked_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pairs=QUOTES) -> DataFrame:
    """(doc_id, marker, span): every text between a pair of quotation marks, shortest first found."""
    text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    found = [F.transform(F.regexp_extract_all("text", F.lit(f"(?s){re.escape(a)}(.*?){re.escape(b)}"), F.lit(1)), _marker(name)) for a, b, name in pairs]
    return text.select("doc_id", F.inline(F.concat(*found)))


def _marker(name: str):
    return lambda s: F.struct(F.lit(name).alias("marker"), s.alias("span"))


def excerpts(docs: DataFrame, records: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, item_id, shared): documents that hold runs of n consecutive words of a longer record, with the number of its runs held."""
    runs = lambda df, key, w: df.filter(F.size(w) >= n).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))).alias("run"))
    return runs(docs, "doc_id", F.col("dw")).join(runs(records.filter(F.col("m") > n), "item_id", F.col("rw")), "run").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def detection_status(texts: DataFrame, findings: DataFrame, records: DataFrame, required: DataFrame) -> DataFrame:
    """(doc_id, status, findings): INDEX_EMPTY without records, UNRESOLVED if a required record isn't there, else RAN.

    required(doc_id, item_id).
    """
    empty = records.limit(1).agg((F.count("*") == 0).alias("_empty"))
    lost = required.join(records.select("item_id"), "item_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("_lost"))
    n = findings.groupBy("doc_id").agg(F.count("*").alias("findings"))
    out = texts.select("doc_id").join(lost, "doc_id", "left").join(n, "doc_id", "left").crossJoin(F.broadcast(empty))  # one row
    status = F.when(F.col("_empty"), "INDEX_EMPTY").when(F.col("_lost").isNotNull(), "UNRESOLVED").otherwise("RAN")
    return out.select("doc_id", status.alias("status"), F.coalesce("findings", F.lit(0).cast("long")).alias("findings"))


def span_effects(findings: DataFrame, levels: DataFrame, domain: str | None = None) -> DataFrame:
    """Per document: whether a near miss forces CONTRADICTS (of a record of `domain` if given, unless its level is D), else the
    first near record as a notice.  findings(doc_id, item_id, start, classification[, domain])."""
    near = findings.filter("classification = 'NEAR_MISS'")
    forcing = F.lit(True) if domain is None else F.coalesce(F.col("domain") == domain, F.lit(False))
    near = near.groupBy("doc_id").agg(F.min(F.struct("start", "item_id")).alias("first"), F.bool_or(forcing).alias("forcing"))
    out = levels.join(near, "doc_id", "left")
    force = F.coalesce("forcing", F.lit(False)) & (F.col("level") != "D")
    return out.select("doc_id", force.alias("force_contradicts"), F.when(~force, F.col("first.item_id")).alias("notice"))
