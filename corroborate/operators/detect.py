"""Quotation detection from texts to findings: marked spans, whole-text windows, their classes, and what survives.

A finding is a place in a text (offsets in code points, end exclusive) with the record that it quotes or misquotes.  Marked
spans, between quotation marks or after an attribution formula, are always classified; other windows count only if they equal
a record or lie within its budget of word edits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..common import dealt, kept, slices
from ..functions.automaton import Patterns, grouped
from ..functions.text import comparison_words
from ..functions.tokens import key_token_lists, key_tokens
from . import spans
from .metric import Words, nearest_records

#: An excerpt's least number of words, to be exact and to be a near miss.
EXACT_EXCERPT, NEAR_EXCERPT = 3, 5
ATTRIBUTION = "attribution_formula"
_FINDING = ["doc_id", "start", "end", "marker", "classification", "item_id", "distance", "token_count", "length_difference", "partial"]


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """(doc_id, text, dw, starts, ends): each text's words of the comparison key and their places; a null text is empty.

    carry=False leaves out the text.
    """

    def run(batches):
        for b in slices(batches, most=1 << 19):
            own = b if carry else b.select(["doc_id"])
            yield pa.RecordBatch.from_arrays([*own.columns, *key_token_lists(b.column("text"))], [*own.schema.names, "dw", "starts", "ends"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {'text string, ' * carry}dw array<string>, starts array<int>, ends array<int>")


def phrase_places(texts: DataFrame, phrases: Sequence[Sequence[str]], most_words: int = 100_000) -> DataFrame:
    """(doc_id, phrase, at): every place, in words from 0, of every phrase (a sequence of key words, by its number) in texts(doc_id, dw).

    An automaton reads each text once for all phrases, as numbers of the phrases' words, of what lies between those only that
    it is there; phrases of over `most_words` words together are several automata, each sent to the tasks on its own.
    Phrases without words are nowhere.
    """
    out = None
    for numbers in grouped(phrases, most_words) or [[]]:
        known = {w: i for i, w in enumerate(dict.fromkeys(w for i in numbers for w in phrases[i]))}
        automaton = Patterns([[known[w] for w in phrases[i]] for i in numbers])
        shared = texts.sparkSession.sparkContext.broadcast((numbers, pa.array(list(known), pa.string()), automaton))

        def run(batches, shared=shared):
            numbers, known, automaton = shared.value
            for b in slices(batches):
                lists = b.column("dw")
                size = pc.list_value_length(lists).fill_null(0).to_numpy()
                code = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
                row = np.repeat(np.arange(b.num_rows), size)
                at = np.arange(len(code)) - (np.cumsum(size) - size)[row]
                place = np.flatnonzero(code >= 0)
                # -1, which no phrase has, before a word that doesn't follow the one before in its text
                apart = np.flatnonzero((np.diff(place, prepend=-2) > 1) | (at[place] == 0))
                place, read = np.insert(place, apart, -1), np.insert(code[place], apart, -1)
                hits = [(place[i], numbers[k]) for i, k in automaton.find(read.tolist())]
                start = np.array([x[0] for x in hits], np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[start])), pa.array([x[1] for x in hits], pa.int32()), pa.array(at[start], pa.int32())], ["doc_id", "phrase", "at"])

        found = texts.select("doc_id", "dw").mapInArrow(run, "doc_id long, phrase int, at int")
        out = found if out is None else out.unionByName(found)
    return out


def marked(texts: DataFrame, formulas: Sequence[str], pairs=spans.QUOTES, most_words: int = 100_000) -> DataFrame:
    """(doc_id, start, end, marker, dw): distinct spans between quotation marks, shortest first found, and what follows a formula.

    Formulas are found on key words; of several at a word the longest counts.  What follows it runs to the end of the sentence,
    without the white space and colons at its start; where only signs stand between a formula and a quotation, the quotation
    is all.
    """
    phrases = [[w for w, _, _ in key_tokens(f)] for f in formulas]
    longest = phrase_places(texts, phrases, most_words).withColumn("n", F.element_at(F.array(*[F.lit(len(p)) for p in phrases] or [F.lit(0)]), F.col("phrase") + 1))
    longest = longest.groupBy("doc_id", "at").agg(F.max("n").alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("hits"))
    rows = texts.join(longest, "doc_id", "left").select("doc_id", "text", "ends", "hits")
    quotes = [(re.compile(f"(?s){re.escape(a)}(.*?){re.escape(b)}"), name) for a, b, name in pairs]
    stop, opening = re.compile(r"[\n.!?؟؛]"), re.compile(r"[\s:،]*")

    def run(batches):
        for b in slices(batches):
            out = []
            for i, text, ends, hits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ends", "hits"))):
                found = {(*m.span(1), name) for pattern, name in quotes for m in pattern.finditer(text)}
                opened = sorted(s for s, _, _ in found)
                for hit in hits or ():
                    after = ends[hit["at"] + hit["n"] - 1]
                    k = bisect_right(opened, after - 1)  # the first quotation that opens at or after the formula's end
                    if k < len(opened) and not key_tokens(text[after : opened[k]]):
                        continue
                    at_end = stop.search(text, after)
                    end = at_end.start() if at_end else len(text)
                    start = min(opening.match(text, after).end(), end)
                    if start < end:
                        found.add((start, end, ATTRIBUTION))
                out += [(i, s, e, name, [w for w, _, _ in key_tokens(text[s:e])]) for s, e, name in sorted(found)]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "start", "end", "marker", "dw"])

    return rows.mapInArrow(run, "doc_id long, start int, end int, marker string, dw array<string>")


def excerpts_of(texts: DataFrame, records: DataFrame) -> DataFrame:
    """(dw, item_id, distance) for texts(dw) that are a window of a longer record: exact in the first record that has it, else the nearest.

    An exact excerpt has at least three words, a near one five and a distance within its length's budget; the record is longer
    than text and budget together and has as many of the text's distinct words as the text has words, but for the budget.
    Candidates are records that hold one of the text's rarest words, so many of them that one must be held.
    """
    n = F.size("dw")
    edits = F.when(n < NEAR_EXCERPT, 0).otherwise(spans.word_budget(n))
    asked = texts.filter(n >= EXACT_EXCERPT).select("dw", n.alias("n"), edits.alias("b"), F.array_distinct("dw").alias("own")).withColumn("needed", F.greatest(F.lit(1), F.col("n") - F.col("b")))
    asked = asked.filter(F.size("own") >= F.col("needed"))
    held = records.select("item_id", "m", F.explode(F.array_distinct("rw")).alias("word"))
    often = held.groupBy("word").agg(F.count("*").alias("often"))
    ranked = asked.select("dw", "needed", F.size("own").alias("u"), F.explode("own").alias("word")).join(often, "word", "left")
    order = Window.partitionBy("dw").orderBy(F.coalesce("often", F.lit(0)), "word")
    rarest = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("u") - F.col("needed") + 1).select("dw", "word")
    pairs = rarest.join(held, "word").join(asked.select("dw", "n", "b", "needed"), "dw").filter(F.col("m") > F.col("n") + F.col("b")).select("dw", "item_id", "b", "needed").distinct()
    pairs = pairs.join(records.select("item_id", "rw"), "item_id")

    def compare(batches):
        for b in slices(batches):
            out = []
            for item, words, edits, needed, record in zip(*(b.column(c).to_pylist() for c in ("item_id", "dw", "b", "needed", "rw"))):
                if len(set(words) & set(record)) < needed:
                    continue
                own, best = Words(words), edits + 1
                for i in range(len(record) - len(words) + 1):
                    best = min(best, own.distance(record[i : i + len(words)]))
                    if not best:
                        break
                if best <= edits:
                    out.append((words, item, best))
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.string()), pa.int64(), pa.int32()))], ["dw", "item_id", "distance"])

    found = pairs.select("item_id", "dw", "b", "needed", "rw").mapInArrow(compare, "dw array<string>, item_id long, distance int")
    return found.groupBy("dw").agg(F.min(F.struct("distance", "item_id")).alias("e")).select("dw", "e.item_id", "e.distance")


def classify(texts: DataFrame, records: DataFrame) -> DataFrame:
    """(dw, classification, item_id, distance, token_count, length_difference, partial) for the distinct rows of texts(dw).

    VERBATIM equals a record, or a window of a longer one (partial); NEAR_MISS lies within the budget of a record, or of a
    window (partial); else UNRELATED, with the nearest record, whether or not they share a word.  The order of records is
    that of item_id.
    """
    asked = kept(texts.select("dw").distinct(), "asked")
    n = F.size("dw")
    equal = records.select(F.col("rw").alias("dw"), "item_id")
    exact = asked.join(equal, "dw").select("dw", F.lit("VERBATIM").alias("classification"), "item_id", F.lit(0).alias("distance"), n.alias("token_count"), F.lit(0).alias("length_difference"), F.lit(False).alias("partial"))
    rest = asked.join(equal, "dw", "left_anti")
    nearest = kept(nearest_records(rest, records), "nearest")
    parts = excerpts_of(nearest.filter("not near").select("dw"), records).withColumnsRenamed({"item_id": "part", "distance": "part_distance"})
    both = nearest.join(parts, "dw", "left")
    cut = F.col("part").isNotNull()
    kind = F.when(F.col("near"), "NEAR_MISS").when(cut & (F.col("part_distance") == 0), "VERBATIM").when(cut, "NEAR_MISS").otherwise("UNRELATED")
    other = both.select("dw", kind.alias("classification"), F.coalesce("part", "item_id").alias("item_id"), F.coalesce("part_distance", "distance").alias("distance"), F.when(cut, n).otherwise(F.greatest(n, "m")).alias("token_count"), F.when(cut, 0).otherwise(F.col("gap")).alias("length_difference"), cut.alias("partial"))
    return exact.unionByName(other)


def classify_marked(marked: DataFrame, records: DataFrame, compose: bool = True) -> DataFrame:
    """marked(span_id, span) -> (span_id, classification, item_id, distance, partial), as classify; equal spans are judged once."""
    asked = marked.select("span_id", comparison_words(F.coalesce("span", F.lit("")), True, compose).alias("dw"))
    return asked.join(classify(asked, records), "dw").select("span_id", "classification", "item_id", "distance", "partial")


def detect(docs: DataFrame, records: DataFrame, formulas: Sequence[str] = (), pairs=spans.QUOTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", record_col: str = "text", least: int = 3) -> DataFrame:
    """All findings of texts, one row each: doc_id, start, end, marker (null for a window), classification, item_id, distance,
    token_count, length_difference, partial.

    Of windows, those that equal a record stay, one-word ones only with the same letters before folding.  A near window goes
    if it overlaps a verbatim finding of a record at least as long; of the others, those stay that overlap none chosen before,
    by distance, length difference, number of words and place.  A window inside a marked finding of the same class and
    record goes.  Rows without an id take no part; of records with the same words the first by id stands for all.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.filter(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).repartition(parts, "doc_id")
    texts = dealt(tokens(rows), "doc_id", "texts")  # the one time that texts are shuffled
    held = kept(spans.record_words(records, item_col, record_col), "records")
    found = kept(marked(texts, formulas, pairs), "marked")
    judged = found.join(classify(found, held), "dw").select("doc_id", "start", "end", "marker", "classification", "item_id", "distance", "token_count", "length_difference", "partial")
    judged = kept(judged, "judged")

    exact = kept(spans.exact_windows(texts, held), "exact")
    near = spans.best_windows(spans.near_windows(texts, held, least), exact)
    size = held.select("item_id", "m")
    windows = exact.select("doc_id", F.col("start").alias("p"), "n", "item_id", F.lit("VERBATIM").alias("classification"), F.lit(0).alias("distance"), F.lit(0).alias("length_difference"))
    windows = windows.unionByName(near.select("doc_id", F.col("start").alias("p"), "n", "item_id", F.lit("NEAR_MISS").alias("classification"), "distance", "length_difference"))
    windows = windows.join(size, "item_id").join(texts.select("doc_id", "text", "starts", "ends"), "doc_id")
    windows = windows.select("doc_id", F.expr("starts[p - 1]").alias("start"), F.expr("ends[p + n - 2]").alias("end"), "n", "p", "item_id", "classification", "distance", "length_difference", "m", F.when(F.col("n") == 1, F.expr("substring(text, starts[p - 1] + 1, ends[p - 1] - starts[p - 1])")).alias("letters"))
    # one word alone must be the record's word letter by letter
    own = records.select(records[item_col].alias("item_id"), comparison_words(records[record_col], False).alias("unfolded")).filter(F.size("unfolded") == 1)
    own = held.filter("m = 1").join(own, "item_id").select("item_id", "unfolded")
    windows = windows.join(own, "item_id", "left").filter((F.col("n") > 1) | F.coalesce(comparison_words(F.col("letters"), False) == F.col("unfolded"), F.lit(False))).drop("letters", "unfolded")
    windows = kept(windows, "windows")

    verbatim = windows.filter("classification = 'VERBATIM'").select("doc_id", "start", "end", "m")
    verbatim = verbatim.unionByName(judged.filter("classification = 'VERBATIM'").join(size, "item_id").select("doc_id", "start", "end", "m")).distinct()
    open_ = spans.unless(windows.filter("classification = 'NEAR_MISS'"), verbatim, F.col("r_m") >= F.col("m"))
    chosen = spans.choose(open_, ["distance", "length_difference", "n", "p", "item_id"])
    windows = windows.filter("classification = 'VERBATIM'").unionByName(chosen)
    inside = (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end")) & (F.col("r_classification") == F.col("classification")) & (F.col("r_item_id") == F.col("item_id"))
    windows = spans.unless(windows, judged.select("doc_id", "start", "end", "classification", "item_id"), inside)
    counted = F.greatest("n", "m").alias("token_count")
    return judged.unionByName(windows.select("doc_id", "start", "end", F.lit(None).cast("string").alias("marker"), "classification", "item_id", "distance", counted, "length_difference", F.lit(False).alias("partial"))).select(*_FINDING)


def detections(docs: DataFrame, findings: DataFrame, records: DataFrame, required: DataFrame, levels: DataFrame, domains: DataFrame, protected: str, id_col: str = "doc_id") -> DataFrame:
    """Per document: status (as in detection_status), number of findings by class, force_contradicts and notice (as in span_effects).

    required(doc_id, item_id), levels(doc_id, level), domains(item_id, domain).
    """
    names = docs.select(docs[id_col].alias("doc_id"))
    status = spans.detection_status(names, findings, records, required)
    effects = spans.span_effects(findings.join(domains, "item_id", "left"), levels, protected)
    kinds = findings.groupBy("doc_id").agg(*[F.count_if(F.col("classification") == k).alias(k.lower()) for k in ("VERBATIM", "NEAR_MISS", "UNRELATED")])
    return status.join(kinds, "doc_id", "left").join(effects, "doc_id", "left").fillna(0, ["verbatim", "near_miss", "unrelated"])
