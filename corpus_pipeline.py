"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import decontaminate, langid, wfst
from corroborate.llm.common import table, written
from corroborate.llm.line_dedup import remove_repeated_lines
from corroborate.llm.queries import PIECE_MODEL
from corroborate.llm.simhash import near_duplicates


def _columns(docs: DataFrame) -> list:
    """All columns by name, whatever the names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter (`und`) or without one language that is likelier than all others together go.

    Null and empty texts go with them; repeated rows are judged alike; all columns stay as they are.
    """
    trees = langid.train(docs.filter(~langid.held_out(docs["doc_id"])), "doc_id", "text", "lang")
    taken = {c.lower() for c in docs.columns}
    lang, score = (next(n for n in (stem + "_" * i for i in range(len(taken) + 1)) if n not in taken) for stem in ("_stage_lang", "_stage_score"))
    said = langid.predict(docs, trees, names=(lang, score))
    return said.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= 0.5)).select(*_columns(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows.  A null text stays null, a text may end up empty; other columns stay."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = remove_repeated_lines(docs, carry=tuple(f"`{c}`" for c in others)).withColumnRenamed("kept", "text")
    out = kept.withColumn("n_chars", F.length("text").cast("long"))
    rest = [F.col("rest").getField(c).alias(c) for c in others]
    return out.select("doc_id", "text", "n_chars", *rest).select(*_columns(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the smallest doc_id stays, with all rows that repeat it; texts without words are a class."""
    first = near_duplicates(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again; a null text has null ids."""
    return wfst.encode_decode(docs, PIECE_MODEL, keep_text=False).drop("decoded")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", sentencepiece)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
