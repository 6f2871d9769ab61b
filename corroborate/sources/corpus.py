"""Reading corpora, registers, allowlists, artifacts and cases; writing records with a manifest."""

from __future__ import annotations

import json
import lzma
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pages import manifest


def _strict(text: str | None) -> str | None:
    """What is wrong with a JSON line: blank, not an object, a key twice, NaN or Infinity, not JSON; null if nothing."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise KeyError
        return dict(items)

    def constant(_):
        raise ArithmeticError

    if text is None or not text.strip():
        return "blank"
    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except KeyError:
        return "duplicate_key"
    except ArithmeticError:
        return "not_finite"
    except ValueError:
        return "not_json"
    return None if isinstance(value, dict) else "not_object"


def numbered_lines(spark: SparkSession, path: str, check=None) -> DataFrame:
    """(file, line, value, rule): the lines of all files under path, numbered from 1 within their file; rule is check(value).

    Files are cut into splits that many tasks read, however long a file is: a task counts the lines of its splits, sums over a
    file's splits in order give where each begins, and a second read adds the line's place in its split.  Lines end at \\n,
    where a \\r before it stays.  A line that is no UTF-8 has rule not_utf8 and its broken bytes replaced; a file without
    lines is one row with line null and rule empty.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("value"), F.is_valid_utf8("value").alias("valid"))
    counts = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def number(batches):
        last, at = None, 0
        for b in batches:
            places, rules = [], []
            for key, value, valid in zip(zip(b.column("file").to_pylist(), b.column("block").to_pylist()), b.column("value").to_pylist(), b.column("valid").to_pylist()):
                last, at = (key, at + 1) if key == last else (key, 1)
                places.append(at)
                rules.append(check(value) if valid and check else None if valid else "not_utf8")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("file", "block", "value")), pa.array(places, pa.int64()), pa.array(rules, pa.string())], ["file", "block", "value", "at", "rule"])

    found = rows.mapInArrow(number, "file string, block long, value string, at long, rule string").join(starts, ["file", "block"])
    found = found.select("file", (F.col("before") + F.col("at")).alias("line"), "value", "rule")
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", f),) for f in text.inputFiles()], "file string")  # as many as the files, which the driver lists anyway
    return found.unionByName(names.join(counts, "file", "left_anti").select("file", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("value"), F.lit("empty").alias("rule")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, violations): each line of each file under path as a record of the closed schema.

    Records carry file and line (from 1, see numbered_lines); violations(file, line, rule) name what a line breaks: see
    _strict, not_utf8, unknown_key and wrong_type against the schema; an empty file breaks rule empty, without a line.
    """
    return parsed_lines(numbered_lines(spark, path, _strict), schema)


def parsed_lines(lines: DataFrame, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of lines(file, line, value, rule), as read_jsonl."""
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    parsed = lines.withColumn("record", F.from_json("value", T.StructType([*schema, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}))
    unknown = F.size(F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*[F.lit(f.name) for f in schema]))) > 0
    rule = F.coalesce("rule", F.when(unknown, "unknown_key"), F.when(F.col("record._bad").isNotNull(), "wrong_type"))
    parsed = parsed.withColumn("rule", rule)
    records = parsed.filter("rule IS NULL").select("file", "line", *[F.col("record")[f.name].alias(f.name) for f in schema])
    return records, parsed.filter("rule IS NOT NULL").select("file", "line", "rule")


def read_register(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A pipe table inside a Markdown file as rows of strings; fails on missing or repeated columns, ragged rows or repeated ids."""
    rows = [[c.strip() for c in r.value.strip().strip("|").split("|")] for r in spark.read.text(path).filter(F.trim("value").startswith("|")).collect()]  # a register is a page of text
    if len(rows) < 2:
        raise ValueError("the register has no table")
    head, body = rows[0], [r for r in rows[1:] if not all(set(c) <= set("-: ") for c in r)]
    if len(set(head)) != len(head) or not set(required) <= set(head) or any(len(r) != len(head) for r in body):
        raise ValueError("the register's columns don't fit")
    if len({r[head.index(required[0])] for r in body}) != len(body):
        raise ValueError("the register repeats an id")
    return spark.createDataFrame(body, ", ".join(f"`{c}` string" for c in head))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """The objects of `sources` in a JSON file, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")


def read_artifact(spark: SparkSession, path: str, sha256: str | None = None, most: int = 64 << 20) -> DataFrame:
    """(path, sha256, content) of plain, gzip or xz files, decompressed to at most `most` bytes; fails on another hash."""

    def unpack(batches):
        import zlib

        for b in batches:
            out = []
            for raw in b["content"]:
                raw = bytes(raw)
                if raw[:2] == b"\x1f\x8b":
                    raw = zlib.decompressobj(31).decompress(raw, most + 1)
                elif raw[:6] == b"\xfd7zXZ\x00":
                    raw = lzma.LZMADecompressor().decompress(raw, most + 1)
                if len(raw) > most:
                    raise ValueError("an artifact is too large")
                out.append(raw)
            yield pd.DataFrame({"path": b["path"], "content": out})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "path string, content binary")
    out = out.withColumn("sha256", F.sha2("content", 256))
    if sha256 is not None:
        out = out.withColumn("content", F.when(F.col("sha256") == sha256, F.col("content")).otherwise(F.raise_error(F.lit("an artifact has another hash"))))
    return out.select("path", "sha256", "content")


def write_records(records: DataFrame, path: str, by: str, text: str, order: str) -> DataFrame:
    """Records as JSON lines, one folder for each value of `by`; returns the manifest, written beside them."""
    records.write.partitionBy(by).json(f"{path}/records")
    out = manifest(records, F.col(by), F.col(text), order)
    out.write.json(f"{path}/manifest")
    return out


def read_cases(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """Cases and violations; a case id that is missing or repeated is a violation too."""
    cases, bad = read_jsonl(spark, path, fields)
    repeated = cases.filter("case_id IS NULL").select("file", "line", F.lit("no_case_id").alias("rule")).unionByName(cases.join(cases.groupBy("case_id").count().filter("count > 1"), "case_id").select("file", "line", F.lit("repeated_case_id").alias("rule")))
    return cases, bad.unionByName(repeated)
