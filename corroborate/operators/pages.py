"""HTML snapshots: sections, fields, links, crawl accounting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import shared_folder
from ..functions.text import url_is_clean

def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, target): distinct link targets, those from the root made absolute."""
    host = F.regexp_extract(pages[url_col], r"^(https?://[^/]+)", 1)
    found = pages.select(pages[id_col].alias("page_id"), host.alias("host"), F.explode(F.array_distinct(F.regexp_extract_all(pages[html_col], F.lit(r'<a href="([^"]*)"'), F.lit(1)))).alias("href"))
    return found.select("page_id", F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href")).alias("target")).distinct()


def fields(pages: DataFrame) -> DataFrame:
    """(page_id, host, lang, title, h1, canonical): single values of a page, '' if missing."""
    one = lambda pattern: F.regexp_extract("html", pattern, 1)
    return pages.select("page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"), one('<html lang="([^"]*)"').alias("lang"), one("<title>([^<]*)</title>").alias("title"), one("<h1>([^<]*)</h1>").alias("h1"))


def reasons(rows: DataFrame, langs: list[str], least: int) -> Column:
    """Why a page is no record, the first that holds; null for records."""
    return F.when(~F.col("lang").isin(langs), "language").when(F.col("h1") == "", "no_heading").when(F.length("title") < least, "short_title")


def host_completeness(pages: DataFrame, host: Column, collected: Column, listing: Column) -> DataFrame:
    """Per host: pages, records, and whether every page is a record or a listing and there is a record."""
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_if(collected).alias("records"), (F.bool_and(collected | listing) & (F.count_if(collected) > 0)).alias("complete"))


def manifest(records: DataFrame, by: Column, text: Column, order: str, span: int = 1000) -> DataFrame:
    """Per file: records, bytes, blank ones and a hash.

    The hash is made in two steps, so that no task holds more than a range's hashes or a file's ranges: the records' hashes
    of each range of `span` numbers of the order column, in order, one a line, are hashed; so are the ranges' hashes of each
    bundle of `span` ranges, and then the bundles' hashes.
    """
    rows = records.select(by.alias("file"), F.col(order).alias("o"), F.octet_length(text).alias("n"), F.sha2(text, 256).alias("sha"), (F.trim(text) == "").alias("blank"))

    def bundled(df: DataFrame, *keys: Column) -> DataFrame:
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "sha"))), lambda x: x["sha"]), "\n")
        return df.groupBy(*keys).agg(F.sum("records").alias("records"), F.sum("n").cast("long").alias("bytes"), F.sum("empty").alias("empty"), F.sha2(lines, 256).alias("sha"))

    rows = rows.withColumns({"records": F.lit(1).cast("long"), "empty": F.coalesce("blank", F.lit(False)).cast("long")})
    ranges = bundled(rows, F.col("file"), F.floor(F.col("o") / span).alias("range")).withColumnRenamed("bytes", "n").withColumnRenamed("range", "o")
    bundles = bundled(ranges, F.col("file"), F.floor(F.col("o") / span).alias("range")).withColumnRenamed("bytes", "n").withColumnRenamed("range", "o")
    return bundled(bundles, F.col("file")).withColumnRenamed("sha", "sha256")


def first_per_id(rows: DataFrame, id_col: str, order: str) -> DataFrame:
    """The first row of each id, by order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).filter("_n = 1").drop("_n")


def reachable(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, depth): nodes reached from seeds(node) over edges(src, dst), with the fewest steps.

    Each round joins only the newest nodes and appends what it finds to a table in the shared folder, until none is new.
    """
    spark = seeds.sparkSession
    path = f"{shared_folder(spark)}/reached-{uuid.uuid4().hex}"
    new = seeds.select("node").distinct()
    for depth in range(rounds + 1):
        new.write.parquet(f"{path}/depth={depth}")
        newest = spark.read.schema(new.schema).parquet(f"{path}/depth={depth}")
        visited = spark.read.option("basePath", path).schema(f"{new.schema.simpleString()[7:-1].replace(':', ' ')}, depth int").parquet(*[f"{path}/depth={d}" for d in range(depth + 1)])
        if not newest.limit(1).count():
            return visited
        step = newest.join(edges, newest["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = step.join(visited.select("node"), "node", "left_anti")
    raise RuntimeError("not every node was reached in time")
