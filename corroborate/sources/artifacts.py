"""Records with a pinned shape: short indexes, graded texts, landed responses, snapshots with hashes, runs put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_arabic_mostly, search_text, display_text, url_of_index
from ..operators.validate import rule_rows

DISPLAY_LIMIT, INDEX_LIMIT, LIST_LIMIT = 12_000, 200_000, 200

# The fields of the two kinds of short index rows: always needed, optional, lists, only indexed, and their path.
SHORT_QA = {"needed": ["title", "question_text"], "optional": ["summary"], "lists": ["keywords"], "indexed": ["detailed_answer"], "path": r"^/ar/category/[^/]+/[^/]+/?$"}
SHORT_TERM = {"needed": ["term_ar", "terminological_meaning"], "optional": ["short_explanation", "linguistic_definition", "definition"], "lists": ["translations"], "indexed": [], "path": r"^/dictionary/word/[^/]+/?$"}


def bounded(c: Column, optional: bool = False, limit: int = DISPLAY_LIMIT) -> Column:
    """A text of at most `limit` characters without NUL; not blank unless optional."""
    ok = c.isNotNull() & (F.length(c) <= limit) & ~F.contains(c, F.lit("\0"))
    return F.coalesce(ok if optional else ok & (F.length(F.trim(c)) > 0), F.lit(False))


def short_index_violations(rows: DataFrame, kind: dict, host: str, arabic: bool = True) -> DataFrame:
    """(row_id, rule) of rows(id, url, ...) of a short index, version 2."""
    said = [*kind["needed"], *kind["indexed"]]
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    rules = {
        "url": url_of_index(F.col("url"), host, F.col("id")),
        "path": path.rlike(kind["path"]),
        "id_unique": F.count("*").over(Window.partitionBy("id")) == 1,
        **{f"text:{f}": bounded(F.col(f)) for f in kind["needed"]},
        **{f"text:{f}": bounded(F.col(f), limit=INDEX_LIMIT) for f in kind["indexed"]},
        **{f"text:{f}": bounded(F.col(f), optional=True) for f in kind["optional"]},
        **{f"list:{f}": (F.size(f) <= LIST_LIMIT) & F.forall(f, lambda x: bounded(x)) for f in kind["lists"]},
    }
    if arabic:
        rules |= {f"arabic:{f}": is_arabic_mostly(F.col(f)) for f in said}
    marked = rows.withColumns({f"_{i}": ok for i, ok in enumerate(rules.values())})  # windows first, then rows
    return rule_rows(marked, "id", {name: F.col(f"_{i}") for i, name in enumerate(rules)})


def load_short_index(rows: DataFrame, manifest: DataFrame, source_id: str, kind: dict, host: str, arabic: bool = True) -> DataFrame:
    """rows as corpus rows with search and display text, if their manifest entry is the source's only one and complete, their number
    is its `records`, and no rule is broken; else ValueError.  manifest(source_id, records, complete)."""
    entry = manifest.filter(F.col("source_id") == source_id).limit(2).collect()
    if len(entry) != 1 or not entry[0].complete or entry[0].records != rows.count():
        raise ValueError("the index isn't what its manifest says")
    if short_index_violations(rows, kind, host, arabic).limit(1).count():
        raise ValueError("the index violates its constraints")
    if kind["indexed"]:
        text, shown = search_text(F.col("title"), F.col("question_text"), F.concat_ws("\n", "keywords"), F.col("detailed_answer")), display_text(F.col("summary"), F.col("detailed_answer"))
    else:
        text, shown = search_text(*[F.col(f) for f in kind["needed"] + kind["optional"]]), F.coalesce(F.nullif(F.trim("terminological_meaning"), F.lit("")), "short_explanation")
    return rows.select(F.col("id").alias("corpus_id"), F.lit(source_id).alias("source_id"), text.alias("search_text"), shown.alias("display"), "url")


#: Grades that a graded text must have to be used.
GRADES = ("صحيح", "حسن")


def load_graded(rows: DataFrame, records: int, grades=GRADES) -> DataFrame:
    """rows(id, title, text, grade, attribution, url) as corpus rows with a grading, of the given grades only; ValueError if there
    are other than `records` rows or an id twice."""
    n, ids = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if n != records or ids != n:
        raise ValueError("the artifact isn't what was pinned")
    grading = F.struct(F.col("grade").alias("grade_ar"), F.col("attribution").alias("grader_ar"), F.col("url").alias("grading_source_url"))
    return rows.filter(F.col("grade").isin(*grades)).select(F.concat(F.lit("hadith:"), "id").alias("corpus_id"), F.lit("hadith").alias("domain"), F.col("text").alias("text_ar"), grading.alias("grading"))


def questions_only(cases: DataFrame, id_col: str = "case_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Ids and questions alone, and (id, rule) of what is wrong: an id twice or null, a blank question."""
    rows = cases.select(F.col(id_col), F.col(text_col), F.count("*").over(Window.partitionBy(id_col)).alias("_n"))
    rules = {"id_unique": F.col("_n") == 1, "id_present": F.col(id_col).isNotNull(), "text_present": F.length(F.trim(text_col)) > 0}
    return rows.drop("_n"), rule_rows(rows, id_col, rules)


def snapshot_violations(pages: DataFrame, name: str, content: str, sha: str) -> DataFrame:
    """(row_id, rule): snapshots whose name isn't a hash with .html, whose bytes have another hash, or aren't UTF-8."""
    c = F.col(content)
    rules = {"name": F.col(name).rlike(r"^[0-9a-f]{64}\.html$"), "hash": F.sha2(c, 256) == F.col(sha), "utf8": F.is_valid_utf8(c.cast("string"))}
    return rule_rows(pages, name, rules)


def item_copies(items: DataFrame, id_col: str, fields: list[str], categories: str) -> DataFrame:
    """Items with null or blank fields as '' and categories in numeric order."""
    numbers = F.array_sort(F.transform(F.array_distinct(F.coalesce(categories, F.array().cast("array<string>"))), lambda x: F.struct(x.try_cast("long").alias("n"), x.alias("x"))))
    return items.select(id_col, *[F.coalesce(F.trim(f), F.lit("")).alias(f) for f in fields], F.transform(numbers, lambda s: s["x"]).alias(categories))


def category_members(listing: DataFrame, item: str, category: str) -> DataFrame:
    """(item, categories): the categories that list each item, each once, in order."""
    return listing.groupBy(item).agg(F.array_sort(F.collect_set(category)).alias("categories"))


def pagination(pages: DataFrame, by: str) -> DataFrame:
    """pages(by, page, total, last_page, item) -> per `by`: items, whether every page says the same total and last page, no item is
    repeated, and the items are as many as the total."""
    out = pages.groupBy(by).agg(F.count("item").alias("items"), F.count_distinct("item").alias("distinct_items"), F.min("total").alias("_lo"), F.max("total").alias("total"), F.min("last_page").alias("_pl"), F.max("last_page").alias("_ph"), F.count_distinct("page").alias("_pages"))
    good = (F.col("_lo") == F.col("total")) & (F.col("_pl") == F.col("_ph")) & (F.col("_pages") == F.col("_ph")) & (F.col("items") == F.col("distinct_items")) & (F.col("items") == F.col("total"))
    return out.select(by, "items", "total", good.alias("complete"))


def assembled(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Per source over its runs: files(run_id, source_id, sha256, bytes, records) as found against runs' manifest of the same columns
    and `complete`: runs, records, and status: complete, partial, or mismatch if any run isn't what its manifest says."""
    f = files.select("run_id", "source_id", F.struct("sha256", "bytes", "records").alias("_found"))
    rows = runs.join(f, ["run_id", "source_id"], "left")
    same = F.struct("sha256", "bytes", "records").eqNullSafe(F.col("_found"))
    status = F.when(~F.bool_and(same), "mismatch").when(F.bool_and("complete"), "complete").otherwise("partial")
    return rows.groupBy("source_id").agg(F.count("*").alias("runs"), F.sum("records").alias("records"), status.alias("status"))


def tagged_block(c: Column, tag: str, most: int = DISPLAY_LIMIT) -> Column:
    """The text of the one section <tag>...</tag>; null if there is none, more than one, or a longer one."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    text = F.trim(F.try_element_at(found, F.lit(1)))
    return F.when((F.size(found) == 1) & (F.length(text) <= most), text)


def response_rows(responses: DataFrame, id_pattern: str, base_url: str, most: int = 2) -> DataFrame:
    """responses(request_id, body) with body {"results": [{"id", "url", "text"}]} -> (request_id, id, url, text): the first `most`
    results whose id fits and whose URL is the base with the id, each id once."""
    item = "array<struct<id:string,url:string,text:string>>"
    rows = responses.select("request_id", F.posexplode(F.from_json("body", f"struct<results:{item}>")["results"]).alias("place", "r"))
    fit = F.col("r.id").rlike(id_pattern) & (F.col("r.url") == F.concat(F.lit(base_url), F.col("r.id"))) & (F.length(F.trim("r.text")) > 0)
    first = rows.filter(F.coalesce(fit, F.lit(False))).groupBy("request_id", "r.id").agg(F.min(F.struct("place", "r.url", "r.text")).alias("s"))
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("s.place")))
    return ranked.filter(F.col("_n") <= most).select("request_id", "id", "s.url", "s.text")


def verse_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(key, body): of three lines, the first the key in brackets, the second mostly Arabic: (key, text, translation)."""
    lines = F.split(F.trim("body"), "\n")
    fit = (F.size(lines) == 3) & (F.try_element_at(lines, F.lit(1)) == F.concat(F.lit("["), "key", F.lit("]"))) & is_arabic_mostly(F.try_element_at(lines, F.lit(2)))
    return blocks.filter(F.coalesce(fit, F.lit(False))).select("key", F.element_at(lines, 2).alias("text"), F.element_at(lines, 3).alias("translation"))


def landed_items(landed: DataFrame, limits: dict[str, int]) -> DataFrame:
    """landed(asked_id, body) with body a JSON object: rows whose id is the one asked for and whose fields are within their limits."""
    got = landed.select("asked_id", F.from_json("body", ", ".join(f"{c} string" for c in ("id", *limits))).alias("r"))
    fit = F.col("r.id") == F.col("asked_id")
    for f, n in limits.items():
        fit = fit & F.length(F.trim(F.col(f"r.{f}"))).between(1, n)
    return got.filter(F.coalesce(fit, F.lit(False))).select(F.col("asked_id").alias("id"), *[F.trim(F.col(f"r.{f}")).alias(f) for f in limits])


def budget_bands_ordered(bands: DataFrame) -> DataFrame:
    """bands(upto, edits): those whose budget is smaller than the one before; empty if the table is sound."""
    order = Window.orderBy("upto")  # a policy table of a few rows
    return bands.withColumn("before", F.lag("edits").over(order)).filter(F.col("edits") < F.col("before")).select("upto", "edits")


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Per group: how many numbers, and whether they are 1, 2, ... without gap or repeat."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), ((F.min(number) == 1) & (F.max(number) == F.count("*")) & (F.count_distinct(number) == F.count("*"))).alias("contiguous"))


def health(items: DataFrame, done: Column, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("items"), F.count_if(~F.coalesce(done, F.lit(False))).alias("pending"))
