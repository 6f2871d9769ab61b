"""Quality classifier by co-training.

Two views of a document, the words of its text and its metadata (source, language, size, shape of the characters), each
train a logistic regression on the labelled documents.  The text view has the words of the labelled documents that tell the
two classes apart best, so that a model, and what tasks send to the driver, stays small.  Over some rounds each view labels the unlabelled documents that it
is sure of for the other.  A last logistic regression on the two views' logits, fitted on labelled documents that neither
view has seen, calibrates and combines them; it scores every document.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SHAPE = ["n_log", "lines_log", "capitals", "digits", "signs", "word_length"]


def _tokens(text):
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _vocabulary(known: DataFrame, most: int, least: int = 3) -> list[str]:
    """Of the words in at least `least` of the rows of known(text, y), the `most` with the largest chi-square; ties by word."""
    rows = known.select("y", F.explode(F.array_distinct(_tokens(F.coalesce("text", F.lit(""))))).alias("word"))
    totals = known.agg(F.count("*").alias("n"), F.sum("y").alias("n_good"))
    words = rows.groupBy("word").agg(F.count("*").alias("df"), F.sum("y").alias("good")).filter((F.col("df") >= least) & (F.col("word") != ""))
    words = words.crossJoin(F.broadcast(totals))  # one row
    n, g, df, good = (F.col(c).cast("double") for c in ("n", "n_good", "df", "good"))
    bad, rest_good, rest_bad = df - good, g - good, n - g - (df - good)
    chi = n * (good * rest_bad - bad * rest_good) ** 2 / F.greatest(df * (n - df) * g * (n - g), F.lit(1.0))
    return [r.word for r in words.withColumn("chi", chi).orderBy(F.desc("chi"), "word").limit(most).select("word").collect()]


def _views(rows: DataFrame, words: list[str]) -> DataFrame:
    """(id, text_view, meta_view) of every row of rows(id, text, source, lang)."""
    rows = rows.select("id", F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in ("source", "lang")])
    n = F.greatest(F.length("text"), F.lit(1))

    def count(pattern):
        return F.regexp_count("text", F.lit(pattern))

    rows = rows.withColumn("words", _tokens("text"))
    shape = {
        "n_log": F.log1p(F.length("text")),
        "lines_log": F.log1p(count("\n")),
        "capitals": count("[A-Z]") / n,
        "digits": count("[0-9]") / n,
        "signs": count(r"[^\p{L}\p{N}\s]") / n,
        "word_length": n / F.size("words"),
    }
    rows = rows.select("id", "source", "lang", "words", *[c.alias(name) for name, c in shape.items()])
    counted = CountVectorizerModel.from_vocabulary(words or ["?"], inputCol="words", outputCol="text_view").setBinary(True)
    hashed = FeatureHasher(numFeatures=512, inputCols=["source", "lang", *SHAPE], outputCol="meta_view")
    return hashed.transform(counted.transform(rows)).select("id", "text_view", "meta_view")


def _fit(rows: DataFrame, view: str, strength: float, sparse: float = 0.0):
    names = {"probabilityCol": f"{view}_p", "rawPredictionCol": f"{view}_raw", "predictionCol": f"{view}_y"}
    return LogisticRegression(featuresCol=view, labelCol="y", weightCol="weight", regParam=strength, elasticNetParam=sparse, maxIter=30, **names).fit(rows)


def _logit(view: str):
    return F.element_at(vector_to_array(f"{view}_raw"), 2)


def _share(n: int, of: int):
    return F.pmod(F.xxhash64(F.col("id"), F.lit("draw")), F.lit(1 << 30)) < F.lit(int(min(1.0, n / max(of, 1)) * (1 << 30)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", good=None, rounds: int = 3, labelled_rows: int = 8000, sure: float = 0.97, pseudo_weight: float = 0.3, words: int = 4096) -> DataFrame:
    """(id, p_text, p_meta, score, keep) for every row: each view's own probability, the combined one, and score >= 0.5.

    `good` says of a row of labels whether the document is good (quality 1 and not toxic, unless given); labels with a null
    there or a null id are ignored, of several labels of an id one that says no wins.  The fit's documented bound: about
    `labelled_rows` labelled documents, drawn by a hash of the id, which also give the text view's `words` words.  All
    documents without a label are the pool of every round, and all documents are scored.  What a view is taught weighs
    `pseudo_weight` a row, and together at most `pseudo_weight` of the labelled rows, so that labels count alike at every
    size.  A null text counts as empty, null metadata as a value of its own.  Rows that repeat an id are scored each by its
    own text.  A fold of the drawn labels, three in ten by a hash of the id, is kept for the judge; unless it and the rest both
    have labels of both kinds, all scores are null and keep is true.  A score of exactly 0.5 keeps.
    """
    good = F.expr("quality = 1 AND toxic = 0") if good is None else good
    said = labels.select(labels[id_col].cast("long").alias("id"), good.cast("double").alias("y")).filter("id is not null and y is not null").groupBy("id").agg(F.min("y").alias("y"))
    said = written(said, "labels")
    n_labels, kinds = said.agg(F.count("*"), F.count_distinct("y")).first()
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), docs[source_col].alias("source"), docs[lang_col].alias("lang"))
    unknown = rows.select(F.col("id").alias(id_col), *[F.lit(None).cast("double").alias(c) for c in ("p_text", "p_meta", "score")], F.lit(True).alias("keep"))
    if kinds < 2:
        return unknown
    fold = F.pmod(F.xxhash64(F.col("id"), F.lit("fold")), F.lit(10))
    drawn = said.filter(_share(labelled_rows, n_labels)).withColumn("fold", fold)
    vocabulary = _vocabulary(written(rows.select("id", "text").join(drawn.filter("fold < 7"), "id").select("text", "y"), "sample"), words)
    views = written(_views(rows, vocabulary).join(said, "id", "left"), "views")
    known = written(views.filter("y is not null").filter(_share(labelled_rows, n_labels)).withColumns({"weight": F.lit(1.0), "fold": fold}).coalesce(2), "labelled")
    train, rest = known.filter("fold < 7").drop("fold"), known.filter("fold >= 7").drop("fold")
    parts = {(r.fitted, r.y): r["count"] for r in known.groupBy((F.col("fold") < 7).alias("fitted"), "y").count().collect()}
    if len(parts) < 4:  # one of the two parts lacks a kind
        return unknown
    n_train, pool = parts[True, 0.0] + parts[True, 1.0], views.filter("y is null").drop("y")
    seen = {"text_view": train, "meta_view": train}
    strength = {"text_view": (0.001, 1.0), "meta_view": (0.001, 0.0)}  # few words matter, so the text's weights are sparse
    for turn in range(rounds + 1):
        models = {view: _fit(seen[view], view, *strength[view]) for view in seen}
        if turn == rounds:
            break
        for view, other in (("text_view", "meta_view"), ("meta_view", "text_view")):
            p = F.element_at(vector_to_array(f"{view}_p"), 2)
            own = models[view].transform(pool).withColumn("p", p).filter((p >= sure) | (p <= 1 - sure))
            weight = pseudo_weight * min(1.0, n_train / max(own.count(), 1))
            # not written: a copy of both views for every turn would be larger than the documents
            taught = own.select("id", "text_view", "meta_view", F.when(F.col("p") > 0.5, 1.0).otherwise(0.0).alias("y"), F.lit(weight).alias("weight"))
            seen[other] = train.unionByName(taught)

    def both(rows: DataFrame) -> DataFrame:
        rows = models["meta_view"].transform(models["text_view"].transform(rows))
        return pair.transform(rows.withColumns({"text_logit": _logit("text_view"), "meta_logit": _logit("meta_view")}))

    pair = VectorAssembler(inputCols=["text_logit", "meta_logit"], outputCol="pair")
    judge = _fit(both(rest).select("pair", "y", "weight"), "pair", 0.001)
    scored = judge.transform(both(views.drop("y")))
    p = {name: F.element_at(vector_to_array(f"{view}_p"), 2) for name, view in (("p_text", "text_view"), ("p_meta", "meta_view"), ("score", "pair"))}
    return scored.select(F.col("id").alias(id_col), *[c.alias(name) for name, c in p.items()], (p["score"] >= 0.5).alias("keep"))
