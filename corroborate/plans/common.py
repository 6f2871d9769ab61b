from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import kept
from ..functions.text import PREFIXES
from ..operators import spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of documents and records, worked out once and kept; documents are dealt out first, however few blocks their file has."""
    docs, records = table(spark, sf_dir, "documents").repartition("doc_id"), table(spark, sf_dir, "benchmark")
    return kept(spans.document_words(docs), "document-words"), kept(spans.record_words(records), "record-words")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 to the nearest whole one, halves to the even one."""
    return F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")


#: Letters that the Arabic spelling of a text takes for a to z, hamza forms and both kinds of final ya and ta among them.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "اأإآبةتثجحخدذرزسشصطعغفىقلم"
DIGITS, ARABIC_DIGITS = "0123456789", "٠١٢٣٤٥٦٧٨٩"


def arabic(text: Column) -> Column:
    """A Latin text as Arabic letters with a vowel sign after some, the ligature of lam and alef for z, and Arabic digits."""
    return F.replace(F.replace(F.translate(F.lower(text), LATIN + DIGITS, ARABIC + ARABIC_DIGITS), F.lit("ز"), F.lit("زَ")), F.lit("م"), F.lit("ﻻ"))


def decomposed(text: Column) -> Column:
    """The Arabic spelling with each letter é as two signs."""
    return F.replace(arabic(text), F.lit("é"), F.lit("e\u0301"))


def arabic_key_sql(text: str) -> str:
    """The retrieval key of decomposed(text), but for white space."""
    spelt = f"replace(replace(replace(translate(lower(coalesce({text}, '')), '{LATIN}{DIGITS}', '{ARABIC}{ARABIC_DIGITS}'), 'ز', 'زَ'), 'م', 'ﻻ'), 'é', 'e' || chr(769))"
    return f"translate(nfc_normalize(replace(nfc_normalize({spelt}), 'َ', '')), 'أإآٱىة', 'اااايه')"


def aliases_sql(word: str) -> str:
    """A word with what remains after each prefix that it may carry, where three letters do."""
    rest = f"list_filter(list_transform({PREFIXES}, lambda p: CASE WHEN starts_with({word}, p) AND length({word}) - length(p) >= 3 THEN substr({word}, length(p) + 1) END), lambda x: x IS NOT NULL)"
    return f"CASE WHEN regexp_full_match({word}, '[ء-غف-ي]+') THEN list_distinct(list_concat([{word}], {rest})) ELSE [{word}] END"
