"""Text keys, words and checks as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letter variants, Arabic digits, and the mark ranges of the retrieval key and of the comparison key.
VARIANTS = ("أإآٱىة", "اااايه")
TATWEEL = "ـ"
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
RETRIEVAL_MARKS = r"\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0898-\u089f\u08d3-\u08ff"
COMPARISON_MARKS = r"\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0898-\u089f\u08ca-\u08ff"
# What a word may carry before it, a conjunction, a preposition, an article or several of them; the longest come first.
PREFIXES = (
    "فبال فكال وبال وكال "
    "بال فال فلل كال وال ولل "
    "ال فب فك فل لل وب وك ول "
    "ب ف ك ل و"
).split()

SPACES = r"(?U)\s+"
#: Texts of these signs alone (Latin, Arabic letters, digits and short vowels, punctuation) compose to themselves, but for the
#: order of the vowel signs of one letter, which both keys drop.
COMPOSED = (
    r"^[\u0000-~¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž"
    r"ء-غـ-ْ،؛؟٠-٬‐‒-‖‘-‟]*$"
)


def composed(c: Column, form: str) -> Column:
    """Unicode composition (NFC or NFKC), which Spark has no function for; only texts that may need it go to Python."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    plain = _ascii(c) | c.rlike(COMPOSED)
    return F.when(plain, c).otherwise(compose(F.when(~plain, c)))


def text_keys(texts: pa.Array, key: Callable[[str], str], rows: int = 64) -> pa.Array:
    """The key of each text, null for a null; Python holds those of `rows` texts at a time."""
    part = lambda some: pa.array([None if t is None else key(t) for t in some.to_pylist()], pa.string())
    return pa.concat_arrays([part(texts.slice(at, rows)) for at in range(0, len(texts), rows)] or [pa.array([], pa.string())])


def nfc(c: Column) -> Column:
    return composed(c, "NFC")


def _tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def _ascii(c: Column) -> Column:
    """Texts of one byte a character hold nothing that the keys drop or fold, and need no pass over their letters."""
    return F.octet_length(c) == F.length(c)


def _folded(c: Column, compose: bool) -> Column:
    """The retrieval key before its white space is collapsed; texts that may need composing go to Python, in one pass."""
    bare = F.regexp_replace(c, f"[{TATWEEL}]|[{RETRIEVAL_MARKS}&&[\\p{{M}}]]", "")
    native = F.when(_ascii(c), c).otherwise(F.translate(bare, *VARIANTS))
    if not compose:
        return native

    @F.arrow_udf("string")
    def key(texts: pa.Array) -> pa.Array:
        return text_keys(texts, retrieval_text)

    plain = _ascii(c) | c.rlike(COMPOSED)
    return F.when(plain, native).otherwise(key(F.when(~plain, c)))


_VARIANTS = str.maketrans(*VARIANTS)
_RETRIEVAL_MARKS = re.compile(f"[{RETRIEVAL_MARKS}]")


def retrieval_text(x: str) -> str:
    """The retrieval key of one text before its white space is collapsed, composition included."""
    bare = _RETRIEVAL_MARKS.sub(lambda m: "" if unicodedata.category(m[0])[0] == "M" else m[0], unicodedata.normalize("NFC", x))
    return unicodedata.normalize("NFC", bare.replace(TATWEEL, "")).translate(_VARIANTS)


def norm_ar(c: Column, compose: bool = True) -> Column:
    """Retrieval key: marks and tatweel dropped, letter variants folded, white space collapsed; null stays null.

    compose=False leaves out Unicode composition (the only part that needs Python) for texts known to be composed.
    """
    return _tidy(_folded(c, compose))


def retrieval_words(c: Column, compose: bool = True) -> Column:
    """Words of the retrieval key; white space between them needs no collapsing."""
    return words(_folded(c, compose))


_BARE = f"[\\p{{Cf}}{TATWEEL}]|[{COMPARISON_MARKS}&&[\\p{{M}}]]"


def comparison_key(c: Column, fold: bool = True, compose: bool = True) -> Column:
    """Key that survives retyping: format characters, marks and tatweel dropped, compatibility forms, digits and (fold) letters folded.

    compose=False leaves out compatibility forms; else texts that may hold some go to Python, in one pass.
    """
    return _tidy(_comparable(c, fold, compose))


def _comparable(c: Column, fold: bool, compose: bool) -> Column:
    """The comparison key before its white space is collapsed."""
    letters = VARIANTS if fold else ("", "")
    folded = F.translate(F.regexp_replace(c, _BARE, ""), DIGITS[0] + letters[0], DIGITS[1] + letters[1])
    native = F.when(_ascii(c), c).otherwise(folded)
    if not compose:
        return native

    @F.arrow_udf("string")
    def key(texts: pa.Array) -> pa.Array:
        return text_keys(texts, lambda x: comparable_text(x, fold))

    plain = _ascii(c) | c.rlike(COMPOSED)
    return F.when(plain, native).otherwise(key(F.when(~plain, c)))


_FOLDED = {fold: str.maketrans(DIGITS[0] + VARIANTS[0] * fold, DIGITS[1] + VARIANTS[1] * fold) for fold in (True, False)}
_MARKS = re.compile(f"[{COMPARISON_MARKS}]")


def comparable_text(x: str, fold: bool = True) -> str:
    """The comparison key of one text, compatibility forms included."""

    def forms(y: str) -> str:
        return unicodedata.normalize("NFKC", "".join(z for z in y if unicodedata.category(z) != "Cf"))

    bare = _MARKS.sub(lambda m: "" if unicodedata.category(m[0])[0] == "M" else m[0], forms(x)).replace(TATWEEL, "")
    return " ".join(forms(bare).translate(_FOLDED[fold]).split())


def comparison_words(c: Column, fold: bool = True, compose: bool = True) -> Column:
    """Words of the comparison key; white space between them needs no collapsing."""
    return words(_comparable(c, fold, compose))


def words(c: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def alias_groups(c: Column, compose: bool = True) -> Column:
    """One array for each word: its aliases."""
    return F.transform(retrieval_words(c, compose), aliases)


def aliases(word: Column) -> Column:
    """A word of the retrieval key, then what remains after each known prefix (Arabic words, at least three letters left)."""
    rest = [F.when(word.startswith(p) & (F.length(word) - len(p) >= 3), F.substring(word, len(p) + 1, 1000)) for p in PREFIXES]
    return F.when(word.rlike("^[ء-غف-ي]+$"), F.array_distinct(F.array_compact(F.array(word, *rest)))).otherwise(F.array(word))


_ARABIC = re.compile("[ء-غف-ي]+")
_FIRST = {p[0] for p in PREFIXES}


def word_aliases(word: str) -> list[str]:
    """`aliases` of one word."""
    if len(word) < 4 or word[0] not in _FIRST or not _ARABIC.fullmatch(word):
        return [word]
    return list(dict.fromkeys([word, *(word[len(p) :] for p in PREFIXES if word.startswith(p) and len(word) - len(p) >= 3)]))


def search_tokens(c: Column, compose: bool = True) -> Column:
    return F.flatten(alias_groups(c, compose))


def is_arabic_mostly(c: Column) -> Column:
    """More Arabic than Latin letters."""
    return F.regexp_count(c, F.lit("[ء-ي]")) > F.regexp_count(c, F.lit("[A-Za-z]"))


# Section labels that may open an answer, and what ends its excerpt.
SECTION_LABELS = ("الجواب التفصيلي", "الخلاصة", "مضمون الشبهة", "نص السؤال", "الجواب")
STOP_MARKERS = r"(?:^|(?<=[\s:：،.؛()\-]))(?:المراجع|الآيات التي ورد\S*)(?=$|[\s:：،.؛()*\-])"


def first_paragraph(c: Column, limit: int = 400) -> Column:
    """The first paragraph without the labels that open it, up to a list of references.

    A longer one is cut at the last sentence end if that lies in the later three quarters of `limit`, else at the last
    white space, else at limit.
    """
    labels = "|".join(SECTION_LABELS)
    opened = F.regexp_replace(F.regexp_replace(c, "\r", ""), rf"(?U)^\s*(?:(?:{labels})\s*[:：]?\s*)*", "")
    lines = F.regexp_replace(opened, r"[^\S\n]*\n[^\S\n]*", "\n")
    paragraph = _strip(F.element_at(F.split(lines, "\n\n", 2), 1))
    stopped = F.regexp_replace(F.element_at(F.split(paragraph, STOP_MARKERS, 2), 1), r"[ \n:،-]+$", "")
    text = F.when(F.length(F.regexp_extract(paragraph, STOP_MARKERS, 0)) > 0, stopped).otherwise(paragraph)
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?؟؛])", 1)
    space = F.regexp_extract(head, r"(?s)^(.+)\s", 1)
    cut = F.when(F.length(sentence) >= limit // 4, sentence).when(space != "", space).otherwise(head)
    return _strip(F.when(F.length(text) <= limit, text).otherwise(cut))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_sentences(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"(?<=[.!?؟])\s+"), 1, n), " ")


def shingles(w: Column, n: int = 3) -> Column:
    """Runs of n words; the whole text if it has fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<string>"))


def word_budget(n: Column) -> Column:
    """Word edits allowed for a length, from the tuning table (4: 1, 10: 2, else 3)."""
    return F.when(n <= 4, 1).when(n <= 10, 2).otherwise(3)


_ALPHABET = 1024


def word_signs(left: Column, a: Column) -> Column:
    """The words of `a` as one character each: the word's place in `left` (38,000 distinct words at most), or one other sign for
    words not there."""
    alphabet = F.split(F.lit("".join(chr(0x4E00 + i) for i in range(_ALPHABET))), "")  # folded to one constant

    def letter(w):
        place = F.array_position(left, w)
        code = F.when(place + 0x6000 >= 0xD800, place + 0x6800).otherwise(place + 0x6000)  # the surrogates' range left out
        beyond = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
        return F.when(place < _ALPHABET, F.element_at(alphabet, (place + 1).cast("int"))).otherwise(beyond)

    return F.array_join(F.transform(a, letter), "")


def word_distance(left: Column, right: Column, cap: int | None = None) -> Column:
    """Edits between two arrays of words of any length; -1 if cap is exceeded."""
    return F.levenshtein(word_signs(left, left), word_signs(left, right), *(() if cap is None else (cap,)))


def url_is_clean(c: Column, hosts: list[str] | None = None) -> Column:
    """A link to follow: https or http with an exact host, no user, fragment, dot segments, escapes or backslashes."""
    host, path = F.try_parse_url(c, F.lit("HOST")), F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    ok = c.rlike(r"^https?://") & host.isNotNull() & F.try_parse_url(c, F.lit("USERINFO")).isNull() & ~c.contains("#") & _plain_path(path)
    return F.coalesce(ok & host.isin(hosts) if hosts else ok, F.lit(False))


def _plain_path(path: Column) -> Column:
    return ~path.rlike(r"[%\\]") & F.forall(F.split(path, "/"), lambda p: ~p.isin(".", ".."))


def is_https(c: Column) -> Column:
    """An https URL with a host, without user or white space."""
    ok = c.rlike(r"^https://") & ~c.rlike(r"(?U)\s") & F.try_parse_url(c, F.lit("HOST")).isNotNull() & F.try_parse_url(c, F.lit("USERINFO")).isNull()
    return F.coalesce(ok, F.lit(False))


def url_of_source(c: Column, entry: Column, section: bool = False) -> Column:
    """An https URL on the host of a source's entry URL, port 443 or none, with a plain path; section: below the entry's path."""
    path = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit(""))
    base = F.regexp_replace(F.coalesce(F.try_parse_url(entry, F.lit("PATH")), F.lit("")), "/+$", "")
    port = F.regexp_extract(F.try_parse_url(c, F.lit("AUTHORITY")), r":(\d+)$", 1)
    ok = is_https(c) & is_https(entry) & (F.try_parse_url(c, F.lit("HOST")) == F.try_parse_url(entry, F.lit("HOST"))) & port.isin("", "443") & _plain_path(path)
    return F.coalesce(ok & ((path == base) | path.startswith(F.concat(base, F.lit("/")))) if section else ok, F.lit(False))


#: Keys that an indexed URL's query may have.
INDEX_QUERY_KEYS = ("page", "lang", "language")


def url_of_index(c: Column, host: str, identity: Column) -> Column:
    """An https URL of an index row: exact host, allowed query keys, no fragment, and path and query equal to its identity."""
    path, query = F.coalesce(F.try_parse_url(c, F.lit("PATH")), F.lit("")), F.try_parse_url(c, F.lit("QUERY"))
    keys = F.forall(F.split(F.coalesce(query, F.lit("")), "&"), lambda q: F.element_at(F.split(q, "="), 1).isin("", *INDEX_QUERY_KEYS))
    same = F.concat(path, F.coalesce(F.concat(F.lit("?"), query), F.lit(""))) == identity
    return F.coalesce(url_of_source(c, F.lit(f"https://{host}/")) & ~c.contains("#") & keys & same, F.lit(False))


def cue_pattern(phrases: list[str]) -> str:
    """A pattern for a row of cues: any of the phrases, whose Arabic words may carry any known prefix and lose their article."""
    carried = "(?:" + "|".join(PREFIXES) + ")?"

    def carry(phrase: str) -> str:
        parts = re.split("([ء-ي]+)", unicodedata.normalize("NFC", phrase).translate(str.maketrans(*VARIANTS)).lower())
        return "".join(carried + p.removeprefix("ال") if i % 2 else p for i, p in enumerate(parts))

    return "|".join(f"(?:{carry(p)})" for p in phrases)


# --- offsets, references, questions -------------------------------------------------------------------------------------


TOKENS = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def token_lists(texts: pa.Array, tokens: Callable[[str], list[tuple[str, int, int]]], rows: int = 64) -> pa.Array:
    """The tokens of each text, null for a null; Python holds those of `rows` texts at a time."""
    part = lambda some: pa.array([None if t is None else [dict(zip(("word", "start", "end"), x)) for x in tokens(t)] for t in some.to_pylist()], TOKENS)
    return pa.concat_arrays([part(texts.slice(at, rows)) for at in range(0, len(texts), rows)] or [pa.array([], TOKENS)])


def tokens_with_places(c: Column) -> Column:
    """Array of (word, start, end) of the text's own words, offsets in code points, from 0, end exclusive."""

    @F.arrow_udf("array<struct<word:string,start:int,end:int>>")
    def places(texts: pa.Array) -> pa.Array:
        return token_lists(texts, lambda t: [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(t)])

    return places(c)


# a word with the marks on its letters
_TOKEN = re.compile(r"(?:[^\W_][\u0300-\u036f\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u08ca-\u08ff]*)+")


def utf8_cap(c: Column, most: int = 8000) -> Column:
    """The first `most` bytes of the text as UTF-8, without a broken last character, stripped."""
    cut = F.substring(F.encode(c, "UTF-8"), 1, most)
    tail = F.hex(F.substring(cut, -4, 4))
    # bytes of a character that the cut broke: a lead byte with too few bytes after it
    broken = F.when(tail.rlike("(C[2-9A-F]|D[0-9A-F]|E[0-9A-F]|F[0-4])$"), 1).when(tail.rlike("(E[0-9A-F]|F[0-4])[89AB][0-9A-F]$"), 2).when(tail.rlike("F[0-4]([89AB][0-9A-F]){2}$"), 3).otherwise(0)
    whole = F.when(F.octet_length(c) <= most, F.encode(c, "UTF-8")).otherwise(F.substring(cut, F.lit(1), (F.length(cut) - broken).cast("int")))
    return _strip(F.decode(whole, "UTF-8"))


def search_text(*parts: Column) -> Column:
    """Title, question, keywords (an array) and answer on lines of their own; nulls are left out."""
    return F.concat_ws("\n", *parts)


def display_text(summary: Column, answer: Column) -> Column:
    """The summary unless it is blank, else the answer's first paragraph."""
    return F.coalesce(F.when(F.length(F.trim(summary)) > 0, summary), first_paragraph(answer))


#: Fixed value: the names of English in a list of translations.
ENGLISH_NAMES = r"(?i)english|الإنجليزية|الانجليزية|إنجليزي|انجليزي"


def english_item(items: Column) -> Column:
    """The first item of a list that names English and has two Latin letters besides the name; null if none has."""
    return F.try_element_at(F.filter(items, lambda x: x.rlike(ENGLISH_NAMES) & (F.regexp_count(F.regexp_replace(x, ENGLISH_NAMES, ""), F.lit("[A-Za-z]")) >= 2)), F.lit(1))


def clean_lines(c: Column) -> Column:
    """Carriage returns dropped, runs of tabs and spaces one space, lines stripped, blank lines at most one."""
    flat = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[^\S\n]+", " ")
    return _strip(F.regexp_replace(F.regexp_replace(flat, r" ?\n ?", "\n"), "\n{3,}", "\n\n"))


def routing_key(c: Column, compose: bool = True) -> Column:
    """Retrieval key without format characters, lower-cased."""
    return F.lower(norm_ar(F.regexp_replace(c, r"\p{Cf}", ""), compose))


def language_flag(c: Column) -> Column:
    return F.when(c.rlike(r"[؀-ۿ]"), "ar").otherwise("en")


def verse_reference(c: Column) -> Column:
    """Struct(surah, ayah) of "33:40" (or with ： or /), null if out of bounds."""
    pattern = r"^\s*(\d{1,3})\s*[:：/]\s*(\d{1,3})\s*$"
    surah, ayah = (F.regexp_extract(c, pattern, i).try_cast("int") for i in (1, 2))
    return F.when(surah.between(1, 114) & (ayah >= 1), F.struct(surah.alias("surah"), ayah.alias("ayah")))


def is_question(c: Column) -> Column:
    return c.rlike("[?؟]")


#: Words that open a remark, and words that leave a subject unresolved.
FRAGMENT_OPENERS, UNRESOLVED = r"^(?:هذا|هذه|ذلك|تلك|يا)(?![\p{L}\p{N}_])", r"(?:^|\s)(?:هذه|هذا|تلك|ذلك|كذا|هكذا)(?:\s|$|[؟?!.،])"


def is_fragment(c: Column, most: int = 5) -> Column:
    """A short remark without a question mark: it ends in ! or opens with a demonstrative."""
    text = _strip(c)
    return (F.length(text) > 0) & ~is_question(text) & (F.size(F.split(text, SPACES)) <= most) & (text.endswith("!") | text.rlike(FRAGMENT_OPENERS))


def has_unresolved_subject(c: Column) -> Column:
    return c.rlike(UNRESOLVED)


# Words of a question that name no subject, and words that never count as overlap.
QUESTION_WORDS = "لماذا ماذا ما هل كيف من متى أين اين لم لما لمَ هو هي في عن على الى إلى و أو ثم أن إن ان كان يا هناك هنا الذي التي ليس لا نعم بل قد كل".split()
STOP_WORDS = "من ما هل هو هي في على عن إلى الى لا أن ان إن كان الم ألم أليس اليس لماذا كيف".split()


def content_groups(groups: Column, drop: list[str] = QUESTION_WORDS, longer_than: int = 0) -> Column:
    """The alias groups whose word is no function word and longer than so many letters."""
    return F.filter(groups, lambda g: ~F.element_at(g, 1).isin(drop) & (F.length(F.element_at(g, 1)) > longer_than))


def alias_shared(group: Column, aliases: Column, stem: int = 4) -> Column:
    """A common alias, or two of over `stem` letters that begin with the same `stem`."""
    stems = F.transform(F.filter(group, lambda a: F.length(a) > stem), lambda a: F.left(a, F.lit(stem)))
    others = F.transform(F.filter(aliases, lambda a: F.length(a) > stem), lambda a: F.left(a, F.lit(stem)))
    return F.arrays_overlap(group, aliases) | F.arrays_overlap(stems, others)


def title_share(question_groups: Column, title_groups: Column) -> Column:
    """Share of the question's content words that the title carries; null with fewer than two content words."""
    content, aliases = content_groups(question_groups), F.flatten(title_groups)
    found = F.size(F.filter(content, lambda g: alias_shared(g, aliases)))
    return F.when(F.size(content) >= 2, found / F.size(content))


def content_overlap(question_groups: Column, record_groups: Column) -> Column:
    """Whether an alias of a content word of over two letters occurs in the record, stop words apart."""
    asked = F.array_except(F.flatten(content_groups(question_groups, STOP_WORDS, 2)), F.array(*map(F.lit, STOP_WORDS)))
    return F.coalesce(F.arrays_overlap(asked, F.flatten(record_groups)), F.lit(False))


def mentions_term(term: Column, text_aliases: Column, compose: bool = True) -> Column:
    """Whether the term, with or without its article, is one of the text's aliases."""
    key = F.lower(norm_ar(term, compose))
    bare = F.when(key.startswith("ال") & (F.length(key) > 4), F.substring(key, F.lit(3), F.length(key)))
    return F.coalesce(F.array_contains(text_aliases, key) | F.coalesce(F.array_contains(text_aliases, bare), F.lit(False)), F.lit(False))


def mentions_english(equivalent: Column, items: Column, text: Column) -> Column:
    """Whether a word of four letters or more of a term's English equivalent stands in the text: of `equivalent`, or if that is blank
    of the item that names English, without the language's name."""
    said = F.coalesce(F.when(F.length(F.trim(equivalent)) > 0, equivalent), english_item(items))
    wanted = F.regexp_extract_all(F.lower(F.regexp_replace(said, ENGLISH_NAMES, "")), F.lit("[a-z]{4,}"), F.lit(0))
    return F.coalesce(F.arrays_overlap(wanted, F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), F.lit(False))


def relocated(text: Column, source: Column, start: Column, end: Column) -> Column:
    """Struct(start, end) of the source text: the given offsets if right, else its first place; null if absent."""
    right = (start >= 0) & (start < end) & (end <= F.length(text)) & (F.substring(text, start + 1, end - start) == source)
    at = F.position(source, text)
    return F.when(right, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(source)).alias("end")))


def repaired(value: Column, valid: Column, default: Column) -> Column:
    """The value if valid, else the default."""
    return F.coalesce(F.when(valid, value), default)


def repaired_list(items: Column, valid, most: int) -> Column:
    """The first `most` items for which valid(item) holds."""
    return F.slice(F.filter(F.coalesce(items, F.array().cast("array<string>")), valid), 1, most)
