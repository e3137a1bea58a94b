"""Column expressions on text: tags, hashes, words, scripts.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as the unit hashes take it, and the inline formatting tags.
SPACE = r"[\s\x1c-\x1f]+"
TAG = r"</?g(\d+)>"
# Letters of each script as the validator counts them.
SCRIPTS = {
    "arabic": r"[؀-ۿ]",
    "latin": r"[A-Za-zÀ-ɏ]",
    "cyrillic": r"[Ѐ-ӿ]",
    "han": r"[一-鿿]",
    "thai": r"[฀-๿]",
}
# Script of each language, by the part of its code before the hyphen.
SCRIPT_OF = {"ar": "arabic", "fa": "arabic", "ur": "arabic", "en": "latin", "fr": "latin", "de": "latin", "es": "latin", "tr": "latin", "ru": "cyrillic", "zh": "han", "th": "thai"}
RIGHT_TO_LEFT = ("ar", "fa", "ur", "he")
DIACRITICS = r"[ً-ْٰـ]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"(?U){TAG}", "")


def tag_ids(c: Column | str) -> Column:
    """Sorted distinct ids of the inline tags of a text; null gives an empty array."""
    return F.coalesce(F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(f"(?U){TAG}"), F.lit(1)))), F.array().cast("array<string>"))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(_col(c), f"(?U){SPACE}", " "))


def text_hash(c: Column | str) -> Column:
    """SHA-256 of the collapsed text; tags, case and marks count."""
    return F.sha2(collapse(c), 256)


def visible(c: Column | str) -> Column:
    return collapse(strip_tags(c))


def words(c: Column | str) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def count_words(c: Column | str) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.size(words(c)), F.lit(0))


def is_translatable(c: Column | str) -> Column:
    """A text of two characters or more that holds a letter once tags are put aside."""
    v = visible(c)
    return F.coalesce((F.length(v) >= 2) & v.rlike(r"[\p{L}\p{Nl}\p{No}]"), F.lit(False))


def base_language(c: Column | str) -> Column:
    return F.lower(F.element_at(F.split(_col(c), "-"), 1))


def lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def script_share(c: Column | str, script: str) -> Column:
    """Share of a text's letters that belong to a script; no letters or null give 0."""
    letters = F.length(F.regexp_replace(_col(c), r"[^\p{L}]", ""))
    own = F.length(F.regexp_replace(F.regexp_replace(_col(c), r"[^\p{L}]", ""), SCRIPTS[script].replace("[", "[^"), ""))
    return F.when(letters > 0, own / letters).otherwise(F.lit(0.0))


#: A grouped number has up to three digits, then groups of three, each after one of these.
GROUP_MARKS = ".,\u00a0\u202f "
DIGIT = r"\p{Nd}"


def _grouped() -> str:
    """A number in groups of three, with its decimals; the marks are written by their code points."""
    marks = "".join(f"\\x{{{ord(c):04X}}}" for c in GROUP_MARKS)
    return f"{DIGIT}{{1,3}}(?:[{marks}]{DIGIT}{{3}})+(?:[.,]{DIGIT}+)?"


#: The forms of a number in the order they are looked for: grouped, with decimals, plain; digits of every script.
NUMBER = "|".join((_grouped(), f"{DIGIT}+[.,]{DIGIT}+", f"{DIGIT}+"))


def numbers(c: Column | str) -> Column:
    """Numbers as written: grouped ones with their separators, decimals, plain ones."""
    return F.regexp_extract_all(_col(c), F.lit(NUMBER), F.lit(0))


def number_digits(c: Column | str) -> Column:
    """Sorted digits of the numbers, separators left out."""
    return F.array_sort(F.transform(numbers(c), lambda n: F.regexp_replace(n, f"[^{DIGIT}]", "")))


def ambiguous_numbers(c: Column | str, most: int = 3) -> Column:
    """The first numbers with three digits after a period, which are thousands in one language and decimals in another."""
    three = F.regexp_extract_all(_col(c), F.lit(f"({DIGIT}+\\.{DIGIT}{{3}})(?:[^{DIGIT}]|$)"), F.lit(1))
    return F.slice(three, 1, most)


def letter_runs(c: Column | str) -> Column:
    """Runs of letters and letter numbers, in lower case; digits, marks and underscores part them."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))


def repeats_word(c: Column | str) -> Column:
    """Two equal neighbouring words of at most four characters, whatever their case and what stands between them."""
    w = letter_runs(c)
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b) & (F.length(a) <= 4))
    return F.coalesce(F.when(n > 1, F.exists(pairs, lambda x: x)), F.lit(False))


def bare_arabic(c: Column | str) -> Column:
    """Arabic text without vowel marks and stretching."""
    return collapse(F.regexp_replace(_col(c), DIACRITICS, ""))


def verse_key(c: Column | str) -> Column:
    """Letters a verse is found by: no vowel marks, no weak letters, only U+0628 to U+064A, no spaces."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(c), DIACRITICS, ""), r"[ء-اىوية]", ""), r"[^ب-ي]", "")


def marked_share(c: Column | str) -> Column:
    """Vowel marks per Arabic letter; under eight letters 0."""
    letters = F.regexp_count(_col(c), F.lit(r"[ء-غف-ي]"))
    marks = F.regexp_count(_col(c), F.lit(r"[ً-ْٰ]"))
    return F.when(letters >= 8, marks / letters).otherwise(F.lit(0.0))


def strip_html(c: Column | str) -> Column:
    """Text of an HTML fragment: footnote marks and tags left out, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(_col(c), r"(?is)<sup[^>]*>.*?</sup>", ""), r"(?s)<[^>]+>", " "))


def echo(c: Column | str) -> Column:
    """The offline engine's answer: the text behind a fixed prefix, blank texts unchanged."""
    return F.when(collapse(c) == "", _col(c)).otherwise(F.concat(F.lit("[EN] "), collapse(c)))
