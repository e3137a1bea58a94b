"""Problem 6: texts that look the same but are stored as different characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prototypes of look-alike letters.  Left the letter, right the Latin letter that
# prints the same; capitals and small letters apart, since case makes texts different.
LOOKALIKES = {
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ρ": "p", "α": "a", "ι": "ı",
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Latin letters of other blocks
    "ɑ": "a", "ɡ": "g",
    # Arabic letters and digits drawn alike in every position
    "ہ": "ه", "ھ": "ه", "ە": "ه",
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
    # punctuation and spaces
    "‐": "-", "‑": "-", "−": "-", "˗": "-", "’": "'", "ʼ": "'", "′": "'", "`": "'", "…": "...",
    "٬": "،",
}
# Letters whose shape depends on whether a letter follows: (letter, before a letter, at the end of a word).
POSITIONAL = (("ی", "ي", "ى"), ("ک", "ك", "ک"), ("ى", "ي", "ى"))
#: Compatibility decompositions that change only the width or the form, not the look.
SAME_LOOK = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")


class _Prototypes(dict):
    """str.translate table filled on demand: one lookup per distinct character of the data."""

    def __missing__(self, code: int):
        ch = chr(code)
        cat = unicodedata.category(ch)
        out = ch
        if cat in ("Cf", "Cc") and ch not in "\n\t\r" or code == 0x034F or 0xFE00 <= code <= 0xFE0F:
            out = ""
        elif cat in ("Zs", "Zl", "Zp") or ch in "\n\t\r":
            out = " "
        else:
            form = unicodedata.decomposition(ch)
            if form.startswith(SAME_LOOK) or form.startswith("<compat>") and 0xFB00 <= code <= 0xFDFF:
                out = unicodedata.normalize("NFKD", ch)
            out = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", out))
        self[code] = out
        return out


_TABLE = _Prototypes()


def _joins(ch: str) -> bool:
    return "ؠ" <= ch <= "ي" or "ٮ" <= ch <= "ۓ"


def skeleton(text: str | None) -> str | None:
    """The text with every character replaced by its prototype.

    Decompose, replace each character by its prototype (nothing for characters that print
    nothing, one plain space for any space), decompose again.  Vowel marks, case, punctuation,
    digits of another look and tags stay.  Null gives null, an empty text gives an empty text.
    """
    if text is None:
        return None
    out = unicodedata.normalize("NFD", text).translate(_TABLE)
    out = unicodedata.normalize("NFD", out)
    if not out.isascii():
        for letter, inner, last in POSITIONAL:
            if letter in out:
                chars = list(out)
                for i, ch in enumerate(chars):
                    if ch == letter:
                        j = i + 1
                        while j < len(chars) and unicodedata.combining(chars[j]):
                            j += 1
                        chars[i] = inner if j < len(chars) and _joins(chars[j]) else last
                out = "".join(chars)
    return out.strip(" ")


@F.pandas_udf(T.StringType())
def skeleton_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(skeleton, na_action="ignore")


def canonical(df: DataFrame, text: str, out: str = "skeleton") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out``; nulls stay null."""
    return df.withColumn(out, skeleton_udf(F.col(text)))


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of ``left(left_id, text)`` and ``right(right_id, text)`` that look the same but differ in code points.

    Both sides shrink to (id, 128-bit key of the skeleton, hash of the stored text) before the
    shuffle, so texts never travel.  Rows delivered again collapse by distinct.  Null ids and null
    texts match nothing; an empty text matches only texts that print nothing.  The join is a plain
    equi-join on the key: a hot key is split by adaptive skew handling, no cap is set.
    """

    def side(df: DataFrame, key: str) -> DataFrame:
        s = F.col("skeleton")
        return (
            canonical(df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text"), "text")
            .select(key, F.struct(F.xxhash64(s).alias("a"), F.hash(F.reverse(s)).alias("b"), F.length(s).alias("n")).alias("k"), F.xxhash64("text").alias("stored"))
            .distinct()
        )

    a, b = side(left, "left_id"), side(right, "right_id").withColumnRenamed("stored", "other")
    return a.join(b, "k").where(F.col("stored") != F.col("other")).select("left_id", "right_id").distinct()


def found(segments: DataFrame, memory: DataFrame, verses: DataFrame) -> DataFrame:
    """Each segment with each memory entry or verse whose whole text looks the same (p6_found)."""
    left = segments.select(F.col("id").alias("left_id"), F.col("source_text").alias("text"))
    right = memory.select(F.col("id").alias("right_id"), F.col("source_text").alias("text")).unionByName(
        verses.select(F.col("verse_key").alias("right_id"), F.col("arabic").alias("text"))
    )
    return matches(left, right).select(F.col("left_id").alias("segment_id"), F.col("right_id").alias("match_key"))


def groups(memory: DataFrame) -> DataFrame:
    """Stored forms per consistent form: skeleton key, number of entries and of distinct stored texts.

    One row per skeleton that is stored in more than one form; partial aggregation first, so a hot
    skeleton costs one row per task.
    """
    base = canonical(memory.select("id", F.col("source_text").alias("text")).where(F.col("text").isNotNull()).distinct(), "text")
    forms = base.groupBy("skeleton", "text").agg(F.count_distinct("id").alias("n"))
    return forms.groupBy("skeleton").agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("forms"), F.min("text").alias("first_form")).where("forms > 1")
