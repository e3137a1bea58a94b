"""Shared text helpers of the subpackage: words, scripts, languages of a text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*")
PLAIN_WORD = re.compile(r"[^\W\d_]+")
TAG = re.compile(r"</?g\d+>")

# Letters that Urdu writes and Arabic does not.
URDU_ONLY = frozenset("ٹڈڑںےہھپچگژۓۂ۔کی")
# Frequent short words that tell apart languages in one script.
FUNCTION_WORDS = {
    "en": "the of and in on to for is at by with from this that are as an a its was it".split(),
    "fr": "le la les de des du un une et à en pour dans sur est par ce cette au aux son l d se ne pas".split(),
    "tr": "ve bir bu ile için tarihinde kentinde olarak olan göre sonra önce üzerinden karşılığında da de kadar".split(),
}
TURKISH_ONLY = frozenset("ğışİ")
FRENCH_ONLY = frozenset("éèêàùûôîœë")


def strip_tags(text: str) -> str:
    return TAG.sub("", text)


def fold(text: str) -> str:
    """Case folding that also makes the Turkish dotted and dotless pairs equal."""
    return text.replace("İ", "i").replace("I", "i").replace("ı", "i").lower()


_SCRIPT: dict[str, str] = {}


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x4E00 <= o <= 0x9FFF:
        return "zh"
    if 0x0E00 <= o < 0x0E80:
        return "th"
    if not ch.isalpha():
        return ""
    if o < 0x250:
        return "la"
    if 0x400 <= o < 0x530:
        return "ru"
    return "ar" if 0x600 <= o < 0x700 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00 else ""


class _Scripts(dict):
    def __missing__(self, ch: str) -> str:
        got = self[ch] = _script(ch)
        return got


#: Script of a character: ar, la, ru, th, zh, or '' for what is no letter.
script_of = _Scripts().__getitem__


def language_of(text: str | None, chars: Counter | None = None, words: Counter | None = None) -> str:
    """Language of a text by script and function words; 'und' without letters.

    Covers ar, ur, ru, zh, th, en, fr, tr.  The script with most letters wins, so a foreign name
    or code does not change the result.  ``chars`` and ``words`` are counts the caller already has.
    """
    if not text:
        return "und"
    counts = {"ar": 0, "ru": 0, "zh": 0, "th": 0, "la": 0}
    urdu = 0
    for ch, n in (Counter(text) if chars is None else chars).items():
        script = _SCRIPT.get(ch)
        if script is None:
            script = _SCRIPT[ch] = _script(ch)
        if script:
            counts[script] += 2 * n if script == "zh" else n
            if script == "ar" and ch in URDU_ONLY:
                urdu += n
    best = max(counts, key=lambda k: counts[k])
    if counts[best] == 0:
        return "und"
    if best == "ar":
        return "ur" if urdu > 0.04 * counts["ar"] else "ar"
    if best != "la":
        return best
    if words is None:
        words = Counter(PLAIN_WORD.findall(text.lower()))
    score = {k: float(sum(words[w] for w in listed)) for k, listed in _FUNCTION.items()}
    if not text.isascii():
        for w, n in words.items():
            if not w.isascii():
                score["tr"] += 1.5 * n * (not TURKISH_ONLY.isdisjoint(w))
                score["fr"] += 0.8 * n * (not FRENCH_ONLY.isdisjoint(w))
    top = max(score, key=lambda k: score[k])
    if score[top] > 0:
        return top
    return "tr" if any(c in "üöç" for c in text) else "en"


_FUNCTION = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


def category(ch: str) -> str:
    return unicodedata.category(ch)


class Counts:
    """Counts of words, held as two sorted arrays of 64-bit hashes and numbers: twelve bytes a word.

    Two words share a hash with a chance of words / 2^64.  Words asked for are remembered, in bounds.
    """

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.numbers = np.ascontiguousarray(hashes[order], dtype=np.int64), np.ascontiguousarray(numbers[order], dtype=np.int32)
        self._seen: dict[str, int] = {}

    def __reduce__(self):
        return Counts, (self.hashes, self.numbers)

    def __len__(self) -> int:
        return len(self.hashes)

    def __contains__(self, word: str) -> bool:
        return self.get(word) > 0

    def __getitem__(self, word: str) -> int:
        return self.get(word)

    def get(self, word: str, default: int = 0) -> int:
        n = self._seen.get(word)
        if n is None:
            if len(self._seen) > 300_000:
                self._seen.clear()
            h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
            h -= (h >> 63) << 64
            at = int(np.searchsorted(self.hashes, h))
            n = self._seen[word] = int(self.numbers[at]) if at < len(self.hashes) and self.hashes[at] == h else 0
        return n or default

    @classmethod
    def of(cls, counts: dict[str, int]) -> Counts:
        h = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed=42) for w in counts]
        return cls(np.array(h, dtype=np.uint64).astype(np.int64), np.array(list(counts.values()), dtype=np.int64))

    @classmethod
    def read(cls, rows: DataFrame, word: str = "word", n: str = "n") -> Counts:
        """From the rows of a table of distinct words; only hashes and numbers reach the driver."""
        got = rows.select(F.xxhash64(word).alias("h"), F.least(n, F.lit(2**31 - 1)).cast("int").alias("n")).toPandas()
        return cls(got["h"].to_numpy(), got["n"].to_numpy())
