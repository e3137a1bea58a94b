"""Problem 4: text that was decoded with the wrong character encoding."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Counts
from weft.operators.dedup import first_delivery
from weft.session import cut, lanes

# Encodings that text is commonly misread in, the likelier first.
LEGACY = ("cp1252", "latin-1", "cp1256", "cp1251", "cp1254", "mac_roman", "cp850", "cp437", "cp857", "cp866", "koi8_r", "iso8859_6", "iso8859_5", "iso8859_9", "cp720", "mac_turkish", "mac_cyrillic", "mac_arabic", "cp1250", "cp1253", "cp1255", "cp1257", "cp1258", "iso8859_2", "iso8859_15")
# Fixed values: (read as, written in): single-byte encodings taken for one another.
SWAPS = (
    ("cp1252", "cp1256"), ("latin-1", "cp1256"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "iso8859_6"), ("latin-1", "iso8859_6"),
    ("cp1252", "cp1254"), ("latin-1", "iso8859_9"), ("cp1251", "cp1254"), ("cp1256", "cp1254"), ("cp1251", "cp1252"), ("cp1256", "cp1252"), ("cp1251", "cp1256"), ("cp1256", "cp1251"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1250", "cp1254"), ("iso8859_2", "iso8859_9"), ("cp1253", "cp1252"),
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("latin-1", "iso8859_5"), ("cp1251", "iso8859_5"), ("cp1252", "cp857"), ("cp857", "cp1254"), ("cp850", "cp1254"), ("mac_roman", "cp1254"), ("mac_roman", "cp1256"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp850", "cp1256"), ("cp437", "cp1256"), ("cp437", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "iso8859_6"), ("cp1256", "iso8859_6"), ("cp437", "cp720"), ("cp1252", "cp720"), ("cp850", "cp720"),
)
#: Encodings whose misreadings are told by a single sequence.
MAIN = ("cp1252", "latin-1", "cp1254", "cp437", "cp850", "cp857", "mac_roman")
#: A passage is repaired again at most so often: text garbled twice or three times.
ROUNDS = 4
#: A word whose form in another encoding is so many times as frequent is that word misread, however often it occurs.
MISREAD = 10
#: Spans that must hold a word for it to be known, and the least share of all spans.
LEAST, LEAST_SHARE = 3, 1e-6
#: Share of a token's characters outside ASCII that its multibyte sequences cover, where bytes were lost and else.
SHARE_LOST, SHARE = 0.5, 0.75
TOKEN = re.compile(r"[^ \t\n]+")


@lru_cache(maxsize=None)
def _to_byte(codec: str) -> dict[str, int]:
    """Characters of the upper half of a single-byte encoding; undefined bytes stand for the control of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    for b in range(0x80, 0xA0):
        out.setdefault(chr(b), b)
    out.setdefault("\xa0", 0xA0) if codec in ("cp1252", "latin-1", "cp1254", "cp1256", "cp1251") else None
    return out


# The automaton of well-formed multibyte sequences: state -> ((first byte, last byte, next state), ...); state 0 accepts.
AUTOMATON = {
    0: ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)),
    1: ((0x80, 0xBF, 0),),
    2: ((0x80, 0xBF, 1),),
    3: ((0x80, 0xBF, 2),),
    4: ((0xA0, 0xBF, 1),),
    5: ((0x80, 0x9F, 1),),
    6: ((0x90, 0xBF, 2),),
    7: ((0x80, 0x8F, 2),),
}


def _pattern(state: int, chars: dict[int, str]) -> str:
    """The automaton from ``state`` to acceptance as a pattern over the characters of an encoding."""
    ways = []
    for low, high, then in AUTOMATON[state]:
        own = "".join(chars.get(b, "") for b in range(low, high + 1))
        rest = "" if then == 0 else _pattern(then, chars)
        if own and (then == 0 or rest):
            ways.append(f"[{re.escape(own)}]{rest}")
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""


@lru_cache(maxsize=None)
def _sequences(codec: str) -> re.Pattern:
    """Maximal runs of well-formed multibyte sequences, in the characters of an encoding."""
    chars: dict[int, str] = {}
    for ch, b in _to_byte(codec).items():
        chars[b] = chars.get(b, "") + ch
    return re.compile(f"{_pattern(0, chars)}+")


def multibyte_spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Maximal spans (start, end, decoded) whose characters, mapped back to bytes, are well-formed multibyte sequences."""
    table = _to_byte(codec)
    return [(m.start(), m.end(), bytes([table[c] for c in m[0]]).decode("utf-8")) for m in _sequences(codec).finditer(text)]


@lru_cache(maxsize=None)
def _roles() -> np.ndarray:
    """For the characters of the first plane, as bits the encodings in which each leads two, three, four bytes, or continues."""
    out = np.zeros((4, 0x10000), dtype=np.uint32)
    for k, codec in enumerate(LEGACY):
        for ch, b in _to_byte(codec).items():
            row = 3 if 0x80 <= b <= 0xBF else 0 if 0xC2 <= b <= 0xDF else 1 if 0xE0 <= b <= 0xEF else 2 if 0xF0 <= b <= 0xF4 else None
            if row is not None:
                out[row, ord(ch)] |= 1 << k
    return out


def encodings_met(texts: list[str]) -> np.ndarray:
    """For each text, as bits, the encodings in which multibyte sequences cover enough of one of its tokens.

    All texts are looked through at once: every character is a number, its roles are read from a table.
    Sequences that overlap count each, so no encoding that ``repair_multibyte`` could use is left out.
    """
    two, three, four, more = _roles()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.append(np.where(points < 0x10000, points, 0x10000 - 1), np.zeros(3, dtype=np.uint32))
    after = more[points]
    hits = [two[points[:-3]] & after[1:-2]]
    hits.append(three[points[:-3]] & after[1:-2] & after[2:-1])
    hits.append(four[points[:-3]] & after[1:-2] & after[2:-1] & after[3:])
    at = np.flatnonzero(hits[0] | hits[1] | hits[2])
    out = np.zeros(len(texts), dtype=np.uint32)
    if not len(at):
        return out
    token = np.cumsum((points == 32) | (points == 9) | (points == 10))
    high = np.bincount(token, weights=(points >= 0x80) & (points != 0xFFFD))
    share = np.where(np.bincount(token, weights=points == 0xFFFD) > 0, SHARE_LOST, SHARE)
    text = np.searchsorted(np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]), at, side="right") - 1
    sizes = [h[at] for h in hits]
    own = token[at]
    for k in range(len(LEGACY)):
        covers = sum((h >> k & 1).astype(np.int64) * n for n, h in enumerate(sizes, 2))
        if covers.any():
            covered = np.bincount(own, weights=covers, minlength=len(high))
            enough = (covers > 0) & (covered >= share * high)[own]
            np.bitwise_or.at(out, text[enough], np.uint32(1 << k))
    return out


# Signs that running text holds beside letters.
_PUNCT = "–—‘’“”„…•«»§€£°±µ×÷·№\xa0†‡™©®¿¡‚‹›½¼¾²³ʼ′"
#: Letters outside ASCII that the Latin-script languages of the tables write.
_LATIN = "àâæçèéêëîïôœùûüÿÀÂÆÇÈÉÊËÎÏÔŒÙÛÜŸğıöşüçĞİÖŞÜÇâîûÂÎÛ"
_CYRILLIC, _ARABIC = "\u0410-\u044fЁё", "\u0621-\u0652\u0660-\u0669،؛؟"
#: Characters that no text of these languages is made of.
_ODD = re.compile(f"[^\\x00-\\x7f{_LATIN}{_CYRILLIC}{_ARABIC}{re.escape(_PUNCT)}]")
_NEVER = re.compile("[\x00-\x1f\u0700-\u1dff\u2c00-\ufb4f\ufe00-\ufe6f\uff00-\U0010ffff]")
_ONE_SCRIPT = re.compile(f"[\\x00-\\x7f{_LATIN}{re.escape(_PUNCT)}]*|[{_CYRILLIC}'’{re.escape(_PUNCT)}-]*|[{_ARABIC}'’{re.escape(_PUNCT)}-]*")
#: Other letters of the Latin block; odd, but letters.
_LETTERS = frozenset(chr(o) for o in range(0xC0, 0x180) if o not in (0xD7, 0xF7))
_EITHER = re.compile(f"[{_CYRILLIC}{_ARABIC}]")


def _odd(text: str) -> int:
    """Characters that no text of these languages is made of."""
    return 0 if text.isascii() else len(_ODD.findall(text))


def _plausible(after: str) -> bool:
    """Whether the decoded form can be text of these languages, or one more garbled layer of it."""
    return not _NEVER.search(after)


def _well(token: str) -> bool:
    return all(_shape(w) for w in words_of(token))


def repair_multibyte(text: str, met: int | None = None) -> tuple[str, bool]:
    """Decode the well-formed multibyte spans of each token under the encoding that explains most of the token.

    ``met`` are the encodings that ``encodings_met`` leaves, all without it.
    """
    best: tuple[float, str] | None = None
    if text.isascii():
        return text, False
    met = (1 << len(LEGACY)) - 1 if met is None else int(met)
    tokens = _tokens(text) if met else []
    begins = [t[0] for t in tokens]
    for k, codec in enumerate(LEGACY):
        spans = multibyte_spans(text, codec) if met >> k & 1 else None
        if not spans:
            continue
        of_token: dict[int, list[tuple[int, int, str]]] = {}
        for s in spans:
            of_token.setdefault(bisect_right(begins, s[0]) - 1, []).append(s)
        out, at, gain, count = [], 0, 0, 0
        for number, own in of_token.items():
            t0, t1 = tokens[number]
            if own[0][0] >= t1:
                continue
            covered = sum(s[1] - s[0] for s in own)
            whole = text[t0:t1]
            lost = "�" in whole
            high = t1 - t0 - len(whole.encode("ascii", "ignore")) - whole.count("�")
            if covered < (SHARE_LOST if lost else SHARE) * high:
                continue
            decoded = "".join(s[2] for s in own)
            if not _plausible(decoded):
                continue
            whole, back = [], t0
            for s0, s1, piece in own:
                whole += [text[back:s0], piece]
                back = s1
            after = "".join(whole) + text[back:t1]
            if _well(text[t0:t1]) and not lost and not _well(after):
                continue
            if len(decoded) < 2 and codec not in MAIN and not (_well(after) and not _well(text[t0:t1])):
                continue
            if _odd(decoded) > _odd("".join(text[s0:s1] for s0, s1, _ in own)) and covered < 3 * len(decoded):
                continue
            for s0, s1, piece in own:
                out.append(text[at:s0])
                out.append(piece)
                at = s1
                gain += s1 - s0
                count += 1
            gain -= 0.6 * _odd(decoded)
        if count:
            fixed = "".join(out) + text[at:]
            if best is None or gain > best[0] + 1e-9:
                best = (gain, fixed)
    return (best[1], True) if best else (text, False)


def _tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


# ---------------------------------------------------------------- single-byte encodings taken for one another


_WORD = re.compile(r"[^\s\d!-&(-/:-@\[-`{-~«»“”„‘’…–—·•§،؛؟]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


@lru_cache(maxsize=None)
def _swap_table(read_as: str, written_in: str) -> dict[int, str]:
    out = {}
    for ch, b in _to_byte(read_as).items():
        try:
            to = bytes([b]).decode(written_in)
        except UnicodeDecodeError:
            continue
        if to != ch:
            out[ord(ch)] = to
    return out


def _shape(word: str) -> bool:
    """Whether the word is built of the letters of one script, capitals only in front or throughout."""
    if not _ONE_SCRIPT.fullmatch(word):
        return False
    rest = word[1:]
    return rest == rest.lower() or word == word.upper()


class _Suspects(dict):
    """Whether a word may be misread: outside ASCII, unlike the words of the corpus, or with capitals inside."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = not word.isascii() and (self.lexicon.score(word) < 0.95 or _shouts(word))
        return got


class Lexicon:
    """Frequent well-shaped words and letter pairs of the corpus, to judge a decoding by."""

    def __init__(self, words: Counts | dict[str, int], pairs: dict[str, int] | None = None, least: int = LEAST):
        self.words = words if isinstance(words, Counts) else Counts.of(words)
        self.pairs = letter_pairs(words.items()) if pairs is None else pairs
        self.least = least
        self.readings: dict[str, dict[int, tuple[float, str]]] = {}
        self.suspect = _Suspects(self)
        self._scores: dict[str, float] = {}

    def score(self, word: str) -> float:
        """How well the word fits the corpus: 3 for a known word, else the share of known letter pairs."""
        got = self._scores.get(word)
        if got is None:
            if len(self._scores) > 300_000:
                self._scores.clear()
            got = self._scores[word] = self._score(word)
        return got

    def _score(self, word: str) -> float:
        if not _shape(word):
            return 0.0
        n = self.words.get(word, 0)
        if not n:
            low = word.lower()
            n = max(self.words.get(low, 0), self.words.get(low[:1].upper() + low[1:], 0)) if low != word else 0
        if n >= self.least:
            return 3.0
        if word.isascii():
            return 1.0
        steps = list(zip("^" + word, word + "$"))
        good = sum(1 for a, b in steps if self.pairs.get(a + b, 0) >= LEAST)
        return good / len(steps)


def letter_pairs(counts) -> dict[str, int]:
    """Pairs of neighbouring letters, word ends included, of (word, n) outside ASCII."""
    pairs: dict[str, int] = {}
    for w, n in counts:
        if not w.isascii():
            for a, b in zip("^" + w, w + "$"):
                pairs[a + b] = pairs.get(a + b, 0) + n
    return pairs


def is_misread(word: str, n: int, words: Counts) -> bool:
    """Whether a word of two letters or more is a far more frequent word in a wrong encoding.

    The share of garbled text stays as a corpus grows and its counts do not, so a ratio tells them at any size.
    Single letters and signs are kept: sound ones stand for frequent letters in other encodings, too.
    """
    return len(word) >= 2 and not word.isascii() and any(words.get(word.translate(_swap_table(*swap)), 0) > MISREAD * n for swap in SWAPS)


_QUOTES = "‘’“”„‚«»‹›–—•…'\""


def _shouts(word: str) -> bool:
    """Capitals after the first letter: what an encoding with swapped case leaves."""
    return len(word) > 1 and word[1:] != word[1:].lower()


def _weight(text: str, lexicon: Lexicon) -> float:
    return sum(math.log1p(n) for w in words_of(text) if len(w) > 2 and not w.isascii() and (n := lexicon.words.get(w, 0)) >= lexicon.least)


def _reading(w: str, table: dict[int, str], lexicon: Lexicon) -> tuple[float, str] | None:
    """(gain, word) where the word reads better with the characters of ``table`` exchanged."""
    alt = w.translate(table)
    if alt == w:
        return None
    parts = words_of(alt)
    gain = 0.0
    if parts != [alt]:
        if len(w) > 2 and len(parts) == 1 and alt.strip(_QUOTES) == parts[0] and lexicon.words.get(parts[0], 0) >= lexicon.least > lexicon.words.get(w, 0):
            gain = 2.0
        if len(w) > 1:
            return (gain, alt) if gain else None
    other = bool(_EITHER.search(alt))
    if len(w) < 2 and _ODD.match(w) and w not in _LETTERS or other and any(ord(c) not in table for c in _EITHER.findall(w)):
        return None
    if _shouts(w) and lexicon.words.get(alt, 0) > 4 * lexicon.words.get(w, 0) + 4:
        return 3.0 * len(w), alt
    was, now = lexicon.score(w), lexicon.score(alt)
    if now >= 3 > was or other and len(w) >= 3 and now >= 0.85 and was < 0.6 or len(w) >= 4 and was == 0 and now >= 0.99:
        return gain + (now - was) * len(w), alt
    return None


def _readings(w: str, lexicon: Lexicon) -> dict[int, tuple[float, str]]:
    """What a word reads as in each exchange of encodings that makes it better, by the number of the exchange."""
    got = lexicon.readings.get(w)
    if got is None:
        if len(lexicon.readings) > 100_000:
            lexicon.readings.clear()
        got = lexicon.readings[w] = {k: r for k, swap in enumerate(SWAPS) if (r := _reading(w, _swap_table(*swap), lexicon))}
    return got


def repair_swap(text: str, lexicon: Lexicon) -> tuple[str, bool]:
    """Replace words that read better when their bytes are decoded in another single-byte encoding.

    First word by word, since one garbled name may stand in sound text; then the whole text, since
    a letter may have become a sign or a space.
    """
    if text.isascii():
        return text, False
    suspects = [w for w in set(words_of(text)) if lexicon.suspect[w]]
    if not suspects:
        return text, False
    gains: dict[int, float] = {}
    for w in sorted(suspects):
        for k, (gain, _) in _readings(w, lexicon).items():
            gains[k] = gains.get(k, 0.0) + gain
    best: tuple[dict[str, str], dict[int, str]] | None = None
    if gains:
        k = min(gains, key=lambda k: (-gains[k], k))
        best = {w: r[k][1] for w in suspects if k in (r := _readings(w, lexicon))}, _swap_table(*SWAPS[k])
    if best is not None:
        change, table = best
        known = any(lexicon.score(x) >= 3 for alt in change.values() for x in words_of(alt))
        foreign = any(_EITHER.search(alt) for alt in change.values())
        if known or foreign and (len(change) > 1 or sum(map(len, change)) >= 4):
            for w in set(words_of(text)).difference(change):  # known words, single letters mostly, that are rare beside what they stand for
                alt = w.translate(table)
                if words_of(alt) == [alt] and lexicon.words.get(alt, 0) > MISREAD * lexicon.words.get(w, 0) > 0:
                    change[w] = alt
            return _WORD.sub(lambda m: change.get(m[0], m[0]), text), True
    letters = [(len(w), lexicon.score(w) >= 3) for w in words_of(text) if not w.isascii()]
    if 2 * sum(n for n, known in letters if known) > sum(n for n, _ in letters):
        return text, False  # a text in a wrong encoding is not made of known words
    was = _weight(text, lexicon)
    top: tuple[float, str] | None = None
    for read_as, written_in in SWAPS:
        alt = text.translate(_swap_table(read_as, written_in))
        if alt != text and (top is None or (w := _weight(alt, lexicon)) > top[0]):
            top = (_weight(alt, lexicon) if top is None else w, alt)
    if top is not None and top[0] > 1.5 * was + 3:
        return top[1], True
    return text, False


def repair_all(texts: list[str | None], lexicon: Lexicon | None = None) -> list[tuple[str | None, bool, bool]]:
    """(restored text, affected, complete) of every text.

    Null and empty texts are not affected.  A replacement character marks a passage whose bytes are
    lost: the text is affected, its other passages are restored, ``complete`` is false.  All texts go
    through a round together; those that it changed go through the next.
    """
    out = list(texts)
    affected = [bool(t) and "�" in t for t in texts]
    left = [i for i, t in enumerate(texts) if t and not t.isascii()]
    for _ in range(ROUNDS):
        changed = []
        for i, met in zip(left, encodings_met([out[i] for i in left]).tolist() if left else ()):
            now, hit = repair_multibyte(out[i], met) if met else (out[i], False)
            if not hit and lexicon is not None:
                now, hit = repair_swap(now, lexicon)
            if hit:
                out[i], affected[i] = now, True
                changed.append(i)
        left = [i for i in changed if not out[i].isascii()]
    return [(t, hit, not t or "�" not in t) for t, hit in zip(out, affected)]


def repair(text: str | None, lexicon: Lexicon | None = None) -> tuple[str | None, bool, bool]:
    """``repair_all`` of one text."""
    return repair_all([text], lexicon)[0]


# ---------------------------------------------------------------- operators


def distinct_spans(spans: DataFrame) -> DataFrame:
    """Spans with an id, each once, in a stated number of partitions."""
    return spans.select("span_id", "file_id", "page", "text").where(F.col("span_id").isNotNull()).repartition(lanes(spans.sparkSession), "span_id").distinct()


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows, counted in each task before the shuffle, and the rows themselves as the word ''.

    Words of mixed shape and words of garbled rows are left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shaped: dict[str, bool] = {}
        for pdf in batches:
            n: dict[str, int] = {}
            texts = [t for t in pdf[text] if t and "�" not in t]
            for t, met in zip(texts, encodings_met(texts)):
                if not met or not repair_multibyte(t, met)[1]:
                    for w in set(words_of(t)):
                        n[w] = n.get(w, 0) + 1
            n = {w: k for w, k in n.items() if (shaped[w] if w in shaped else shaped.setdefault(w, _shape(w)))}
            n[""] = len(pdf)
            if len(shaped) > 300_000:
                shaped.clear()
            yield pd.DataFrame({"word": list(n), "n": list(n.values())}).astype({"word": object, "n": "int64"})

    return texts.select(text).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(spans: DataFrame, least: int = LEAST, share: float = LEAST_SHARE) -> Lexicon:
    """The words in at least ``least`` spans and at least ``share`` of all spans, and their letter pairs.

    Counts cover all spans, each once, and are written once.  ``share`` bounds what the workers get: at
    most 1/share (a million) times the mean number of words of a span, twelve bytes each; under 1/share
    spans times ``least`` it does not bind.  Letter pairs are those of four alphabets.  Words that are
    frequent ones misread are left out.
    """
    counts = cut(word_counts(distinct_spans(spans)).where((F.col("n") >= least) | (F.col("word") == "")))
    rows = counts.where(F.col("word") == "").first()
    enough = max(least, math.ceil(share * (rows["n"] if rows else 0)))
    known = counts.where((F.col("word") != "") & (F.col("n") >= enough))
    every = Counts.read(known)
    shared = spans.sparkSession.sparkContext.broadcast(every)

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = shared.value
        for pdf in batches:
            yield pdf[[not is_misread(w, n, words) for w, n in zip(pdf["word"], pdf["n"])]]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = letter_pairs(zip(pdf["word"], pdf["n"]))
            yield pd.DataFrame({"pair": list(n), "n": list(n.values())}).astype({"pair": object, "n": "int64"})

    right = cut(known.mapInPandas(sound, "word string, n long"))
    steps = right.mapInPandas(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).collect()
    return Lexicon(Counts.read(right), {r["pair"]: r["n"] for r in steps}, enough)


SCHEMA = "span_id long, file_id string, page int, text string, restored string, affected boolean, complete boolean"


def restore(spans: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """All spans with restored text.  Rows delivered again count once; extra columns are ignored; null texts stay null."""
    lexicon = lexicon or fit_lexicon(spans)
    shared = spans.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.pairs, lexicon.least))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon(*shared.value)
        for pdf in batches:
            got = repair_all(pdf["text"].tolist(), own)
            pdf["restored"] = pd.Series([g[0] for g in got], dtype=object, index=pdf.index)
            pdf["affected"] = [g[1] for g in got]
            pdf["complete"] = [g[2] for g in got]
            yield pdf

    return distinct_spans(spans).mapInPandas(fix, SCHEMA)


def found(spans: DataFrame) -> DataFrame:
    """Spans with at least one passage in wrong characters (p4_found)."""
    return restore(spans).where("affected").select("span_id").distinct()


def pages(restored: DataFrame, files: DataFrame) -> DataFrame:
    """Pages with garbled spans beside the pages the file's diagnosis names.

    Full outer on (file_id, page): ``hinted`` pages without garbled spans and garbled pages the hint
    misses both come out.  Null hints name no page.
    """
    own = restored.groupBy("file_id", "page").agg(
        F.count(F.lit(1)).alias("spans"), F.count_if("affected").alias("garbled"), F.count_if(F.col("affected") & F.col("complete")).alias("restored_spans")
    )
    hints = (
        first_delivery(files.select(F.col("id").alias("file_id"), "unreliable_pages"), "file_id")
        .select("file_id", F.explode(F.array_distinct("unreliable_pages")).alias("page"))
        .withColumn("hinted", F.lit(True))
    )
    joined = own.join(hints, ["file_id", "page"], "full_outer")
    return joined.select(
        "file_id", "page", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("garbled", F.lit(0)).alias("garbled"),
        F.coalesce("restored_spans", F.lit(0)).alias("restored_spans"), F.coalesce("hinted", F.lit(False)).alias("hinted"),
    )
