"""What translates what: a small lexicon learned from the translation memory, shared by problems 2 and 3."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.lookalike import LOOKALIKES
from weft.llm.words import TAG
from weft.session import cut, lanes, small_table

#: Memory entries, and as many segments, the lexicon is fitted on at most per language pair; chosen by a hash of the id.
SAMPLE = 1500
#: Pairs that must hold a word for it to be in the lexicon; rarer ones are mostly names.
LEAST = 4
#: Longest source text of a sampled entry, in characters: single sentences align best.
LONGEST = 140
WORD = re.compile(r"[^\W_]+")
DATE = re.compile(r"(?<!\d)\d{1,2}[./](\d{2})[./]\d{4}(?!\d)")
#: What every date holds; it begins with a set of characters, which is looked for fast.
DAY = re.compile(r"\d[./]\d\d[./]\d")
GROUPED = re.compile(r"(?<!\d)(\d{1,3})((?:[.,   ]\d{3})+)(?!\d)")
# what every grouped number and every word of two scripts holds, looked for fast as well
THREE, GREEK = re.compile(r"\d[.,   ]\d{3}"), re.compile("[\u0370-\u052f]")
# digits as ASCII, one form of letters that differ only by keyboard, nothing for characters that print nothing
_PLAIN = {ord(c): str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")} | {ord("ک"): "ك", ord("ی"): "ي", ord("ى"): "ي", ord("İ"): "i"} | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF))
_CHANGES = frozenset(map(chr, _PLAIN))
# Consonants of Arabic and Cyrillic letters in Latin writing; vowels and weak letters stand for nothing.
CONSONANTS = {
    "ب": "b", "ت": "t", "ث": "t", "ج": "j", "ح": "h", "خ": "k", "د": "d", "ذ": "d", "ر": "r", "ز": "z", "س": "s", "ش": "s", "ص": "s", "ض": "d", "ط": "t", "ظ": "z", "غ": "g", "ف": "f", "ق": "k", "ك": "k", "ک": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h",
    "б": "b", "в": "v", "г": "g", "д": "d", "ж": "z", "з": "z", "к": "k", "л": "l", "м": "m", "н": "n", "п": "p", "р": "r", "с": "s", "т": "t", "ф": "f", "х": "h", "ц": "s", "ч": "c", "ш": "s", "щ": "s",
}
_SKELETON = {ord(k): v for k, v in CONSONANTS.items()} | {ord(c): None for c in "aeiouyıàâéèêëîïôöûüùاأإآىيوةعءئؤًٌٍَُِّْаеёиоуыэюяйьъ"}


MIXED = re.compile(r"[A-Za-z\d][\u0370-\u052f]|[\u0370-\u052f][A-Za-z\d]")
_TO_LATIN = {ord(k): v for k, v in LOOKALIKES.items() if "\u0370" <= k <= "\u052f" and v.isascii()}
_TO_CYRILLIC = {ord(v): k for k, v in LOOKALIKES.items() if "А" <= k <= "я" and v.isascii()}


def tokens(text: str) -> list[str]:
    """Lower-case words and plain numbers; digits as ASCII, grouped numbers in one piece, tags left out."""
    if "<" in text:
        text = TAG.sub("", text)
    if not text.isascii():
        text = _plain(text)
        if not unicodedata.is_normalized("NFKC", text):
            text = _plain(unicodedata.normalize("NFKC", text))
        if GREEK.search(text) and MIXED.search(text):
            text = WORD.sub(_one_script, text)
    text = text.lower()
    if THREE.search(text):
        text = GROUPED.sub(lambda m: m[1] + re.sub(r"\D", "", m[2]), text)
    return [w.lstrip("0") or "0" if w[0] == "0" else w for w in WORD.findall(text)]


def _plain(text: str) -> str:
    """``translate`` by _PLAIN, which asks for every character; few texts hold many that change."""
    for c in _CHANGES.intersection(text):
        text = text.replace(c, _PLAIN[ord(c)] or "")
    return text


def _one_script(m: re.Match) -> str:
    """A word of Latin letters among which look-alikes of another script stand, or the reverse, in the script of most of its letters."""
    w = m[0]
    if not any("a" <= c.lower() <= "z" or c.isdigit() for c in w) or not any("\u0370" <= c <= "\u052f" for c in w):
        return w
    back = w.translate(_TO_LATIN)
    if all(c < "\u0250" for c in back):
        return back
    return w.translate(_TO_CYRILLIC)


@lru_cache(200_000)
def skeleton(word: str) -> str:
    return word.translate(_SKELETON)


class _Told(dict):
    """What the lexicon says of a word, remembered: how telling it is, its translations, its written form as ``hits`` and
    as ``look`` take it, its language, whether it begins with no digit."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str) -> tuple[float, frozenset[str] | None, str, str, str | None, bool]:
        own = self.lexicon
        likely, s = own.sets.get(w), "" if w in own.weight else skeleton(w)
        s = s if len(s) >= 2 else ""
        if len(self) > 300_000:
            self.clear()
        got = self[w] = own.weigh(w), likely, "" if likely is not None or w[0].isdigit() else s, "" if w.isdigit() else s, own.speaks.get(w), not w[0].isdigit()
        return got


@dataclass
class Lexicon:
    """likely: word -> its translations with probabilities, both ways; weight: word -> how telling it is; speaks: word -> language."""

    likely: dict[str, dict[str, float]] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)
    speaks: dict[str, str] = field(default_factory=dict)
    names_hit: float = 1.6

    def __post_init__(self) -> None:
        self.sets = {k: frozenset(v) for k, v in self.likely.items()}
        self.told = _Told(self)

    def weigh(self, w: str) -> float:
        x = self.weight.get(w)
        return x if x is not None else 2.0 if w[0].isdigit() else 1.3

    def look(self, other: list[str]) -> tuple[frozenset[str], set[str]]:
        """What ``hits`` asks of the other side: its words, and the written forms of its names."""
        return frozenset(other), {s for w in other if w not in self.weight and not w.isdigit() and len(s := skeleton(w)) >= 2}

    def hits(self, words: list[str], other: tuple[frozenset[str], set[str]]) -> list[bool]:
        """For every word whether the other side holds it or one of its translations."""
        have, names = other
        out = []
        sets, weight = self.sets, self.weight
        for w in words:
            if w in have:
                out.append(True)
                continue
            likely = sets.get(w)
            if likely is not None:
                out.append(not likely.isdisjoint(have))
            elif w in weight or w[0].isdigit():
                out.append(False)
            else:
                s = skeleton(w)
                out.append(len(s) >= 2 and s in names)
        return out

    def covered(self, words: list[str], other: list[str]) -> tuple[float, float, list[bool]]:
        """(weight of ``words`` found in ``other``, whole weight, which are found)."""
        hits = self.hits(words, self.look(other))
        got = total = 0.0
        for w, h in zip(words, hits):
            x = self.weigh(w)
            total += x
            got += x * h
        return got, total, hits

    def language(self, words: list[str]) -> str | None:
        """The language most known words belong to; None without known words."""
        n: dict[str, int] = {}
        for w in words:
            lang = self.speaks.get(w)
            if lang:
                n[lang] = n.get(lang, 0) + 1
        return max(n, key=lambda k: (n[k], k)) if n else None


def sent(results: DataFrame) -> DataFrame:
    """(segment_id, source_lang, language): every segment sent, with its languages; the least where a segment was sent with several."""
    return (
        results.select(F.explode("segment_ids").alias("segment_id"), "source_lang", F.col("target_lang").alias("language")).where(F.col("segment_id").isNotNull())
        .groupBy("segment_id").agg(F.min("source_lang").alias("source_lang"), F.min("language").alias("language"))
    )


def some_segments(segments: DataFrame, results: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` segments, chosen by a hash of their ids, with the languages they were sent with.

    The share is taken from the row count before anything is joined, so only the sample's texts travel.
    """
    share = max(1, segments.count() // max(1, rows))
    few = segments.where((F.pmod(F.xxhash64("id"), F.lit(share)) == 0) & F.col("source_text").isNotNull() & F.col("target_text").isNotNull())
    return few.select(F.col("id").alias("segment_id"), "source_text", "target_text").join(sent(results), "segment_id").dropDuplicates(["segment_id"])


def sample(memory: DataFrame, segments: DataFrame | None = None, results: DataFrame | None = None, per_pair: int = SAMPLE) -> list[tuple[str, str, str, str]]:
    """(source language, target language, source, target): at most ``per_pair`` short texts of each language pair from the
    memory, and as many from the segments sent."""
    c = F.col
    pair = ["source_lang", "target_lang", "segment"]
    rows = memory.select("id", "source_lang", "target_lang", "source_text", "target_text", F.lit(False).alias("segment"))
    if segments is not None and results is not None:
        more = some_segments(segments, results, 16 * per_pair)
        rows = rows.unionByName(more.select(c("segment_id").alias("id"), "source_lang", c("language").alias("target_lang"), "source_text", "target_text", F.lit(True).alias("segment")))
    rows = (
        rows.where(c("source_text").isNotNull() & c("target_text").isNotNull() & c("source_lang").isNotNull() & c("target_lang").isNotNull())
        .where((F.length("source_text") <= LONGEST) & (F.length("target_text").between(4, 2 * LONGEST)))
    )
    # the lowest hashes of each pair: twice the share wanted is let through where it is read, only that is sorted
    sizes = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows for each pair of languages
    lowest = [(r["source_lang"], r["target_lang"], r["segment"], int(-(2**63) + min(1.0, (2 * per_pair + 200) / r["n"]) * (2**64 - 4096))) for r in sizes]
    limits = small_table(memory.sparkSession, lowest, "source_lang string, target_lang string, segment boolean, highest long")
    w = Window.partitionBy(*pair).orderBy("hash", "id")
    few = rows.withColumn("hash", F.xxhash64("id")).join(F.broadcast(limits), pair).where(c("hash") <= c("highest"))
    few = few.withColumn("n", F.row_number().over(w)).where(c("n") <= per_pair)
    return [(r["source_lang"], r["target_lang"], r["source_text"], r["target_text"]) for r in few.orderBy(*pair, "n").collect()]


def fit(pairs: list[tuple[str, str, str, str]], rounds: int = 4, keep: float = 0.06) -> Lexicon:
    """Translation probabilities by expectation maximisation over sentence pairs, from each language into each other.

    Words met fewer than LEAST times are left to their written form (names, codes).
    """
    coded = [(a, b, list(dict.fromkeys(tokens(s))), list(dict.fromkeys(tokens(t)))) for a, b, s, t in pairs]
    seen: Counter[str] = Counter()
    spoken: dict[str, Counter[str]] = {}
    for a, b, s, t in coded:
        for lang, ws in ((a, s), (b, t)):
            for w in ws:
                if not any(c.isdigit() for c in w):
                    seen[w] += 1
                    spoken.setdefault(w, Counter())[lang] += 1
    known = {w for w, n in seen.items() if n >= LEAST}
    likely: dict[str, dict[str, float]] = {}
    languages = sorted({(a, b) for a, b, _, _ in coded} | {(b, a) for a, b, _, _ in coded})
    for one, two in languages:
        data = []
        for a, b, s, t in coded:
            for x, y in ((s, t),) * ((a, b) == (one, two)) + ((t, s),) * ((b, a) == (one, two)):
                x, y = [w for w in x if w in known], [w for w in y if w in known]
                if x and y:
                    data.append((x, y))
        prob: dict[str, dict[str, float]] = {}
        for x, y in data:
            for w in x:
                row = prob.setdefault(w, {})
                for v in y:
                    row[v] = 1.0
        for k in range(rounds):
            count: dict[str, dict[str, float]] = {w: dict.fromkeys(row, 0.0) for w, row in prob.items()}
            for x, y in data:
                rows = [(prob[w], count[w]) for w in x]
                for v in y:
                    z = sum(p.get(v, 0.0) for p, _ in rows) + 1e-9
                    for p, c in rows:
                        if v in p:
                            c[v] += p[v] / z
            prob = {}
            for w, row in count.items():
                whole = sum(row.values()) or 1.0
                low = 0.01 if k else 0.0
                prob[w] = {v: n / whole for v, n in row.items() if n / whole > low}
        for w, row in prob.items():
            own = likely.setdefault(w, {})
            for v, p in row.items():
                if p >= keep and p > own.get(v, 0.0):
                    own[v] = p
    # numbers of months: what a word of one side always meets as the middle of a date on the other
    dates: dict[str, Counter[str]] = {}
    for _, _, s, t in pairs:
        for x, y in ((s, t), (t, s)):
            if middle := _middle(y):
                for w in set(tokens(x)) & known:
                    dates.setdefault(w, Counter())[middle] += 1
    lexicon = _assemble(likely, {w: seen[w] for w in known}, spoken, dates, len(coded))
    # a word that sound pairs often leave without its translation tells little when it is not found
    met: Counter[str] = Counter()
    found: Counter[str] = Counter()
    for _, _, s, t in coded:
        for x, y in ((s, t), (t, s)):
            for w, h in zip(x, lexicon.hits(x, lexicon.look(y))):
                if w in known:
                    met[w] += 1
                    found[w] += h
    _damp(lexicon, met, found)
    return lexicon


def _middle(text: str) -> str | None:
    """The one number that stands in the middle of the dates of a text."""
    found = {m.lstrip("0") for m in DATE.findall(text)} if DAY.search(text) else ()
    return found.pop() if len(found) == 1 else None


def _assemble(likely: dict[str, dict[str, float]], seen: dict[str, int], spoken: dict[str, Counter[str]], dates: dict[str, Counter[str]], n: int) -> Lexicon:
    """A lexicon from translation probabilities, the pairs that hold each known word, its languages and its months."""
    for w, c in dates.items():
        month, hits = max(c.items(), key=lambda x: (x[1], x[0]))
        if hits >= 3 and hits >= 0.9 * sum(c.values()):
            likely.setdefault(w, {})[month] = 0.3
    weight = {w: max(0.15, min(2.0, math.log(max(1, n) / k) / 3)) for w, k in seen.items()}
    speaks = {}
    for w in seen:
        lang, most = spoken[w].most_common(1)[0]
        if most >= 0.85 * sum(spoken[w].values()):
            speaks[w] = lang
    for w, row in likely.items():
        if weight.get(w, 1.0) >= 0.5:  # what any sentence holds proves nothing about a telling word
            likely[w] = {v: p for v, p in row.items() if weight.get(v, 1.0) >= 0.35 or p >= 0.5}
    return Lexicon(likely, weight, speaks)


def _damp(lexicon: Lexicon, met: dict[str, int], found: dict[str, int]) -> None:
    """A word that sound pairs often leave without its translation tells little when it is not found."""
    for w in lexicon.weight:
        rate = (found.get(w, 0) + 1) / (met.get(w, 0) + 1.5)
        lexicon.weight[w] *= max(0.05, rate) ** 2


# ---------------------------------------------------------------- the same, from all pairs of a table

#: Of the pairs of a language, the share that must hold a word for ``fit_all`` to know it, LEAST of them in any case;
#: rarer ones are mostly names and are compared by their written form.  So of a language at most the inverse times the
#: mean number of different words of its texts are known.
SHARE = 5e-4
#: Pairs that a task takes at most, about.
TASK = 20_000
#: Pairs of one direction whose expected counts are taken together, about.
PART = 100_000
#: Cells of one direction held as a full table; more are held as sorted keys.
FULL = 8_000_000
#: Products of words looked up together; so many stay in a core's cache.
CHUNK = 50_000
#: Different entries of a tally that a task holds before it hands them on.
HELD = 500_000


def tokenized(pairs: DataFrame, declines: Callable[[list[str]], bool], rows: int) -> DataFrame:
    """All pairs, each once, with their different words, joined by spaces, the months of their dates and whether the answer declines; spread by id, for about ``rows`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for side, text in (("s", "source_text"), ("t", "target_text")):
                words = [tokens(x or "") for x in pdf[text]]
                pdf[f"{side}_words"] = pd.Series([" ".join(dict.fromkeys(ws)) for ws in words], dtype=object, index=pdf.index)
                pdf[f"{side}_month"] = pd.Series([_middle(x or "") for x in pdf[text]], dtype=object, index=pdf.index)
            pdf["declines"] = [declines(ws) for ws in words]
            yield pdf

    schema = ", ".join(f"{k} {v}" for k, v in pairs.dtypes) + ", s_words string, s_month string, t_words string, t_month string, declines boolean"
    n = max(lanes(pairs.sparkSession), 1 + rows // TASK)
    spread = pairs.repartition(n, "id").distinct().sortWithinPartitions("id", "source_text", "target_text")
    return cut(spread.mapInPandas(run, schema))


def _tally(words: DataFrame, count: Callable[[dict[str, Counter], pd.DataFrame], None]) -> DataFrame:
    """(word, kind, n): what ``count`` adds up by kind over all rows, summed in each task first."""

    def frame(held: dict[str, Counter]) -> pd.DataFrame:
        return pd.DataFrame({"word": [w for c in held.values() for w in c], "kind": [k for k, c in held.items() for _ in c], "n": [n for c in held.values() for n in c.values()]}).astype({"word": object, "kind": object, "n": "int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            count(held, pdf)
            if sum(map(len, held.values())) > HELD:
                yield frame(held)
                held.clear()
        yield frame(held)

    return words.mapInPandas(run, "word string, kind string, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))


def _count_words(held: dict[str, Counter], pdf: pd.DataFrame) -> None:
    """Words by language (kind 'in xx'), months words meet ('on m'), pairs by their languages (no word, 'of', a, b by tabs)."""
    for a, b, s, t, in_s, in_t in zip(pdf["source_lang"], pdf["target_lang"], pdf["s_words"], pdf["t_words"], pdf["s_month"], pdf["t_month"]):
        held[f"of \t{a}\t{b}"][""] += 1
        for lang, ws, month in ((a, s, in_t), (b, t, in_s)):
            own = [w for w in ws.split(" ") if w.isalpha() or w and not any(c.isdigit() for c in w)]
            held["in " + lang].update(own)
            if month:
                held["on " + month].update(own)


class _Table:
    """Values by cell of one direction; what is not named is zero, without keys everything is one."""

    def __init__(self, size: int, keys: np.ndarray | None, values: np.ndarray | None):
        self.keys, self.values = keys, values
        if keys is not None and size <= FULL:
            self.keys, self.values = None, np.zeros(size)
            self.values[keys] = values

    def get(self, cells: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return np.ones(cells.shape) if self.values is None else self.values[cells]
        if not len(self.keys):
            return np.zeros(cells.shape)
        at = np.minimum(np.searchsorted(self.keys, cells), len(self.keys) - 1)
        return np.where(self.keys[at] == cells, self.values[at], 0.0)


class _Sums:
    """Sums by cell of one direction."""

    def __init__(self, size: int):
        self.full = np.zeros(size) if size <= FULL else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, cells: np.ndarray, values: np.ndarray) -> None:
        if self.full is not None:
            np.add.at(self.full, cells.ravel(), values.ravel())
            return
        self.parts.append((cells.ravel(), values.ravel()))
        self.waiting += cells.size
        if self.waiting > FULL:
            self.parts = [self.items()]
            self.waiting = 0

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        if self.full is not None:
            keys = np.flatnonzero(self.full)
            return keys, self.full[keys]
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0)
        keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        values = np.bincount(at, np.concatenate([v for _, v in self.parts]), len(keys))
        return keys[values > 0], values[values > 0]


def _expect(table: _Table, sums: _Sums, wide: int, block: tuple[np.ndarray, ...]) -> None:
    """Adds the expected translations of a block of pairs: every target word is shared out among the source words."""
    x, n_x, y, n_y = block
    first_x, first_y = np.cumsum(n_x) - n_x, np.cumsum(n_y) - n_y
    for m in np.unique(n_x):
        own = np.flatnonzero(n_x == m)
        for part in np.array_split(own, int(m * n_y[own].sum()) // CHUNK + 1):
            lengths = n_y[part]
            before = np.cumsum(lengths) - lengths
            at = np.arange(int(lengths.sum())) + np.repeat(first_y[part] - before, lengths)
            of, rows = np.repeat(np.arange(len(part)), lengths), x[first_x[part][:, None] + np.arange(m)] * wide
            step = 4 * CHUNK // int(m) + 1  # only pairs of very long texts are parted
            for low in range(0, len(at), step):
                cells = rows[of[low : low + step]]
                cells += y[at[low : low + step]][:, None]
                p = table.get(cells)
                p /= p.sum(1, keepdims=True) + 1e-9
                sums.add(cells, p)


def fit_all(words: DataFrame, rounds: int = 4, keep: float = 0.06) -> Lexicon:
    """What ``fit`` learns, from every row of ``tokenized``: tallies and expected counts are summed in the tasks.

    Rows without a text or a language, and answers that decline, are left out.  The driver holds the
    known words and the translations that are kept.
    """
    spark = words.sparkSession
    words = words.dropna(subset=["source_lang", "target_lang", "source_text", "target_text"]).where(~F.col("declines"))
    tally = cut(_tally(words, _count_words))
    sizes = {tuple(r["kind"].split("\t")[1:]): r["n"] for r in tally.where(F.col("word") == "").collect()}
    if not sizes:
        return Lexicon()
    held: Counter[str] = Counter()
    for (a, b), n in sizes.items():
        for lang in {a, b}:
            held[lang] += n
    share = F.col("n") >= F.coalesce(F.create_map(*[F.lit(x) for lang, n in held.items() for x in ("in " + lang, float(max(LEAST, SHARE * n)))])[F.col("kind")], F.lit(float("inf")))
    of_language = F.when(F.startswith("kind", F.lit("in ")), F.col("n")).otherwise(0)
    rows = (
        tally.where(F.col("word") != "").groupBy("word").agg(F.sum(of_language).alias("n"), F.max(share).alias("often"), F.collect_list(F.struct("kind", "n")).alias("kinds"))
        .where("often").orderBy("word").collect()
    )
    seen = {r["word"]: r["n"] for r in rows}
    spoken, dates = {}, {}
    for r in rows:
        kinds = sorted((k["kind"], k["n"]) for k in r["kinds"])
        spoken[r["word"]] = Counter({k[3:]: n for k, n in kinds if k.startswith("in ")})
        if months := Counter({k[3:]: n for k, n in kinds if k.startswith("on ")}):
            dates[r["word"]] = months
    known: dict[str, dict[str, int]] = {lang: {} for lang in held}
    for w in sorted(seen, key=lambda w: (-seen[w], w)):  # cells of frequent words lie together
        for lang in spoken[w]:
            known[lang][w] = len(known[lang])
    listed = {lang: list(ids) for lang, ids in known.items()}
    ways = sorted({(a, b) for a, b in sizes} | {(b, a) for a, b in sizes})
    likely: dict[str, dict[str, float]] = {}
    base = np.concatenate([[0], np.cumsum([len(known[a]) * len(known[b]) for a, b in ways])]).astype(np.int64)
    wide = np.array([max(1, len(known[b])) for _, b in ways])
    cells = _cells(words, known, ways, sizes, base, wide, rounds, keep)
    for key, p in sorted((key, p) for keys, values in cells for key, p in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(values).tolist())):
        d = int(np.searchsorted(base, key, "right")) - 1
        w, v = divmod(key - int(base[d]), int(wide[d]))
        own, other = likely.setdefault(listed[ways[d][0]][w], {}), listed[ways[d][1]][v]
        own[other] = max(p, own.get(other, 0.0))
    lexicon = _assemble(likely, seen, spoken, dates, sum(sizes.values()))
    shared = spark.sparkContext.broadcast((set(seen), lexicon.sets))

    def count_found(held: dict[str, Counter], pdf: pd.DataFrame) -> None:
        words_, sets = shared.value
        nothing = frozenset()
        met, found = held["met"], held["found"]
        for s, t in zip(pdf["s_words"], pdf["t_words"]):
            s, t = frozenset(s.split(" ")), frozenset(t.split(" "))
            for x, y in ((s, t), (t, s)):
                own = x & words_
                met.update(own)
                found.update([w for w in own if w in y or not sets.get(w, nothing).isdisjoint(y)])

    met: dict[str, dict[str, int]] = {"met": {}, "found": {}}
    for r in _tally(words, count_found).collect():
        met[r["kind"]][r["word"]] = r["n"]
    _damp(lexicon, met["met"], met["found"])
    return lexicon


def _packed(words: DataFrame, known: dict[str, dict[str, int]], ways: list[tuple[str, str]], parts: list[int]) -> DataFrame:
    """Blocks of pairs of one direction as arrays of the numbers of their known words, by parts of a direction."""
    shared = words.sparkSession.sparkContext.broadcast((known, {w: i for i, w in enumerate(ways)}, np.concatenate([[0], np.cumsum(parts)]).tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, numbers, first = shared.value
        for pdf in batches:
            blocks: dict[tuple[int, int], list[tuple[list[int], list[int]]]] = {}
            for a, b, s, t in zip(pdf["source_lang"], pdf["target_lang"], pdf["s_words"], pdf["t_words"]):
                in_a, in_b = ids[a], ids[b]
                x, y = [in_a[w] for w in s.split(" ") if w in in_a], [in_b[w] for w in t.split(" ") if w in in_b]
                if x and y:
                    spread = zlib.crc32(s.encode("utf-8", "surrogatepass"))
                    for way, pair in ((numbers[a, b], (x, y)), (numbers[b, a], (y, x))):
                        blocks.setdefault((way, first[way] + spread % (first[way + 1] - first[way])), []).append(pair)
            rows = []
            for (way, part), block in blocks.items():
                flat = [np.fromiter((i for p in block for i in p[k]), np.int32) for k in (0, 1)]
                sizes = [np.array([len(p[k]) for p in block], np.int32) for k in (0, 1)]
                rows.append((part, way, flat[0].tobytes(), sizes[0].tobytes(), flat[1].tobytes(), sizes[1].tobytes()))
            yield pd.DataFrame(rows, columns=["part", "way", "x", "n_x", "y", "n_y"]).astype({"part": "int32", "way": "int32"})

    blocks = words.select("source_lang", "target_lang", "s_words", "t_words").mapInPandas(run, "part int, way int, x binary, n_x binary, y binary, n_y binary")
    return cut(blocks)


def _cells(words: DataFrame, known: dict[str, dict[str, int]], ways: list[tuple[str, str]], sizes: dict[tuple[str, str], int], base: np.ndarray, wide: np.ndarray, rounds: int, keep: float) -> list[tuple[bytes, bytes]]:
    """(cells, probabilities) of all directions after the rounds, those of at least ``keep``.

    A part of a direction, PART pairs or so, gets the cells its own pairs have and no others; the
    cells of a word are added up and divided by their sum where its bucket is.
    """
    parts = [1 + (sizes.get((a, b), 0) + (a != b) * sizes.get((b, a), 0)) // PART for a, b in ways]
    n = buckets = max(lanes(words.sparkSession), sum(parts))
    packed = _packed(words, known, ways, parts).repartition(n, "part")
    schema = "part int, bucket int, cells binary, n binary"

    def expect(own: pd.DataFrame, cells: pd.DataFrame | None) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"part": np.zeros(0, np.int32), "bucket": np.zeros(0, np.int32), "cells": [], "n": []})
        way, size = int(own["way"].iloc[0]), int(base[own["way"].iloc[0] + 1] - base[own["way"].iloc[0]])
        table = _Table(size, None, None)
        if cells is not None:
            keys, values = _joined(cells, "cells", np.int64) - base[way], _joined(cells, "p", float)
            order = np.argsort(keys)
            table = _Table(size, keys[order], values[order])
        sums = _Sums(size)
        _expect(table, sums, int(wide[way]), tuple(_joined(own, c, np.int32).astype(np.int64) for c in ("x", "n_x", "y", "n_y")))
        keys, values = sums.items()
        return _by(keys // wide[way] % buckets, keys + base[way], values).rename(columns={"of": "bucket"}).assign(part=np.int32(own["part"].iloc[0]))[["part", "bucket", "cells", "n"]]

    def divide(low: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            keys, values = _joined(pdf, "cells", np.int64), _joined(pdf, "n", float)
            part = np.repeat(pdf["part"].to_numpy(), pdf["cells"].map(len).to_numpy() // 8)
            cell, at = np.unique(keys, return_inverse=True)
            way = np.searchsorted(base, cell, "right") - 1
            counts = np.bincount(at, values, len(cell))
            _, word = np.unique(base[way] + (cell - base[way]) // wide[way], return_inverse=True)
            p = (counts / np.bincount(word, counts)[word])[at]
            high = p > low
            return _by(part[high], keys[high], p[high]).rename(columns={"of": "part", "n": "p"})

        return run

    state = packed.groupBy("part").applyInPandas(lambda own: expect(own, None), schema)
    for k in range(rounds):
        if k:
            state = packed.groupBy("part").cogroup(state.repartition(n, "part").groupBy("part")).applyInPandas(expect, schema)
        state = state.repartition(n, "bucket").groupBy("bucket").applyInPandas(divide(0.01 if k else 0.0), "part int, cells binary, p binary")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, values = _joined(pdf, "cells", np.int64), _joined(pdf, "p", float)
            keys, first = np.unique(keys[values >= keep], return_index=True)  # parts that share a cell hold the same value
            yield pd.DataFrame({"cells": [keys.tobytes()], "p": [values[values >= keep][first].tobytes()]})

    return [(r["cells"], r["p"]) for r in state.mapInPandas(kept, "cells binary, p binary").collect()]


def _joined(pdf: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[column]), kind)


def _by(of: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """One row for each part or bucket with its cells and figures."""
    order = np.argsort(of, kind="stable")
    of, keys, values = of[order], keys[order].astype(np.int64), values[order]
    names, first = np.unique(of, return_index=True)
    ends = [*first[1:], len(of)]
    rows = [(keys[a:b].tobytes(), values[a:b].tobytes()) for a, b in zip(first, ends)]
    return pd.DataFrame({"of": names.astype(np.int32), "cells": [x for x, _ in rows], "n": [y for _, y in rows]})
