"""Problem 10: per-document text statistics and what is not running prose."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import language_of
from weft.session import cut, small_table

WORD = re.compile(r"[^\W\d_]+")
_END = frozenset(".!?؟。！？۔…")
_CLOSE = "\"'”»’）)]“ \t\xa0\u202f"
SENTENCE = re.compile(r"[.!?؟。！？۔…]+[\"'”»’）)\]“]*(?=\s|$|[一-鿿“（])|\n\s*\n")
MARKER = re.compile(r"^\s*(?:[-*•◦▪►✓☑☐✗●○■□→–—·»]\s+|\(?[\da-zA-Z٠-٩۰-۹]{1,3}[.)\]:]\s+|[一二三四五六七八九十]+[、.]\s*|\[[ xX✓]?\]\s*)")
GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S|\t|$)")
FIELD = re.compile(r"[\d٠-٩۰-۹][\d٠-٩۰-۹.,:/%٪-]*$|[A-Z]{1,3}[-/]?\d[\d/-]*$|n/a$|x$|[—–-]$")
GLOSS = re.compile(r"\S\s+[:=–—]\s+\S|\S:\s+\S|\.{4,}|(?: \.){4,}|\S; \S|…{2,}")
LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|…+\s*\d+\s*$")
BAR = re.compile(r"(?:^|\s)[¦│‖┃~](?=\s|$)")
RULE = re.compile(r"[+|=─━┼╋*:-]{5,}$")
UNSPACED = re.compile(r"[一-鿿฀-๿]")
STATS = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "lines", "words_a_line", "end_share", "common_share", "repeat_share", "few_share", "list_share", "table_share", "prose_share")
SKETCHED = ("mean_word_length", "symbol_ratio", "digit_ratio", "words_a_line", "end_share", "common_share", "repeat_share", "few_share", "list_share", "table_share", "prose_share")


def ended(line: str) -> bool:
    """Whether a line ends with the end of a sentence, closing quotes and brackets aside."""
    s = line.rstrip(_CLOSE)
    return s[-1:] in _END and bool(s)


def tokens(text: str) -> list[str]:
    """Words in lower case; pairs of neighbouring letters where a script writes no spaces."""
    out = WORD.findall(text.lower())
    if UNSPACED.search(text):
        more = []
        for w in out:
            if UNSPACED.match(w):
                more += [w[i : i + 2] for i in range(max(1, len(w) - 1))]
            else:
                more.append(w)
        out = more
    return out


def _fields(line: str) -> int:
    """Number of fields of a table row, 1 for anything else."""
    s = line.strip()
    if "\t" in s:
        return s.count("\t") + 1
    stop = ended(s)
    for mark in "|;":
        if s.count(mark) >= 2:
            return s.count(mark) + 1
    if not s.isascii() and (bars := len(BAR.findall(s))) >= 2:
        return bars + 1
    if RULE.match(s):
        return 2
    if stop and "  " not in s:
        return 1
    parts = s.split()
    gaps = len(GAPS.findall(s)) if "  " in s else 0
    if gaps >= 2 and (gaps < 0.6 * (len(parts) - 1) or len(parts) < 8 and not stop):
        return gaps + 1
    if stop or len(s) > 200:
        return 1
    like = sum(1 for p in parts if FIELD.match(p)) if parts else 0
    if gaps == 1 and like >= 1 and len(s) < 90:
        return 2
    if len(parts) >= 3 and (like >= 0.5 * len(parts) or like >= 3 and FIELD.match(parts[0]) and FIELD.match(parts[-1])):
        return len(parts)
    if like and s.count(",") >= 2 and sum(1 for p in s.split(",") if FIELD.match(p.strip())) >= 2:
        return s.count(",") + 1
    return 1


def shares(text: str) -> tuple[float, float, float, list[str]]:
    """(list, table, prose) shares of the non-blank characters, and the paragraphs taken for prose.

    Wrapped lines are put together first: a line that does not end a sentence goes on in the next one
    where that begins in lower case, or where its first word would not have fitted in the width.
    """
    kinds: Counter[str] = Counter()
    prose: list[str] = []
    stretch: list[str] = []

    def close() -> None:
        if not stretch:
            return
        width = max(map(len, stretch))
        para: list[str] = []
        paras: list[tuple[str, int]] = []
        for i, line in enumerate(stretch):
            para.append(line)
            go = False
            if i + 1 < len(stretch) and not ended(line):
                nxt = stretch[i + 1].lstrip()
                first = nxt.split(maxsplit=1)[0] if nxt else ""
                fits = len(line) + 1 + len(first) <= width
                spaced = not UNSPACED.search(line)
                go = nxt[:1].islower() or (width >= 25 and not fits and len(line) >= 20) or (not spaced and width >= 24 and len(line) >= width - 2)
            if not go:
                paras.append((" ".join(para), len(para)))
                para = []
        for p, n in paras:
            size = len(p) - p.count(" ")
            words = p.count(" ") + 1
            unspaced = words < 0.12 * size and not p.isascii() and len(UNSPACED.findall(p)) > 0.4 * size
            long_enough = unspaced and size >= 22 or words >= 9
            if long_enough or (words >= 3 or unspaced) and SENTENCE.search(p):
                kinds["prose"] += size
                prose.append(p)
            else:
                kinds["list"] += size
        stretch.clear()

    for line in text.splitlines():
        if not line.strip():
            close()
            continue
        size = sum(map(len, line.split()))
        n = _fields(line)
        if n >= 2:
            close()
            kinds["table"] += size
        elif MARKER.match(line) and not (ended(line) and line.count(" ") >= 11):
            close()
            kinds["list"] += size
        elif len(line) < 160 and (not ended(line) and line.count(" ") <= 60 and (GLOSS.search(line) and len(line.split()) <= 14 or LEADER.search(line))):
            close()
            kinds["list"] += size
        else:
            stretch.append(line)
    close()
    total = max(1, sum(kinds.values()))
    return kinds["list"] / total, kinds["table"] / total, kinds["prose"] / total, prose


PIECE = re.compile(r"[^.!?؟。！？۔…\n]+")
ORDINARY = frozenset(".,;:!?'\"()-/%،؛؟。，：；！？“”«»、۔–’…")
_KINDS: dict[str, str] = {}


def measure(text: str, common: frozenset[str] | set[str]) -> tuple:
    """Language and the figures of STATS of one text."""
    toks = tokens(text)
    chars, counted = Counter(text), Counter(toks)
    letters = digits = ordinary = blank = 0
    for c, n in chars.items():
        kind = _KINDS.get(c)
        if kind is None:
            kind = _KINDS[c] = "l" if c.isalpha() or unicodedata.combining(c) or "\u0e31" <= c <= "\u0e4e" else "d" if c.isdigit() else "o" if c in ORDINARY else "w" if c.isspace() else "s"
        if kind == "l":
            letters += n
        elif kind == "d":
            digits += n
        elif kind == "o":
            ordinary += n
        elif kind == "w":
            blank += n
    size = max(1, len(text) - blank)
    symbols = max(0, size - letters - digits - ordinary)
    lines = [x for x in text.splitlines() if x.strip()]
    stops = sum(map(ended, lines))
    li, ta, pr, prose = shares(text)
    known = sum(n for w, n in counted.items() if w in common)
    parts = [p for x in PIECE.findall(text) if len(p := x.strip()) > 3]
    top = max(counted.values(), default=0) / len(toks) if len(toks) >= 12 else 0.0
    dup = 1 - len(set(parts)) / len(parts) if len(parts) >= 4 else 0.0
    few = 1 - len(counted) / len(toks) if len(toks) >= 12 else 0.0
    words = len(toks)
    return (
        language_of(text, chars, counted), words, sum(map(len, toks)) / words if words else 0.0, symbols / size, digits / size, len(lines), words / max(1, len(lines)), stops / len(lines) if lines else 0.0,
        known / words if words else 0.0, max(dup, top), few, li, ta, pr,
    )


def _group(words: set[str]) -> str:
    """The script most of a text's words are written in; a word counts by its first letter."""
    n: dict[str, int] = {}
    for w in words:
        o = ord(w[0])
        k = "la" if o < 0x250 else "ru" if o < 0x530 else "ar" if o < 0x800 else "th" if o < 0x1000 else "zh"
        n[k] = n.get(k, 0) + 1
    return max(n, key=lambda k: n[k]) if n else "und"


def common_words(docs: DataFrame, share: float = 0.01, least: int = 3) -> DataFrame:
    """(lang, word): words in at least ``share`` of the documents in one script, over all documents.

    Document counts are summed within each task before the shuffle and written once; totals and words
    are read from there.  Scripts are detected, since the table's language is partly wrong.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: dict[tuple[str, str], int] = {}
            for t in pdf["text"]:
                if t:
                    own = set(tokens(t))
                    lang = _group(own)
                    n[(lang, "")] = n.get((lang, ""), 0) + 1
                    for w in own:
                        n[(lang, w)] = n.get((lang, w), 0) + 1
            keys = list(n)
            yield pd.DataFrame({"lang": [k[0] for k in keys], "word": [k[1] for k in keys], "n": list(n.values())}).astype({"lang": object, "word": object, "n": "int64"})

    counts = docs.select("text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts.where((F.col("n") >= least) | (F.col("word") == "")))
    totals = counts.where(F.col("word") == "").select("lang", F.col("n").alias("total"))
    return counts.where(F.col("word") != "").join(totals, "lang").where(F.col("n") >= share * F.col("total")).select("lang", "word")


def statistics(docs: DataFrame) -> DataFrame:
    """The figures of STATS of every document.

    Null and empty texts have language 'und' and zeros; null ids are left out, extra columns ignored.
    The workers get the common words: of each of five scripts at most 1/share (100) times the mean
    number of different words of its documents, since each stands in that share of them.
    """
    rows = common_words(docs).select("word").distinct().collect()
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["word"] for r in rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value
        for pdf in batches:
            got = [measure(t or "", common) for t in pdf["text"]]
            out = pd.DataFrame(got, columns=["language", *STATS])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out.astype({"words": "int64", "lines": "int64"})

    schema = "doc_id long, language string, " + ", ".join(f"{c} {'long' if c in ('words', 'lines') else 'double'}" for c in STATS)
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, schema)


def sketches(stats: DataFrame) -> DataFrame:
    """One mergeable quantile sketch of each figure per language; partial sketches are merged in the shuffle."""
    return stats.groupBy("language").agg(F.count(F.lit(1)).alias("documents"), *[F.kll_sketch_agg_double(c).alias(c) for c in SKETCHED])


#: Least spread of a figure, so that a language whose documents are all alike does not flag trifles.
FLOOR = {
    "mean_word_length": 0.6, "symbol_ratio": 0.02, "digit_ratio": 0.02, "words_a_line": 8.0, "end_share": 0.15, "common_share": 0.04, "repeat_share": 0.06, "few_share": 0.1,
    "list_share": 0.05, "table_share": 0.05, "prose_share": 0.05,
}
#: Documents that the sketch over all languages weighs beside a language's own; texts without a language have only that.
PRIOR = 20


def percentiles(stats: DataFrame) -> DataFrame:
    """Every figure with its rank within the language (``*_pct``) and its robust z-score (``*_z``).

    Quantiles of a language are read from its sketches and drawn towards those of all languages, whose
    sketches are the merged ones, with the weight of PRIOR documents.
    """
    grid = F.array(*[F.lit(i / 100) for i in range(101)])
    own = cut(sketches(stats))
    languages = own.select("language", "documents", *[F.kll_sketch_get_quantile_double(c, grid).alias(c) for c in SKETCHED]).collect()  # nine rows at most
    merged = [F.kll_sketch_get_quantile_double(F.kll_merge_agg_double(c), grid).alias(c) for c in SKETCHED]
    pooled = own.agg(*merged).first() if languages else None  # nothing can be read from a sketch of nothing
    rows = []
    for r in languages:
        w = 0.0 if r["language"] == "und" else r["documents"] / (r["documents"] + PRIOR)
        rows.append((r["language"], *[[w * a + (1 - w) * b for a, b in zip(r[c], pooled[c])] for c in SKETCHED]))
    sketched = small_table(stats.sparkSession, rows, "language string, " + ", ".join(f"{c}_grid array<double>" for c in SKETCHED))
    joined = stats.join(F.broadcast(sketched), "language")

    def at(c: str, i: int):
        return F.element_at(f"{c}_grid", i + 1)

    def rank(c: str):
        return F.round(F.size(F.filter(f"{c}_grid", lambda q: q <= F.col(c))) / 101, 4).alias(f"{c}_pct")

    def score(c: str):
        spread = F.greatest((at(c, 75) - at(c, 25)) / 1.349, F.lit(FLOOR[c]))
        return F.round((F.col(c) - at(c, 50)) / spread, 3).alias(f"{c}_z")

    return joined.select(*stats.columns, *map(rank, SKETCHED), *map(score, SKETCHED))


#: Least z-scores, by sign, that mark a tail.
LOW_PROSE, NOISE, LOUD, UNKNOWN, REPEATED = -9.6, 6.0, 15.0, -8.4, 7.0


def shapes(scored: DataFrame) -> DataFrame:
    """doc_id, shape: list, table, junk, prose, by the tails of the distributions the document lies in.

    Far less prose than its language has makes a list or a table, whichever share lies farther out.
    Junk has a tail of unknown words in running text, of symbols, of symbols and unknown words, of
    repetition, or of few different words said over and over; a text without a word is junk unless it
    is figures.
    """
    z = lambda c: F.col(f"{c}_z")
    not_prose = z("prose_share") < LOW_PROSE
    unknown = (z("common_share") < UNKNOWN) & ~not_prose & (F.col("words") >= 5)
    noise = (z("symbol_ratio") > LOUD) | (z("symbol_ratio") > NOISE) & (z("table_share") < 2 * NOISE)
    menu = (z("symbol_ratio") > NOISE) & (z("common_share") < -REPEATED) & (z("digit_ratio") < -2)
    said_again = (z("repeat_share") > REPEATED) & (z("prose_share") > LOW_PROSE - 2)
    few = (z("few_share") > 2.8) & (z("repeat_share") > 1) & (z("few_share") + z("repeat_share") > 5) & (z("digit_ratio") < -2) & z("words_a_line").between(-2, 8)
    wordless = (F.col("words") == 0) & (F.col("digit_ratio") < 0.1)
    shape = (
        F.when(wordless | noise | menu | unknown | said_again | few, "junk")
        .when(not_prose & (z("table_share") >= z("list_share")), "table")
        .when(not_prose, "list")
        .otherwise("prose")
    )
    return scored.withColumn("shape", shape)


def found(docs: DataFrame) -> DataFrame:
    """Documents that are not prose by most of their text, with their shape (p10_found).

    Empty and null texts carry no message and come out as junk.  The figures, a hundred bytes a
    document, are written once: the sketches and the scores both read them.
    """
    return shapes(percentiles(cut(statistics(docs)))).where(F.col("shape") != "prose").select("doc_id", "shape")
