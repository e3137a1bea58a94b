"""Problem 1: noise in text from scanned pages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import Counts
from weft.session import cut, lanes

HYPHENS = "‐‑\u00ad¬⁃-"
BREAK = re.compile(rf"([^\s]*[^\W\d_])[{HYPHENS}][ \t\xa0]*$")
_BREAKS = tuple(HYPHENS)


def hyphen_at_end(line: str) -> re.Match | None:
    """The match of BREAK, looked for only where a line ends with a hyphen."""
    return BREAK.search(line) if line.rstrip(" \t\xa0").endswith(_BREAKS) else None


#: A break whose line end was lost.
INLINE = re.compile(rf"([^\W\d_]{{2,}})[{HYPHENS}] +([^\W\d_]{{2,}})")
TOKEN = re.compile(r"[^\W_](?:[^\s«»“”„()\[\]{}|•…<>=+*;!?؟،؛。，]*[^\W_])?")
SEPARATOR = r"[\s|•·:;,،—–-]"
NUMBER = r"(?:[\d٠-٩۰-۹lIOo]{1,4})"
WORD_FOR_PAGE = r"(?:p|pp|page|pag|s|с|стр|sayfa|sf|ص|صفحة|صفحه)\.?"
ROMAN = r"(?:(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))"
MARKED = rf"(?:\[\s*{NUMBER}\s*\]|\(\s*{NUMBER}\s*\)|[-–—]\s*{NUMBER}\s*[-–—]|{WORD_FOR_PAGE}\s*{NUMBER}(?:\s*/\s*{NUMBER})?|{NUMBER}\s*/\s*{NUMBER}|[-–—]?{NUMBER}[-–—]?|{ROMAN}\b)"
WHOLE_NUMBER = re.compile(rf"^\s*{MARKED}\s*$", re.I)
TAIL_NUMBER = re.compile(rf"(?:\s*[|•·—–]\s*|\s+)({MARKED})\s*$", re.I)
LEAD_NUMBER = re.compile(rf"^\s*({MARKED})(?:\s*[|•·—–]\s*|\s{{1,}})", re.I)
DIGITS = re.compile(r"[\d٠-٩۰-۹]+")
# Pairs of letters that a scan takes for one, and the one.
PAIRS = (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ni", "m"), ("in", "m"), ("lc", "k"), ("il", "u"), ("nn", "m"), ("ln", "m"), ("ti", "n"), ("fi", "h"), ("ci", "a"), ("ij", "y"), ("ll", "u"), ("iu", "m"))
#: Times, and least share of all words, that the corpus must hold a word for it to be in the lexicon.
LEAST, LEAST_SHARE = 2, 1e-7
#: Times, and least share of all words, for a word to be what another is misread from.
FREQUENT, FREQUENT_SHARE = 20, 1e-5
#: Pages of a group on which a line must stand at the top or foot to be a running line of that part of a long file.
CHAPTER = 16
#: Pages per group of a file that one task treats; a file of any length is cut into such groups.
CHUNK = 64
#: Files the line model is fitted on at most; it has four states and a few dozen figures.
SAMPLE_FILES = 200
STATES = ("body", "head", "number", "break")


# ---------------------------------------------------------------- lines


def lines_of(text: str | None, cells) -> list[tuple[int, str]]:
    """(part, line) of a block: part -1 for the text, else the number of the cell."""
    out = []
    if text:
        out += [(-1, x) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    if cells is not None:
        for k, c in enumerate(cells):
            if c:
                out += [(k, x) for x in c.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
    return out


def without_number(line: str) -> tuple[str, int | None, bool]:
    """(line without a printed page number, the number, whether anything else is left)."""
    if WHOLE_NUMBER.match(line):
        return "", value(line), False
    m = TAIL_NUMBER.search(line)
    if m and line[: m.start()].strip():
        return line[: m.start()], value(m[1]), True
    m = LEAD_NUMBER.match(line)
    if m and line[m.end() :].strip():
        return line[m.end() :], value(m[1]), True
    return line, None, True


def value(mark: str) -> int | None:
    bare = mark.strip(" []()-–—|•·\t").lower()
    if re.fullmatch(ROMAN, bare):
        figures = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in bare]
        return sum(-a if a < b else a for a, b in zip(figures, [*figures[1:], 0]))
    found = re.search(NUMBER, mark.replace("ص", " "))
    m = DIGITS.search(mark)
    if m and len(m[0]) <= 4:
        try:
            return int("".join(str(int(c)) for c in m[0]))
        except ValueError:
            return None
    return 0 if found else None


_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "6": "b", "8": "b", "9": "g"})


@lru_cache(maxsize=50_000)
def key_of(line: str) -> str:
    """Comparable form of a line: no page number, one kind of space, letters a scan confuses made equal."""
    rest = without_number(line)[0]
    return re.sub(r"[\W_]+", " ", rest.lower().translate(_FOLD)).strip()


def near(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 0.25 * max(len(a), len(b)) + 1:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.8


# ---------------------------------------------------------------- words


def shape_of(token: str) -> str:
    return "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)


@dataclass
class Lexicon:
    """Counts of words, of words with a capital and of compounds; the frequent words; shapes of tokens; how many tokens there are."""

    words: Counts
    compounds: Counts
    capital: Counts
    frequent: dict[str, int]
    shapes: dict[str, int]
    total: int
    patterns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._known: dict[str, str | None] = {}
        self._judged: dict[str, str | None] = {}
        for w, n in self.frequent.items():
            for i in range(len(w)):
                p = w[:i] + "*" + w[i + 1 :]
                have = self.patterns.get(p)
                if have is None or self.frequent[have] < n:
                    self.patterns[p] = w

    def __reduce__(self):
        return Lexicon, (self.words, self.compounds, self.capital, self.frequent, self.shapes, self.total)

    def count(self, word: str) -> int:
        return self.words.get(word) or self.compounds.get(word)

    def correction(self, word: str) -> str | None:
        """The frequent word that ``word`` is a misreading of, if there is one."""
        if word not in self._known:
            if len(self._known) > 300_000:
                self._known.clear()
            self._known[word] = self._correction(word)
        return self._known[word]

    def _correction(self, word: str) -> str | None:
        w = word.lower()
        n = max(self.words.get(w, 0), LEAST - 1)
        size = len(w)
        if size < 2:
            return None
        need = 400 if size == 2 else 200 if size == 3 else 120 if size == 4 else 40 if size == 5 else 20 if size < 8 else 12
        words = self.words
        if word[:1].isupper() and word[1:].islower():
            if word[0] == "I" and words.get("l" + w[1:], 0) >= max(20, need * n):
                return "l" + w[1:]
            # a capital speaks for a name unless the word meant is itself often written with one
            words = self.capital
            n = max(words.get(w, 0), LEAST - 1)
        best = None
        for i in range(size):
            c = self.patterns.get(w[:i] + "*" + w[i + 1 :])
            if c is not None and c != w and (best is None or self.words[c] > self.words[best]):
                best = c
        for pair, one in PAIRS:
            for old, new in ((pair, one), (one, pair)):
                at = w.find(old)
                while at >= 0:
                    c = w[:at] + new + w[at + len(old) :]
                    if c in self.words and (best is None or self.words[c] > self.words[best]):
                        best = c
                    at = w.find(old, at + 1)
        return best if best is not None and words.get(best, 0) >= max(20, need * n) else None


def tokens_of(line: str) -> list[str]:
    return TOKEN.findall(line)


def plain_tokens(lines: list[tuple[int, str]]) -> list[str]:
    """Tokens of a block without the pieces of words cut at line ends."""
    out: list[str] = []
    after = False
    for _, line in lines:
        got = tokens_of(line)
        cut = bool(hyphen_at_end(line))
        if after:
            got = got[1:]
        if cut:
            got = got[:-1]
        out += got
        after = cut
    return out


def split_token(token: str) -> list[str]:
    return [p for p in re.split(r"['’/\-‐‑.,:%٪]+", token) if p]


def misread(token: str, lexicon: Lexicon) -> str | None:
    """A reason why the token is a misreading: a mixed shape or a frequent word one confusion away."""
    if token not in lexicon._judged:
        if len(lexicon._judged) > 300_000:
            lexicon._judged.clear()
        lexicon._judged[token] = _misread(token, lexicon)
    return lexicon._judged[token]


def _misread(token: str, lexicon: Lexicon) -> str | None:
    total = lexicon.total
    has_digit = any(c.isdigit() for c in token)
    has_letter = any(c.isalpha() for c in token)
    if has_digit and has_letter:
        shape = shape_of(token)
        common = lexicon.shapes.get(shape, 0)
        if common * 400 >= total:
            return None
        if any(any(c.isdigit() for c in p) and any(c.isalpha() for c in p) for p in split_token(token)) or common * 4000 < total:
            return "shape"
        return None
    if has_digit:
        return None
    for p in split_token(token):
        if len(p) >= 2 and lexicon.correction(p):
            return "word"
        if len(p) >= 4 and re.search(r"[a-zà-ÿ][A-Z][a-zà-ÿ]", p) and lexicon.words.get(p.lower(), 0) < 5:
            return "case"
    return None


def is_split(front: str, rest: str, lexicon: Lexicon) -> bool:
    """Whether front + hyphen + line break + rest is one word cut in two, not a compound, range or code."""
    a = re.split(r"[\s«»“”„(\[]", front)[-1]
    m = TOKEN.match(rest.strip().lstrip("«»“”(["))
    b = m[0] if m else ""
    if not a or not b:
        return False
    if any(c.isdigit() for c in a[-1] + b[0]) or not a[-1].isalpha() or not b[0].isalpha():
        return False
    if b[0].isupper() and not a[-1].isupper():
        return False
    if a.isupper() and len(a) <= 3:
        return False
    last, first = re.split(r"[-'’/]", a)[-1].lower(), re.split(r"[-'’/]", b)[0].lower()
    joined = lexicon.words.get(last + first, 0)
    compound = (a + "-" + b).lower()
    if max(lexicon.compounds.get(compound), lexicon.compounds.get(f"{last}-{first}")) >= 5:
        return joined > 20 * lexicon.compounds.get(f"{last}-{first}", 5)
    if joined >= LEAST:
        return True
    if lexicon.words.get(last, 0) >= 20 and lexicon.words.get(first, 0) >= 20 and len(last) >= 3 and len(first) >= 2:
        return False
    return True


def opening(lines: list[tuple[int, str]]) -> bool:
    return len(lines) == 1 or len(lines) > 1 and len(lines[0][1]) < 60  # a running line may open the block


def keys_of(token: str) -> list[tuple[str, str]]:
    """What a token counts as: words (w), words with a capital (u), compounds (c), shapes of codes (s), tokens (t)."""
    if any(map(str.isdigit, token)):
        return [("s", shape_of(token))] if any(map(str.isalpha, token)) else []
    out = [("t", "")]
    if "-" in token:
        out.append(("c", token.lower()))
    for p in split_token(token):
        low = p.lower()
        out.append(("w", low))
        if p[0].isupper() and p[1:].islower():
            out.append(("u", low))
    return out


# ---------------------------------------------------------------- line model


FEATURES = (4, 3, 4, 4, 4)  # place on the page, likeness to a running line, number, break, kind
#: Values of the break feature: no hyphen at the line's end, a word cut in two, a hyphen without a sign of that, not judged yet.
NO_HYPHEN, CUT, WHOLE, OPEN = range(4)


def features(lines: list[dict], templates: list[str], offsets: set[int]) -> list[list[int]]:
    """Layout features of the lines of one page, in reading order; hyphens are not judged."""
    n = len(lines)
    out = []
    for i, x in enumerate(lines):
        line = x["line"]
        edge = i == 0 or i == n - 1
        close = i < 2 or i >= n - 2 or len(line) <= 14
        key = key_of(line) if close else ""
        alike = number_is = 0
        if key and templates and x["part"] < 0:
            if key in templates:
                alike = 2
            elif edge and any(near(key, t) for t in templates):
                alike = 1
        _, number, more = without_number(line) if close and x["part"] < 0 else ("", None, True)
        if number is not None:
            fits = number - x["page"] in offsets or not offsets
            number_is = (3 if alike and fits else 0) if more else 1 if fits or edge and number < 1500 else 2
        hyphen = OPEN if hyphen_at_end(line) or "-" in line and INLINE.search(line) else NO_HYPHEN
        out.append([2 if n == 1 else 0 if i == 0 else 1 if i == n - 1 else 3, alike, number_is, hyphen, {"header": 1, "footer": 2, "heading": 3}.get(x["kind"], 0)])
    return out


@dataclass
class LineModel:
    """Hidden Markov model of the lines of a page."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def __post_init__(self) -> None:
        self._start, self._move = np.log(self.start).tolist(), np.log(self.move).T.tolist()
        self._emit = [np.log(e).T.tolist() for e in self.emit]
        self._seen: dict[tuple[int, ...], list[float]] = {}
        self._pages: dict[tuple[tuple[int, ...], ...], list[int]] = {}

    def score(self, x: list[int]) -> list[float]:
        """Log-likelihood of one line's features in each state."""
        key = tuple(x)
        got = self._seen.get(key)
        if got is None:
            got = self._seen[key] = [sum(v) for v in zip(*(e[k] for e, k in zip(self._emit, x)))]
        return got

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum(np.log(e[:, x[:, k]]).T for k, e in enumerate(self.emit))

    def decode(self, rows: list[list[int]]) -> list[int]:
        """Most likely states; pages that look alike are decoded once."""
        if not rows:
            return []
        key = tuple(map(tuple, rows))
        if key not in self._pages:
            if len(self._pages) > 50_000:
                self._pages.clear()
            self._pages[key] = self._viterbi(rows)
        return self._pages[key]

    def _viterbi(self, rows: list[list[int]]) -> list[int]:
        best, back = [a + b for a, b in zip(self._start, self.score(rows[0]))], []
        for x in rows[1:]:
            via, own = [], []
            for into, here in zip(self._move, self.score(x)):
                ways = [a + b for a, b in zip(best, into)]
                top = max(ways)
                via.append(ways.index(top))
                own.append(top + here)
            back.append(via)
            best = own
        path = [best.index(max(best))]
        for via in reversed(back):
            path.append(via[path[-1]])
        return path[::-1]


def first_model() -> LineModel:
    """Starting figures: what each state looks like before any page has been seen."""
    emit = [
        np.array([[0.2, 0.15, 0.05, 0.6], [0.8, 0.08, 0.1, 0.02], [0.03, 0.85, 0.1, 0.02], [0.15, 0.15, 0.05, 0.65]]),
        np.array([[0.988, 0.01, 0.002], [0.0005, 0.2, 0.7995], [0.97, 0.02, 0.01], [0.988, 0.01, 0.002]]),
        np.array([[0.985, 0.003, 0.01, 0.002], [0.66, 0.01, 0.01, 0.32], [0.0002, 0.93, 0.0598, 0.01], [0.985, 0.003, 0.01, 0.002]]),
        np.array([[0.95, 0.002, 0.03, 0.018], [0.97, 0.001, 0.009, 0.02], [0.97, 0.001, 0.009, 0.02], [0.004, 0.94, 0.006, 0.05]]),
        np.array([[0.85, 0.03, 0.03, 0.09], [0.3, 0.45, 0.05, 0.2], [0.3, 0.1, 0.5, 0.1], [0.85, 0.03, 0.03, 0.09]]),
    ]
    move = np.array([[0.8, 0.01, 0.06, 0.13], [0.84, 0.02, 0.02, 0.12], [0.6, 0.2, 0.1, 0.1], [0.9, 0.01, 0.02, 0.07]])
    return LineModel(np.array([0.45, 0.4, 0.05, 0.1]), move, emit)


#: Lines that the starting figures of each emission weigh; likeness, number and break say what a state is and weigh more.
PRIOR = (40, 200_000, 200_000, 200_000, 40)


def fit(pages: list[np.ndarray], rounds: int = 4) -> LineModel:
    """Expectation maximisation over the pages of a bounded sample, from ``first_model``, whose figures stay as prior counts."""
    model = first_model()
    for _ in range(rounds if pages else 0):
        prior = first_model()
        start, move = prior.start * 20, prior.move * 40
        emit = [e * weight for e, weight in zip(prior.emit, PRIOR)]
        for x in pages:
            s = model.scores(x)
            p = np.exp(s - s.max(1, keepdims=True))
            n = len(x)
            a = np.zeros((n, 4))
            b = np.ones((n, 4))
            a[0] = model.start * p[0]
            a[0] /= a[0].sum()
            for t in range(1, n):
                a[t] = (a[t - 1] @ model.move) * p[t]
                a[t] /= a[t].sum()
            for t in range(n - 2, -1, -1):
                b[t] = model.move @ (p[t + 1] * b[t + 1])
                b[t] /= b[t].sum()
            g = a * b
            g /= g.sum(1, keepdims=True)
            start += g[0]
            for t in range(n - 1):
                z = a[t][:, None] * model.move * (p[t + 1] * b[t + 1])[None, :]
                move += z / z.sum()
            for k, e in enumerate(emit):
                np.add.at(e.T, x[:, k], g)
        model = LineModel(start / start.sum(), move / move.sum(1, keepdims=True), [e / e.sum(1, keepdims=True) for e in emit])
    return model


@dataclass
class Line:
    """A line in reading order, its state, and where the word it breaks off goes on."""

    block: int
    page: int
    part: int
    line: str
    context: bool
    rows: list[int]
    state: str = ""
    goes_on: int | None = None
    ends_cut: bool = False


def label(pages: list[tuple[int, list[dict]]], templates: list[str], offsets: set[int], model: LineModel, lexicon: Lexicon) -> list[Line]:
    """The lines of a group of pages with their states.

    The pages are decoded, hyphens at line ends are judged by the body lines that follow and by the
    lexicon, and pages with hyphens are decoded again: whether a line breaks off in the middle of a
    word is what its label says, from that judgement, its place and the lines around it.
    """
    out: list[Line] = []
    spans = []
    for page, lines in pages:
        rows = features(lines, templates, offsets)
        states = model.decode(rows)
        spans.append((len(out), len(out) + len(lines)))
        out += [Line(x["block"], page, x["part"], x["line"], x["context"], r, STATES[k]) for x, r, k in zip(lines, rows, states)]
    judge_hyphens(out, lexicon)
    for a, b in spans:
        if any(x.rows[3] for x in out[a:b]):
            for x, k in zip(out[a:b], model.decode([x.rows for x in out[a:b]])):
                x.state = STATES[k]
    return out


def judge_hyphens(lines: list[Line], lexicon: Lexicon) -> None:
    """Set the break feature of body lines with hyphens, and the line the word goes on in where that is known.

    Within a block that is the next line; at the end of a block the first line of a later block on the
    same or the next page that completes a known word.
    """
    body = [i for i, x in enumerate(lines) if x.state in ("body", "break")]
    for at, i in enumerate(body):
        x = lines[i]
        if x.rows[3] == NO_HYPHEN:
            continue
        inside = any(is_split(m[1], m[2], lexicon) and lexicon.count((m[1] + m[2]).lower()) >= LEAST for m in INLINE.finditer(x.line))
        x.rows[3] = CUT if inside else WHOLE
        m = hyphen_at_end(x.line)
        if not m:
            continue
        nxt = body[at + 1] if at + 1 < len(body) else None
        if nxt is not None and lines[nxt].block == x.block and lines[nxt].part == x.part:
            if is_split(m[1], lines[nxt].line, lexicon):
                x.rows[3], x.ends_cut, x.goes_on = CUT, True, nxt
            continue
        if x.part >= 0:
            continue
        last = re.split(r"[\s«»“”„(\[\-'’/]", m[1])[-1].lower()
        first_of_later = None
        before = i
        for j in body[at + 1 :]:
            if lines[j].page > x.page + 1:
                break
            fresh = lines[j].part < 0 and lines[j].block != lines[before].block
            before = j
            if not fresh:
                continue
            first_of_later = j if first_of_later is None else first_of_later
            t = TOKEN.match(lines[j].line.strip())
            if t and lexicon.count(last + re.split(r"[-'’/]", t[0])[0].lower()) >= LEAST and is_split(m[1], lines[j].line, lexicon):
                x.rows[3], x.ends_cut, x.goes_on = CUT, True, j
                break
        else:
            if len(last) >= 2 and last.isalpha() and lexicon.count(last) < 20 and not m[1].isupper():
                x.rows[3], x.ends_cut = CUT, True
                if first_of_later is not None and lines[first_of_later].line.strip()[:1].islower():
                    x.goes_on = first_of_later


# ---------------------------------------------------------------- operators


COLUMNS = ("file_id", "chunk", "page", "seq", "block_id", "context", "kind", "text", "cells", "templates", "offsets")


def groups(blocks: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Rows of blocks by file and group of CHUNK pages, each group together and in reading order in one partition.

    With ``hints`` the running lines of a group come as its first row, and the first page of the next
    group comes along as context.  Blocks without id, file or page are left out.  This is the only
    shuffle of the texts; rows delivered again meet in their group.
    """
    c = F.col
    chunk = F.floor((c("page") - 1) / CHUNK).cast("int")
    own = blocks.where(c("block_id").isNotNull() & c("file_id").isNotNull() & c("page").isNotNull()).select("file_id", chunk.alias("chunk"), "page", "seq", "block_id", "kind", "text", "cells")
    none = [F.lit(None).cast("array<string>").alias("templates"), F.lit(None).cast("array<long>").alias("offsets")]
    if hints is None:
        rows = own.select("*", F.lit(False).alias("context"), *none)
    else:
        last = F.pmod(c("page") - 1, F.lit(CHUNK)) == 0
        to = F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        rows = own.select("*", to.alias("back"), *none).withColumn("chunk", c("chunk") - c("back")).withColumn("context", c("back") == 1).drop("back")
        rows = rows.unionByName(hints, allowMissingColumns=True)
    return rows.select(*COLUMNS).repartition(lanes(blocks.sparkSession), "file_id", "chunk").sortWithinPartitions("file_id", "chunk", c("page").asc_nulls_first(), c("seq").asc_nulls_last(), "block_id")


def read_groups(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, list[str], set[int], list[tuple[int, list[dict]]]]]:
    """(file, running lines, offsets, pages with their lines) of each group, also where it goes on over batches; a block counts once."""

    def rows() -> Iterator[tuple]:
        for pdf in batches:
            yield from zip(*(pdf[c].tolist() for c in COLUMNS))

    for (file, _), own in groupby(rows(), key=lambda r: r[:2]):
        templates: list[str] = []
        offsets: set[int] = set()
        pages: list[tuple[int, list[dict]]] = []
        seen = set()
        for _, _, page, _, block, context, kind, text, cells, t, o in own:
            if page is None or page != page:
                templates, offsets = [] if t is None else list(t), set() if o is None else set(o)
            elif block not in seen:
                seen.add(block)
                if not pages or pages[-1][0] != page:
                    pages.append((int(page), []))
                pages[-1][1].extend({"block": int(block), "page": int(page), "part": part, "line": line, "kind": kind, "context": bool(context)} for part, line in lines_of(text, cells))
        yield file, templates, offsets, pages


def facts(blocks: DataFrame) -> DataFrame:
    """(kind, file_id, page, key, n): counts of words over all blocks, and the first and last line of every page.

    Words are counted in each task before the shuffle.  A short line that opens a block, or is all of
    it, counts once a file and group of pages however often it comes there: else the names in running
    lines would be frequent words.  Kinds 'top' and 'foot' hold the comparable form of the line and in
    n the number printed in it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter[str] = Counter()
        edges: list[tuple] = []

        def frame() -> pd.DataFrame:
            n: dict[tuple[str, str], int] = {}
            for token, k in tally.items():
                for key in keys_of(token):
                    n[key] = n.get(key, 0) + k
            rows = [(kind, None, None, key, k) for (kind, key), k in n.items()] + edges
            tally.clear(), edges.clear()
            out = pd.DataFrame(rows, columns=["kind", "file_id", "page", "key", "n"], dtype=object)
            return out.astype({"page": "Int32", "n": "Int64"})

        for file, _, _, pages in read_groups(batches):
            met: set[str] = set()
            for page, lines in pages:
                texts = [x["line"] for x in lines if x["part"] < 0]
                for kind, line in (("top", texts[0] if texts else ""), ("foot", texts[-1] if texts else "")):
                    edges.append((kind, file, page, key_of(line), without_number(line)[1] if line else None))
                for _, rows in groupby(lines, key=lambda x: x["block"]):
                    own = [(x["part"], x["line"]) for x in rows]
                    if opening(own):
                        key = key_of(own[0][1])
                        if key in met:
                            own = own[1:]
                        met.add(key)
                    tally.update(plain_tokens(own))
            if len(tally) + len(edges) > 200_000:
                yield frame()
        yield frame()

    return groups(blocks).mapInPandas(run, "kind string, file_id string, page int, key string, n long").groupBy("kind", "file_id", "page", "key").agg(F.sum("n").alias("n"))


def learn_words(known: DataFrame, share: float = LEAST_SHARE, frequent_share: float = FREQUENT_SHARE) -> Lexicon:
    """The lexicon of the counts of ``facts``.

    Words in at least LEAST places and the share ``share`` of all are kept as hashes, so at most
    1/share (ten million) of them; the words that others can be misread from, in at least FREQUENT
    places and the share ``frequent_share``, at most 1/frequent_share, as texts; of the shapes those
    that can be common.
    """
    c = F.col
    total = (known.where(c("kind") == "t").agg(F.sum("n")).first()[0]) or 1
    enough = known.where(c("n") >= max(LEAST, share * total))
    of = lambda kind: Counts.read(enough.where(c("kind") == kind), "key")
    often = known.where((c("kind") == "w") & (c("n") >= max(FREQUENT, frequent_share * total)) & F.length("key").between(2, 24))
    shapes = known.where((c("kind") == "s") & (c("n") * 4000 >= total))
    return Lexicon(of("w"), of("c"), of("u"), {r["key"]: r["n"] for r in often.orderBy("key").collect()}, {r["key"]: r["n"] for r in shapes.collect()}, total)


def running_lines(known: DataFrame) -> DataFrame:
    """(file_id, chunk, templates, offsets): lines that come back at the top or foot of pages, and the usual distances of
    printed numbers from page numbers, for every group of pages.

    A line is a template where it stands on two pages or more and on a quarter of the file's pages, or
    on CHAPTER pages of the group; so a group has at most 16.  A distance counts where it is met
    twice and on a tenth of the pages of the file or the group.
    """
    c = F.col
    edges = known.where(c("kind").isin("top", "foot")).select("file_id", "page", "key", "n", F.floor((c("page") - 1) / CHUNK).cast("int").alias("chunk"))
    whole = edges.groupBy("file_id").agg(F.count_distinct("page").alias("pages"))
    parts = edges.select("file_id", "chunk").distinct()

    def usual(rows: DataFrame, what: str, share: float, least: int) -> DataFrame:
        """(file_id, chunk, what): values met often enough in the file, or in the group."""
        n = rows.groupBy("file_id", "chunk", what).agg(F.count_distinct("page").alias("n"))
        per_file = n.groupBy("file_id", what).agg(F.sum("n").alias("n")).join(whole, "file_id").where((c("n") >= 2) & (c("n") >= share * c("pages"))).select("file_id", what)
        return per_file.join(parts, "file_id").unionByName(n.where(c("n") >= least).select("file_id", what, "chunk")).groupBy("file_id", "chunk").agg(F.sort_array(F.collect_set(what)).alias(what))

    templates = usual(edges.where(c("key") != ""), "key", 0.25, CHAPTER).withColumnRenamed("key", "templates")
    offsets = usual(edges.where(c("n").isNotNull()).withColumn("offset", c("n") - c("page")), "offset", 0.1, -(-CHUNK // 10)).withColumnRenamed("offset", "offsets")
    return parts.join(templates, ["file_id", "chunk"], "left").join(offsets, ["file_id", "chunk"], "left")


def fit_lines(blocks: DataFrame, hints: DataFrame, lexicon: Lexicon, sample_files: int = SAMPLE_FILES) -> LineModel:
    """The line model, fitted on the first CHUNK pages of at most ``sample_files`` files chosen by a hash of their ids."""
    ids = [r["file_id"] for r in hints.where("chunk = 0").orderBy(F.xxhash64("file_id"), "file_id").limit(sample_files).select("file_id").collect()]
    if not ids:
        return first_model()
    some = groups(blocks.where(F.col("file_id").isin(ids) & F.col("page").between(1, CHUNK)), hints.where((F.col("chunk") == 0) & F.col("file_id").isin(ids))).where(~F.coalesce("context", F.lit(False)))
    sample = some.toPandas().sort_values(["file_id", "chunk", "page", "seq", "block_id"], na_position="first", kind="stable")
    first, pages = first_model(), []
    for _, templates, offsets, own in read_groups([sample.astype(object).where(sample.notna(), None)]):
        for _, lines in groupby(label(own, templates, offsets, first, lexicon), key=lambda x: x.page):
            pages.append(np.array([x.rows for x in lines], dtype=np.int8))
    return fit(pages)


def labelled(blocks: DataFrame, run: Callable[[str, list[Line], Lexicon], list[tuple]], schema: str, columns: dict[str, str]) -> DataFrame:
    """The rows that ``run`` makes of the labelled lines of every group."""
    known = cut(facts(blocks))
    lexicon = learn_words(known)
    hints = cut(running_lines(known))
    shared = blocks.sparkSession.sparkContext.broadcast((lexicon, fit_lines(blocks, hints, lexicon)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, model = shared.value
        rows: list[tuple] = []
        frame = lambda: pd.DataFrame(rows, columns=list(columns), dtype=object).astype(columns)
        for file, templates, offsets, pages in read_groups(batches):
            rows += run(file, label(pages, templates, offsets, model, lexicon), lexicon)
            if len(rows) > 20_000:
                yield frame()
                rows.clear()
        yield frame()

    return groups(blocks, hints).mapInPandas(work, schema)


def defects(blocks: DataFrame) -> DataFrame:
    """(block_id, defect): split_word, misread, running_head, page_number, one row per kind and block.

    Blocks delivered again count once.  Null file ids or pages, blank texts and empty cells have no
    lines and so no defect; ties of (page, seq) are read in the order of block_id.
    """

    def run(file: str, lines: list[Line], lexicon: Lexicon) -> list[tuple]:
        out: set[tuple[int, str]] = set()
        begun = {x.goes_on: x for x in lines if x.state == "break" and x.goes_on is not None}
        for i, x in enumerate(lines):
            if x.context:
                continue
            if x.state == "head" and not (x.page == 1 and x.rows[0] in (0, 2)):
                out.add((x.block, "running_head"))
            if x.state == "number" or x.state == "head" and x.rows[2] == 3:
                out.add((x.block, "page_number"))
            if x.state == "break":
                out.add((x.block, "split_word"))
            if x.state == "number":
                continue
            tokens = tokens_of(without_number(x.line)[0] if x.state == "head" else x.line)
            front = begun.get(i)
            if front is not None and tokens:
                first = tokens.pop(0)
                if front.block == x.block and (before := tokens_of(front.line)):
                    tokens.append(before[-1] + first)
            if x.state == "break" and x.ends_cut and tokens and (front is None or len(tokens) > 1):
                tokens.pop()
            if any(misread(t, lexicon) for t in tokens):
                out.add((x.block, "misread"))
        return sorted(out)

    return labelled(blocks, run, "block_id long, defect string", {"block_id": "int64", "defect": "object"})


def found(blocks: DataFrame) -> DataFrame:
    """p1_found."""
    return defects(blocks)


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(file_id, page, block_id, cell, text): clean paragraphs and cells of every file in reading order.

    Running lines and page numbers are left out, lines joined, words cut in two put together (a word
    that goes on over the page ends in its first block), misread words replaced where the word meant
    is known.  ``cell`` is null for text.
    """

    def mend(m: re.Match, lexicon: Lexicon) -> str:
        word = m[0]
        if any(c.isdigit() for c in word) or not word.isalpha():
            return word
        fix = lexicon.correction(word)
        if not fix:
            return word
        return fix[:1].upper() + fix[1:] if word[:1].isupper() else fix

    def run(file: str, lines: list[Line], lexicon: Lexicon) -> list[tuple]:
        texts: dict[tuple[int, int, int], str] = {}
        own: set[int] = set()
        home: dict[int, tuple[int, int, int]] = {}
        begun = {x.goes_on: i for i, x in enumerate(lines) if x.state == "break" and x.goes_on is not None}
        for i, x in enumerate(lines):
            if x.state in ("head", "number"):
                continue
            key = home[i] = (x.page, x.block, x.part)
            line = " ".join(x.line.split())
            if not x.context:
                own.add(x.block)
            if i in begun and begun[i] in home:
                front = home[begun[i]]
                first, _, line = line.partition(" ")
                texts[front] = texts[front].rstrip().rstrip(HYPHENS) + first
                if not line:
                    continue
            texts[key] = f"{texts[key]} {line}" if texts.get(key) else line
        return [(file, page, block, None if part < 0 else part, TOKEN.sub(lambda m: mend(m, lexicon), t)) for (page, block, part), t in texts.items() if block in own]

    return labelled(blocks, run, "file_id string, page int, block_id long, cell int, text string", {"file_id": "object", "page": "int32", "block_id": "int64", "cell": "Int32", "text": "object"})
