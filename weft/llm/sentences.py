"""Problem 5: sentence boundaries across languages and scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import language_of, script_of
from weft.session import cut, lanes

LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
TERMINAL = re.compile(r"[.!?…؟。！？۔।։｡]+")
STRONG = frozenset("!?؟。！？۔।։｡")
OPENERS = "“«„‘「『（([{‹\"'"
CLOSERS = "”»’」』）)]}›\"'“"
MATE = {"“": "”", "«": "»", "„": "“”", "‘": "’", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "”": "“"}
TOKEN = re.compile(r"\S+")
NUMBER = re.compile(r"[\d٠-٩۰-۹][\d٠-٩۰-۹.,:/%٪٫٬-]*$")
#: What opens a list item or a clause and so never is a sentence of its own.
ITEM = re.compile(r"[(\[（]?(?:[\d٠-٩۰-۹]{1,3}(?:\.[\d٠-٩۰-۹]{1,3})*|[^\W\d_])[.)\]）]?$")
FREE_NUMBER = re.compile(r"[\d๐-๙][\d๐-๙.,:/%-]*$")
# Verbs of speaking by which a clause after a quotation belongs to it, for scripts without capitals.
SPEECH = {"zh": "问|说|道|答|喊|叫", "ar": "قال|قالت|سأل|سألت|أجاب|صاح|أضاف", "ur": "کہا|پوچھا|بولا|جواب"}
_SPEECH = {k: re.compile(v) for k, v in SPEECH.items()}


@dataclass
class Model:
    """What was learned: abbreviations, sentence starters and collocations over a period per language, openings of Thai sentences."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    collocations: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    thai_starts: set[str] = field(default_factory=set)


DIGITS = re.compile(r"[\d٠-٩۰-۹]+")


@lru_cache(maxsize=100_000)
def token_type(token: str) -> str:
    """Lower-case form of a token without outer quotes and brackets, digits as one sign."""
    t = token.strip("“”«»„‘’「」『』（）()[]{}‹›\"',;:،؛—–-").lower()
    return DIGITS.sub("#", t)


LATIN = ("en", "fr", "tr")
ARABIC = ("ar", "ur")


def language(text: str, hint: str | None) -> str:
    """The hinted language where the script bears it out, else the detected one."""
    scripts = {script_of(ch) for ch in set(text)} - {""}
    if len(scripts) == 1:  # one script tells the language, or that the hint can be right
        only = next(iter(scripts))
        if only in ("ru", "zh", "th"):
            return only
        if hint in (LATIN if only == "la" else ARABIC):
            return hint
    got = language_of(text)
    return hint if hint and any(hint in g and got in g for g in (LATIN, ARABIC)) else got


# ---------------------------------------------------------------- statistics

THAI_PREFIX = 4
#: Share of the periods after a type that a collocation makes up at least; so each type has at most its inverse of them.
LEAST_SHARE = 1e-4


def count_unit(text: str, n: dict[tuple[str, str, str], int], hint: str | None = None) -> None:
    """Add the counts of one text to ``n``: (language, kind, type).

    Kinds: p with a period, e of these at the end of a line, w without, s after a sure sentence end,
    c a type with a period and the type after it, t and u Thai openings at line starts and after
    numbers; N, P, E, S the totals of w+p, p, e, s.
    """
    lang = language(text, hint)
    got: dict[tuple[str, str], int] = {}

    def add(kind: str, key: str) -> None:
        got[kind, key] = got.get((kind, key), 0) + 1

    for line in LINE.findall(text):
        words = line.split()
        if lang == "th":
            if words:
                add("t", words[0][:THAI_PREFIX])
            for a, b in zip(words, words[1:]):
                if FREE_NUMBER.match(a):
                    add("u", b[:THAI_PREFIX])
            continue
        sure, before, last = True, "", len(words) - 1
        for i, w in enumerate(words):
            core = w.rstrip("”»’」』）)]}›\"'“")
            ends = core.endswith(".") and not core.endswith("..")
            t = token_type(core[:-1] if ends else core.rstrip("!?؟。！？۔…."))
            if not t:
                sure, before = sure or bool(core) and core[-1] in STRONG, ""
                continue
            if sure:
                add("s", t)
            if before:
                add("c", before + PAIR + t)
            add("p" if ends else "w", t)
            if ends and i == last:
                add("e", t)
            before = t if ends else ""
            sure = bool(core) and core[-1] in STRONG or ends and len(t) > 4 and "#" not in t and "." not in t
    total = dict.fromkeys("pwes", 0)
    for (kind, key), k in got.items():
        n[lang, kind, key] = n.get((lang, kind, key), 0) + k
        if kind in total:
            total[kind] += k
    for kind, k in (("N", total["p"] + total["w"]), ("P", total["p"]), ("E", total["e"]), ("S", total["s"])):
        if k:
            n[lang, kind, ""] = n.get((lang, kind, ""), 0) + k


#: Between the two types of a pair; no token holds it.
PAIR = "\x00"


def _hint(units: DataFrame):
    return (F.col("lang") if "lang" in units.columns else F.lit(None).cast("string")).alias("hint")


def distinct_units(units: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, hint): every distinct unit with an id and a text, in a stated number of partitions."""
    known = units.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return known.select(key, text, _hint(units)).repartition(lanes(units.sparkSession), key).distinct()


def _lean(part, whole, share):
    """Log-likelihood ratio of ``part`` of ``whole`` against the rate ``share``."""
    tiny = 1e-9
    rate = part / whole
    return 2 * (part * F.log((rate + tiny) / (share + tiny)) + (whole - part) * F.log((1 - rate + tiny) / (1 - share + tiny)))


def learn(
    units: DataFrame, text: str = "text", key: str = "unit_id", least: int = 3, abbreviation_score: float = 0.3, starter_score: float = 20.0, collocation_score: float = 7.88
) -> Model:
    """Abbreviations, collocations and starters by log-likelihood ratios over all texts, units delivered again once.

    Counts are summed in each task, then per (language, kind, type), and written once; the ratios are
    computed and filtered in Spark, and only what passes comes to the driver: word types, not
    documents.  A type counts as an abbreviation where its ratio, weighed by shortness, inner periods
    and missing uses without a period, reaches ``abbreviation_score``, and where it stands at line ends
    clearly more rarely than other types with a period.  A starter is a type that follows sure sentence
    ends more often than chance by ``starter_score``.  A collocation is a number or an abbreviation with
    a period and the type after it, where that follows more often than in all text and more often than
    it follows sure sentence ends, both by ``collocation_score``, and is no starter: the period between
    the two ends no sentence.  What is seen under ``least`` times is left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: dict[tuple[str, str, str], int] = {}
            for t, h in zip(pdf[text], pdf["hint"]):
                if t:
                    count_unit(t, n, h)
            keys = list(n)
            yield pd.DataFrame({"lang": [k[0] for k in keys], "kind": [k[1] for k in keys], "key": [k[2] for k in keys], "n": [n[k] for k in keys]}).astype({"lang": object, "kind": object, "key": object, "n": "int64"})

    c = F.col
    tallied = distinct_units(units, key, text).mapInPandas(count, "lang string, kind string, key string, n long")
    counts = cut(tallied.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).where((c("kind") != "c") | (c("n") >= least)))
    of = lambda kind: F.coalesce(F.sum(F.when(c("kind") == kind, c("n"))), F.lit(0)).cast("double")
    totals = counts.where(c("key") == "").groupBy("lang").agg(*[of(k).alias(f"t{k}") for k in "NPES"])
    x = (
        counts.where((c("key") != "") & (c("kind") != "c")).groupBy("lang", "key").agg(*[of(k).alias(k) for k in "pewstu"])
        .where(F.greatest(c("p") + c("w"), c("t") + c("u")) >= least)
        .join(totals, "lang", "left")
        .fillna(0.0)
    )
    one = F.lit(1.0)
    a = F.greatest(c("p") + c("w"), one)
    base = F.greatest(F.least(c("tP") / F.greatest(c("tN"), one), F.lit(0.98)), F.lit(1e-6))
    null = c("p") * F.log(base) + c("w") * F.log(1 - base)
    alt = c("p") * F.log(F.lit(0.99)) + c("w") * F.log(F.lit(0.01))
    letters = F.length(F.regexp_replace("key", r"[.]", ""))
    inner = F.length("key") - letters
    score = -2 * (null - alt) * F.exp(-letters) * (inner + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -c("w"))
    quiet = c("e") / F.greatest(c("p"), one) < 0.5 * c("tE") / F.greatest(c("tP"), one)
    plain = ~c("key").contains("#")
    after_end = c("tS") / F.greatest(c("tN"), one)
    types = x.select(
        "lang", "key", "p", "s", "tN", "tS", (c("p") + c("w")).alias("n"),
        (plain & quiet & (c("p") > 0) & (score >= abbreviation_score) & (alt > null)).alias("abbreviation"),
        (plain & (c("s") >= least) & (c("s") / a > after_end) & (_lean(c("s"), a, after_end) >= starter_score)).alias("starter"),
        ((c("lang") == "th") & (c("t") >= least) & (c("t") > c("u"))).alias("thai"),
    )
    parts = F.split("key", PAIR)
    pairs = counts.where(c("kind") == "c").select("lang", parts[0].alias("first"), parts[1].alias("second"), c("n").cast("double").alias("both"))
    first = types.where((c("key") == "#") | c("abbreviation")).select("lang", c("key").alias("first"), c("p").alias("ends"))
    second = types.select("lang", c("key").alias("second"), "n", "s", "tN", "tS", "starter")
    share, chance, opening = c("both") / c("ends"), c("n") / c("tN"), c("s") / F.greatest(c("tS"), one)
    bound = (share >= LEAST_SHARE) & (share > chance) & (share > opening) & (_lean(c("both"), c("ends"), chance) >= collocation_score) & (_lean(c("both"), c("ends"), opening) >= collocation_score)
    together = pairs.join(first, ["lang", "first"]).join(second, ["lang", "second"]).where(bound & ~c("starter")).select("lang", "first", "second")
    model = Model()
    for r in types.where("abbreviation or starter or thai").select("lang", "key", "abbreviation", "starter", "thai").collect():
        if r["abbreviation"]:
            model.abbreviations.setdefault(r["lang"], set()).add(r["key"])
        if r["starter"]:
            model.starters.setdefault(r["lang"], set()).add(r["key"])
        if r["thai"]:
            model.thai_starts.add(r["key"])
    for r in together.collect():
        model.collocations.setdefault(r["lang"], set()).add((r["first"], r["second"]))
    return model


# ---------------------------------------------------------------- splitting


QUOTES = re.compile(r"[“«„「『（(\[”\"]")


def _open_quote(text: str, start: int, end: int) -> int | None:
    """Place of the last opening quote or bracket in text[start:end] that has not been closed."""
    stack: list[tuple[str, int]] = []
    if not QUOTES.search(text, start, end):
        return None
    for i in range(start, end):
        ch = text[i]
        if stack and ch in MATE.get(stack[-1][0], ""):
            stack.pop()
        elif ch in "“«„「『（([" or ch == "”" and not stack and (i == start or text[i - 1].isspace()):
            stack.append((ch, i))
        elif ch == '"':
            if stack and stack[-1][0] == '"':
                stack.pop()
            else:
                stack.append((ch, i))
    return stack[-1][1] if stack else None


def _closers(line: str, j: int, opened: bool) -> int:
    """End of the closing marks after position j; one space before a closing guillemet counts with it."""
    while j < len(line):
        ch = line[j]
        if ch in "”»’」』）)]}›" or opened and ch in "\"'“":
            j += 1
        elif ch in " \xa0 " and j + 1 < len(line) and line[j + 1] == "»":
            j += 2
        else:
            break
    return j


def _thai(line: str, model: Model) -> list[tuple[int, int]]:
    tokens = [m.span() for m in TOKEN.finditer(line)]
    out: list[list[int]] = []
    for k, (a, b) in enumerate(tokens):
        if out:
            before, here = line[tokens[k - 1][0] : tokens[k - 1][1]], line[a:b]
            inside = bool(FREE_NUMBER.match(before) and len(out) and True) or bool(FREE_NUMBER.match(here))
            if inside and FREE_NUMBER.match(before) and not FREE_NUMBER.match(here) and here[:THAI_PREFIX] in model.thai_starts:
                inside = False
            if inside or ITEM.match(before) and out[-1][0] == tokens[k - 1][0]:
                out[-1][1] = b
                continue
        out.append([a, b])
    return [(a, b) for a, b in out]


def _kind(ch: str) -> str:
    if not ch:
        return ""
    if ch.isdigit():
        return "d"
    if ch.isupper() or ch.istitle():
        return "U"
    if ch.islower():
        return "l"
    if ch.isalpha():
        return "c"
    return "o" if ch in OPENERS or ch == "”" else "-" if ch in "—–-" else ","


def _ends(line: str, start: int, i: int, j: int, k: int, lang: str, model: Model, opener: int | None) -> bool:
    """Whether the terminal line[i:j], with its closing marks up to k, ends the sentence begun at start."""
    n = len(line)
    p = k
    while p < n and line[p].isspace():
        p += 1
    if p >= n:
        return True
    gap, run = p > k, line[i:j]
    q = p
    while q < n and (line[q] in OPENERS or line[q] == "”") and q < p + 3:
        q += 1
    kind = _kind(line[p])
    after = _kind(line[q]) if kind == "o" and q < n else kind
    strong = any(c in STRONG for c in run)
    nxt = TOKEN.match(line, q)
    next_type = token_type(nxt[0].rstrip(".!?؟。！？۔…")) if nxt else ""
    closed = opener is not None and k > j
    head = line[start:i].lstrip()
    at_start = opener is not None and (not (front := line[start:opener].strip()) or bool(ITEM.match(front)))
    if kind in ("-", ","):
        return kind == "," and line[p] in "•▪◦*#§" or False
    if not strong and ("…" in run or len(run) > 1):
        return (kind == "U" or kind == "o" and after in ("U", "c")) and gap
    if strong:
        if after == "l":
            return False
        if closed:
            if after == "c":
                if not at_start:
                    return False
                rest = TERMINAL.split(line[p:], maxsplit=1)[0]
                return not (lang in _SPEECH and len(rest) <= 24 and _SPEECH[lang].search(rest))
            return True
        return True
    # one period
    left = line[i - 1] if i else ""
    if not gap and k == j:
        if kind not in ("U", "c") or not left or kind == "c" and _kind(left) not in ("c", "d"):
            return False
        token = re.search(r"[^\s“«(\"„‘]*$", line[start:i])[0]
        return len(token) > 1 and "." not in token and token_type(token) not in model.abbreviations.get(lang, ()) and not ("/" in token and not token[-1].isdigit())
    token = re.search(r"[^\s“«(\"„‘]*$", line[start:i])[0]
    t = token_type(token)
    if closed and after in ("U", "c", "d", "o"):
        return at_start or after != "c"
    if ITEM.match(head) and len(head) <= 6:
        return False
    if (t, next_type) in model.collocations.get(lang, ()):
        return False
    if NUMBER.match(token):
        return after != "l"
    initial = len(token) == 1 and token.isalpha()
    if initial or t in model.abbreviations.get(lang, ()) or re.fullmatch(r"(?:[^\W\d_]\.-?)+[^\W\d_]", token):
        if after in ("l", "d"):
            return False
        if initial and token.isupper():
            return False
        if kind == "o":
            return True
        if after == "U":
            before = line[start : i - len(token)].split()
            if before and NUMBER.match(before[-1]):
                return True
        return next_type in model.starters.get(lang, ())
    return after != "l"


def split(text: str | None, model: Model, hint: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the sentences of one text, without outer white space, in code points.

    Null, empty and blank texts have none.  Every other character belongs to exactly one sentence.
    """
    if not text:
        return []
    lang = language(text, hint)
    out = []
    for m in LINE.finditer(text):
        line, base = m[0], m.start()
        if lang == "th":
            out += [(base + a, base + b) for a, b in _thai(line, model)]
            continue
        start = 0
        cuts = []
        for t in TERMINAL.finditer(line):
            i, j = t.span()
            if j <= start:
                continue
            opener = _open_quote(line, start, i)
            k = _closers(line, j, opener is not None)
            if _ends(line, start, i, j, k, lang, model, opener):
                cuts.append(k)
                start = k
        a = 0
        for cut in [*cuts, len(line)]:
            piece = line[a:cut]
            lead = len(piece) - len(piece.lstrip())
            tail = len(piece.rstrip())
            if tail > lead:
                out.append((base + a + lead, base + a + tail))
            a = cut
    return out


def split_units(units: DataFrame, model: Model, key: str = "unit_id", text: str = "text") -> DataFrame:
    """(key, no, start_pos, end_pos, sentence) of every distinct unit; units delivered again count once."""
    kind = dict(units.dtypes)[key]
    shared = units.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            ids, no, a, b, s = [], [], [], [], []
            for uid, t, h in zip(pdf[key], pdf[text], pdf["hint"]):
                for x, (p, q) in enumerate(split(t, own, h)):
                    ids.append(uid), no.append(x), a.append(p), b.append(q), s.append(t[p:q])
            yield pd.DataFrame({key: pd.Series(ids, dtype=pdf[key].dtype), "no": pd.Series(no, dtype="int32"), "start_pos": pd.Series(a, dtype="int32"), "end_pos": pd.Series(b, dtype="int32"), "sentence": pd.Series(s, dtype=object)})

    return distinct_units(units, key, text).mapInPandas(run, f"{key} {kind}, no int, start_pos int, end_pos int, sentence string")


def found(units: DataFrame) -> DataFrame:
    """One row per sentence of every text unit (p5_found)."""
    return split_units(units, learn(units)).select("unit_id", "start_pos", "end_pos")
