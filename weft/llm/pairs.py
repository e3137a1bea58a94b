"""Problem 2: broken source and answer pairs."""

from __future__ import annotations

import random
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import bitext
from weft.llm.words import fold, language_of, strip_tags
from weft.session import cut, lanes

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Different training examples up to which the driver takes the sums of the field's fit itself.
LOCAL = 20_000
#: Different training examples that a task holds before it hands them on.
HELD = 50_000
#: Clauses of training examples that make a block.
TOGETHER = 20_000
#: Different training examples that the driver starts from, at least, where tasks take the sums.
START = 10_000
#: Clauses of a training example above which it is long.
LONG = 12
#: Marks of an answer: repeats the whole source, source without a known word, breaks off, without letters or digits.
COPIED, NAMED, BREAKS_OFF, EMPTY = 1, 2, 4, 8
#: Rows whose scores are computed together.
BLOCK = 512
# a mark and what parts it from the next clause, or line ends; it begins with a set of characters, which is looked for fast
BETWEEN = re.compile(r"[.!?؟。！？۔\n](?:(?<=\n)\n*|(?<!\n)[\"'”»)\]]*\s+|(?<=[。！？])(?=[^\W\d_])|(?<=[^\W\d_][.!?])(?=[^\W\d_]{3}))")
STOP = frozenset(".!?؟。！？۔")
CLOSERS = "\"'”»’）)]“ \t\n\xa0 "
ALNUM = re.compile(r"[\W_]+")
#: Marks an answer breaks off with.
CUT = ("...", "…", *"-–—,;:،؛(/")
#: Letters that stay no ASCII whatever is made equal.
FAR = re.compile("[\u0400-\u047f\u0621-\u063a]")
# Words of answers that decline, by language; they only serve to make training clauses and one feature.
CUES = {
    "en": "sorry unfortunately apologies apologise afraid cannot can't unable decline declined declining refuse refusing assistant won't provide render offered able must request passage content processed process policy policies safety translate translating translation segment text language model comply assist help personal private sensitive blocked refused removed denied redacted censored filtered withheld beyond protected details my me",
    "ar": "عذرا آسف أعتذر أعتذر معذرة للأسف لا أستطيع يمكنني تتعذر يتعذر أمتنع مساعدا مساعد بصفتي لغويا ترجمة الترجمة معالجة تقديم النص المقطع المحتوى الطلب سياسة سياستي نطاق عملي منك نقل رفض أرفض",
    "ru": "извините простите прошу прощения сожалению могу не невозможно отказаться отказываюсь придётся помощник языковой перевести перевод перевода фрагмент текст запрос запроса содержание обработать состоянии нельзя дать мне",
    "tr": "üzgünüm maalesef özür dilerim yapamam çeviremem çevirisini veremem sunamam reddetmek çevirmek zorundayım mümkün değil dil yardımcısı olarak isteği geri metni bölümü içeriği işlemem aktarmayı",
    "fr": "désolé désolée malheureusement regrette excuses navré impossible peux puis refuser refuse assistant linguistique traduire traduction fournir passage contenu demande texte traiter",
}
# Patterns to make training refusals from; {x} is filled from FILL.
REFUSALS = {
    "en": (("Sorry, ", "I'm sorry, but ", "Unfortunately, ", "As a language assistant, ", "My apologies: ", ""), ("I cannot translate this text", "I am not able to provide this translation", "I must decline this request", "this text can't be processed by me", "I won't render this content", "no translation can be offered for this passage", "translating this segment is beyond what I can do"), ("", " for safety reasons", " because it contains personal data", " as it goes against my policies", "; please ask a translator")),
    "ar": (("عذرا، ", "أعتذر منك، ", "للأسف، ", "بصفتي مساعدا لغويا، ", ""), ("لا أستطيع ترجمة هذا النص", "لا يمكنني تقديم هذه الترجمة", "تتعذر علي معالجة هذا المقطع", "أمتنع عن نقل هذا المحتوى", "ترجمة هذا الجزء خارج نطاق عملي"), ("", " حفاظا على السلامة", " لأنه يحتوي على بيانات شخصية", "، يرجى الرجوع إلى مترجم")),
    "ru": (("Извините, ", "К сожалению, ", "Прошу прощения, ", "Как языковой помощник, ", ""), ("я не могу перевести этот фрагмент", "я не в состоянии дать такой перевод", "этот текст мне обработать нельзя", "мне придётся отказаться от этого запроса"), ("", " из соображений безопасности", ", так как он содержит личные данные", "; обратитесь к переводчику")),
    "tr": (("Üzgünüm, ", "Maalesef ", "Özür dilerim, ", "Bir dil yardımcısı olarak ", ""), ("bu metni çeviremem", "bu isteği geri çevirmek zorundayım", "bu metni işlemem mümkün değil", "bu bölümün çevirisini sunamam"), ("", ", çünkü kişisel veri içeriyor", "; lütfen bir çevirmene danışın", " güvenlik nedeniyle")),
    "fr": (("Désolé, ", "Malheureusement, ", "En tant qu'assistant linguistique, ", ""), ("je ne peux pas traduire ce texte", "je dois refuser cette demande", "je ne suis pas en mesure de fournir cette traduction"), ("", " pour des raisons de sécurité", "; veuillez consulter un traducteur")),
}
# Short marks put in place of an answer.
SHORT = ("[content blocked]", "<refused>", "[translation declined]", "[refused]", "(no translation)", "[blocked by policy]", "<content removed>", "[request denied]", "[not translated]", "REFUSED")
_CUES = {k: frozenset(w for x in v.split() for w in bitext.tokens(x)) for k, v in CUES.items()}
_ALL_CUES = frozenset().union(*_CUES.values())
FEATURES = 23


def flat(text: str) -> str:
    """Letters and digits only, one case, compatible forms made equal."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return "".join(bitext.WORD.findall(fold(text)))


def clauses(text: str) -> list[str]:
    """The text parted after marks that end a sentence and at line ends, parts without letter or digit left out."""
    out, at = [], 0
    for m in BETWEEN.finditer(text):
        out.append(text[at : m.start() + (m[0][0] != "\n")])
        at = m.end()
    out.append(text[at:])
    return [c for c in out if c and not ALNUM.fullmatch(c)]


def ended(text: str) -> bool:
    s = text.rstrip(CLOSERS)
    return bool(s) and s[-1] in STOP


def packed(rows: list[tuple[float, ...]]) -> bytes:
    return array("f", chain.from_iterable(rows)).tobytes()


def breaks(text: str) -> bool:
    """Whether a text ends in a mark that it breaks off with, a closing quote aside."""
    end = text[-12:].rstrip()
    return (end[:-1].rstrip() if end[-1:] in ("\"", "'", "”", "»") else end).endswith(CUT)


class Source:
    """What the features of all answers to one source share; clauses and words of answers are remembered."""

    __slots__ = ("_clauses", "_flat", "_shares", "breaks", "ended", "far", "lexicon", "look", "named", "parts", "split", "text", "told", "weight", "whole", "words")

    def __init__(self, text: str, lexicon: bitext.Lexicon):
        self.text = strip_tags(text) if "<" in text else text
        self.parts = clauses(self.text) or [self.text]
        self.split = [bitext.tokens(c) for c in self.parts]
        self.words = [w for ws in self.split for w in ws]
        self.lexicon = lexicon
        told = lexicon.told
        self.told = [list(map(told.__getitem__, ws)) for ws in self.split]
        self.look = frozenset(self.words), {x[3] for xs in self.told for x in xs} - {""}
        self.named = not any(x[4] for xs in self.told for x in xs)
        self.whole = [sum(x[0] for x in xs) for xs in self.told]
        self.weight = sum(self.whole)
        self.ended, self.breaks = ended(self.text), breaks(self.text)
        self.far = FAR.search(self.text) is not None
        self._flat: str | None = None
        self._clauses: dict[str, tuple] = {}
        self._shares: dict[tuple[str, ...], tuple[list[float], float]] = {}

    @property
    def flat(self) -> str:
        if self._flat is None:
            self._flat = flat(self.text)
        return self._flat

    def clause(self, c: str) -> tuple:
        """Of a clause of an answer: words, weight found in the source, whole weight, words of refusals, words that are no
        numbers, known words by language, those of them that the source holds, written forms of names, language by script."""
        key = c.rstrip(".!?؟ ")
        got = self._clauses.get(key)
        if got is None:
            words = bitext.tokens(c)
            have, names = self.look
            told = self.lexicon.told
            found = total = 0.0
            plain = 0
            tongues: dict[str, int] = {}
            same: dict[str, int] = {}
            forms = set()
            for w in words:
                x, likely, as_hit, as_look, tongue, letters = told[w]
                total += x
                plain += letters
                held = w in have
                if held or (not likely.isdisjoint(have) if likely is not None else as_hit and as_hit in names):
                    found += x
                if tongue:
                    tongues[tongue] = tongues.get(tongue, 0) + 1
                    if held:
                        same[tongue] = same.get(tongue, 0) + 1
                elif as_look:
                    forms.add(as_look)
            cue = sum(map(_ALL_CUES.__contains__, words))
            guess = None
            if plain and not c.isascii() and max(tongues.values(), default=0) < 0.4 * plain:
                guess = language_of(c)
            got = self._clauses[key] = words, found, total, cue, plain, tongues, same, forms, guess
        return got

    def shares(self, every: list[str], forms: set[str]) -> tuple[list[float], float]:
        """The share of each of its clauses that an answer of these words covers, and the weight that is found of all."""
        key = tuple(every)
        got = self._shares.get(key)
        if got is None:
            have = frozenset(every)
            out, of_source = [], 0.0
            for c, ws, xs, whole in zip(self.parts, self.split, self.told, self.whole):
                hits = [w in have or (not x[1].isdisjoint(have) if x[1] is not None else x[2] != "" and x[2] in forms) for w, x in zip(ws, xs)]
                if all(hits):
                    of_source += whole
                    out.append(1.0)
                    continue
                weights = [x[0] for x in xs]
                of_source += sum(compress(weights, hits))
                # a first phrase may be left out: up to a comma, or up to three words before the first that is there
                front = re.split(r"[,،，]", c[:60], maxsplit=1)
                lead = len(bitext.tokens(front[0])) if len(front) > 1 and len(front[0]) < 45 and not any(map(str.isdigit, front[0])) else 0
                known = self.lexicon.weight
                if not lead or sum(x * h for w, x, h in zip(ws[:lead], weights, hits) if w in known) >= 0.5 * sum(x for w, x in zip(ws[:lead], weights) if w in known):
                    lead = next((k for k, (w, x, h) in enumerate(zip(ws, weights, hits)) if h and x >= 0.5 or w[0].isdigit()), 0)
                    lead = lead if lead <= 3 < len(ws) - lead else 0
                total = sum(weights[lead:])
                out.append(sum(compress(weights[lead:], hits[lead:])) / total if total else 1.0)
            got = self._shares[key] = out, of_source
        return got


class Pair:
    """One source and answer with what the features need."""

    __slots__ = ("_sound", "breaks_off", "clauses", "copied", "named", "rows")

    def __init__(self, source: Source, target: str, language: str | None, lexicon: bitext.Lexicon, hide: str | None = None):
        target = strip_tags(target) if "<" in target else target
        self.clauses = clauses(target)
        sources, words, in_source = source.parts, source.words, source.look[0]
        self.named = source.named
        parts = [source.clause(c) for c in self.clauses]
        every = [w for p in parts for w in p[0]]
        self.copied = False
        if not self.named and sum(map(in_source.__contains__, every)) >= 0.5 * len(words):
            self.copied = bool(source.flat) and source.flat in flat(target)
        shares, of_source = source.shares(every, set().union(*[p[7] for p in parts]))
        last, worst, mean = shares[-1], min(shares), sum(shares) / len(shares)
        n_s, n_t = len(sources), len(self.clauses)
        stop_s, stop_t = source.ended, ended(target)
        broken = breaks(target) and not source.breaks
        short = min(2.0, len(every) / max(1, len(words)))
        # what an exact check asks of an answer called unfinished
        self.breaks_off = broken or (stop_s and not stop_t and 1 - last > 0.13) or (n_t < n_s and 1 - worst > 0.3) or 1 - worst > (0.6 if stop_t else 0.3)
        self.rows = []
        copied, named = float(self.copied), float(self.named)
        of_target = whole_target = 0.0
        spoken_in: dict[str, int] = {}
        for k, (c, (p, got, total, cue, plain, tongues, held, _, guess)) in enumerate(zip(self.clauses, parts)):
            final = k == n_t - 1
            of_target += got
            whole_target += total
            if hide in tongues:
                tongues = {x: n for x, n in tongues.items() if x != hide}
            known = sum(tongues.values())
            spoke = tongues.get(language, 0)
            mine = got / total if total else 1.0
            same = sum(n for x, n in held.items() if x != hide) / known if known else 0.0
            for x, n in tongues.items():
                spoken_in[x] = spoken_in.get(x, 0) + n
            spoken = max(tongues, key=tongues.__getitem__) if tongues else None
            if hide is None and guess is not None:
                spoken = guess if guess not in ("en", "fr", "tr", "und") else spoken
            other = float(bool(language) and spoken is not None and spoken != language)
            cues = min(1.0, 3 * cue / max(1, len(p)))
            inside = float(not self.named and same > 0.6 and flat(c) in source.flat)
            away = 1 - mine
            vocabulary = spoke / plain if plain else 1.0
            front = 1.0, 0.0 if other else mine, 0.0 if other else away, other * (1 - same), same, inside, copied, cues, cues * away
            odd = away * (1 - vocabulary) * (cue == 0) * (plain >= 2)
            if final:
                self.rows.append((
                    *front, 1.0, 1 - last, 1 - worst, 1 - mean, float(broken), float(stop_s and not stop_t),
                    float(n_t < n_s), 1 - min(1.0, short), named, (1 - vocabulary) * away, float(worst < 0.5), float(worst < 0.78), odd, float(worst < 0.9),
                ))
            else:
                self.rows.append((*front, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, named, (1 - vocabulary) * away, 0.0, 0.0, odd, 0.0))
        self._sound = source, target, language, n_s == n_t, of_source, of_target, whole_target, spoken_in

    @property
    def sound(self) -> bool:
        """Whether the answer covers its source and is in its language."""
        source, target, language, same, of_source, of_target, whole_target, spoken_in = self._sound
        return (
            not self.copied and same and of_source > 0.85 * source.weight and of_target > 0.8 * whole_target
            and max(spoken_in, key=lambda k: (spoken_in[k], k), default=None) == language and (source.far and target.isascii() or source.flat not in flat(target))
        )


# ---------------------------------------------------------------- conditional random field


class Crf:
    """Linear-chain conditional random field over the clauses of an answer."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi for a padded batch: rows (n, longest, features) -> labels (n, longest)."""
        s = rows @ self.weights
        n, longest, k = s.shape
        best, back = s[:, 0].copy(), np.zeros((n, longest, k), dtype=np.int8)
        for t in range(1, longest):
            via = best[:, :, None] + self.moves[None]
            back[:, t] = via.argmax(1)
            new = via.max(1) + s[:, t]
            live = (t < lengths)[:, None]
            best = np.where(live, new, best)
        out = np.zeros((n, longest), dtype=np.int8)
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            live = t < lengths
            out[:, t] = np.where(live, state, 0)
            state = np.where(live & (t > 0), np.take_along_axis(back[:, t], state[:, None], 1)[:, 0], state)
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return top[:, 0] + np.log(np.exp(x - top).sum(1))


def _log_product(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """log(exp(x) @ e)."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top) @ e)


def expected(xs: list[np.ndarray], w: np.ndarray, m: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Logarithm of the sums over all labellings, and the expected counts of (feature, label) and (label, next label), of
    all sequences, by forward and backward sums; each sequence counts as often as ``counts`` says.

    ``xs[t]`` holds the features of clause t of the sequences that have one; the longest come first, so
    those are the first rows of ``xs[t - 1]``.
    """
    e, n = np.exp(m), [len(x) for x in xs] + [0]
    c = np.ones((n[0], 1)) if counts is None else counts[:, None]
    s = [x @ w for x in xs]
    a = [s[0]]
    for t in range(1, len(xs)):
        a.append(_log_product(a[t - 1][: n[t]], e) + s[t])
    whole = np.concatenate([_log_sum(a[t][n[t + 1] :]) for t in reversed(range(len(xs))) if n[t] > n[t + 1]])
    b = [np.zeros_like(x) for x in s]
    for t in reversed(range(len(xs) - 1)):
        b[t][: n[t + 1]] = _log_product(s[t + 1] + b[t + 1], e.T)
    of_w, of_m = np.zeros_like(w), np.zeros_like(m)
    for t, x in enumerate(xs):
        of_w += x.T @ (c[: n[t]] * np.exp(a[t] + b[t] - whole[: n[t], None]))
        if t:
            before = a[t - 1][: n[t]]
            top = before.max(1, keepdims=True)
            of_m += e * (np.exp(before - top).T @ (c[: n[t]] * np.exp(s[t] + b[t] + top - whole[: n[t], None])))
    return float(whole @ c[:, 0]), of_w, of_m


def gradient(xs: list[np.ndarray], w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts of (feature, label) and (label, next label) of all sequences."""
    return expected(xs, w, m)[1:]


def ascend(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 100, close: float = 5e-5, metric: np.ndarray | None = None) -> np.ndarray:
    """The place of the least value of a convex function, by its values and gradients (limited-memory BFGS); wherever it
    starts, the place is the same.  ``metric``, about the inverse of the curvature, saves rounds."""
    at, steps = start, []
    f, g = value(at)
    for _ in range(rounds):
        if np.abs(g).max() < close:
            break
        q, used = g.copy(), []
        for ds, dg in reversed(steps):
            used.append((ds @ q) / (ds @ dg))
            q -= used[-1] * dg
        if metric is not None:
            q = metric @ q
        else:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1.0
        for (ds, dg), u in zip(steps, reversed(used)):
            q += (u - (dg @ q) / (ds @ dg)) * ds
        far = 1.0
        while True:
            new_f, new_g = value(at - far * q)
            if new_f <= f - 1e-4 * far * (g @ q) or far < 1e-6:
                break
            far /= 2
        if far < 1e-6:
            break
        step = (-far * q, new_g - g)
        at, f, g = at + step[0], new_f, new_g
        if step[0] @ step[1] > 1e-12:
            steps = [*steps, step][-12:]
    return at


def curved(value: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, h: float = 1e-4) -> np.ndarray:
    """The inverse of the curvature of a convex function at a place, by differences of its gradients."""
    g = value(at)[1]
    second = np.array([(value(at + h * e)[1] - g) / h for e in np.eye(len(at))])
    return np.linalg.inv((second + second.T) / 2)


def block(labels: list[bytes], rows: list[bytes], n: list[int]) -> tuple[int, int, int, bytes, bytes, bytes, bytes]:
    """Examples of all lengths as one block: a name, how many, clauses of the longest, their lengths, features, labels and how often each is met.

    The longest come first; features and labels lie clause by clause, the first clauses of all examples before the second.
    """
    order = sorted(range(len(labels)), key=lambda i: -len(labels[i]))
    lengths = np.array([len(labels[i]) for i in order], np.int32)
    at = np.argsort(np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths), kind="stable")
    x = np.frombuffer(b"".join(rows[i] for i in order), np.float32).reshape(-1, FEATURES)[at]
    y = np.frombuffer(b"".join(labels[i] for i in order), np.int8)[at]
    return xxhash.xxh64_intdigest(x.tobytes()) >> 1, len(order), int(lengths[0]), lengths.tobytes(), x.tobytes(), y.tobytes(), np.array([n[i] for i in order], np.int64).tobytes()


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Examples in blocks of at least TOGETHER clauses, the last of a task aside."""
    names = ["id", "examples", "longest", "lengths", "rows", "labels", "n"]
    held: tuple[list, list, list] = ([], [], [])
    size = 0
    for pdf in batches:
        for labels, rows, n in zip(pdf["labels"], pdf["rows"], pdf["n"]):
            for column, x in zip(held, (bytes(labels), bytes(rows), n)):
                column.append(x)
            size += len(labels)
            if size >= TOGETHER:
                yield pd.DataFrame([block(*held)], columns=names)
                held, size = ([], [], []), 0
    if size:
        yield pd.DataFrame([block(*held)], columns=names)


def sums(parts: Iterable[tuple[int | bytes, bytes, bytes, bytes]], w: np.ndarray | None, m: np.ndarray | None) -> np.ndarray:
    """Over blocks: without weights the counts in the labels as given, with them what ``expected`` gives, in one row of figures.

    A block is (lengths, or the one length of all its examples; features; labels; how often), as ``block`` lays them.
    """
    k = len(LABELS)
    out = np.zeros(1 + FEATURES * k + k * k)
    for lengths, rows, labels, n in parts:
        c = np.frombuffer(n, np.int64).astype(float)
        each = np.full(len(c), lengths) if isinstance(lengths, int) else np.frombuffer(lengths, np.int32)
        x = np.frombuffer(rows, np.float32).reshape(-1, FEATURES).astype(float)
        live = len(c) - np.cumsum(np.bincount(each))[:-1]  # examples that have a clause t
        first = np.cumsum(live) - live
        if w is None:
            y = np.frombuffer(labels, np.int8)
            of = np.arange(len(y)) - np.repeat(first, live)  # example of each clause
            of_w, of_m = x.T @ (np.eye(k)[y] * c[of][:, None]), np.zeros((k, k))
            later = np.arange(live[0], len(y))
            np.add.at(of_m, (y[later - np.repeat(live[:-1], live[1:])], y[later]), c[of[later]])
            out += np.concatenate([[c.sum()], of_w.ravel(), of_m.ravel()])
        else:
            z, of_w, of_m = expected(np.split(x, first[1:]), w, m, c)
            out += np.concatenate([[z], of_w.ravel(), of_m.ravel()])
    return out


def fit_crf(examples: DataFrame, penalty: float = 2e-3) -> Crf:
    """Maximum conditional likelihood over all examples (labels, rows, n).

    Up to LOCAL different examples the sums are taken by the driver, beyond that by tasks, one small
    row of figures from each.  Long examples meet in few tasks: a block takes as many steps as its
    longest example has clauses.
    """
    k = len(LABELS)
    columns = ("lengths", "rows", "labels", "n")
    n = lanes(examples.sparkSession)
    own = F.xxhash64("labels", "rows")
    place = F.when(F.length("labels") <= LONG, own).otherwise(F.pmod(own, F.lit(1 + n // 16)))
    once = examples.withColumn("place", place).repartition(n, "place").groupBy("place", "labels", "rows").agg(F.sum("n").alias("n"))
    packed = cut(once.mapInPandas(blocks, "id long, examples long, longest int, lengths binary, rows binary, labels binary, n binary"))
    different = packed.agg(F.coalesce(F.sum("examples"), F.lit(0))).first()[0]

    def split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[: FEATURES * k].reshape(FEATURES, k), x[FEATURES * k :].reshape(k, k)

    def loss(over: Callable[..., np.ndarray]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
        truth = over(None, None)

        def value(x: np.ndarray) -> tuple[float, np.ndarray]:
            got = over(*split(x))
            return (got[0] - truth[1:] @ x) / truth[0] + 0.5 * penalty * (x @ x), (got[1:] - truth[1:]) / truth[0] + penalty * x

        return value

    def by_tasks(w: np.ndarray | None, m: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = (row for pdf in batches for row in zip(*(pdf[c] for c in columns)))
            yield pd.DataFrame({"figures": [sums(parts, w, m).tobytes()]})

        return sum(np.frombuffer(r["figures"]) for r in packed.mapInPandas(run, "figures binary").collect())

    # the driver's fit on blocks of few steps is where the tasks' fit on all of them starts, with the curvature there
    place = np.zeros(FEATURES * k + k * k)
    if not different:
        return Crf(*split(place))
    all_here = different <= LOCAL
    first = packed.orderBy("id")
    if not all_here:  # only figures of the blocks are ordered, so no others reach the driver
        few = packed.select("id", "examples", (F.col("longest") / F.col("examples")).alias("steps")).orderBy("steps", "id").limit(2000).collect()
        before = np.cumsum([0, *(r["examples"] for r in few)])
        first = packed.where(F.col("id").isin([r["id"] for r, b in zip(few, before) if b < START]))
    here = [tuple(bytes(r[c]) for c in columns) for r in first.collect()]
    near = loss(lambda w, m: sums(here, w, m))
    place = ascend(near, place)
    return Crf(*split(place if all_here else ascend(loss(by_tasks), place, metric=curved(near, place))))


def _without_end(text: str, rng: random.Random) -> str | None:
    """The text broken off: within its last sentence, or whole sentences missing."""
    parts = clauses(text)
    if len(parts) > 1 and rng.random() < 0.4:
        return " ".join(parts[: rng.randint(1, len(parts) - 1)])
    words = parts[-1].split()
    if len(words) < 5:
        return None
    keep = rng.randint(max(2, len(words) // 4), max(2, int(0.72 * len(words))))
    end = rng.choice(("", "", "", "...", "…", " -", ","))
    return " ".join([*parts[:-1], " ".join(words[:keep]).rstrip(",;:")]) + end


def examples(key: str, source: Source, target: str, lang: str, clean: Pair, before: dict[str, str], lexicon: bitext.Lexicon) -> Iterator[tuple[bytes, bytes]]:
    """(labels, features) of a sound answer and of answers made from it, drawn by the key.

    ``before`` holds, by language, the last sound answer met before this one.
    """
    rng = random.Random(f"{key}")
    s, t = source.text, target

    def example(target: str, lang: str, label: str | list[str], hide: str | None = None, p: Pair | None = None) -> Iterator[tuple[bytes, bytes]]:
        p = p or Pair(source, target, lang, lexicon, hide)
        names = label if isinstance(label, list) else [label] * len(p.rows)
        if label == "unfinished":
            names = ["answer"] * (len(p.rows) - 1) + ["unfinished"]
        if p.rows and len(names) == len(p.rows):
            yield bytes(LABELS.index(x) for x in names), packed(p.rows)

    draw = rng.random()
    yield from example(t, lang, "answer", p=clean)
    if draw < 0.12:
        yield from example(rng.choice((s, s.upper(), s.lower(), f"«{s}»", f"{s} {s}", s.rstrip("."), f"{lang.upper()}: {s}", s.replace(",", ""))), lang, "echo")
    elif draw < 0.3:
        tongue = lang if rng.random() < 0.65 else rng.choice(sorted(REFUSALS))
        if tongue in REFUSALS:
            a, b, c = REFUSALS[tongue]
            text = f"{rng.choice(a)}{rng.choice(b)}{rng.choice(c)}." if rng.random() > 0.12 else rng.choice(SHORT)
            if rng.random() < 0.25:
                text = " ".join(t.split()[: rng.randint(2, 5)]) + "... " + text
            yield from example(text, lang, ["answer", "refusal"] if ("... " in text and len(clauses(text)) == 2) else "refusal")
    elif draw < 0.42:
        others = sorted(k for k in before if k != lang)
        if others:
            k = rng.choice(others)
            yield from example(t, k, "foreign")  # a true translation, asked for in another language
            yield from example(before[k], lang, "foreign", k if rng.random() < 0.4 else None)
    elif draw < 0.72:
        cut_off = _without_end(t, rng)
        if cut_off:
            yield from example(cut_off, lang, "unfinished")
    else:
        yield from example(t.rstrip(".!?؟ "), lang, "answer")


def declines(words: list[str]) -> bool:
    """Whether a third of the words are those of a refusal; such answers are kept out of the lexicon."""
    return bool(words) and sum(map(_ALL_CUES.__contains__, words)) >= max(2, 0.34 * len(words))


# ---------------------------------------------------------------- operators


def judge(answers: list[tuple[int, np.ndarray, np.ndarray]], model: Crf) -> list[str | None]:
    """The defect of every answer (marks, characters of its clauses, features of its clauses), None for a sound one."""
    out: list[str | None] = ["empty" if a[0] & EMPTY else None for a in answers]
    order = sorted((i for i, a in enumerate(answers) if not a[0] & EMPTY), key=lambda i: len(answers[i][1]))
    for a in range(0, len(order), BLOCK):
        part = order[a : a + BLOCK]
        lengths = np.array([len(answers[i][1]) for i in part])
        x = np.zeros((len(part), lengths.max(), FEATURES))
        for k, i in enumerate(part):
            x[k, : lengths[k]] = answers[i][2].reshape(-1, FEATURES)
        for i, n, labels in zip(part, lengths, model.decode(x, lengths)):
            out[i] = defect(answers[i][0], answers[i][1], [LABELS[y] for y in labels[:n]])
    return out


def defect(marks: int, sizes: np.ndarray, labels: list[str]) -> str | None:
    """One defect of an answer from the labels of its clauses.

    Two exact checks follow the labels: a repetition of the whole source is an echo, and an answer called
    unfinished must break off, miss a sentence or leave much of one untranslated.
    """
    if "refusal" in labels:
        return "refusal"
    if marks & COPIED:
        return "copied"
    if marks & NAMED:
        return None
    size = {x: sum(int(c) for c, y in zip(sizes, labels) if y == x) for x in set(labels)}
    whole = sum(size.values())
    if size.get("echo", 0) > 0.5 * whole:
        return "copied"
    if size.get("foreign", 0) > 0.5 * whole:
        return "other_language"
    return "truncated" if "unfinished" in labels and marks & BREAKS_OFF else None


def features(words: DataFrame, lexicon: bitext.Lexicon) -> DataFrame:
    """Of every segment sent its answer's marks, clause sizes and features (segment_id set), and of every sound pair, of the
    memory too, the examples for training (segment_id null), equal ones of a task counted together."""
    shared = words.sparkSession.sparkContext.broadcast((lexicon.likely, lexicon.weight, lexicon.speaks))
    names = ["segment_id", "marks", "sizes", "labels", "rows", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = bitext.Lexicon(*shared.value)
        held: Counter[tuple[bytes, bytes]] = Counter()
        before: dict[str, str] = {}

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names, dtype=object).astype({"marks": "int32", "n": "int64"})

        for pdf in batches:
            rows = []
            for key, sent, lang, s, t, left in zip(pdf["id"], pdf["sent"], pdf["target_lang"], pdf["source_text"], pdf["target_text"], pdf["declines"]):
                t = strip_tags(t) if t else ""
                if not any(map(str.isalnum, t)):
                    if sent:
                        rows.append((key, EMPTY, b"", None, b"", 1))
                    continue
                source = Source(s or "", own)
                p = Pair(source, t, lang, own)
                if sent:
                    marks = COPIED * p.copied + NAMED * p.named + BREAKS_OFF * p.breaks_off
                    rows.append((key, marks, np.array([len(c) for c in p.clauses], np.int32).tobytes(), None, packed(p.rows), 1))
                if p.sound and lang and s and (sent or not left):
                    held.update(examples(key, source, t, lang, p, before, own))
                    before[lang] = t
            if len(held) > HELD:
                rows += [(None, 0, b"", labels, x, n) for (labels, x), n in held.items()]
                held.clear()
            yield frame(rows)
        yield frame([(None, 0, b"", labels, x, n) for (labels, x), n in held.items()])

    return cut(words.mapInPandas(run, "segment_id string, marks int, sizes binary, labels binary, rows binary, n long"))


def prepare(segments: DataFrame, results: DataFrame, memory: DataFrame) -> tuple[DataFrame, bitext.Lexicon, Crf]:
    """Features of all answers, and the lexicon and the field fitted on all segments sent and all memory entries."""
    texts = segments.select("id", "source_text", "target_text", F.lit(True).alias("sent"))
    pairs = texts.join(bitext.sent(results).select(F.col("segment_id").alias("id"), "source_lang", F.col("language").alias("target_lang")), "id")
    words = bitext.tokenized(pairs.unionByName(memory.select("id", "source_text", "target_text", F.lit(False).alias("sent"), "source_lang", "target_lang")), declines, segments.count() + memory.count())
    lexicon = bitext.fit_all(words)
    known = features(words, lexicon)
    return known, lexicon, fit_crf(known.where(F.col("segment_id").isNull()).select("labels", "rows", "n"))


def found(segments: DataFrame, results: DataFrame, memory: DataFrame) -> DataFrame:
    """(segment_id, defect) of every segment sent to the engine whose answer is no translation (p2_found).

    Segments delivered again or sent twice count once.  A null answer is empty; a null source is taken
    as an empty text, which nothing repeats; a null language rules out nothing.
    """
    known, _, model = prepare(segments, results, memory)
    shared = segments.sparkSession.sparkContext.broadcast((model.weights, model.moves))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = Crf(*shared.value)
        for pdf in batches:
            got = judge([(a, np.frombuffer(c, np.int32), np.frombuffer(x, np.float32)) for a, c, x in zip(pdf["marks"], pdf["sizes"], pdf["rows"])], crf)
            yield pd.DataFrame({"segment_id": pdf["segment_id"], "defect": pd.Series(got, dtype=object, index=pdf.index)}).dropna()

    answers = known.where(F.col("segment_id").isNotNull()).select("segment_id", "marks", "sizes", "rows")
    return answers.mapInPandas(run, "segment_id string, defect string").distinct()


def missing(results: DataFrame, defects: DataFrame) -> DataFrame:
    """Per target language and defect: segments, and how many of them their batch named as missing."""
    rows = results.select("target_lang", F.explode("segment_ids").alias("segment_id"), F.coalesce(F.array_contains("missing", F.col("segment_id")), F.lit(False)).alias("named"))
    per = rows.groupBy("segment_id").agg(F.min("target_lang").alias("target_lang"), F.max("named").alias("named"))
    return per.join(defects, "segment_id", "left").groupBy("target_lang", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("segments"), F.count_if("named").alias("named_missing"))
