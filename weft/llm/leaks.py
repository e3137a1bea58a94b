"""Problem 8: held-out evaluation passages inside corpus documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.words import fold
from weft.operators.dedup import first_delivery

WORD = re.compile(r"[^\W_]+(?:[̀-ًͯ-ْ]+[^\W_]*)*")
#: Words of a seed.
GRAM = 3  # as grams() takes them
#: One seed, the rarest n-gram, is kept of every so many neighbouring n-grams of an item, however frequent it is.
WINDOW = 4
#: Characters of items that one pass over the corpus looks for; more items take more passes.
BLOCK_CHARS = 8_000_000
#: Least share of an item's words, and of agreement within the aligned part, that count as a leak.
SHARE, AGREEMENT = 0.5, 0.8


def words_of(text: str) -> list[str]:
    return WORD.findall(fold(text))


def grams(words: list[str]) -> list[tuple[str, ...]]:
    return list(zip(words, words[1:], words[2:])) or ([tuple(words)] if words else [])


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int, int]:
    """Best local alignment of two word sequences: (item start, item end, doc start, doc end, words in agreement).

    Smith-Waterman with 2 for a match, -2 for a mismatch and -1.5 for a gap; a row at a time, the
    running gap within a row as a prefix maximum.
    """
    n, m = len(item), len(doc)
    if not n or not m:
        return 0, 0, 0, 0, 0
    gap = 1.5
    ramp = np.arange(m + 1) * gap
    h = np.zeros((n + 1, m + 1), dtype=np.float32)
    same = item[:, None] == doc[None, :]
    score = np.where(same, np.float32(2), np.float32(-2))
    for i in range(1, n + 1):
        row = h[i]
        np.maximum(h[i - 1, :-1] + score[i - 1], h[i - 1, 1:] - gap, out=row[1:])
        np.maximum(row, 0, out=row)
        np.maximum(row, np.maximum.accumulate(row + ramp) - ramp, out=row)
    end = int(h.argmax())
    i, j = divmod(end, m + 1)
    i1, j1, hits = i, j, 0
    while i > 0 and j > 0 and h[i, j] > 0:
        if abs(h[i, j] - (h[i - 1, j - 1] + score[i - 1, j - 1])) < 1e-3:
            hits += bool(same[i - 1, j - 1])
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] - gap)) < 1e-3:
            i -= 1
        else:
            j -= 1
    return i, i1, j, j1, hits


def gram_counts(docs: DataFrame, wanted: frozenset[tuple[str, ...]]) -> DataFrame:
    """(gram, n): documents that hold each wanted n-gram, over the whole corpus, summed in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = shared.value
        n: dict[tuple[str, ...], int] = {}
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    for g in want.intersection(grams(words_of(t))):
                        n[g] = n.get(g, 0) + 1
        yield pd.DataFrame({"gram": ["\x00".join(g) for g in n], "n": list(n.values())}).astype({"gram": object, "n": "int64"})

    return docs.select("text").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def seeds_of(items: dict[int, list[str]], frequency: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[int]]:
    """n-gram -> items it is a seed of: the rarest of every WINDOW neighbouring n-grams of each item, all of a short one."""
    out: dict[tuple[str, ...], list[int]] = {}
    for key, words in items.items():
        gs = grams(words)
        step = 1 if len(gs) <= 2 * WINDOW else WINDOW
        for k in range(0, len(gs), step):
            best = min(gs[k : k + step], key=lambda g: frequency.get(g, 0))
            own = out.setdefault(best, [])
            if key not in own:
                own.append(key)
    return out


OUT = "doc_id long, item_id long, part double, agreement double, words int"


def _search(docs: DataFrame, items: dict[int, list[str]], frequency: dict[tuple[str, ...], int]) -> DataFrame:
    seeds = seeds_of(items, frequency)
    count = {k: sum(k in v for v in seeds.values()) for k in items}
    # seeds of an item that a document must hold; of a short item one will do
    least = {k: 1 if count[k] <= 2 or len(grams(ws)) <= 2 * WINDOW else max(2, 0.15 * count[k]) for k, ws in items.items()}
    alone = frozenset(g for g, keys in seeds.items() if any(least[k] == 1 for k in keys))
    vocabulary: dict[str, int] = {}
    coded = {k: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], dtype=np.int32) for k, ws in items.items()}
    shared = docs.sparkSession.sparkContext.broadcast((seeds, least, alone, vocabulary, coded))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds, least, alone, vocabulary, coded = shared.value
        known = frozenset(seeds)
        for pdf in batches:
            rows = []
            for doc, t in zip(pdf["doc_id"], pdf["text"]):
                if not t:
                    continue
                ws = words_of(t)
                gs = grams(ws)
                met = known.intersection(gs)
                if len(met) < 2 and alone.isdisjoint(met):
                    continue
                hits: dict[int, int] = {}
                for g in met:
                    for key in seeds[g]:
                        hits[key] = hits.get(key, 0) + 1
                ids = None
                for key, n in hits.items():
                    if n < least[key]:
                        continue
                    if ids is None:
                        ids = np.array([vocabulary.get(w, -1) for w in ws], dtype=np.int32)
                        where: dict[tuple[str, ...], list[int]] = {}
                        for p, g in enumerate(gs):
                            if g in met:
                                where.setdefault(g, []).append(p)
                    item = coded[key]
                    spots = sorted(p for g in met if key in seeds[g] for p in where[g])
                    for a, b in _regions(spots, len(item), len(ids), least[key]):
                        i0, i1, j0, j1, same = align(item, ids[a:b])
                        span = i1 - i0
                        if span and span >= 0.25 * len(item):
                            rows.append((doc, key, span / len(item), same / max(span, j1 - j0), span))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "part", "agreement", "words"]).astype({"doc_id": "int64", "item_id": "int64", "part": "float64", "agreement": "float64", "words": "int32"})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(run, OUT)


def _regions(spots: list[int], reach: int, n: int, least: float) -> list[tuple[int, int]]:
    """Stretches of a document around ``least`` seed hits or more that lie within an item's length of each other."""
    out: list[list[int]] = []
    for p in spots:
        if out and p - out[-1][1] <= reach:
            out[-1][1] = p
            out[-1][2] += 1
        else:
            out.append([p, p, 1])
    return [(max(0, a - reach), min(n, b + reach + GRAM)) for a, b, k in out if k >= least]


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Aligned parts of items in documents: (doc_id, item_id, part, agreement, words), every part of a quarter or more.

    Items are looked for in blocks of BLOCK_CHARS, each sent to the workers once; a block takes two
    passes over the corpus, one to count n-grams, one to seed and align.  Null or wordless texts match
    nothing; copied documents come out each; items stored twice count once.
    """
    base = first_delivery(items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()), "item_id")
    total = base.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        part = base if blocks == 1 else base.where(F.pmod(F.hash("item_id"), F.lit(blocks)) == k)
        own = {r["item_id"]: ws for r in part.collect() if (ws := words_of(r["text"]))}
        wanted = frozenset(g for ws in own.values() for g in grams(ws))
        frequency = {tuple(r["gram"].split("\x00")): r["n"] for r in gram_counts(docs, wanted).collect()}  # at most one row per n-gram of the block
        found_here = _search(docs, own, frequency)
        out = found_here if out is None else out.unionByName(found_here)
    return out


def found(docs: DataFrame, items: DataFrame, share: float = SHARE, agreement: float = AGREEMENT) -> DataFrame:
    """Documents with the items of which they hold a connected part of at least ``share`` of the words (p8_found)."""
    return matches(docs, items).where((F.col("part") >= share) & (F.col("agreement") >= agreement)).select("doc_id", "item_id").distinct()


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Leaked items: documents that hold each, the largest part found."""
    hits = matches(docs, items).where((F.col("part") >= SHARE) & (F.col("agreement") >= AGREEMENT))
    return hits.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.round(F.max("part"), 4).alias("largest_part"))
