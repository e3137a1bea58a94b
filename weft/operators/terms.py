"""Terms: candidates from short pairs, conflicts, containment, propagation of a changed term."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.session import cut

#: Terms sent to every task at most; a longer list takes more passes over the texts.
BLOCK = 20_000


def candidates(pairs: DataFrame, most_words: int = 4) -> DataFrame:
    """(source_term, target_term, frequency) of pairs short enough to be terms: no digits, at most ``most_words`` words on either side."""
    s, t = T.visible("source_text"), T.visible("target_text")
    short = (T.count_words(s) <= most_words) & (T.count_words(t) <= most_words) & ~s.rlike(r"\p{N}") & ~t.rlike(r"\p{N}") & T.is_translatable(s) & T.is_translatable(t)
    return pairs.where(short).groupBy(s.alias("source_term"), t.alias("target_term")).agg(F.count(F.lit(1)).alias("frequency"))


def ranked(terms: DataFrame) -> DataFrame:
    """Terms with their place among the renderings of one source term, the most frequent first."""
    w = Window.partitionBy("source_term").orderBy(F.desc("frequency"), "target_term")
    return terms.withColumn("place", F.row_number().over(w))


def conflicts(terms: DataFrame) -> DataFrame:
    """(source_term, renderings, best, others): source terms with more than one rendering."""
    return (
        ranked(terms).groupBy("source_term").agg(F.count(F.lit(1)).alias("renderings"), F.min_by("target_term", "place").alias("best"), F.sum("frequency").alias("frequency"))
        .where("renderings > 1")
    )


def enforcement(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(segment_id, source_term, target_term): pairs whose source holds a term and whose answer lacks its rendering.

    ``pairs(segment_id, source_text, target_text)``.  A term is met wherever its characters stand, also inside
    a word or an unspaced run; empty terms meet nothing.  One automaton of all terms runs once over each text;
    the terms are taken in blocks of BLOCK, each sent to the workers once.
    """
    listed = cut(terms.where(F.col("source_term") != "").select("source_term", "target_term", F.lower("target_term").alias("wanted")).where(F.col("wanted").isNotNull()))
    blocks = max(1, -(-listed.count() // BLOCK))
    kind = dict(pairs.dtypes)["segment_id"]
    texts = pairs.where(F.col("source_text").isNotNull() & F.col("target_text").isNotNull())
    texts = texts.select("segment_id", T.collapse("source_text").alias("source"), F.lower(T.collapse("target_text")).alias("target"))
    out = None
    for b in range(blocks):
        part = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("source_term"), F.lit(blocks)) == b)
        own: dict[str, list[tuple[str, str]]] = {}
        for r in part.collect():
            own.setdefault(r["source_term"], []).append((r["target_term"], r["wanted"]))
        shared = pairs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term, renderings in shared.value.items():
                machine.add_word(term, (term, renderings))
            if shared.value:
                machine.make_automaton()
            for pdf in batches:
                rows = []
                if shared.value:
                    for key, source, target in zip(pdf["segment_id"], pdf["source"], pdf["target"]):
                        met = dict(hit for _, hit in machine.iter(source))
                        rows += [(key, term, rendering) for term, renderings in met.items() for rendering, wanted in renderings if wanted not in target]
                yield pd.DataFrame(rows, columns=["segment_id", "source_term", "target_term"]).astype({"source_term": object, "target_term": object})

        got = texts.mapInPandas(run, f"segment_id {kind}, source_term string, target_term string")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def whole_word(term: str) -> str:
    """Pattern of a term as a whole word, whatever its case."""
    return rf"(?iU)\b\Q{term}\E\b"


def replace_term(target: Column, old: str, new: str) -> Column:
    """The answer with every whole-word ``old`` replaced by ``new``, taken literally."""
    return F.regexp_replace(target, whole_word(old), re.sub(r"([\\$])", r"\\\1", new))


def change_of(before: str, after: str) -> tuple[str, str] | None:
    """The one phrase that differs between two answers, as (old, new); None where more or nothing differs.

    Outer punctuation is put aside; an old phrase under three characters or over four words, or one that
    differs in case only, is no term.
    """
    a, b = before.split(), after.split()
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    old, new = a[i : len(a) - j], b[i : len(b) - j]
    if not old or not new or len(old) > 4:
        return None
    x, y = (" ".join(w).strip(" .,;:") for w in (old, new))
    return (x, y) if len(x) >= 3 and y and x.lower() != y.lower() else None


def bulk(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source_term, domain, target_term, action): terms after ``incoming(source_term, domain, target_term, seq)``.

    The last of several renderings of a term counts.  ``added`` is new, ``updated`` has another rendering,
    ``kept`` is as before; terms with a blank side are left out.
    """
    key = ["source_term", "domain"]
    new = incoming.where((F.trim("source_term") != "") & (F.trim("target_term") != "")).groupBy(*key).agg(F.max_by("target_term", F.struct("seq", "target_term")).alias("new"))
    old = existing.groupBy(*key).agg(F.min("target_term").alias("old"))
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNotNull() & (F.col("new") != F.col("old")), "updated").otherwise("kept")
    return old.join(new, key, "full_outer").select(*key, F.coalesce("new", "old").alias("target_term"), action.alias("action"))
