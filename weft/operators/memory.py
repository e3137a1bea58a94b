"""Translation memory: exact lookup, fuzzy lookup, upsert, coverage, statistics."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions import text as T
from weft.session import cut, lanes

#: Length bucket of the band join, in characters.
BUCKET = 16
#: Characters of entries and number of queries that meet in one block of the fuzzy lookup.
BLOCK_CHARS, BLOCK_QUERIES = 500_000, 500


def exact(segments: DataFrame, memory: DataFrame, domain: str | None = None) -> DataFrame:
    """(segment_id, memory_id, same_domain): the memory entry of each segment with an equal hash and languages.

    One entry per (hash, languages) is kept before the join: the given domain first, then domain and id
    in order, so a sentence stored often meets each segment once.  Segments without entry are left
    out; null hashes meet nothing.
    """
    key = ["source_hash", "source_lang", "target_lang"]
    own = F.coalesce(F.col("domain") == F.lit(domain), F.lit(False))
    best = memory.where(F.col("source_hash").isNotNull()).groupBy(*key).agg(F.min(F.struct((~own).alias("other"), F.col("domain"), F.col("id"))).alias("m"))
    return segments.join(best, key).select(F.col("id").alias("segment_id"), F.col("m.id").alias("memory_id"), (~F.col("m.other")).alias("same_domain"))


def band(queries: DataFrame, memory: DataFrame, domain: str | None = None, threshold: int = 75, most: int = 800) -> DataFrame:
    """Candidates of a fuzzy lookup: (segment_id, memory_id, query, candidate, gap, place).

    ``queries`` has id, text and languages, ``memory`` id, text, languages and domain.  A candidate has
    the languages, the domain given or else the query's own, and a length within the band the threshold leaves; the ``most`` nearest
    in length are kept, ties by id.  The band becomes an equi-join on length buckets: each query row is
    repeated for the few buckets its band touches.  Queries under eight characters have no candidates.
    """
    r = threshold / 100
    size = F.length("query")
    own_domain = F.lit(domain) if domain is not None else F.col("domain")
    q = (
        queries.select(F.col("id").alias("segment_id"), T.visible("text").alias("query"), "source_lang", "target_lang", own_domain.alias("domain")).where(size >= 8)
        .withColumn("low", F.floor(size * r).cast("int")).withColumn("high", (F.floor(size / r) + 1).cast("int"))
        .withColumn("bucket", F.explode(F.sequence((F.col("low") / BUCKET).cast("int"), (F.col("high") / BUCKET).cast("int"))))
    )
    m = memory.select(F.col("id").alias("memory_id"), T.visible("text").alias("candidate"), "source_lang", "target_lang", "domain")
    m = m.withColumn("size", F.length("candidate")).withColumn("bucket", (F.col("size") / BUCKET).cast("int"))
    pairs = q.join(m, ["source_lang", "target_lang", "domain", "bucket"]).where(F.col("size").between(F.col("low"), F.col("high")))
    gap = F.abs(F.col("size") - size)
    w = Window.partitionBy("segment_id").orderBy(gap, "memory_id")
    return pairs.select("segment_id", "memory_id", "query", "candidate", gap.alias("gap"), F.row_number().over(w).alias("place")).where(F.col("place") <= most)


def similarity(query: str, candidate: str) -> int:
    """Ratio of matching blocks in percent, rounded down."""
    m = SequenceMatcher(None, autojunk=False)
    m.set_seq2(query)
    m.set_seq1(candidate)
    return int(m.ratio() * 100)


def common(query: np.ndarray, texts: np.ndarray, letters: int) -> np.ndarray:
    """Length of the longest common subsequence of a text with each of many, letters given by number.

    ``texts`` has a column for each, filled up with ``letters``.  Bit-parallel: a bit of state for each letter
    of the query, 64 a word, and all texts go on by one letter at a time; the zeros left are the length.
    """
    words = -(-len(query) // 64)
    masks = np.zeros((words, letters + 1), dtype=np.uint64)
    at = np.flatnonzero(query >= 0)
    np.bitwise_or.at(masks, (at // 64, query[at]), np.uint64(1) << (at % 64).astype(np.uint64))
    state = np.full((words, texts.shape[1]), ~np.uint64(0))
    for column in texts:
        carry = None
        for k in range(words):
            v, mask = state[k], masks[k][column]
            more = v + (v & mask)
            over = more < v
            if carry is not None:
                more += carry
                over |= more < carry
            carry = over.astype(np.uint64)
            state[k] = more | (v & ~mask)
    return 64 * words - np.bitwise_count(state).sum(0, dtype=np.int64)


def fuzzy(queries: DataFrame, memory: DataFrame, domain: str | None = None, threshold: int = 75, limit: int = 5) -> DataFrame:
    """(segment_id, memory_id, score, place): the ``limit`` most similar entries of every query.

    All entries in the length band of a query are compared, however many.  The longest common subsequence
    bounds the ratio from above and is taken of many entries at once; only where it reaches the threshold is the
    exact ratio taken.  Queries and entries of one length bucket meet in blocks of BLOCK_CHARS by BLOCK_QUERIES,
    so a hot bucket is many tasks and pairs are never shuffled.
    """
    r = threshold / 100
    key, size = ["source_lang", "target_lang", "domain", "bucket"], F.length("query")
    own_domain = F.lit(domain) if domain is not None else F.col("domain")
    q = cut(
        queries.select(F.col("id").alias("segment_id"), T.visible("text").alias("query"), "source_lang", "target_lang", own_domain.alias("domain")).where(size >= 8)
        .withColumn("low", F.floor(size * r).cast("int")).withColumn("high", (F.floor(size / r) + 1).cast("int"))
        .withColumn("bucket", F.explode(F.sequence((F.col("low") / BUCKET).cast("int"), (F.col("high") / BUCKET).cast("int"))))
    )
    wanted = memory if domain is None else memory.where(F.col("domain") == domain)
    m = wanted.select(F.col("id").alias("memory_id"), T.visible("text").alias("candidate"), "source_lang", "target_lang", "domain")
    m = cut(m.withColumn("size", F.length("candidate")).where(F.col("size") > 0).withColumn("bucket", (F.col("size") / BUCKET).cast("int")))
    blocks = m.groupBy(*key).agg(F.ceil(F.sum("size") / BLOCK_CHARS).cast("int").alias("parts")).join(q.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("lots")), key)
    own, each = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet, spread = [*key, "part", "lot"], lanes(queries.sparkSession)
    q = q.join(blocks, key).withColumn("lot", own("segment_id", "lots")).withColumn("part", each("parts")).drop("parts", "lots").repartition(spread, *meet)
    m = m.join(blocks, key).withColumn("part", own("memory_id", "parts")).withColumn("lot", each("lots")).drop("parts", "lots").repartition(spread, *meet)

    def run(qs: pd.DataFrame, ms: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(qs) and len(ms):
            coded = [np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in ms["candidate"]]
            alphabet, sizes = np.unique(np.concatenate(coded)), ms["size"].to_numpy()
            texts = np.full((int(sizes.max()), len(ms)), len(alphabet), dtype=np.int32)
            for i, x in enumerate(coded):
                texts[: len(x), i] = np.searchsorted(alphabet, x)
            ids, candidates, matcher = ms["memory_id"].tolist(), ms["candidate"].tolist(), SequenceMatcher(None, autojunk=False)
            for segment, text, low, high in zip(qs["segment_id"], qs["query"], qs["low"], qs["high"]):
                fit = np.flatnonzero((sizes >= low) & (sizes <= high))
                if not len(fit):
                    continue
                x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
                place = np.minimum(np.searchsorted(alphabet, x), len(alphabet) - 1)
                most = common(np.where(alphabet[place] == x, place, -1), texts[: sizes[fit].max(), fit], len(alphabet))
                near = fit[200 * most >= threshold * (len(x) + sizes[fit])]
                if len(near):
                    matcher.set_seq2(text)
                for i in near:
                    matcher.set_seq1(candidates[i])
                    score = int(matcher.ratio() * 100)
                    if score >= threshold:
                        rows.append((segment, ids[i], abs(int(sizes[i]) - len(x)), score))
        return pd.DataFrame(rows, columns=["segment_id", "memory_id", "gap", "score"]).astype({"segment_id": object, "memory_id": object, "gap": "int32", "score": "int32"})

    scored = q.groupBy(*meet).cogroup(m.groupBy(*meet)).applyInPandas(run, "segment_id string, memory_id string, gap int, score int")
    w = Window.partitionBy("segment_id").orderBy(F.desc("score"), "gap", "memory_id")
    return scored.select("segment_id", "memory_id", "score", F.row_number().over(w).alias("place")).where(F.col("place") <= limit)


def upsert(memory: DataFrame, updates: DataFrame) -> DataFrame:
    """The memory after ``updates(source_text, target_text, source_lang, target_lang, domain, seq)``.

    Blank sides are skipped.  Updates with the key of an entry (hash, languages, domain) replace its
    answer by the last of them and raise its use by their number; others add an entry with the first
    source text.  Result: key columns, source_text, target_text, usage_count, source_length.
    """
    key = ["source_hash", "source_lang", "target_lang", "domain"]
    u = updates.where((T.collapse("source_text") != "") & (T.collapse("target_text") != "")).withColumn("source_hash", T.text_hash("source_text"))
    u = u.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("target_text", F.struct("seq", "target_text")).alias("new_target"), F.min_by("source_text", F.struct("seq", "source_text")).alias("new_source")
    )
    m = memory.groupBy(*key).agg(F.min_by(F.struct("source_text", "target_text", "usage_count"), "id").alias("old"))
    both = m.join(u, key, "full_outer")
    source = F.coalesce("old.source_text", "new_source")
    return both.select(
        *key, source.alias("source_text"), F.coalesce("new_target", "old.target_text").alias("target_text"),
        (F.when(F.col("old").isNull(), F.col("n") - 1).otherwise(F.coalesce("old.usage_count", F.lit(0)) + F.coalesce("n", F.lit(0)))).cast("long").alias("usage_count"),
        F.length(T.visible(source)).alias("source_length"),
    )
