"""Changes to segments, memory and files as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import text as T

# Origins of answers that are not written to the memory, statuses an approval takes, words a page holds, bytes a group of base64 holds.
NOT_REMEMBERED, APPROVABLE = ("echo", "source"), ("translated", "reviewed")
WORDS_A_PAGE, GROUP_BYTES, GROUP_CHARS = 250, 3, 4
ECHO = "[EN] "


def derived(segments: DataFrame, matched: DataFrame) -> DataFrame:
    """(id, status, target_text, origin, is_locked) of new segments: a memory match is translated, a text that needs none locked.

    ``segments(id, source_text, source_hash)``, ``matched(id, memory_text)``; null matches are none.
    """
    c = F.col
    needless = ~T.is_translatable("source_text")
    hit = c("memory_text").isNotNull()
    return segments.join(matched, "id", "left").select(
        "id", F.when(needless, "approved").when(hit, "translated").otherwise("draft").alias("status"),
        F.when(needless, c("source_text")).otherwise(c("memory_text")).alias("target_text"),
        F.when(needless, "source").when(hit, "tm_exact").alias("origin"), needless.alias("is_locked"),
    )


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key is not among the deleted ones; null keys stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def apply_proposals(segments: DataFrame, proposals: DataFrame) -> DataFrame:
    """(id, old_text, target_text, status) of the segments an approved proposal changes.

    ``proposals(id, proposal)``, one for each segment.  Locked and absent segments are left out, and
    proposals that change nothing; a draft becomes translated.  The old text is what an audit keeps.
    """
    c = F.col
    open_ = segments.where(~F.coalesce(c("is_locked"), F.lit(False)))
    changed = open_.join(proposals, "id").where(c("proposal").isNotNull() & ~c("proposal").eqNullSafe(c("target_text")))
    return changed.select("id", c("target_text").alias("old_text"), c("proposal").alias("target_text"), F.when(c("status") == "draft", "translated").otherwise(c("status")).alias("status"))


def sibling_proposals(segments: DataFrame) -> DataFrame:
    """(id, proposal): segments that repeat, in their file, a source whose answer a person has edited.

    The latest edit counts, ties by id.  Edits are one row for each hash, so no pairs within a group are made.
    """
    c = F.col
    key = ["file_id", "source_hash"]
    edits = segments.where(c("edited_by_human") & c("source_hash").isNotNull() & c("target_text").isNotNull())
    last = edits.groupBy(*key).agg(F.max(F.struct("updated_at", "id", "target_text")).alias("e"))
    return segments.where(~c("edited_by_human")).join(last, key).where(~c("e.target_text").eqNullSafe(c("target_text"))).select("id", c("e.target_text").alias("proposal"))


def approved(segments: DataFrame) -> DataFrame:
    """(id, remembered): what approving everything approves, and whether the pair goes to the memory.

    Segments translated or reviewed whose answer is not blank; answers that only echo or repeat the
    source by their origin are approved and not remembered.
    """
    c = F.col
    answer = F.coalesce(T.collapse("target_text"), F.lit("")) != ""
    known = ~F.coalesce(c("origin").isin(*NOT_REMEMBERED), F.lit(False)) & ~F.startswith(c("target_text"), F.lit(ECHO))
    return segments.where(c("status").isin(*APPROVABLE) & answer).select("id", known.alias("remembered"))


def reindexed(memory: DataFrame) -> DataFrame:
    """(id, old_length, source_length) of the entries whose stored length is not that of their visible text."""
    now = F.coalesce(F.length(T.visible("source_text")), F.lit(0))
    return memory.select("id", F.col("source_length").alias("old_length"), now.alias("source_length")).where(~F.col("old_length").eqNullSafe(F.col("source_length")))


def polluted(memory: DataFrame) -> DataFrame:
    """Entries whose answer is the offline engine's echo; deleting them is ``without(memory, polluted(memory), 'id')``."""
    return memory.where(F.startswith(F.col("target_text"), F.lit(ECHO)))


def pages_from_words(words: Column) -> Column:
    """Pages of so many words, halves to the even page, one at least."""
    return F.greatest(F.lit(1), F.bround(words / F.lit(float(WORDS_A_PAGE))).cast("int"))


def encoded_bytes(size: Column) -> Column:
    """Bytes of a file of ``size`` bytes once written in base64."""
    return (F.floor((size + (GROUP_BYTES - 1)) / GROUP_BYTES) * GROUP_CHARS).cast("long")


def longest_run(text: Column) -> Column:
    """Longest run of characters whose code points follow each other by one, white space left out; null and blank texts have 0."""
    chars = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", ""), ""), lambda ch: ch != "")
    points = F.transform(chars, F.ascii)
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, p: Column) -> Column:
        run = F.when(p == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(points, start, step, lambda acc: acc["best"])
