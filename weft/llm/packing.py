"""Problem 7: filling batches of fixed capacity with segments of varying length."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.dedup import first_delivery

#: Rows that one task packs at most, about: a file with more is cut into shards packed independently.
SHARD_ROWS = 20_000


def pack(sizes: list[int], capacity: int, most: int | None) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, end): harmonic packing of one shard.

    An item longer than the capacity C is cut into full pieces and a rest, no other item is split.
    Pieces of length in (C/(j+1), C/j] form class j, for every j that the lengths call for; where a bin
    takes at most ``most`` pieces, all of C/most or shorter are one class.  A bin of class j takes j
    pieces, whatever their lengths.  Classes are packed from the longest to the shortest.  Before a
    class opens bins of its own, the bins that longer classes left open, the roomiest first, take from
    it as many pieces as the longest of them that fits allows by count.  Empty pieces go with any bin
    of the last class.  A capacity under 1 counts as 1.
    """
    capacity = max(1, capacity)
    limit = max(1, most) if most is not None else 1 << 60
    classes: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for i, n in enumerate(sizes):
        for a in range(0, max(n, 1), capacity):
            b = min(n, a + capacity)
            classes[min(limit, capacity // max(1, b - a))].append((a - b, i, a, b))
    bins: list[list[tuple[int, int, int]]] = []
    left: list[tuple[int, int]] = []  # (room, number) of bins that may take more
    for j in sorted(classes):
        pieces = sorted(classes[j])
        still = []
        for room, x in sorted(left, key=lambda r: (-r[0], r[1])):
            while len(bins[x]) < limit and (at := bisect_left(pieces, (-room,))) < len(pieces):
                longest = -pieces[at][0]
                count = min(limit - len(bins[x]), room // longest if longest else limit)
                room += sum(p[0] for p in pieces[at : at + count])
                bins[x] += [p[1:] for p in pieces[at : at + count]]
                del pieces[at : at + count]
            still.append((room, x))
        for at in range(0, len(pieces), j):
            own = pieces[at : at + j]
            still.append((capacity + sum(p[0] for p in own), len(bins)))
            bins.append([p[1:] for p in own])
        left = [(room, x) for room, x in still if len(bins[x]) < limit]
    return bins


def shards(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with a shard number: groups of more than SHARD_ROWS rows are cut by a hash of the segment id.

    Group sizes are counted with partial aggregation; only sizes of groups that need a cut are joined
    back, and those are at most rows / SHARD_ROWS.
    """
    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SHARD_ROWS)
    # joined without a hint: the optimizer broadcasts the few large groups or shuffles by its measured size
    joined = rows.join(large, group, "left")
    cut = F.ceil(F.coalesce("__n", F.lit(1)) / F.lit(SHARD_ROWS)).cast("int")
    return joined.withColumn("shard", F.pmod(F.xxhash64("segment_id"), cut).cast("int")).drop("__n")


def batches(segments: DataFrame, settings: DataFrame) -> DataFrame:
    """(profile, file_id, shard, batch_no, segment_id, start_pos, end_pos): the translatable segments of every file in batches.

    Segments delivered again count once; null ids and null file ids are left out, null texts count as
    empty, untranslatable segments are not packed.  A profile with a null segment limit has none; one
    with a null budget is left out.  Batch numbers run within (profile, file_id, shard).
    """
    base = segments.where(F.col("id").isNotNull() & F.col("file_id").isNotNull() & F.col("is_translatable"))
    sizes = base.groupBy(F.col("id").alias("segment_id")).agg(F.min("file_id").alias("file_id"), F.max(F.coalesce(F.length("source_text"), F.lit(0))).alias("size"))
    plain = shards(sizes, ["file_id"])
    profiles = first_delivery(settings.where(F.col("batch_char_budget").isNotNull()).select("profile", "batch_char_budget", "batch_max_segments"), "profile")
    rows = [(r["profile"], int(r["batch_char_budget"]), None if r["batch_max_segments"] is None else int(r["batch_max_segments"])) for r in profiles.orderBy("profile").collect()]  # settings: one row per profile

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = pdf["segment_id"].tolist(), pdf["size"].tolist()
        out = []
        for profile, budget, most in rows:
            for no, content in enumerate(pack(sizes, budget, most)):
                out += [(profile, no, ids[i], a, b) for i, a, b in content]
        got = pd.DataFrame(out, columns=["profile", "batch_no", "segment_id", "start_pos", "end_pos"])
        got["file_id"], got["shard"] = pdf["file_id"].iloc[0], pdf["shard"].iloc[0]
        return got[["profile", "file_id", "shard", "batch_no", "segment_id", "start_pos", "end_pos"]]

    return plain.groupBy("file_id", "shard").applyInPandas(run, "profile string, file_id string, shard int, batch_no int, segment_id string, start_pos int, end_pos int")


def use_of_budget(packed: DataFrame, settings: DataFrame) -> DataFrame:
    """Per profile: batches, characters, the share of the budget used and the fewest batches there could be.

    The lower bound is per file: characters over budget or pieces over the segment limit, rounded up.
    """
    c = F.col
    per_batch = packed.groupBy("profile", "file_id", "shard", "batch_no").agg(F.sum(c("end_pos") - c("start_pos")).alias("chars"), F.count(F.lit(1)).alias("pieces"))
    per_file = per_batch.groupBy("profile", "file_id").agg(F.count(F.lit(1)).alias("batches"), F.sum("chars").alias("chars"), F.sum("pieces").alias("pieces"), F.max("chars").alias("fullest"), F.max("pieces").alias("most_pieces"))
    profiles = first_delivery(settings.select("profile", "batch_char_budget", "batch_max_segments"), "profile")
    least = F.greatest(F.ceil(c("chars") / c("batch_char_budget")), F.coalesce(F.ceil(c("pieces") / c("batch_max_segments")), F.lit(1)), F.lit(1))
    return (
        per_file.join(profiles, "profile").withColumn("least", least)
        .groupBy("profile").agg(
            F.sum("batches").alias("batches"), F.sum("least").alias("fewest_possible"), F.sum("chars").alias("chars"),
            F.round(F.sum("chars") / F.sum(c("batches") * c("batch_char_budget")), 4).alias("budget_used"), F.max("fullest").alias("fullest"), F.max("most_pieces").alias("most_pieces"),
        )
    )
