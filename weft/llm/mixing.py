"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.dedup import first_delivery
from weft.session import cut, small_table

#: Blocks of equal tokens that a mix is apportioned in, besides those for each shard of its sources.
BLOCKS = 4096
#: Blocks more for each shard, so that a shard's quota is fine however many shards there are.
BLOCKS_A_SHARD = 16
#: Documents of a source that one shard holds, about; a source has at most MOST_SHARDS shards.
SHARD_DOCS = 200_000
MOST_SHARDS = 4096
#: Documents on either side of the end of a draw that are chosen one by one, so that the sum meets the quota.
RIM = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) with the public tokenizer at ``vocabulary``.

    Null and empty texts have none; null ids are left out.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": pd.Series(n, dtype="int64")})

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, tokens long")


def apportion(shares: dict, blocks: int, caps: dict | None = None) -> dict:
    """Sainte-Laguë: every block goes to the name with the highest share / (2 * blocks it has + 1).

    A name stops at its cap.  Ties go to the name that sorts first; shares of zero get nothing.
    """
    got = {s: 0 for s in shares}
    heap = [(-w, s) for s, w in shares.items() if w > 0 and (caps is None or caps.get(s, blocks) > 0)]
    heapq.heapify(heap)
    for _ in range(blocks):
        if not heap:
            break
        _, s = heapq.heappop(heap)
        got[s] += 1
        if caps is None or got[s] < caps.get(s, blocks):
            heapq.heappush(heap, (-shares[s] / (2 * got[s] + 1), s))
    return got


def subset(sizes: list[int], want: float) -> list[bool]:
    """Which items to take so that their sizes sum up to ``want`` as nearly as can be; the lower of two equally near sums.

    The sums that can be reached are kept as the bits of one number for every prefix of the items.
    """
    reach = [1]
    for n in sizes:
        reach.append(reach[-1] | reach[-1] << n)
    bits = bin(reach[-1])[:1:-1]
    start = max(0, min(len(bits) - 1, round(want)))
    below = bits.rfind("1", 0, start + 1)
    above = bits.find("1", start)
    at = below if above < 0 or want - below <= above - want else above
    out = [False] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        if not reach[i] >> at & 1:
            out[i] = True
            at -= sizes[i]
    return out


def laid_out(counts: DataFrame, names: list[str], seed: int) -> tuple[DataFrame, dict[str, dict[int, int]], dict[str, int]]:
    """The documents of the named sources laid end to end in each shard, the tokens of each shard, the documents of each source.

    A source has one shard for every SHARD_DOCS documents, MOST_SHARDS at most; a shard is a hash of
    the document id.  Within a shard the documents stand in the order of a seeded hash; ``start`` is
    the number of tokens before a document, ``place`` its number from 1.  To the driver come one row
    a source and one row a shard.
    """
    own = counts.where(F.col("source").isin(names) & (F.col("tokens") > 0))
    many = {r["source"]: r["n"] for r in own.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()} if names else {}
    shards = {s: min(MOST_SHARDS, -(-n // SHARD_DOCS)) for s, n in many.items()}
    table = small_table(counts.sparkSession, sorted(shards.items()), "source string, shards int")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    laid = cut(
        own.join(table, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards")).cast("int"))
        .select("doc_id", "source", "tokens", "shard", (F.sum("tokens").over(order) - F.col("tokens")).alias("start"), F.row_number().over(order).alias("place"))
    )
    sums: dict[str, dict[int, int]] = {}
    for r in laid.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect():
        sums.setdefault(r["source"], {})[r["shard"]] = r["tokens"]
    return laid, sums, many


def sizes_of(mixes: list[dict], sums: dict[str, dict[int, int]], many: dict[str, int], few: int) -> dict[str, tuple[float, str, dict[str, float]]]:
    """mix -> (tokens of the whole mix, the source that bounds it, shares of the sources that have documents)."""
    out = {}
    for mix in sorted({m["mix_name"] for m in mixes}):
        own = {m["source"]: m for m in mixes if m["mix_name"] == mix and m["source"] in sums and (m["target_share"] or 0) > 0 and (m["max_repeats"] or 0) > 0}
        if not own:
            continue
        whole = sum(m["target_share"] for m in own.values())
        shares = {s: m["target_share"] / whole for s, m in own.items()}
        room = {s: sum(sums[s].values()) * m["max_repeats"] / shares[s] for s, m in own.items()}
        bound = min((s for s in own if many[s] >= few), key=lambda s: (room[s], s), default=None) or min(own, key=lambda s: (room[s], s))
        out[mix] = room[bound], bound, shares
    return out


def records(counts: DataFrame, targets: DataFrame, seed: int = 7, few: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """(mix_name, doc_id, source, tokens, repeats, bound): the chosen records of every mix.

    A mix is as large as every source with documents can meet its share within its repeats; ``bound``
    is the source that sets the size.  With ``few`` above 0 sources of fewer documents don't bound it:
    they are taken as often as they may be and fall short.  A source without documents gets nothing;
    the others keep their proportions.

    The mix is cut into equal blocks of tokens; Sainte-Laguë gives each source its number of blocks
    and each of its shards a part of them.  A shard gives whole rounds of all its documents and then
    its first blocks in seeded order: the documents whose middle lies within them.  At the rim of each
    source's draw, up to RIM documents on either side are taken or left one by one, so that the tokens
    of the source come as near to its quota as whole documents allow.  Rows of the targets with null
    or repeated (mix, source) count once or not at all; ties go to the lower document id.
    """
    spark = counts.sparkSession
    mixes = [r.asDict() for r in first_delivery(targets.where(F.col("source").isNotNull() & F.col("mix_name").isNotNull()), ["mix_name", "source"]).collect()]
    laid, sums, many = laid_out(counts, sorted({m["source"] for m in mixes}), seed)
    repeats = {(m["mix_name"], m["source"]): m["max_repeats"] for m in mixes}
    rows, wanted = [], {}
    for mix, (size, bound, shares) in sizes_of(mixes, sums, many, few).items():
        n = blocks + BLOCKS_A_SHARD * sum(len(sums[s]) for s in shares)
        block = size / n
        quota = apportion(shares, n)
        for s in sorted(shares):
            have, most = sum(sums[s].values()), repeats[mix, s]
            rounds = min(most, int(quota[s] * block / have + 1e-9))
            rest = min(quota[s] * block - rounds * have, have if rounds < most else 0.0)
            part = apportion(sums[s], max(0, round(rest / block)))
            wanted[mix, s] = rest if rounds < most else 0.0
            rows += [(mix, s, k, rounds, part[k] * block if rounds < most else 0.0, bound) for k in sorted(sums[s])]
    # one row for each shard of each source of each mix, with known size: the optimizer broadcasts it where that is small
    plan = small_table(spark, rows, "mix_name string, source string, shard int, rounds int, edge double, bound string")
    drawn = laid.join(plan, ["source", "shard"]).withColumn("extra", F.col("start") + F.col("tokens") / 2 < F.col("edge"))
    got = drawn.where("extra").groupBy("mix_name", "source", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).collect()
    taken: dict[tuple[str, str], int] = {}
    ends = {(r[0], r[1], r[2]): 0 for r in rows if wanted[r[0], r[1]] > 0}
    for r in got:
        taken[r["mix_name"], r["source"]] = taken.get((r["mix_name"], r["source"]), 0) + r["tokens"]
        ends[r["mix_name"], r["source"], r["shard"]] = r["n"]
    rim_at = [(mix, s, k, ends[mix, s, k]) for mix, s in wanted if wanted[mix, s] > 0 for k in [min(sums[s])]]
    rim = drawn.join(small_table(spark, rim_at, "mix_name string, source string, shard int, end int"), ["mix_name", "source", "shard"])
    near = rim.where((F.col("place") > F.col("end") - RIM) & (F.col("place") <= F.col("end") + RIM)).select("mix_name", "source", "doc_id", "tokens", "place", "extra").collect()  # 2 * RIM rows at most for each row of the targets
    groups: dict[tuple[str, str], list] = {}
    for r in sorted(near, key=lambda r: r["place"]):
        groups.setdefault((r["mix_name"], r["source"]), []).append(r)
    changed = []
    for (mix, s), own in groups.items():
        fixed = taken.get((mix, s), 0) - sum(r["tokens"] for r in own if r["extra"])
        for r, take in zip(own, subset([r["tokens"] for r in own], wanted[mix, s] - fixed)):
            if take != r["extra"]:
                changed.append((mix, r["doc_id"], take))
    # bounded like ``near``
    rim_choice = small_table(spark, changed, "mix_name string, doc_id long, other boolean")
    return (
        drawn.join(F.broadcast(rim_choice), ["mix_name", "doc_id"], "left")
        .withColumn("repeats", F.col("rounds") + F.coalesce("other", "extra").cast("int")).where(F.col("repeats") > 0)
        .select("mix_name", "doc_id", "source", "tokens", "repeats", "bound")
    )


def shares_reached(chosen: DataFrame, counts: DataFrame, targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Every source of every mix: target, what was sought and reached, and what kept it from its share.

    (mix_name, source, target_share, max_repeats, documents, records, tokens, sought_share,
    reached_share, most_repeats, remark).  The share sought is the target's part among the sources that
    have documents.  ``remark`` is 'no documents' where the source has none, 'whole documents' where no
    choice of whole documents came within ``tolerance`` of the share sought, 'sets the size' where the
    mix can't be larger without this source falling short, else 'met'.
    """
    c = F.col
    per = chosen.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("records"), F.sum(c("tokens") * c("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = chosen.groupBy("mix_name").agg(F.sum(c("tokens") * c("repeats")).alias("mix_tokens"), F.min("bound").alias("bound"))
    have = counts.where(c("tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    base = first_delivery(targets, ["mix_name", "source"]).join(have, "source", "left")
    usable = c("documents").isNotNull() & (c("target_share") > 0) & (c("max_repeats") > 0)
    whole = base.groupBy("mix_name").agg(F.sum(F.when(usable, c("target_share"))).alias("whole"))
    rows = base.join(whole, "mix_name", "left").join(per, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = F.lit(0).cast("long")
    reached = F.coalesce(c("tokens") / c("mix_tokens"), F.lit(0.0))
    sought = F.coalesce(F.when(usable, c("target_share") / c("whole")), F.lit(0.0))
    return rows.select(
        "mix_name", "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("records", zero).alias("records"), F.coalesce("tokens", zero).alias("tokens"),
        F.round(sought, 5).alias("sought_share"), F.round(reached, 5).alias("reached_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.when(c("documents").isNull(), "no documents").when(F.abs(reached - sought) > tolerance, "whole documents")
        .when(c("source") == c("bound"), "sets the size").otherwise("met").alias("remark"),
    )
