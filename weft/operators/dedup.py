"""Rows delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, key: str | list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per key.

    Copies are equal but for ``loaded_at``, so any of them serves; ``min`` of the row struct makes
    the choice independent of the partitioning.  Aggregation combines on the map side, so a key
    delivered very often costs one row per task in the shuffle.  Null keys form one group.
    Maps cannot be ordered and are taken with ``any_value``.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in (keep or df.columns) if c not in keys and c != "loaded_at"]
    kinds = dict(df.dtypes)
    plain = [c for c in rest if not kinds[c].startswith("map")]
    if len(plain) == len(rest) and not rest:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(1)
    aggs = [F.min(row).alias("__row")] + [F.any_value(F.col(f"`{c}`")).alias(c) for c in rest if c not in plain]
    out = df.groupBy(*keys).agg(*aggs)
    picked = [F.col("__row")[c].alias(c) if c in plain else F.col(c) for c in rest]
    return out.select(*keys, *picked)
