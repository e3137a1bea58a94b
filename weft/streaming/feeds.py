"""Streams over the event log: usage by time, changes of a key's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The event log as a stream of Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def usage(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events by tumbling window of event time; rows later than the watermark are left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def changes(events: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type): the events at which a user's last type changes; state is one short string per user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for e, t in zip(rows["event_id"], rows["event_type"]):
            if t != last:
                out.append((key[0], e, t))
                last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, event_type string", "last string", "append", "NoTimeout")
