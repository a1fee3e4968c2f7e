"""Structured Streaming counterparts of the event queries: windows with late data, first-seen deduplication, state by key, index upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.snapshots import SnapshotTable

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Parquet event files as a stream, so many new files a batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped, and state with them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: exact, with bounded state."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def throttle(events: DataFrame) -> DataFrame:
    """(user_id, ema, delay): a moving average of latencies by user, kept as state between batches."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema = state.get[0] if state.exists else None
        for v in pd.concat(list(parts)).sort_values("event_id")["value"]:
            ema = v if ema is None else 0.85 * ema + 0.15 * v
        state.update((ema,))
        yield pd.DataFrame({"user_id": [key[0]], "ema": [ema], "delay": [max(0.2, min(30.0, 5 * ema))]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id bigint, ema double, delay double", "ema double", "update", GroupStateTimeout.NoTimeout)


def keep_latest(events: DataFrame, target: SnapshotTable, checkpoint: str, key: str = "user_id", order: str = "event_id"):
    """Upsert every batch into a snapshot table: the latest row of each key; returns the running query (available data, then stop)."""

    def upsert(batch: DataFrame, _: int) -> None:
        old = target.current()
        both = batch if old is None else old.unionByName(batch)
        names = batch.columns
        latest = both.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")
        target.write(latest)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
