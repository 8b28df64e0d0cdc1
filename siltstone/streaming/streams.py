"""The same windows for batches and streams, and incremental upkeep of derived tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.lexical import search_fields


def windowed(events: DataFrame, window: Column, by: list[str], late: str | None = None, time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and values per window and key. ``late``: the watermark, for streams."""
    base = events.withWatermark(time, late) if late and events.isStreaming else events
    out = base.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(value), 4).alias("total"), F.round(F.max(value), 6).alias("most"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("window_end"), *by, "events", "total", "most")


def tumbling(events: DataFrame, size: str, by: list[str], **options) -> DataFrame:
    return windowed(events, F.window("ts", size), by, **options)


def sliding(events: DataFrame, size: str, step: str, by: list[str], **options) -> DataFrame:
    return windowed(events, F.window("ts", size, step), by, **options)


def sessions(events: DataFrame, gap: str, by: list[str], **options) -> DataFrame:
    return windowed(events, F.session_window("ts", gap), by, **options)


def first_deliveries(chunks: DataFrame, late: str = "45 days", key: str = "id", time: str = "created_at") -> DataFrame:
    """A stream without records delivered again within the watermark."""
    return chunks.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def keep_search_fields(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each inserted or updated chunk with its derived search fields; restarts continue at the checkpoint.

    A batch that is run again after a failure writes the same folder again, so nothing is kept twice.
    ``current_fields`` reads the last version of every chunk.
    """

    def batch(df: DataFrame, number: int) -> None:
        search_fields(df).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_fields(kept: DataFrame, key: str = "id", time: str = "created_at") -> DataFrame:
    """One row per key: that of the last batch, in a batch that of the latest ``time``. Aggregated partially before the shuffle."""
    others = [c for c in kept.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*others), F.struct("version", time)).alias("_r")
    return kept.groupBy(key).agg(last).select(key, *[F.col(f"_r.{c}").alias(c) for c in others if c != "version"])


def running_best(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, best, seen) after each batch, with state per key that keeps two numbers."""

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, seen = state.get if state.exists else (float("inf"), 0)
        for p in parts:
            best, seen = min(best, float(p[value].min())), seen + len(p)
        state.update((best, seen))
        yield pd.DataFrame({key: [k[0]], "best": [best], "seen": [seen]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, best double, seen bigint", "best double, seen bigint", "update", GroupStateTimeout.NoTimeout)
