"""Streaming forms: window counts, idempotent events, resettable limits, leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds to wait after the first, second and every later failure.
RETRY_SECONDS = (60, 300, 1800)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream, with a zoned timestamp for watermarks; ``path`` is a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, keys: list[str], width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per key and window; works on a stream and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def sliding(events: DataFrame, keys: list[str], width: str = "1 hour", step: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(*keys, F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each operation id once: within the watermark on a stream, the earliest on a table."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def _fold(times: list[int], kinds: list[str], limit: int, width: int, reset: str, start: int, used: int) -> Iterator[tuple[bool, int, int]]:
    for t, kind in zip(times, kinds, strict=True):
        if kind == reset:
            start, used = -1, 0
            yield True, start, used
            continue
        if start < 0 or t - start >= width:
            start, used = t, 0
        used += 1
        yield used <= limit, start, used


def resettable_limit(events: DataFrame, key: str = "user_id", limit: int = 5, width: int = 900, reset: str = "purchase", late: str = "10 minutes") -> DataFrame:
    """event_id, key and allowed of each event: a window opens with the first attempt, holds ``limit`` of them, and a reset closes it.

    On a stream the open window is state per key that is dropped when the watermark
    passes its end; on a table the same fold runs over each key's rows in order.
    """
    kind = dict(events.dtypes)[key]
    schema = f"event_id long, {key} {kind}, allowed boolean"
    rows = events.select("event_id", key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    if not events.isStreaming:

        def table(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["at", "event_id"])
            pdf["allowed"] = [ok for ok, _, _ in _fold((pdf["at"] // 1_000_000).tolist(), pdf["event_type"].tolist(), limit, width, reset, -1, 0)]
            return pdf[["event_id", key, "allowed"]]

        return rows.groupBy(key).applyInPandas(table, schema)

    def stream(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (-1, 0)
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for ok, start, used in _fold((pdf["at"] // 1_000_000).tolist(), pdf["event_type"].tolist(), limit, width, reset, start, used):
            allowed.append(ok)
        state.update((start, used))
        state.setTimeoutTimestamp(max((start + width) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pdf.assign(allowed=allowed)[["event_id", key, "allowed"]]

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("event_id", key, F.unix_micros("ts").alias("at"), "event_type", "ts")
    return timed.groupBy(key).applyInPandasWithState(stream, schema, "start long, used long", "append", GroupStateTimeout.EventTimeTimeout)


def stale_leases(heartbeats: DataFrame, key: str, now, after_seconds: int = 900) -> DataFrame:
    """Leases whose last heartbeat is too old, with the number of heartbeats as attempts and the wait before the next."""
    last = heartbeats.groupBy(key).agg(F.max("ts").alias("heartbeat_at"), F.count(F.lit(1)).alias("attempts"))
    waits = F.array(*map(F.lit, RETRY_SECONDS))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("heartbeat_at").cast("timestamp"))
    return last.where(age >= after_seconds * 1_000_000).withColumn("retry_seconds", F.element_at(waits, F.least(F.col("attempts"), F.lit(len(RETRY_SECONDS))).cast("int")))


def fenced(results: DataFrame, key: str, generation: str) -> DataFrame:
    """Results of the newest generation of each key; later arrivals of older generations don't count."""
    newest = results.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(newest, [key, generation], "left_semi")
