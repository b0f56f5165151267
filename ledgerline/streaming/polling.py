"""Polling a folder in micro-batches into a table that holds the latest row of each key.

A batch is written to a folder of its own number, which a repeat of the batch replaces; so a
stop between batches, or between a write and its commit, leaves no row twice and none out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds between polls of new records and of slower checks.
FAST, SLOW = 5, 60


def latest_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the largest ``order`` of each key, ties by all columns; null order values are the smallest, null keys are a key."""
    rest = [c for c in rows.columns if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r")).select([f"__r.`{c}`" for c in rows.columns])


def poll(stream: DataFrame, sink: str, checkpoint: str, keys: list[str], order: list[str], seconds: int | None = None) -> StreamingQuery:
    """Start a query that writes each batch's latest row of each key to ``sink``: over what is there and then done, or every ``seconds``.

    ``sink`` and ``checkpoint`` are folders that the executors share; one checkpoint belongs to one sink.
    A batch without rows writes nothing.
    """
    if "batch" in stream.columns:
        raise ValueError("batch is the name of the sink's folders")

    def put(rows: DataFrame, number: int) -> None:
        latest_rows(rows, keys, order).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def current(spark: SparkSession, sink: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key over all batches of ``sink`` (which has at least one)."""
    return latest_rows(spark.read.schema(schema).option("basePath", sink).parquet(f"{sink}/batch=*").drop("batch"), keys, order)
