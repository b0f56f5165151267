"""Sinks: append, upsert by rewrite, JSON, JSON lines, CSV, metric exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import csv_guard


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """One JSON object of the columns in order of their names."""
    return F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of both with, for each key, the one of the largest ``order``."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(canonical_json(df).alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def csv_view(df: DataFrame) -> DataFrame:
    """Columns as guarded text: nested values as JSON, null as empty."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
        out.append(F.coalesce(csv_guard(c) if isinstance(f.dataType, T.StringType) else c, F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    csv_view(df).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quoteAll", False).csv(path)


def exposition(series: DataFrame) -> DataFrame:
    """Lines of a metric exposition text from (name, labels, value): a TYPE line and a sample line each."""
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.format_string('%s="%s"', e["key"], F.regexp_replace(e["value"], r'(["\\])', r"\\$1"))), ",")
    sample = F.format_string("%s{%s} %s", F.col("name"), label, F.col("value").cast("string"))
    kinds = series.select("name").distinct().select("name", F.lit(0).alias("at"), F.format_string("# TYPE %s gauge", "name").alias("value"))
    return kinds.union(series.select("name", F.lit(1), sample)).orderBy("name", "at", "value").select("value")


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], **options) -> dict:
    """Writes Parquet and returns the metrics (aggregates by name) of the rows written, counted in the pass that writes them.

    The table isn't read again.  A task that runs twice counts once; an empty table gives counts of zero and null for the rest.
    """
    seen = Observation()
    df.observe(seen, *(m.alias(name) for name, m in metrics.items())).write.parquet(path, **options)
    return seen.get
