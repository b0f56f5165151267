"""Aggregate-shaped operators: exactly-one, folds, conflicts, rollups, scores, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exactly_one(value: str) -> Column:
    """The value of a group if all rows have it and none is missing, else null."""
    return F.when((F.countDistinct(value) == 1) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def fold(df: DataFrame, keys: list[str], every: dict[str, Column], some: dict[str, Column], first: str, order: str) -> DataFrame:
    """One row a key: conditions that hold for every row, for some row, and the first row's value."""
    return df.groupBy(*keys).agg(*(F.bool_and(c).alias(n) for n, c in every.items()), *(F.bool_or(c).alias(n) for n, c in some.items()), F.min_by(first, F.struct(order, first)).alias(first))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with the number of their distinct values and whether they conflict."""
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values")).withColumn("conflict", F.col("n_values") > 1)


def distinct_list(value: str, sep: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def matrix(df: DataFrame, row: str, column: str, value: Column, columns: list[str]) -> DataFrame:
    """Rows by columns; the columns are named, so no pass over the data finds them."""
    return df.groupBy(row).pivot(column, columns).agg(value)


def metric_series(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(name, labels as canonical JSON, value_sum, sample_count)."""
    key = F.to_json(F.struct(*sorted(labels)))
    return df.groupBy(key.alias("labels")).agg(F.sum(value).alias("value_sum"), F.count(F.lit(1)).alias("sample_count")).select(F.lit(name).alias("name"), "labels", "value_sum", "sample_count")


def alerts(metrics: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(alert, metric, value, firing): a rule fires where its metric is over its threshold."""
    out = [metrics.where(F.col("metric") == metric).select(F.lit(alert).alias("alert"), "metric", "value", (F.col("value") > limit).alias("firing")) for alert, metric, limit in rules]
    return reduce(DataFrame.union, out)


def scores(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall and f1; null where a denominator is zero."""
    hit, miss, extra = F.count_if(truth & predicted), F.count_if(truth & ~predicted), F.count_if(~truth & predicted)
    counted = df.groupBy(*keys).agg(hit.alias("tp"), miss.alias("fn"), extra.alias("fp"))
    return counted.select(
        *keys, "tp", "fp", "fn",
        F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"),
    )


def gate(now: DataFrame, baseline: DataFrame, key: str, metric: str, tolerance: float) -> DataFrame:
    """Change of a metric against a baseline and whether it passes; a missing side doesn't."""
    joined = now.select(key, F.col(metric).alias("now")).join(baseline.select(key, F.col(metric).alias("base")), key, "full")
    return joined.withColumn("delta", F.round(F.col("now") - F.col("base"), 6)).withColumn("passes", F.coalesce(F.col("delta") >= -tolerance, F.lit(False)))


def fingerprint(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """A digest of each key's rows in order; keys have bounded groups."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda r: F.to_json(r))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(rows, "\n"), 256).alias("fingerprint"))


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of a value's histogram."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # sum of -p log2 p in one pass: log2 of the total less the weighted mean of log2 n
    return counts.groupBy(*keys).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
