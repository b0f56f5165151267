"""Operators over keyed, ordered rows: latest versions, changes, runs, counts in ranges.

All are window functions keyed by the series, so a series is one sort within its
partition; rows of a series are never gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def over(keys: list[str], *order: Column | str):
    """A window; null order values come first unless the order says otherwise."""
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__rn", F.row_number().over(over(keys, *order))).where("__rn = 1").drop("__rn")


def latest_with_ties(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """All rows of each key that share the first place."""
    return df.withColumn("__rk", F.rank().over(over(keys, order))).where("__rk = 1").drop("__rk")


def change(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str = "delta") -> DataFrame:
    """The difference to the row before in the series; null for the first and where either is missing."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(over(keys, *order)))


def numbered(df: DataFrame, keys: list[str], *order: Column | str, out: str = "position") -> DataFrame:
    return df.withColumn(out, F.row_number().over(over(keys, *order)))


def placed(df: DataFrame, rank: str, number: str, out: str = "place", width: int = 1 << 14) -> DataFrame:
    """The place of each row in the order of (rank, number) over the whole table; both are whole numbers, nulls come first.

    Rows are numbered within stretches of ``width`` numbers, so no task sorts the table; only counts of stretches meet in one.
    """
    cut = df.withColumn("__cut", F.floor(F.col(number) / width))
    before = F.sum("__n").over(Window.orderBy(rank, "__cut").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut.groupBy(rank, "__cut").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    own = F.row_number().over(over([rank, "__cut"], number))
    counts = counts.select(F.col(rank).alias("__rank"), F.col("__cut").alias("__of"), "__before")
    same = F.col(rank).eqNullSafe(F.col("__rank")) & F.col("__cut").eqNullSafe(F.col("__of"))
    return cut.withColumn("__own", own).join(counts, same).withColumn(out, F.col("__before") + F.col("__own")).drop("__cut", "__own", "__before", "__rank", "__of")


def multiplicity(df: DataFrame, keys: list[str], out: str = "multiplicity") -> DataFrame:
    return df.withColumn(out, F.count(F.lit(1)).over(over(keys)))


def scaled(df: DataFrame, keys: list[str], value: str, out: str = "scaled") -> DataFrame:
    """A value's place between the least and the largest of its series; 0.5 if they are equal."""
    low, high = F.min(value).over(over(keys)), F.max(value).over(over(keys))
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.5)))


def runs(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str = "run") -> DataFrame:
    """The number of the run of equal values that a row is in."""
    w = over(keys, *order)
    fresh = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True)).cast("int")
    return df.withColumn("__fresh", fresh).withColumn(out, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__fresh")


def carried(df: DataFrame, keys: list[str], order: list[Column | str], value: str, out: str) -> DataFrame:
    """The last known value up to a row."""
    w = over(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def counts_before(df: DataFrame, keys: list[str], seconds: str, width: int, out: str) -> DataFrame:
    """Rows of the key in the ``width`` seconds up to a row, itself included."""
    return df.withColumn(out, F.count(F.lit(1)).over(over(keys, seconds).rangeBetween(-width, 0)))


def daily_latest(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key and day."""
    day = df.withColumn("day", F.to_date(ts))
    return latest(day, [*keys, "day"], F.col(ts).desc(), F.col(tie).desc())


def series_of_days(df: DataFrame, keys: list[str], day: str, least: int) -> DataFrame:
    """Rows of the series that have at least so many distinct days."""
    wide = df.groupBy(*keys).agg(F.countDistinct(day).alias("__days")).where(F.col("__days") >= least)
    return df.join(wide.select(*keys), keys, "left_semi")


def change_then_filter(df: DataFrame, keys: list[str], order: str, value: str, chosen: Column) -> DataFrame:
    """Differences over the whole history, shown only where the row before is chosen too."""
    w = over(keys, order)
    full = df.withColumn("__chosen", chosen).withColumn("__before", F.lag("__chosen").over(w)).withColumn("delta", F.col(value) - F.lag(value).over(w))
    return full.where("__chosen").withColumn("delta", F.when(F.col("__before"), F.col("delta"))).drop("__chosen", "__before")
