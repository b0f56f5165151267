"""Typed access to the driver's tables; every read names its columns so that scans stay narrow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Closed schemas of the nested sources; nothing is inferred.
EVENT_PROPS = T.StructType([T.StructField("k", T.LongType())])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def json_dimension(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON dimension with a closed schema; a file that doesn't hold to it fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a JSON-lines source; a line that isn't of the schema is kept as text."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("row"))
    return parsed.where("row._corrupt IS NULL").select("row.*").drop("_corrupt"), parsed.where("row._corrupt IS NOT NULL").select("value")


def portable(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """A portable snapshot of any earlier version: arrays that a version lacks are empty, never null."""
    for name, kind in arrays.items():
        empty = F.array().cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name), empty) if name in df.columns else empty)
    return df


def discover(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder, one for each content (the first by path), with size and sha256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    named = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    first = named.groupBy("sha256").agg(F.min_by(F.struct("path", "length"), "path").alias("f"), F.count(F.lit(1)).alias("copies"))
    return first.select("f.path", "f.length", "sha256", "copies")


def synthetic(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``n`` deterministic rows: id, a patient of a hundredth of them, a day and a value."""
    h = F.xxhash64(F.lit(seed), "id")
    return spark.range(n).select("id", F.pmod(h, F.lit(max(1, n // 100))).alias("patient_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(h, F.lit(1000)).cast("int")).alias("day"), (F.pmod(h, F.lit(10_000)) / 100.0).alias("value"))


def versioned(lines: DataFrame, schemas: dict[int, str], upgrades: dict[int, Callable[[Column], Column]], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows of the last version, rejected lines) of JSON lines that each say their ``version``.

    A line is read with the closed schema of its own version and goes through the upgrades from there
    on, one version at a time; an upgrade is a function from a version's struct to the next one's.  All of it
    is one expression over one pass.  A line is rejected, with its reason, if it is no JSON object
    (``unreadable``), says no known version (``version``), or isn't of its version's schema (``schema``).
    """
    numbers = sorted(schemas)
    if numbers != list(range(numbers[0], numbers[-1] + 1)) or set(upgrades) != set(numbers[:-1]):
        raise ValueError("versions follow each other, and each but the last has an upgrade")
    document = F.try_parse_json(F.col(column))
    said = F.try_variant_get(document, "$.version", "int")
    rows = lines.select(F.col(column).alias("line"), document.alias("document"), said.alias("version"))
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    for n in numbers:
        own = F.from_json("line", f"{schemas[n]}, __corrupt string", mode)
        rows = rows.withColumn(f"__{n}", F.when(F.col("version") == n, own))
    corrupt = F.coalesce(*[F.col(f"__{n}.__corrupt") for n in numbers])
    known = F.col("version").isin(*numbers)
    readable = F.col("document").isNotNull() & (F.schema_of_variant("document").startswith("OBJECT"))
    reason = F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(~F.coalesce(known, F.lit(False)), "version").when(corrupt.isNotNull(), "schema")
    rows = rows.withColumn("reason", reason)
    good, made = rows.where("reason IS NULL"), F.col(f"__{numbers[0]}").dropFields("__corrupt")
    for n in numbers[1:]:
        made = F.when(F.col("version") < n, upgrades[n - 1](made)).otherwise(F.col(f"__{n}").dropFields("__corrupt"))
    return good.select(F.col("version").alias("read_as"), made.alias("r")).select("read_as", "r.*"), rows.where("reason IS NOT NULL").select(F.col("line").alias("value"), "reason")
