"""What several operators share: scratch tables, Arrow text chunks, hashed words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that the numpy kernels take at a time, so that their arrays stay small.
CHUNK_BYTES = 1 << 20

_OWN: dict[str, str] = {}
_PASSING: list = [None]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(app := spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN[app] = f"file://{tempfile.mkdtemp(prefix='ledgerline-')}"
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here and a lost executor loses nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    # lets the cleaner drop shuffle files that nothing refers to any more, so that steps don't add up on disk
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _PASSING[0] is not None:
        _PASSING[0].append(out)
    return out


@contextmanager
def passing() -> Iterator[None]:
    """Tables stored within are deleted on leaving, but for the last one, which has to be all that is read from then on."""
    outer, mine = _PASSING[0], []
    _PASSING[0] = mine
    try:
        yield
    finally:
        _PASSING[0] = outer
        for table in mine[:-1]:
            discard(table)
        if outer is not None:
            outer += mine[-1:]


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    jvm, path = table.sparkSession.sparkContext._jvm, table._scratch
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def widened(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` and more fields of given types."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """The rows from which nothing may be learned: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(seed: int, *cols: Column) -> Column:
    """A seeded number in [0, 1) that depends on the columns alone."""
    return (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def bounded_sample(df: DataFrame, seed: int, most_rows: int, most_bytes: int, most_text: int, size: str = "text") -> DataFrame:
    """The rows of ``df`` that come first by a seeded hash of all columns, as many as keep both bounds; a text over ``most_text`` bytes is left out.

    For rows that a model is fitted to on the driver: their total size is bounded, not only their number.
    Which rows stay depends on their contents alone.  Of at most ``most_rows`` rows, two numbers reach the driver.
    """
    marked = df.withColumn("__h", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])).where(F.octet_length(size) <= most_text)
    got = marked.select("__h", F.octet_length(size).alias("n")).orderBy("__h").limit(most_rows + 1).toArrow()
    h, n = np.asarray(got.column(0)), np.cumsum(np.asarray(got.column(1), np.int64))
    # rows of one hash stay or go together
    last = np.flatnonzero((n <= most_bytes) & (np.arange(len(n)) < most_rows) & np.append(h[1:] != h[:-1], len(h) <= most_rows)) if len(h) else []
    return marked.where(F.col("__h") <= int(h[last[-1]]) if len(last) else F.lit(False)).drop("__h")


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a null text is empty.

    A text over the limit is a chunk of its own: texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWER[0]) < n:
        step = np.full(max(n, 1024), 0x9E3779B97F4A7C15, np.uint64)
        step[0] = 1
        _POWER[0] = np.cumprod(step, dtype=np.uint64)
    return _POWER[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, so that any bits of the result may be used."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document) of the runs of bytes outside ``table``; runs end with their document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~table[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    before |= cut[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    after |= cut[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=first[1:])
    inner = np.arange(first[-1]) - np.repeat(first[:-1], lens)
    terms = _BYTE[data[inner + np.repeat(starts, lens)]] * _powers(int(lens.max()))[inner]
    return mix(np.add.reduceat(terms, first[:-1]) + lens.astype(np.uint64))


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps; each keeps connectivity and moves
    links towards the smallest node.  Every round is written to the shared folder.
    Nothing but a count and a checksum reaches the driver.  Null ends are left out.
    """

    def smallest(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))

    def state(links: DataFrame) -> tuple:
        row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        return tuple(row)

    kept = stored(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    was = state(kept)
    for _ in range(rounds):
        if not was[0]:
            break
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")).where("u <> v"))
        kept = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        now = state(kept)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = kept.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.union(kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
