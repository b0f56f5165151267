"""Export snapshots: the rows that a scope needs, over many tables, closed under their references and cut at one version."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.joins import settled
from ledgerline.sources.sinks import canonical_json


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` name one row of ``parent`` by ``columns``; where they are ``owned``, they go where the parent goes."""

    child: str
    columns: tuple[str, ...]
    parent: str
    owned: bool = False


@dataclass(frozen=True)
class Snapshot:
    tables: dict[str, DataFrame]
    #: (table, n_missing): keys that a row of the set names and the table, at this version, hasn't.
    missing: DataFrame


def as_of(rows: DataFrame, keys: list[str], version: str, at) -> DataFrame:
    """Of each key the row of the largest ``version`` up to ``at``, ties by all columns; rows without a version don't exist yet."""
    return rows.where(F.col(version) <= at).groupBy(*keys).agg(F.max(F.struct(version, *[c for c in rows.columns if c != version])).alias("__r")).select([f"__r.`{c}`" for c in rows.columns])


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__{k}"]) for k in keys))


def _renamed(keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return keys_of.select([F.col(k).alias(f"__{k}") for k in keys])


def closure(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[Reference], seeds: dict[str, DataFrame]) -> Snapshot:
    """The smallest set of rows that holds the ``seeds``, what any of its rows names, and what its rows own.

    seeds: rows of some of the tables, with their key columns.  Only key columns of rows that are new
    in a round are carried, so a round costs one join for each reference whose side moved; rounds end
    when no key is new, also where references run in a ring.  A reference with a null column names
    nothing; a key that is null names itself, so rows of a null key can be seeds or owned; rows that
    share a key come together.  Seeds that no table row has count as missing.
    """
    have: dict[str, DataFrame] = {}
    absent: dict[str, DataFrame] = {}
    front = {t: rows.select(*keys[t]).distinct() for t, rows in seeds.items()}
    while front:
        fresh = {}
        for t, found in front.items():
            if t in have:
                old = _renamed(have[t].unionByName(absent[t]), keys[t])
                found = found.join(old, _same(found, old, keys[t]), "left_anti")
            # a key is looked up once, when it comes up
            there = _renamed(tables[t].select(*keys[t]).distinct(), keys[t]).withColumn("__there", F.lit(True))
            marked = settled(found.join(there, _same(found, there, keys[t]), "left").select(*keys[t], "__there"))
            if marked.isEmpty():
                continue
            fresh[t] = marked.where("__there").select(*keys[t])
            lost = marked.where("__there IS NULL").select(*keys[t])
            have[t], absent[t] = (have[t].unionByName(fresh[t]), absent[t].unionByName(lost)) if t in have else (fresh[t], lost)
        named: dict[str, list[DataFrame]] = {}
        for r in references:
            to = keys[r.parent]
            if r.child in fresh:
                own = _renamed(fresh[r.child], keys[r.child])
                rows = tables[r.child].join(own, _same(tables[r.child], own, keys[r.child]), "left_semi")
                named.setdefault(r.parent, []).append(rows.dropna(subset=list(r.columns)).select([F.col(c).alias(k) for c, k in zip(r.columns, to, strict=True)]))
            if r.owned and r.parent in fresh:
                parent = fresh[r.parent].select([F.col(k).alias(c) for k, c in zip(to, r.columns, strict=True)])
                named.setdefault(r.child, []).append(tables[r.child].join(parent, list(r.columns), "left_semi").select(*keys[r.child]))
        front = {t: reduce(DataFrame.unionByName, parts).distinct() for t, parts in named.items()}
    spark = next(iter(tables.values())).sparkSession
    whole = {}
    for t, rows in tables.items():
        own = _renamed(have[t], keys[t]) if t in have else None
        whole[t] = rows.where("false") if own is None else rows.join(own, _same(rows, own, keys[t]), "left_semi")
    counts = [rows.agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit(t).alias("table"), "n_missing") for t, rows in absent.items()]
    return Snapshot(whole, reduce(DataFrame.union, counts) if counts else spark.createDataFrame([], "table string, n_missing long"))


def manifest(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """table, n_rows and digest of each table: a digest of the multiset of its rows, whatever their order.

    The eight words of the rows' sha256 are added up, so that partial sums meet; repeated rows count each.
    ``columns``: the columns that are digested, as text between slashes; without them whole rows, as canonical JSON.
    """
    parts = []
    for name, rows in tables.items():
        text = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[name]]) if columns else canonical_json(rows)
        word = [F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
        sums = F.concat_ws(",", *[F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in word])
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(sums, 256).alias("digest")).select(F.lit(name).alias("table"), "n_rows", "digest"))
    return reduce(DataFrame.union, parts)


def write(snapshot: Snapshot, folder: str) -> DataFrame:
    """The set as Parquet, a folder for each table, and its manifest, taken from what was written; returns the manifest."""
    spark = snapshot.missing.sparkSession
    for name, rows in snapshot.tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    written = manifest({name: spark.read.parquet(f"{folder}/{name}") for name in snapshot.tables})
    written.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(written.schema).json(f"{folder}/manifest")
