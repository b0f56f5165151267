"""SimHash near-duplicates by pivot distance tables.

Every text has a 64-bit fingerprint over its word shingles; fingerprints that
differ in at most ``radius`` bits are linked, and a component of links is a group.

Each distinct fingerprint carries its pivot table row: its Hamming distances to
``PIVOTS`` reference fingerprints.  By the triangle inequality two fingerprints
within the radius have rows that differ by at most the radius in every
coordinate; a pair with a larger coordinate difference is discarded, and the
survivors are verified bit by bit.

Pairs are only looked at where they can be links: the 64 bits are cut into
``radius + 2`` blocks, and two fingerprints within the radius agree on at least
two whole blocks, so each pair of blocks is a bucket key.  Buckets over
``bucket_rows`` are dealt out as pairs of chunks, so no task holds a whole hot
bucket and no link is lost.  A bucket gives at most one link per member (to the
smallest member of its component), never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, stored, text_chunks, words

#: Seed of the shingles' XXH64.
SHINGLE_SEED = 42
#: Reference fingerprints of the pivot table; any fixed numbers do.
PIVOTS = np.random.default_rng(8).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(9).integers(0, 2, 16, dtype=np.uint64)


def fingerprints_of(data: np.ndarray, offs: np.ndarray, shingle_words: int = 3) -> np.ndarray:
    """Fingerprint of each text of a chunk: the bits set in over half of its shingles' hashes."""
    out = np.zeros(len(offs) - 1, np.uint64)
    starts, ends, first = words(data, offs)
    if not len(starts):
        return out
    lens = ends - starts
    lead = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=lead[1:])
    number = np.repeat(np.arange(len(lens)), lens)
    inner = np.arange(lead[-1])
    joined = np.full(lead[-1] + len(lens), 0x20, np.uint8)  # the words, each with one space behind it
    joined[inner + number] = LOWER[data[inner - lead[number] + starts[number]]]
    raw = joined.tobytes()
    begin, end = lead[:-1] + np.arange(len(lens)), lead[1:] + np.arange(len(lens))
    n_words = np.diff(first)
    n_shingles = np.where(n_words > 0, np.maximum(1, n_words - shingle_words + 1), 0)
    some = np.flatnonzero(n_shingles)
    doc_lead = np.zeros(len(some) + 1, np.int64)
    np.cumsum(n_shingles[some], out=doc_lead[1:])
    at = np.arange(doc_lead[-1]) - np.repeat(doc_lead[:-1] - first[:-1][some], n_shingles[some])
    last = np.minimum(at + shingle_words, np.repeat(first[1:][some], n_shingles[some])) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], SHINGLE_SEED) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, doc_lead[:-1], axis=0, dtype=np.int32)
    over = (2 * ones > n_shingles[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def pivot_rows(fp: np.ndarray) -> np.ndarray:
    """The pivot table: one row of Hamming distances for each fingerprint."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :])


def fingerprints(docs: DataFrame, shingle_words: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, fp (the fingerprint's 64 bits as a long) and coords (its pivot table row) of each row of ``docs``.

    A null or empty text, or one of white space, has fingerprint zero; fewer words
    than a shingle are one shingle.  Whole texts are read, whatever their length.
    """
    fed = docs.select(*(F.col(f"`{k}`") for k in keys), F.col("text").alias("__text"))
    schema = fed.drop("__text").schema.simpleString()[7:-1].replace(":", " ") + ", fp long, coords binary"
    names = [*keys, "fp", "coords"]

    def run(batches):
        for b in batches:
            fp = [fingerprints_of(data, offs, shingle_words) for _, _, data, offs in text_chunks(b.column(len(keys)))]
            fp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
            rows = pivot_rows(fp)
            coords = pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer((np.arange(len(fp) + 1) * rows.shape[1]).astype(np.int32)), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(fp.view(np.int64)), coords], names=names)

    return fed.mapInArrow(run, schema)


def blocks(radius: int) -> list[int]:
    """A mask for each pair of the ``radius + 2`` blocks of the 64 bits, as signed numbers."""
    cut = np.linspace(0, 64, radius + 3).astype(int)
    parts = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return [m - (1 << 64) if (m := x | y) >= 1 << 63 else m for x, y in combinations(parts, 2)]


def near_pairs(fp: np.ndarray, coords: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs within the radius, by the pivot table and then the bits."""
    order = np.argsort(coords[:, 0], kind="stable")
    f, c = fp[order], coords[order].astype(np.int16)
    left, right = [], []
    for at in range(0, len(f), 256):
        stop = min(len(f), at + 256)
        end = int(np.searchsorted(c[:, 0], c[stop - 1, 0] + radius, "right"))
        live = np.triu(np.ones((stop - at, end - at), bool), 1)
        for k in range(4):
            live &= np.abs(c[at:stop, k, None] - c[None, at:end, k]) <= radius
        i, j = np.nonzero(live)
        i, j = i + at, j + at
        close = np.abs(c[i, 4:] - c[j, 4:]).max(1, initial=0) <= radius
        i, j = i[close], j[close]
        true = np.bitwise_count(f[i] ^ f[j]) <= radius
        left.append(order[i[true]])
        right.append(order[j[true]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each of ``n`` members over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def bucket_links(sizes: np.ndarray, fp: np.ndarray, coords: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each bucket, what its pairs within the radius join.  ``sizes``: members of consecutive buckets."""
    lead = np.concatenate([[0], np.cumsum(sizes)])
    us, vs = [], []
    for n in range(2, 9):  # small buckets of one size together
        at = lead[:-1][sizes == n]
        for a, b in combinations(range(n), 2):
            i, j = at + a, at + b
            close = np.abs(coords[i].astype(np.int16) - coords[j]).max(1, initial=0) <= radius
            i, j = i[close], j[close]
            true = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            us.append(fp[i[true]])
            vs.append(fp[j[true]])
    for k in np.flatnonzero(sizes > 8):
        own = slice(lead[k], lead[k + 1])
        f = fp[own]
        root = roots(len(f), *near_pairs(f, coords[own], radius))
        joined = np.flatnonzero(root != np.arange(len(f)))
        us.append(f[joined])
        vs.append(f[root[joined]])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.uint64),) * 2


def links(distinct: DataFrame, radius: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """Links (u, v) among distinct fingerprints (fp, coords) that join exactly what all pairs within the radius join."""
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for t, m in enumerate(blocks(radius)))))
    keyed = distinct.select("fp", "coords", tables.alias("k")).select("k.t", "k.bits", "fp", "coords")
    shared = keyed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.when(chunks == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    pair = F.when(chunks == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), chunks - 1), lambda x: x != own), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b")))
    )
    groups = (
        keyed.join(shared, ["t", "bits"])
        .select("t", "bits", "fp", "coords", F.explode(pair).alias("p"))
        .groupBy("t", "bits", "p")
        .agg(F.collect_list("fp").alias("fps"), F.collect_list("coords").alias("rows"))  # two chunks at most
        .where(F.size("fps") > 1)
        .select("fps", "rows")
    )
    width = len(PIVOTS)

    def run(batches):
        for b in batches:
            fps, rows = b.column(0), b.column(1)
            fp = np.asarray(fps.flatten()).view(np.uint64)
            sizes = np.diff(np.asarray(fps.offsets)).astype(np.int64)
            flat = rows.flatten()
            begin = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset]
            coords = np.frombuffer(flat.buffers()[2], np.uint8)[begin : begin + width * len(fp)].reshape(-1, width)
            u, v = bucket_links(sizes, fp, coords, radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle_words: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable, itself included) of each row.

    Rows repeat as in ``docs``; a null doc_id is never a component_id unless a group has no other.
    No rows give no rows.  Other columns of ``docs`` take no part.
    """
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("coords").alias("coords")), "distinct")
    component = connected_components(links(distinct.select("fp", "coords"), radius, bucket_rows))
    grouped = distinct.select("fp", "least").join(component.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "group").join(least, "group").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
