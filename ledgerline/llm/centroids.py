"""Centroid clustering by annulus search, in whole numbers.

Centroids are sorted by norm.  A vector has an upper bound, its exact distance to some
centroid; no centroid whose norm differs from the vector's by more can be as near, so
binary search in the sorted norms gives the candidates, boundary ties included, and
these alone are compared, exactly.  Vectors are stored once with the centroid that was
nearest when they were stored: its distance is the bound of every later round, and the
table is written anew every few rounds, when the centroids have moved away from it.

A round is one pass: a task sums its vectors by centroid and gives one row for each, so
what is shuffled and what reaches the driver has the size of the centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .topk import matrix

#: Rows that are compared at a time.
TILE = 4096
#: Rounds after which the stored nearest centroid is renewed.
RENEW = 4


def whole_vectors(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as double; only vectors of ``width`` components, none null or not finite."""
    usable = (F.size("embedding") == width) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & usable)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Annulus:
    """Nearest centroids of tiles of vectors; of equally near ones the smallest number."""

    def __init__(self, centroids: np.ndarray, exact: bool):
        #: Whether doubles hold every product and sum.
        self.kind = np.float64 if exact else np.int64
        c = centroids.astype(self.kind)
        self.square = (c * c).sum(1)
        norm = np.sqrt(self.square.astype(np.float64))
        self.order = np.argsort(norm, kind="stable")
        self.norm, self.c = norm[self.order], c

    def nearest(self, v: np.ndarray, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each row of ``v``; ``near`` are the centroids that give the bounds, without them those of the closest norm."""
        v = v.astype(self.kind)
        square = (v * v).sum(1)
        norm = np.sqrt(square.astype(np.float64))
        if near is None:
            right = np.clip(np.searchsorted(self.norm, norm), 0, len(self.norm) - 1)
            left = np.maximum(right - 1, 0)
            near = self.order[np.where(norm - self.norm[left] <= self.norm[right] - norm, left, right)]
        best, number = square - 2 * (v * self.c[near]).sum(1) + self.square[near], near.copy()
        # rounding of the square roots must not lose a tie at the boundary
        reach = np.sqrt(best.astype(np.float64)) + 1e-9 * (norm + self.norm[-1]) + 1e-6
        first, end = np.searchsorted(self.norm, norm - reach, "left"), np.searchsorted(self.norm, norm + reach, "right")
        for place in range(int(first.min(initial=0)), int(end.max(initial=0))):
            k = self.order[place]
            rows = np.flatnonzero((first <= place) & (place < end) & (near != k))
            if len(rows):
                d = square[rows] - 2 * (v[rows] @ self.c[k]) + self.square[k]
                better = (d < best[rows]) | (d == best[rows]) & (k < number[rows])
                rows = rows[better]
                best[rows], number[rows] = d[better], k
        return number.astype(np.int32), best.astype(np.int64)


def _each(df: DataFrame, centroids: np.ndarray, exact: bool, give, schema: str, width: int) -> DataFrame:
    """One row set for each tile of ``df`` (vec_id, v, near); ``give`` sees ids, vectors, numbers and distances and yields batches, and gets None at the end."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # k * width numbers

    def run(batches):
        search, made = Annulus(shared.value, exact), give()
        next(made)
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                some = b.slice(at, TILE)
                v = matrix(some.column(1), width) if exact else np.asarray(some.column(1).flatten(), np.int64).reshape(-1, width)
                near = np.asarray(some.column(2)) if b.num_columns > 2 else None
                if (out := made.send((some, v, *search.nearest(v, near)))) is not None:
                    yield out
        if (out := made.send(None)) is not None:
            yield out

    return df.mapInArrow(run, schema)


def _marked(df: DataFrame, centroids: np.ndarray, exact: bool, width: int) -> DataFrame:
    """``df`` with ``near``, the nearest of the centroids."""

    def give():
        out = None
        while True:
            got = yield out
            out = None if got is None else pa.RecordBatch.from_arrays([got[0].column(0), got[0].column(1), pa.array(got[2])], names=["vec_id", "v", "near"])

    return _each(df, centroids, exact, give, "vec_id long, v array<bigint>, near int", width)


def _sums(df: DataFrame, centroids: np.ndarray, exact: bool, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, sums of components) of each centroid's vectors."""
    k = len(centroids)

    def give():
        n, total, out = np.zeros(k, np.int64), np.zeros((k, width), np.int64), None
        while True:
            got = yield out
            if got is None:
                out = pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], names=["number", "n", "total"])
                continue
            _, v, number, _ = got
            n += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            here, cuts = np.unique(number[order], return_index=True)
            total[here] += np.add.reduceat(v.astype(np.int64)[order], cuts, axis=0)

    rows = _each(df, centroids, exact, give, "number int, n long, total array<bigint>", width)
    cells = rows.select("number", "n", F.posexplode("total").alias("at", "x")).groupBy("number", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    number, at = np.asarray(cells.column("number")), np.asarray(cells.column("at"))
    n[number], total[number, at] = np.asarray(cells.column("n")), np.asarray(cells.column("x"))
    return n, total


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of ``vectors`` (vec_id, embedding).

    Kept are vectors of ``width`` components, none null or not finite, as whole numbers
    floor(scale * x).  Centroids start as the ``k`` vectors whose sha256 of ``seed:vec_id`` is
    smallest (ids that are null last, equal ids by components; all vectors, if fewer) and move
    ``rounds`` times to the floor of their vectors' mean; a centroid without vectors stays.
    Repeated rows count each, other columns are ignored, no kept vectors give no rows.
    Components of 2 ** 27 or more would pass 64 bits and raise an error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, width, scale)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(draw.asc_nulls_last(), "v").limit(k).select("v").toArrow().column(0)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    largest, count = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))), F.count(F.lit(1))).first()
    if largest * largest * 4 * width >= 2**63 or largest * count >= 2**63:
        raise ValueError("distances or sums pass 2 ** 63")
    exact = largest * largest * 4 * width < 2**53
    centroids = np.array([x.as_py() for x in first], np.int64)
    held = stored(_marked(rows, centroids, exact, width), "vectors")
    for done in range(rounds):
        n, total = _sums(held, centroids, exact, width)
        moved = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
        if (moved == centroids).all():
            break  # every later round would give the same
        centroids = moved
        if done % RENEW == RENEW - 1 and done + 1 < rounds:
            old, held = held, stored(_marked(held, centroids, exact, width), "vectors")
            discard(old)

    def give():
        out = None
        while True:
            got = yield out
            out = None if got is None else pa.RecordBatch.from_arrays([got[0].column(0), pa.array(got[2]), pa.array(got[3])], names=["vec_id", "cluster", "distance"])

    found = stored(_each(held, centroids, exact, give, "vec_id long, cluster int, distance long", width), "clusters")
    discard(held)
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
