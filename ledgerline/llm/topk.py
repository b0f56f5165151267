"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are rotated by the right singular vectors of the candidates, so their first
coordinates hold most of every inner product.  Candidates are dealt by descending
length; each task goes through its own in that order.  A block is skipped for a
query when |q| times the block's largest length is below the query's k-th best
score; a candidate is pruned when its partial inner product plus the product of
the two residual lengths (Cauchy-Schwarz) is below it.  What is left is scored
exactly, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, stored

#: Queries that are broadcast at a time, at most about (by hash of the id).
QUERY_BLOCK = 8192
#: Candidates on the driver from which each query's first threshold comes.
PROBE = 2048
TILE = 512


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as double.

    Rows take no part if the id or the vector is null or a component is null or not finite.
    """
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = len(column), np.asarray(column.flatten(), np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if (sizes == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all candidates, from their second moments: width * width sums reach the driver."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            m = matrix(b.column(0), width)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(width * width), pa.int32()), pa.array(total.ravel())], names=["cell", "s"])

    cells = vectors.select("v").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    moments = np.zeros(width * width)
    moments[np.asarray(cells.column("cell"))] = np.asarray(cells.column("s"))
    _, _, vt = np.linalg.svd(moments.reshape(width, width))
    return vt.T


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray | None = None, large: bool = False):
        self.q, self.ids, self.k = queries, ids, k
        self.head = max(1, queries.shape[1] // 4)
        r = queries @ turn
        self.partial, self.rest = np.ascontiguousarray(r[:, : self.head]), np.sqrt((r[:, self.head :] ** 2).sum(1))
        self.norm = np.sqrt((queries**2).sum(1))
        self.whole = queries.astype(np.int64) if large else None
        self.turn = turn
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query, vec_id, score

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Take a tile of candidates; a query that its longest can't help passes over it."""
        norm = np.sqrt((v**2).sum(1))
        slack = 1e-6 + 1e-9 * self.norm * (norm.max() if len(norm) else 0.0)
        live = np.flatnonzero(self.norm * norm.max() + slack >= self.floor)
        if not len(live):
            return
        r = v @ self.turn
        bound = self.partial[live] @ r[:, : self.head].T
        bound += self.rest[live, None] * np.sqrt((r[:, self.head :] ** 2).sum(1))[None, :]
        i, j = np.nonzero(bound + slack[live, None] >= self.floor[live, None])
        i = live[i]
        other = self.ids[i] != ids[j]
        i, j = i[other], j[other]
        # below 2 ** 53 doubles are exact, and faster
        q, v = (self.q, v) if self.whole is None else (self.whole, v.astype(np.int64))
        score = np.empty(len(i), q.dtype)
        for at in range(0, len(i), 1 << 15):
            s = slice(at, at + (1 << 15))
            score[s] = (q[i[s]] * v[j[s]]).sum(1)
        score = score.astype(np.int64)
        good = score + slack[i] >= self.floor[i]
        self._keep(i[good], ids[j[good]], score[good])

    def _keep(self, i: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, v, s = (np.concatenate(x) for x in zip(self.kept, (i, ids, score), strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - first[q]
        self.kept = [x[rank < self.k] for x in (q, v, s)]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best candidates, ties to the smaller vec_id.

    Both have vec_id and v (whole numbers); a query's own id is no candidate for it,
    and fewer candidates give fewer rows.  Vectors of several lengths are compared
    as if the shorter ended in zeros.  No rows on either side give no rows.  Scores are
    whole numbers below 2 ** 63; vectors that could pass that raise an error.  One block of
    queries is held at a time.
    """
    spark = candidates.sparkSession
    n = partitions(spark)
    square = F.aggregate("v", F.lit(0).cast("double"), lambda total, x: total + x.cast("double") * x.cast("double"))
    # the length and the id deal the rows, so a vector that is there many times doesn't fall to one task
    ordered = candidates.select("vec_id", "v", square.alias("square")).repartitionByRange(n, F.col("square").desc(), F.col("vec_id")).sortWithinPartitions(F.col("square").desc(), "vec_id")
    sorted_rows = stored(ordered, "vectors")
    asked = stored(queries.select("vec_id", "v"), "queries")
    facts = sorted_rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    n_queries, q_width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_queries or not facts[1]:
        return empty
    width = max(1, facts[0], q_width)
    largest = [t.agg(F.max(F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double")))))).first()[0] for t in (sorted_rows, asked)]
    bound = float(largest[0]) * float(largest[1]) * width
    if bound >= 2.0**63:
        raise ValueError("scores pass 2 ** 63")
    turn = rotation(sorted_rows, width)
    # a bounded sample of candidates: any subset gives valid thresholds
    probe = sorted_rows.select("vec_id", "v").where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, facts[1] // PROBE))) == 0).limit(2 * PROBE).toArrow()
    probe_ids, probe_rows = np.asarray(probe.column("vec_id")), matrix(probe.column("v"), width)
    n_blocks = -(-n_queries * 2 // QUERY_BLOCK) if n_queries > QUERY_BLOCK else 1
    found = None
    for block in range(n_blocks):  # one pass over the candidates for each block of queries
        own = (asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else asked).toArrow()
        ids, q = np.asarray(own.column("vec_id"), np.int64), matrix(own.column("v"), width)
        if not len(ids):
            continue
        floor = np.full(len(ids), -np.inf)
        for at in range(0, len(ids), TILE):
            s = q[at : at + TILE] @ probe_rows.T
            s[ids[at : at + TILE, None] == probe_ids[None, :]] = -np.inf
            if s.shape[1] >= k:
                floor[at : at + TILE] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        shared = spark.sparkContext.broadcast((ids, q.astype(np.int32) if np.abs(q).max(initial=0) < 1 << 31 else q, turn, floor))

        def run(batches, shared=shared):
            ids, q, turn, floor = shared.value
            best = Best(q.astype(np.float64), ids, turn, k, floor, bound >= 2.0**53)
            for b in batches:
                for at in range(0, b.num_rows, TILE):
                    some = b.slice(at, TILE)
                    best.add(np.asarray(some.column(0)), matrix(some.column(1), width))
            i, v, s = best.kept
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(v), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

        part = sorted_rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        if n_blocks > 1:
            part = stored(part, "block")
            shared.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        return empty
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
