"""SimHash near-duplicates by pivot distance tables, verified by the Jaccard similarity of word shingles.

Two texts are linked if the sets of their five-word shingles have a similarity of
at least ``LEAST``; a component of links is a group.

Every set has a SimHash fingerprint of ``BITS`` bits, wide enough to tell that similarity:
of a pair at 0.8 a bit differs with a probability of at most 3/16 (sets of 4 and 5; 0.161
for all others, 0.152 for large ones), so more than ``RADIUS`` bits differ with one
below 1e-9.  Of unrelated sets half of the bits differ.

Fingerprints meet in buckets: ``BANDS`` MinHash keys, each of ``ROWS`` smallest shingles
under their own hash functions.  A pair at 0.8 shares no key with a probability of
(1 - 0.8 ** ROWS) ** BANDS = 1e-10, pairs above it with less.  Blocks of the fingerprint
can't be the buckets at this radius: as many equal bits as tell strangers apart are
rare between texts at 0.8 (24 bits: 0.02).

First each member of a key's bucket is held against a few members, so that a large
group is mostly joined by as many pairs as it has members.  Then the members of a
bucket that are still in different components are compared where the bucket is.  Its
pivot distance table holds each member's Hamming distances to ``PIVOTS`` members, one
of each of the largest components: by the triangle inequality fingerprints within the
radius have distances to a pivot that differ by at most the radius, so other pairs are
discarded, and the survivors' bits are compared.  Two within the radius belong to one
cluster.  A cluster's texts are compared on their whole sets in one place.  Buckets
and clusters give links that join what their pairs join, never the pairs, so no link is
lost and none of the tables grows with the square of a group; large ones are dealt out
as pairs of chunks, so no task holds a whole one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, connected_components, mix, passing, run_hashes, stored, text_chunks, widened, words
from .simhash import roots

#: Words of a shingle and the least similarity of a link.
SHINGLE_WORDS, LEAST = 5, 0.8
BANDS, ROWS = 44, 4
#: Members of a bucket that the others are held against first.
CENTRES = 4
#: Bits of a fingerprint, the most that differ in a pair that is verified, and pivots of a table.
BITS, RADIUS, PIVOTS = 1024, 272, 16
#: Members of a bucket or cluster in a chunk, and bytes of their sets.
CHUNK_ROWS, CHUNK_SETS = 1024, 8 << 20
_RNG = np.random.default_rng(80)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
_TIMES = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_PLANE = _RNG.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2)
_LANES = np.uint64(0x0101010101010101)


def shingle_sets(data: np.ndarray, offs: np.ndarray, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): the ascending distinct 64-bit hashes of each text's shingles; fewer words than a shingle are one."""
    n = len(offs) - 1
    starts, ends, first = words(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = run_hashes(LOWER[data], starts, ends)
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(1, n_words - shingle_words + 1), 0)
    doc = np.repeat(np.arange(n), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    stop = first[1:][doc]
    total = np.zeros(len(doc), np.uint64)
    for k in range(shingle_words):
        inside = at + k < stop
        total[inside] += word[at[inside] + k] * _PLACE[k]
    h = mix(total)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[fresh], np.searchsorted(doc[fresh], np.arange(n + 1))


def fingerprints_of(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SimHash of each set, ``BITS`` bits as 64-bit numbers: the bits set in over half of its shingles' hashes."""
    out = np.zeros((len(cuts) - 1, BITS // 64), np.uint64)
    sizes = np.diff(cuts)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    # a bit is counted in a byte, eight to a number, so sets are summed in blocks of 255
    blocks = -(-sizes[some] // 255)
    lead = np.cumsum(blocks) - blocks
    at = (np.arange(blocks.sum()) - np.repeat(lead, blocks)) * 255 + np.repeat(cuts[:-1][some], blocks)
    ones = np.empty((len(some), 64), np.int64)
    for k in range(BITS // 64):
        own = mix(h ^ _PLANE[k])
        for bit in range(8):
            lanes = np.add.reduceat(own >> np.uint64(bit) & _LANES, at)
            ones[:, bit::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), lead, axis=0, dtype=np.int64)
        over = (2 * ones > sizes[some][:, None]).astype(np.uint8)
        out[some, k] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def marks(h: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, keys) of each set: a hash of the whole set (zero if it is empty) and its ``BANDS`` bucket keys."""
    n = len(cuts) - 1
    node, keys = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(cuts))
    if len(some):
        lead = cuts[:-1][some]
        node[some] = mix(np.add.reduceat(mix(h ^ _PLACE[63]), lead) + np.diff(cuts)[some].astype(np.uint64))
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for r in range(ROWS):
                i = band * ROWS + r
                least = np.minimum.reduceat((h ^ _FLIP[i]) * _TIMES[i], lead)
                key = mix(key * _PLACE[r] + least)
            keys[some, band] = key
    return node, keys


def marked_rows(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with __node, __n (shingles), __keys (none for a text without a word) and __fp (fingerprint) of each whole text."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            nodes, counts, keys, prints = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.uint64)], []
            for _, _, data, offs in text_chunks(b.column(at)):
                h, cuts = shingle_sets(data, offs, shingle_words)
                node, key = marks(h, cuts)
                prints.append(fingerprints_of(h, cuts).tobytes())
                nodes.append(node)
                counts.append(np.diff(cuts))
                keys.append(key)
            n, k = np.concatenate(counts), np.concatenate(keys)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)), pa.array(k[n > 0].ravel().view(np.int64)))
            width = pa.py_buffer((np.arange(len(n) + 1) * (BITS // 8)).astype(np.int32))
            fp = pa.Array.from_buffers(pa.binary(), len(n), [None, width, pa.py_buffer(b"".join(prints))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(nodes).view(np.int64)), pa.array(n), lists, fp], names=[*b.schema.names, "__node", "__n", "__keys", "__fp"])

    return docs.mapInArrow(run, widened(docs, ("__node", "long"), ("__n", "long"), ("__keys", "array<long>"), ("__fp", "binary")))


def _fingerprints(column: pa.Array) -> np.ndarray:
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[begin : begin + BITS // 8 * len(column)].view(np.uint64).reshape(-1, BITS // 64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def _near(pairs: DataFrame, printed: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (u, v) whose fingerprints are within the radius."""

    def run(batches):
        for b in batches:
            near = distances(_fingerprints(b.column(2)), _fingerprints(b.column(3))) <= RADIUS if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(near)).select(["u", "v"])

    with_u = pairs.join(printed.select(F.col("node").alias("u"), F.col("fp").alias("a")), "u")
    return with_u.join(printed.select(F.col("node").alias("v"), F.col("fp").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def pivot_table(part: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """[member, pivot]: distances to one member of each of the largest parts; no more than ``PIVOTS`` members need none."""
    if len(part) <= PIVOTS:
        return np.zeros((len(part), 0), np.int16)
    _, one, size = np.unique(part, return_index=True, return_counts=True)
    pivots = one[np.argsort(-size, kind="stable")[:PIVOTS]]
    return np.stack([distances(fp, fp[p]) for p in pivots], 1)


def near_of_bucket(n: np.ndarray, part: np.ndarray, fp: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j), i < j, of the pairs in different parts, of sizes that allow the similarity, within the radius: by the pivot table and then the bits."""
    left, right, table = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], pivot_table(part, fp)
    for at in range(0, len(n), 64):
        live = (part[at : at + 64, None] != part[None, at:]) & (np.minimum(n[at : at + 64, None], n[None, at:]) >= least * np.maximum(n[at : at + 64, None], n[None, at:]) - 1e-9)
        for p in range(min(4, table.shape[1])):
            live &= np.abs(table[at : at + 64, p, None] - table[None, at:, p]) <= RADIUS
        i, j = np.nonzero(live)
        i, j = i[i < j] + at, j[i < j] + at
        for k in range(0, len(i), 1 << 14):
            x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            close = np.abs(table[x, 4:] - table[y, 4:]).max(1, initial=0) <= RADIUS
            x, y = x[close], y[close]
            near = distances(fp[x], fp[y]) <= RADIUS
            left.append(x[near])
            right.append(y[near])
    return np.concatenate(left), np.concatenate(right)


def _dealt(members: DataFrame, key: str, share: Column) -> DataFrame:
    """(m) lists of the ``members`` that hold every two members of a ``key`` in different parts together; ``share`` is what a member takes of a chunk.

    The members of a key's largest part aren't held against each other: the others' chunks meet each
    other and those of the largest part, so a hot key costs its members times its strangers' chunks.
    """
    sizes = members.groupBy(key, "part").agg(F.sum(share).alias("__s"))
    size = sizes.groupBy(key).agg(F.max(F.struct("__s", "part")).alias("__m"), F.sum("__s").alias("__s"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    size = size.select(key, F.col("__m.part").alias("__part"), F.ceil("__m.__s").cast("int").alias("__big"), F.greatest(F.ceil(F.col("__s") - F.col("__m.__s")), F.lit(1)).cast("int").alias("__few"), (F.col("__s") <= 1).alias("__one"))
    hot, few, big = F.xxhash64("node"), F.col("__few"), F.col("__big")
    of_big = F.col("part") == F.col("__part")
    own = F.when(F.col("__one"), F.lit(0)).when(of_big, few + F.pmod(hot, big)).otherwise(F.pmod(hot, few)).cast("int")
    met = F.sequence(F.lit(0), F.when(of_big, few).otherwise(few + big) - 1)
    pair = F.when(F.col("__one"), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(F.transform(F.filter(met, lambda x: x != own), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"))))
    fields = [f for f in members.columns if f != key]
    return members.join(size, key).select(key, *fields, F.explode(pair).alias("__p")).groupBy(key, "__p").agg(F.collect_list(F.struct(*fields)).alias("m")).where(F.size("m") > 1).select("m")  # two chunks at most


def _joined(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of nodes that join what the pairs (i, j) join, one fewer than a component has members."""
    root = roots(len(node), i, j)
    at = np.flatnonzero(root != np.arange(len(node)))
    return node[at], node[root[at]]


def _linked(groups: DataFrame, links) -> DataFrame:
    """Links (u, v) that ``links`` gives for each list of members."""

    def run(batches):
        for b in batches:
            found = [links(own.values) for own in b.column(0)]
            u, v = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def _near_links(members: DataFrame, least: float) -> DataFrame:
    """Links of nodes that share a bucket, are in different parts and are within the radius.  members: key, node, n, part, fp."""

    def links(own):
        node, n, part = (np.asarray(own.field(f)) for f in ("node", "n", "part"))
        return _joined(node, *near_of_bucket(n, part, _fingerprints(own.field("fp")), least))

    return _linked(_dealt(members, "key", F.lit(1 / CHUNK_ROWS)), links)


def similar_of_cluster(n: np.ndarray, part: np.ndarray, fp: np.ndarray, shingles: np.ndarray, cuts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the near pairs in different parts whose whole sets have the similarity."""
    i, j = near_of_bucket(n, part, fp, least)
    number = np.unique(shingles, return_inverse=True)[1].ravel()
    mark, left, right = np.zeros(len(shingles), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    for x, own in zip(*(a.tolist() for a in np.unique(i, return_index=True)), strict=True):
        others = j[own : np.searchsorted(i, x, "right")]
        mark[number[cuts[x] : cuts[x + 1]]] = True
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            sizes = n[some]
            inside = mark[np.concatenate([number[cuts[y] : cuts[y + 1]] for y in some.tolist()])]
            both = np.add.reduceat(inside, np.cumsum(sizes) - sizes, dtype=np.int64)
            good = some[both >= least * (n[x] + sizes - both) - 1e-9]
            left.append(np.full(len(good), x))
            right.append(good)
        mark[number[cuts[x] : cuts[x + 1]]] = False
    return np.concatenate(left), np.concatenate(right)


def _similar_links(members: DataFrame, least: float) -> DataFrame:
    """Links of nodes of a cluster, in different parts, whose sets have the similarity.  members: cluster, node, n, part, fp, shingles."""

    def links(own):
        node, n, part = (np.asarray(own.field(f)) for f in ("node", "n", "part"))
        shingles = np.frombuffer(b"".join(x.as_buffer() for x in own.field("shingles")), np.uint64)
        return _joined(node, *similar_of_cluster(n, part, _fingerprints(own.field("fp")), shingles, np.concatenate([[0], np.cumsum(n)]), least))

    share = F.greatest(F.lit(1 / CHUNK_ROWS), F.col("n") * 8 / CHUNK_SETS)
    return _linked(_dealt(members, "cluster", share), links)


def verified(pairs: DataFrame, marked: DataFrame, least: float = LEAST, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``pairs`` (u, v) of nodes whose sets have a similarity of at least ``least``."""
    table = stored(_sets(marked, pairs.select(F.explode(F.array("u", "v")).alias("__node")).distinct(), shingle_words), "sets")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield b.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    with_u = pairs.join(table.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = with_u.join(table.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long")


def _sets(marked: DataFrame, needed: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) of the ``needed`` nodes (__node): the set of one of a node's texts."""

    def sets(batches):
        for b in batches:
            out = []
            for _, _, data, offs in text_chunks(b.column(1)):
                h, cuts = shingle_sets(data, offs, shingle_words)
                out += [h[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "shingles"])

    one = marked.groupBy("__node").agg(F.min("__row").alias("__row")).join(needed, "__node", "left_semi").select("__row")
    return marked.join(one, "__row", "left_semi").select("__node", "text").mapInArrow(sets, "node long, shingles binary")


def grouped(docs: DataFrame, least: float = LEAST, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with __row (a number of its own) and __group (equal for the rows of a component) of each row."""
    marked = stored(marked_rows(docs, shingle_words).withColumn("__row", F.monotonically_increasing_id()), "marked")
    distinct = marked.where("__n > 0").groupBy(F.col("__node").alias("node")).agg(F.first("__n").alias("n"), F.first("__keys").alias("keys"), F.first("__fp").alias("fp"))
    distinct = stored(distinct, "sets_marked")
    printed = distinct.select("node", "fp")
    keyed = distinct.select("node", "n", F.explode("keys").alias("key"))
    # a key's centre is its member that comes first in one of few orders of all nodes
    turn = F.pmod("key", F.lit(CENTRES))
    centre = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", turn).alias("o"), F.col("node").alias("c"), F.col("n").alias("c_n"))).alias("m"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stored(keyed.join(centre.select("key", "m.c", "m.c_n"), "key"), "shared")
    alike = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b) - 1e-9
    star = shared.where((F.col("node") != F.col("c")) & alike("n", "c_n")).select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).distinct()
    tried = stored(_near(star, printed), "tried")
    first = stored(verified(tried, marked, least, shingle_words), "links")
    part = connected_components(first)
    # members of a bucket that the first links leave apart
    named = shared.select("key", "node", "n").join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    apart = named.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key")
    members = named.join(apart, "key", "left_semi").join(printed, "node").select("key", "node", "n", "part", "fp")
    cluster = stored(connected_components(stored(_near_links(members, least), "near")).select("node", F.col("component").alias("cluster")), "clusters")
    whole = stored(_sets(marked, cluster.select(F.col("node").alias("__node")), shingle_words), "sets")
    members = cluster.join(distinct.select("node", "n", "fp"), "node").join(part, "node", "left").join(whole, "node")
    members = members.select("cluster", "node", "n", F.coalesce("component", "node").alias("part"), "fp", "shingles")
    second = stored(_similar_links(members, least), "links")
    group = connected_components(first.union(second)).select(F.col("node").alias("__node"), "component")
    return marked.join(group, "__node", "left").withColumn("__group", F.coalesce("component", "__node")).select(*docs.columns, "__row", "__group")


def keep_one(docs: DataFrame, least: float = LEAST, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of ``docs``, with all its columns: the smallest id, then by the text's hash and the row.

    Rows without an id take part and come last in their group; texts without a word are one group.
    """
    with passing():
        rows = stored(grouped(docs, least, shingle_words), "grouped")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*docs.columns), "__row")
    kept = rows.groupBy("__group").agg(F.min(order).alias("least")).select("least.__row")
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)
