"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Texts are sequences of words (runs of ASCII letters, digits and non-ASCII bytes,
A-Z in lower case).  A document leaks an item if some stretch of its words is
within ``edit_share`` of the item's length in word edits.

The CGK walk reads a window with a pointer that moves on by a random bit of (step,
word); windows at small edit distance give walks at small Hamming distance.  The
walk starts at every word of a document.  Pointers keep their order and merge as
the walk goes on, so walks that met are followed once.  A sample is the words read
at a few of the steps; items and windows with an equal sample are candidates.
Samples are drawn per size class of items (so windows are item-sized), several for
each of several walks.  Some samples of each class use only steps before the
item's own length, so a verbatim passage is found with certainty.  Candidates are
verified by an exact bit-parallel edit distance with free ends in the document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, LOWER, mix, run_hashes, stored, text_chunks, words


@dataclass(frozen=True)
class DecontamParams:
    #: Word edits allowed, as a share of the item's words (similarity of 0.8 or more).
    edit_share: float = 0.2
    walks: int = 4
    samples: int = 4
    #: Words read for a sample.
    sample_words: int = 3
    #: Bytes of items that one pass over the documents looks for.
    items_bytes: int = 16 << 20
    seed: int = 77


_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text)."""
    starts, ends, first = words(data, offs, _NOT_WORD)
    return run_hashes(LOWER[data], starts, ends), first


#: Multiplies a sample's key before the next word is added.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def size_class(n: int) -> int:
    """The largest of 1, 2, 3, 4, 6, 8, 11, 16, 23, ... (steps of the root of 2) up to ``n``."""
    c = int(2 * np.log2(n))
    while int(2 ** ((c + 1) / 2)) <= n:
        c += 1
    while int(2 ** (c / 2)) > n:
        c -= 1
    return int(2 ** (c / 2))


class Walk:
    """One CGK walk over a sequence of word hashes, from every word at once."""

    def __init__(self, seed: int, steps: int):
        self.salts = np.random.default_rng(seed).integers(0, 1 << 63, steps // 64 + 1, dtype=np.uint64)
        self.steps = steps

    def read(self, hashes: np.ndarray, wanted: set[int]):
        """Yield (step, words read, level) at wanted steps, and at the end the maps between levels.

        A level is a set of merged walks; ``maps[k]`` gives the walk of level k + 1 for each of level k.
        """
        padded = np.concatenate([hashes, np.zeros(self.steps + 1, np.uint64)])
        at = np.arange(len(hashes), dtype=np.int32)
        level, maps, got = 0, [], {}
        merge_at = 2
        bits = None
        for step in range(self.steps):
            if step % 64 == 0:
                bits = mix(padded ^ self.salts[step // 64])
            if step == merge_at:
                merge_at = merge_at * 3 // 2 + 1
                fresh = np.ones(len(at), bool)
                fresh[1:] = at[1:] != at[:-1]
                maps.append(np.cumsum(fresh) - 1)
                at = at[fresh]
                level += 1
            if step in wanted:
                got[step] = (padded[at], level)
            at = at + (bits[at] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int32)
        return got, maps


def plan(classes: list[int], p: DecontamParams) -> list[tuple[int, int, list[tuple[int, ...]]]]:
    """(walk, class, samples of steps): half of a class's samples stay below its own length."""
    out = []
    for w in range(p.walks):
        for c in classes:
            rng = np.random.default_rng([p.seed, w, c])
            own = []
            for s in range(p.samples):
                high = c if s % 2 == 0 else max(1, c * 3 // 2)
                low = min(3, high // 4)
                k = min(p.sample_words, high - low)
                own.append(tuple(sorted(int(x) for x in low + rng.choice(high - low, k, replace=False))))
            out.append((w, c, own))
    return out


def sample_keys(got: dict, maps: list[np.ndarray], sample: tuple[int, ...], salt: int) -> tuple[np.ndarray, int]:
    """(key of each walk at the level of the sample's first step, that level)."""
    key, level = None, None
    for step in reversed(sample):
        read, own = got[step]
        if key is None:
            key = read + np.uint64(salt * 0x51ED27)
        else:
            for k in range(level - 1, own - 1, -1):
                key = key[maps[k]]
            key = key * _ODD + read
        level = own
    return key, level


class Items:
    """Benchmark items in the form that documents are searched with."""

    def __init__(self, items: list[tuple[int | None, str]], p: DecontamParams):
        self.p = p
        self.ids, self.words = [], []
        for key, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            h, _ = word_hashes(raw, np.array([0, len(raw)]))
            if len(h):  # an item without a word is nowhere
                self.ids.append(key)
                self.words.append(h)
        self.places = [places(h) for h in self.words]
        classes = [size_class(len(h)) for h in self.words]
        self.plan = plan(sorted(set(classes)), p)
        self.steps = max([1, *(s[-1] + 1 for _, _, own in self.plan for s in own)])
        self.tables = {}
        by_class = defaultdict(list)
        for i, c in enumerate(classes):
            by_class[c].append(i)
        for w in range(p.walks):
            walk = Walk(p.seed * 1000 + w, self.steps)
            wanted = {x for v, _, own in self.plan if v == w for s in own for x in s}
            for v, c, own in self.plan:
                if v != w:
                    continue
                read = {i: walk.read(self.words[i], wanted) for i in by_class[c]}
                for t, s in enumerate(own):
                    keys = [int(sample_keys(*read[i], s, t + 1)[0][0]) for i in by_class[c]]
                    of = defaultdict(list)
                    for key, i in zip(keys, by_class[c], strict=True):
                        of[key].append(i)
                    sieve = np.zeros(1 << 16, bool)  # by the high bits of a key
                    sieve[(np.array(keys, np.uint64) >> np.uint64(48)).astype(np.int64)] = True
                    self.tables[w, c, t] = (s, sieve, dict(of))

    def candidates(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> (first, last) starts of windows with an equal sample."""
        out = defaultdict(set)
        if not len(hashes):
            return out
        for w in range(self.p.walks):
            wanted = {x for v, _, own in self.plan if v == w for s in own for x in s}
            got, maps = Walk(self.p.seed * 1000 + w, self.steps).read(hashes, wanted)
            lead = [np.arange(len(hashes))]  # the first start of each walk of a level
            for m in maps:
                lead.append(lead[-1][np.flatnonzero(np.diff(m, prepend=-1))])
            for (v, c, t), (s, sieve, of) in self.tables.items():
                if v != w:
                    continue
                key, level = sample_keys(got, maps, s, t + 1)
                for k in np.flatnonzero(sieve[(key >> np.uint64(48)).astype(np.int64)]):
                    for i in of.get(int(key[k]), ()):
                        first = int(lead[level][k])
                        last = int(lead[level][k + 1]) - 1 if k + 1 < len(lead[level]) else len(hashes) - 1
                        out[i].add((first, last))
        return out

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, place of the item in ``ids``, edits, end word within the text) of verified leaks, the best of each text and item."""
        found = {}
        for i, spans in self.candidates(hashes).items():
            n = len(self.words[i])
            most = int(self.p.edit_share * n + 1e-9)
            done = -1
            for a, b in sorted(spans):
                text = int(np.searchsorted(first, a, "right")) - 1
                low = max(int(first[text]), a - most)
                # a span of merged walks may reach into the next text
                for doc in range(text, min(len(first) - 2, int(np.searchsorted(first, b, "right")) - 1) + 1):
                    lo, hi = max(low, int(first[doc])), min(int(first[doc + 1]), b + n + most)
                    if hi <= done or hi <= lo:
                        continue
                    lo = max(lo, done - n - most) if done > lo else lo
                    edits, end = edit_distance_within(self.places[i], n, hashes[lo:hi], most)
                    done = hi
                    if edits <= most:
                        old = found.get((doc, i))
                        if old is None or edits < old[0]:
                            found[doc, i] = (edits, lo + end - int(first[doc]))
        return sorted((doc, i, edits, end) for (doc, i), (edits, end) in found.items())


def places(pattern: np.ndarray) -> dict[int, int]:
    """For each word of an item, a bit at each of its places."""
    at: dict[int, int] = {}
    for k, x in enumerate(pattern.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    return at


def edit_distance_within(at: dict[int, int], m: int, text: np.ndarray, most: int) -> tuple[int, int]:
    """(least edit distance of an item of ``m`` words to any stretch of ``text``, where the first such stretch ends).

    Over ``most`` the distance may be given as ``m``.  Bit vectors hold the column
    differences of the distance table, one text word at a time.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    best, end = m, 0
    line = [at.get(x, 0) for x in text.tolist()]
    if len(line) - line.count(0) < m - most:  # each word of the item that isn't here is an edit
        return best, end
    for k, equal in enumerate(line):
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            now += 1
        elif right_down & top:
            now -= 1
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        up = right_down | (full & ~(diagonal | right_up))
        down = right_up & diagonal
        if now < best:
            best, end = now, k + 1
    return best, end


def _item_blocks(benchmark: DataFrame, p: DecontamParams) -> Iterator[tuple[int, Broadcast]]:
    """(number of blocks, broadcast) of the items, each of bounded size; one pass over the documents is made for each."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-n_bytes // p.items_bytes)
    for block in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else items
        yield n, spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def keep_clean(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams(), text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that leak no item, with an id or without (see ``leaks``); no row moves between tasks.

    With several blocks of items the documents are written after each, so that one block is held at a time.
    """
    at = docs.columns.index(text)
    for n, shared in _item_blocks(benchmark, p):

        def run(batches, shared=shared):
            made = Items(shared.value, p)
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for first, _, data, offs in text_chunks(b.column(at), CHUNK_BYTES // 2):
                    clean[[first + hit[0] for hit in made.matches(*word_hashes(data, offs))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:
            docs = stored(docs, "clean")
            shared.destroy()
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams(), key: str = "doc_id") -> DataFrame:
    """``key``, item_id, edits, similarity and end_word of each document row and benchmark item that it leaks.

    One row for each pair, with the best edit distance.  Null and empty texts leak
    nothing, an item without a word is never leaked, items that repeat are found
    each under its id, items without an id are searched as any other and found under
    a null item_id, and document rows that repeat give rows each.  Empty tables
    give no rows.  Whole texts are searched.  A ``key`` of the name of another result
    column is refused.
    """
    if key in ("item_id", "edits", "similarity", "end_word"):
        raise ValueError(f"{key} is a column of the result; rename the key first")
    fed = docs.select(F.col(f"`{key}`").alias(key), F.col("text").alias("__text"))
    schema = f"{key} {fed.schema[0].dataType.simpleString()}, item_id long, edits int, similarity double, end_word long"
    found = None
    for n, shared in _item_blocks(benchmark, p):

        def run(batches, shared=shared):
            made = Items(shared.value, p)
            for b in batches:
                for at, _, data, offs in text_chunks(b.column(1), CHUNK_BYTES // 2):
                    hits = made.matches(*word_hashes(data, offs))
                    if hits:
                        doc, item, edits, end = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([at + d for d in doc])), pa.array([made.ids[i] for i in item], pa.int64()), pa.array(edits, pa.int32()), pa.array([1 - e / len(made.words[i]) for e, i in zip(edits, item, strict=True)]), pa.array(end, pa.int64())],
                            names=[key, "item_id", "edits", "similarity", "end_word"],
                        )

        part = fed.mapInArrow(run, schema)
        if n > 1:
            part = stored(part, "leaks")
            shared.destroy()
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)
