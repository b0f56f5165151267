"""Exact removal of repeated byte strings by per-shard suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts anywhere else.

Every string of that length has its anchor: the leftmost smallest hash among the
16-byte grams that start in its first ``WINDOW`` bytes.  The anchor depends on the
string alone, so equal strings have their anchors at equal places and the
``length - WINDOW + 1`` bytes from the anchor on, its core, are the same.  So
strings can only repeat around anchors whose cores repeat, and

1. each document gives its anchors with hashes of the core and of the context (all
   bytes of strings that have this anchor);
2. anchors with an equal context elsewhere are done: every string around them
   repeats.  Cores with one context only are unique.  Both need counts alone;
3. of the rest, one text for each distinct context is cut out and sent to the
   shard of its core: shards are ranges of core hashes cut at sorted bounds, and a
   context finds its range by binary search, so equal strings meet in one shard.
   A core with very many contexts is split by what a string's place lets be
   compared (hash of the bytes that strings at neighbouring places share);
4. a shard sorts the suffixes at its anchors, onwards and backwards, by refining
   groups of equal beginnings until each is down to one row, and takes the common
   prefixes of neighbours; runs that two contexts share in both arrays are the
   strings that they share.

What step 4 sorts are sparse arrays: groups are refined by their next bytes, where
Larsson and Sadakane's algorithm takes the ranks of later suffixes, which a sparse
array doesn't have; for the same reason common prefixes come from comparing
neighbours and not from Kasai's walk.  Step 2 settles most of what repeats.

A 64-bit hash stands for a core; for a context another, of two hashes of its bytes
mixed with its place and length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, partitions, stored, text_chunks

GRAM = 16
WINDOW = 256
#: Bytes of contexts in a shard, about.
SHARD_BYTES = 4 << 20
#: Contexts of one core that a shard takes; a core with more is split by place.
CORE_CONTEXTS = 8000
#: Places of a context's strings, at each level of splitting.
PLACES = (WINDOW, 16, 1)

_TABLE = np.random.default_rng(66).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_OTHER = np.uint64(0xA24BAED4963EE407)


def _inverse(x: np.uint64) -> np.uint64:
    y = int(x)
    for _ in range(6):
        y = y * (2 - int(x) * y) & (1 << 64) - 1
    return np.uint64(y)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        step = np.full(max(n, 1 << 21), base, np.uint64)
        step[0] = 1
        _POWERS[key] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[key]


class Rolling:
    """Hashes of any stretches of a text, from prefix sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, base: np.uint64 = _BASE):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power_table(base, len(data) + 1)[: len(data)], out=self.sums[1:])
        self.back = _power_table(_inverse(base), len(data) + 1)

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all stretches of ``width`` bytes; only good to be compared."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.back[:n]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of each ``width`` neighbours; ``values`` below 2 ** 34."""
    n = len(values)
    key = values << np.uint64(30) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    rows = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(rows, axis=1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])
    return (least & np.uint64((1 << 30) - 1)).astype(np.int64)


def anchor_rows(data: np.ndarray, offs: np.ndarray, length: int):
    """(document, low, high, lead, core hash, context hash) of the anchors of a chunk's documents, each once, in order."""
    n = len(data)
    sizes = np.diff(offs)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling, other = Rolling(data), Rolling(data, _OTHER)
    h = rolling.grams(GRAM)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(30)
    least = sliding_argmin(h, WINDOW)
    valid = np.zeros(n + 1, np.int8)  # starts of strings that end within their document
    long = sizes >= length
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - length + 1, -1)
    at = least[: n - length + 1][np.cumsum(valid[: n - length + 1], dtype=np.int8) > 0]
    at = at[np.append(True, at[1:] != at[:-1])]  # anchors of neighbouring starts don't go back
    doc = np.searchsorted(offs, at, "right") - 1
    low, high = np.maximum(offs[doc], at - WINDOW + 1), np.minimum(offs[doc + 1], at + length)
    core = rolling.of(at, at + (length - WINDOW + 1))
    context = mix(other.of(low, high) + rolling.of(low, high) * np.uint64(3) + ((at - low).astype(np.uint64) << np.uint64(20)) + (high - at).astype(np.uint64))
    return doc, low - offs[doc], high - offs[doc], at - low, core, context


def symbols(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of symbols, lengths) of byte strings; past its end a row has a symbol below all others."""
    lens = np.array([min(len(r), width) for r in rows], np.int64)
    flat = np.frombuffer(b"".join(r[:width] for r in rows), np.uint8)
    wide = bool(len(flat)) and not flat.all()  # a zero byte must not look like an end
    out = np.zeros((len(rows), -(-width // 8) * 8), np.uint16 if wide else np.uint8)
    at = np.repeat(np.arange(len(rows)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    out[at] = flat.astype(np.uint16) + 1 if wide else flat
    return out, lens


def suffix_order(group: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The suffix array: rows sorted within their groups.

    Groups of equal beginnings are sorted by their next bytes, and those that are down
    to one row are left alone from then on.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = group[order][1:] != group[order][:-1]
    words = matrix.astype(matrix.dtype.newbyteorder(">")).view(">u8").astype(np.uint64)
    for column in range(words.shape[1]):
        places = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(places):
            break
        rank = np.cumsum(fresh)[places]
        own = order[places]
        word = words[own, column]
        by = np.lexsort((word, rank))
        order[places], word, rank = own[by], word[by], rank[by]
        new = np.ones(len(places), bool)
        new[1:] = (word[1:] != word[:-1]) | (rank[1:] != rank[:-1])
        fresh[places] = new
    return order


def neighbour_prefixes(group: np.ndarray, matrix: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row of the array with the one before it; -1 in another group."""
    out = np.full(len(order), -1, np.int64)
    for at in range(1, len(order), 4096):
        one, two = order[at - 1 : at + 4095], order[at : at + 4096]
        one = one[: len(two)]
        apart = matrix[one] != matrix[two]
        common = np.where(apart.any(1), apart.argmax(1), matrix.shape[1])
        out[at : at + 4096] = np.where(group[one] == group[two], np.minimum(common, np.minimum(lens[one], lens[two])), -1)
    return out


def repeated_places(core: np.ndarray, blobs: list[bytes], anchor: np.ndarray, length: int) -> np.ndarray:
    """[context, o]: whether the string of ``length`` bytes that starts o bytes before the anchor is in another context of the core too.

    Two arrays are made: of the suffixes from the anchors on, and of the prefixes
    before them, read backwards.  Contexts that share ``length - o`` bytes on the right
    are neighbours in one, those that share o bytes on the left in the other; those
    in the same run of both share the string.
    """
    m, places = len(blobs), int(anchor.max(initial=0)) + 1
    right, right_len = symbols([b[a:] for b, a in zip(blobs, anchor.tolist(), strict=True)], length)
    left, left_len = symbols([b[:a][::-1] for b, a in zip(blobs, anchor.tolist(), strict=True)], max(1, places - 1))
    order_r, order_l = suffix_order(core, right), suffix_order(core, left)
    prefix_r, prefix_l = neighbour_prefixes(core, right, right_len, order_r), neighbour_prefixes(core, left, left_len, order_l)
    out = np.zeros((m, places), bool)
    run_r, run_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(places):
        run_r[order_r] = np.cumsum(prefix_r < length - o)
        run_l[order_l] = np.cumsum(prefix_l < o)
        both = run_r * (m + 1) + run_l
        by = np.argsort(both)
        same = both[by][1:] == both[by][:-1]
        out[by[1:][same], o] = True
        out[by[:-1][same], o] = True
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted spans (from, to) without overlap or touch."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    high = np.maximum.accumulate(spans[:, 1])
    fresh = np.ones(len(spans), bool)
    fresh[1:] = spans[1:, 0] > high[:-1]
    at = np.flatnonzero(fresh)
    return np.stack([spans[at, 0], high[np.append(at[1:], len(spans)) - 1]], 1)


def split_context(blob: bytes, anchor: int, length: int, places: int, width: int) -> list[tuple[int, int, int, int]]:
    """(first place, from, to, core end) of the parts of a context whose strings start ``width`` places or fewer apart.

    A string at place o starts o bytes before the anchor; a context holds places 0
    to ``places`` - 1, as far as its text goes.  Strings of a part share the bytes
    from the part's first place to the core end.
    """
    out = []
    for o in range(0, places, width):
        near, far = anchor - o, max(0, anchor - o - width + 1)
        if near < 0 or far + length > len(blob):
            continue
        out.append((o, far, min(len(blob), near + length), anchor - o - width + 1 + length))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of two numbers that rows share only if they are the same in both."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("k2"))


def _anchor_table(keyed: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for at, _, data, offs in text_chunks(b.column(2)):
                doc, low, high, lead, core, context = anchor_rows(data, offs, length)
                doc = pa.array(doc + at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(doc), b.column(1).take(doc), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(lead, pa.int32()), pa.array(core.view(np.int64)), pa.array(context.view(np.int64))],
                    names=["k1", "k2", "low", "high", "lead", "core", "context"],
                )

    return keyed.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, low int, high int, lead int, core long, context long")


def _cut(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(core, k1, k2, low, blob, anchor) of the ``wanted`` contexts (core, k1, k2, low, high, lead)."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("core", "low", "high", "lead")).alias("w"))  # those of one document

    def run(batches):
        for b in batches:
            for row, (k1, k2) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                raw, w = (b.column(2)[row].as_py() or "").encode(), b.column(3)[row].as_py()
                for at in range(0, len(w), 4096):
                    some = w[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x["core"] for x in some]), pa.array([k1] * len(some)), pa.array([k2] * len(some)), pa.array([x["low"] for x in some], pa.int32()), pa.array([raw[x["low"] : x["high"]] for x in some]), pa.array([x["lead"] for x in some], pa.int32())],
                        names=["core", "k1", "k2", "low", "blob", "anchor"],
                    )

    return keyed.select("k1", "k2", "text").join(lists, ["k1", "k2"]).select("k1", "k2", "text", "w").mapInArrow(run, "core long, k1 long, k2 long, low int, blob binary, anchor int")


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, low, high) of strings that repeat among ``contexts`` (core, k1, k2, low, blob); equal cores meet in one shard."""
    total = contexts.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    n = max(partitions(contexts.sparkSession), -(-total // SHARD_BYTES))
    # shards are ranges of cores; a row finds its own by binary search among the sorted bounds
    dealt = contexts.repartitionByRange(n, "core").sortWithinPartitions("core").select("core", "k1", "k2", "low", "blob", "anchor")

    def compare(rows):
        # rows that are the same give one context; at a document's start several anchors share a core and low
        rows = list({(r[0], r[1], r[2], r[3], r[5], len(r[4])): r for r in rows}.values())
        cores = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1].ravel()
        k1, k2, low, anchor = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 5))
        marked = repeated_places(cores, [r[4] for r in rows], anchor, length)
        # runs of places, farthest first, are runs of starts
        edge = np.diff(np.pad(marked, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, near), (_, far) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = (low + anchor)[row]
        return pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(base - far + 1, pa.int32()), pa.array(base - near + length, pa.int32())], names=["k1", "k2", "low", "high"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= SHARD_BYTES and held[-1][0] != row[0]:  # whole cores stay together
                    yield compare(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "k1 long, k2 long, low int, high int")


def _split(contexts: DataFrame, length: int, places: int, width: int) -> DataFrame:
    """The parts of contexts that have very many fellows: the same columns, with the finer core."""

    def run(batches):
        for b in batches:
            out = []
            for core, k1, k2, low, blob, anchor in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for o, start, end, stop in split_context(blob, anchor, length, places, width):
                    shared = hashlib.blake2b(blob[anchor - o : stop], digest_size=8, key=f"{core}/{o}".encode()).digest()
                    out.append((int.from_bytes(shared, "little", signed=True), k1, k2, low + start, blob[start:end], anchor - o - start))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)], names=["core", "k1", "k2", "low", "blob", "anchor"])

    return contexts.select("core", "k1", "k2", "low", "blob", "anchor").mapInArrow(run, "core long, k1 long, k2 long, low int, blob binary, anchor int")


def _those_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` whose keys are in ``wanted`` (keys, each once, and n, its number of rows).

    Keys of more than a ten-thousandth of all rows (10,000 rows at least) are looked
    up by a broadcast, of ten thousand keys at most, so that none is one task's work.
    """
    total, most = wanted.agg(F.sum("n"), F.max("n")).first()
    limit = max(10_000, (total or 0) // 10_000)
    few = rows.join(wanted.where(F.col("n") <= limit).select(*keys), keys, "left_semi")
    if (most or 0) <= limit:
        return few
    hot = F.broadcast(wanted.where(F.col("n") > limit).select(*keys))
    return rows.join(hot, keys, "left_anti").join(wanted.where(F.col("n") <= limit).select(*keys), keys, "left_semi").union(rows.join(hot, keys, "left_semi"))


def repeated_spans(docs: DataFrame, length: int = 400, core_contexts: int = CORE_CONTEXTS) -> DataFrame:
    """(k1, k2, low, high) of stretches of the documents whose ``length``-byte strings all start elsewhere too."""
    if length < WINDOW + GRAM:
        raise ValueError(f"strings have {WINDOW + GRAM} bytes at least")
    keyed, read = _keyed(docs), []

    def kept(df: DataFrame, name: str) -> DataFrame:
        read.append(stored(df, name))
        return read[-1]

    table = kept(_anchor_table(keyed, length), "anchors")
    contexts = kept(table.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "low", "high", "lead")).alias("one")), "contexts")
    # a context that is there again needs no comparison, and a core with one context has nothing to be compared with
    found = _those_in(table, contexts.where("n > 1").select("core", "context", "n"), ["core", "context"]).select("k1", "k2", "low", "high")
    cores = kept(contexts.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cores")
    blobs = kept(_cut(keyed, _those_in(contexts, cores, ["core"]).select("core", "one.*")), "blobs")
    for places, width in zip(PLACES, (*PLACES[1:], 0), strict=True):
        many = kept(blobs.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > core_contexts), "many")
        if many.isEmpty() or not width:
            found = found.union(_compare(blobs, length))
            break
        found = found.union(_compare(blobs.join(many, "core", "left_anti"), length))
        parts = kept(_split(_those_in(blobs, many, ["core"]), length, places, width).withColumn("context", F.sha2("blob", 256)), "parts")
        counts = kept(parts.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "low", "blob", "anchor")).alias("one")), "counts")
        twice = _those_in(parts, counts.where("n > 1").select("core", "context", "n"), ["core", "context"])
        found = found.union(twice.select("k1", "k2", "low", (F.col("low") + F.octet_length("blob")).cast("int").alias("high")))
        blobs = kept(counts.select("core", "one.*"), "blobs")
    spans = stored(found, "spans")
    for t in read:
        discard(t)
    return spans


def drop_repeats(docs: DataFrame, length: int = 400, core_contexts: int = CORE_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each row of ``docs`` (doc_id, text).

    Texts are UTF-8 bytes, a null text is empty; strings don't cross rows.  Bytes are
    judged on the input, so a row and its copy both lose what they share.  Cuts are at
    any byte, so ``kept`` is binary.  Rows that repeat count as copies.  No rows give
    no rows; texts under ``length`` bytes keep all.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(docs, length, core_contexts).groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # those of one document
    fed = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in batches:
            for at, end, data, offs in text_chunks(b.column(1)):
                kept, removed, count = [], [], []
                cuts = b.column(2)[at:end]
                flat = cuts.flatten()
                ends = np.cumsum([0, *(len(x) if x.is_valid else 0 for x in cuts)])
                low, high = (np.asarray(flat.field(k), np.int64) for k in (0, 1))
                for i in range(end - at):
                    own = data[offs[i] : offs[i + 1]]
                    if ends[i] == ends[i + 1]:
                        kept.append(own.tobytes())
                        removed.append(0)
                        count.append(0)
                        continue
                    m = merged(np.stack([low[ends[i] : ends[i + 1]], high[ends[i] : ends[i + 1]]], 1))
                    edges = [0, *m.ravel().tolist(), len(own)]
                    raw = own.tobytes()
                    kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append(len(raw) - len(kept[-1]))
                    count.append(len(m))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at:end], pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return fed.mapInArrow(run, f"doc_id {fed.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
