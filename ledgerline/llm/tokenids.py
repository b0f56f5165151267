"""Token ids in compressed binary shards with a shared zstandard dictionary.

Documents in ascending doc_id order are encoded, the end id is appended, and each
document's id array is compressed by itself against one dictionary trained on a
sample of id arrays; so any short document can be read by its index entry alone.

A shard file (numbers little-endian):

    8 bytes   magic ``LTOKIDS1``
    32 bytes  sha256 of the dictionary (of nothing: no dictionary)
    1 byte    bytes of an id, 2 or 4
    7 bytes   zero
    frames    one zstandard frame for each document
    index     16 bytes a document: offset of its frame in the file, number of ids
    keys      9 bytes a document: 1 if there is a doc_id, and the doc_id
    footer    offset of the index, number of documents, magic

Shards are written to a temporary name and renamed, under a name that depends on
the partition alone: a task that runs again replaces its own file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, partitions, run_hashes, scratch, stored, text_chunks, unit_hash

MAGIC = b"LTOKIDS1"
HEAD = struct.Struct("<8s32sB7x")
FOOT = struct.Struct("<QQ8s")
#: A shard is closed when it has this many bytes of frames.
SHARD_BYTES = 32 << 20
#: Documents, about, whose id arrays train the dictionary, and its size.
DICTIONARY_SAMPLE = 1500
DICTIONARY_BYTES = 64 << 10
#: Pieces of which a worker keeps the ids.
PIECES = 1_000_000
END_ID = 1

#: Byte classes: white space, letter, digit, other; and bytes that need the library itself.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
_CLASS[48:58] = _DIGIT
_ODD = np.zeros(256, bool)
_ODD[[0x27, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True


class Pieces:
    """A table of piece hashes with the ids of each piece; it starts afresh beyond ``most`` pieces."""

    def __init__(self, kind: np.dtype, most: int):
        self.kind, self.most, self.bits = kind, most, int(most * 2 - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)  # no hash is zero
        self.values = np.zeros(1 << self.bits, np.int32)
        self.starts, self.lens, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.pool, self.used = np.zeros(1 << 14, self.kind), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's piece, or -1."""
        mask, out = np.int64((1 << self.bits) - 1), np.full(len(h), -1, np.int32)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out[hit] = self.values[slot[hit]]
        todo = np.flatnonzero(~hit & (key != 0))
        while len(todo):
            at = slot[todo] = slot[todo] + 1 & mask
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        """Distinct new hashes, with their ids end to end."""
        n, m = self.n + len(h), self.used + len(ids)
        while len(self.starts) < n:
            self.starts, self.lens = np.concatenate([self.starts, self.starts]), np.concatenate([self.lens, self.lens])
        while len(self.pool) < m:
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used : m] = ids
        self.lens[self.n : n] = lens
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        number = np.arange(self.n, n, dtype=np.int32)
        self.n, self.used = n, m
        mask, slot = np.int64((1 << self.bits) - 1), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = np.zeros(len(slot), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = h[put], number[put]
            h, number, slot = h[~put], number[~put], slot[~put] + 1 & mask


class Encoder:
    """Ids of texts under a word-level BPE tokenizer, the same as those of the tokenizers library.

    The tokenizer lower-cases and drops white space, and its pieces (runs of letters,
    single digits, runs of other signs) have ids of their own, each ending in a word
    end.  So a piece is encoded once, many in one call, and found by a hash of its
    bytes after that.  Texts with apostrophes, control strings, or letters outside
    ASCII and U+00C0 to U+00FF go to the library whole.
    """

    def __init__(self, definition: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2" if max(self.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.vocabulary, bool)
        for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = word.endswith("</w>")
        self.end = np.array([end_id], self.type).tobytes()
        self.pieces = Pieces(self.type, PIECES)
        probe = 'The cats  naïve,\n42 Ways!! of\tÉtude x_y "q" a1b2 --3.14% Ñandú ßß ×'
        self.plain = bool(self.ends.any()) and [b"".join(self._chunk([probe]))] == [self._library(probe)]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _learn(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        h, at = np.unique(h, return_index=True)
        if self.pieces.n + len(h) > self.pieces.most:
            self.pieces.clear()
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.type)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):  # each by itself
                own = [np.frombuffer(self._library(w), self.type) for w in some]
                ids, cut = np.concatenate(own), np.cumsum([len(x) for x in own])
            self.pieces.add(h[k : k + 4096], ids, np.diff(cut, prepend=0).astype(np.int32))

    def _chunk(self, texts) -> Iterator[bytes]:
        """Ids of consecutive texts, without the end id."""
        for at, end, data, offs in text_chunks(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())):
            n = len(data)
            odd = _ODD[data]
            if n > 1:
                second = data[1:]
                odd[1:] |= (data[:-1] == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (data[:-1] == 0x3C) & (second == 0x7C)
            strange = np.zeros(end - at, bool)
            strange[np.searchsorted(offs, np.flatnonzero(odd), "right") - 1] = True
            sort = _CLASS[data]
            lower = LOWER[data]
            if n > 1:
                big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
                lower[1:][big] += 0x20
            cut = np.ones(n + 1, bool)
            if n > 1:
                cut[1:n] = (sort[1:] != sort[:-1]) | (sort[1:] == _DIGIT)
            cut[offs] = True
            cut = np.flatnonzero(cut)
            starts, ends = cut[:-1], cut[1:]
            solid = sort[starts] != _SPACE
            starts, ends = starts[solid], ends[solid]
            first = np.searchsorted(starts, offs)
            if strange.any():  # their pieces aren't asked for
                good = np.repeat(~strange, np.diff(first))
                starts, ends = starts[good], ends[good]
                first = np.searchsorted(starts, offs)
            h = run_hashes(lower, starts, ends) | np.uint64(1)
            number = self.pieces.find(h)
            new = np.flatnonzero(number < 0)
            if len(new):
                self._learn(lower, h[new], starts[new], ends[new])
                number = self.pieces.find(h)
                if (number < 0).any():  # the table started afresh
                    new = np.flatnonzero(number < 0)
                    self._learn(lower, h[new], starts[new], ends[new])
                    number = self.pieces.find(h)
            lens = self.pieces.lens[number].astype(np.int64)
            lead = np.zeros(len(lens) + 1, np.int64)
            np.cumsum(lens, out=lead[1:])
            ids = self.pieces.pool[np.arange(lead[-1]) + np.repeat(self.pieces.starts[number] - lead[:-1], lens)]
            raw, size, bound = ids.tobytes(), self.type.itemsize, lead[first].tolist()
            for i in range(end - at):
                yield self._library(data[offs[i] : offs[i + 1]].tobytes().decode()) if strange[i] else raw[bound[i] * size : bound[i + 1] * size]

    def encode(self, texts) -> Iterator[bytes]:
        """The serialized ids of each text of an array or list, with the end id; null is empty."""
        if self.plain:
            for ids in self._chunk(texts):
                yield ids + self.end
        else:
            for t in texts if isinstance(texts, list) else texts.to_pylist():
                yield self._library(t or "") + self.end


_ENCODERS: dict[str, Encoder] = {}


def encoder(definition: str, end_id: int) -> Encoder:
    key = hashlib.sha256(f"{end_id}/{definition}".encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition, end_id)
    return _ENCODERS[key]


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the arrays; of too few to train on, their plain bytes."""
    arrays = [a for a in arrays if a]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size]


def _codec(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class Shard:
    """A shard file being made."""

    def __init__(self, dictionary: bytes, width: int):
        self.made = zstandard.ZstdCompressor(level=3, dict_data=_codec(dictionary), write_checksum=False)
        self.parts, self.index, self.keys, self.width = [HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width)], [], [], width
        self.at, self.ids = HEAD.size, 0

    def add(self, key: int | None, raw: bytes) -> None:
        frame = self.made.compress(raw)
        self.index.append((self.at, len(raw) // self.width))
        self.keys.append(struct.pack("<Bq", key is not None, key or 0))
        self.parts.append(frame)
        self.at += len(frame)
        self.ids += len(raw) // self.width

    def bytes(self) -> bytes:
        return b"".join([*self.parts, np.array(self.index, "<u8").tobytes(), *self.keys, FOOT.pack(self.at, len(self.index), MAGIC)])


class ShardReader:
    """Random access to the documents of a shard file."""

    def __init__(self, raw: bytes, dictionary: bytes):
        magic, digest, self.width = HEAD.unpack_from(raw)
        at, self.n, again = FOOT.unpack_from(raw, len(raw) - FOOT.size)
        if magic != MAGIC or again != MAGIC:
            raise ValueError("not a whole shard file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.raw, self.index = raw, np.frombuffer(raw, "<u8", 2 * self.n, at).reshape(-1, 2)
        self.end, self.keys = at, at + 16 * self.n
        self.made = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def key(self, i: int) -> int | None:
        has, key = struct.unpack_from("<Bq", self.raw, self.keys + 9 * i)
        return key if has else None

    def ids(self, i: int) -> np.ndarray:
        at = int(self.index[i, 0])
        end = int(self.index[i + 1, 0]) if i + 1 < self.n else self.end
        raw = self.made.decompress(self.raw[at:end], max_output_size=int(self.index[i, 1]) * self.width + 1)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _save(folder: str, name: str, content: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    temporary = f"{path}/_{name}-{context.taskAttemptId() if context else 0}"
    store.create_dir(path, recursive=True)
    with store.open_output_stream(temporary) as f:
        f.write(content)
    store.move(temporary, f"{path}/{name}")


def sample_arrays(docs: DataFrame, definition: str, end_id: int, n: int, seed: int) -> list[bytes]:
    """Serialized ids of about ``n`` documents, drawn by a seeded hash of the id."""
    share = n / max(1, docs.count())
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches):
        made = encoder(shared.value, end_id)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[: 1 << 16] for x in made.encode(b.column(0))], pa.binary())], names=["raw"])

    drawn = docs.where(unit_hash(seed, F.coalesce("doc_id", F.lit(0).cast("long"))) < share).select("text")
    return sorted(r.raw for r in drawn.mapInArrow(run, "raw binary").limit(2 * n).collect())


def write(docs: DataFrame, folder: str, definition: str, end_id: int = END_ID, seed: int = 3) -> DataFrame:
    """Write the ids of every whole text of ``docs`` (doc_id, text) to shards in ``folder``.

    Returns (file, n_docs, n_ids) of the shards.  File names in order hold the
    documents in ascending doc_id (null first, equal ids by text hash); a null text
    is empty, repeated rows are written again, no rows make no shard.  ``folder`` is
    a URI that driver and executors share.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # a bounded sample; arrays are cut for training only
    dictionary = train_dictionary(sample_arrays(docs, definition, end_id, DICTIONARY_SAMPLE, seed))
    _save(folder, "dictionary", dictionary)
    shared = spark.sparkContext.broadcast((definition, dictionary))
    order = ["doc_id", "__tie"]
    dealt = docs.withColumn("__tie", F.xxhash64("text")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        text, trained = shared.value
        made = encoder(text, end_id)
        part, number = TaskContext.get().partitionId(), 0
        shard = None

        def close():
            _save(folder, name := f"part-{part:07d}-{number:05d}.ids", shard.bytes())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(shard.index)], pa.int64()), pa.array([shard.ids], pa.int64())], names=["file", "n_docs", "n_ids"])

        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), made.encode(b.column(1)), strict=True):
                shard = shard or Shard(trained, made.type.itemsize)
                shard.add(key, raw)
                if shard.at >= SHARD_BYTES:
                    yield close()
                    shard, number = None, number + 1
        if shard:
            yield close()

    return stored(dealt.mapInArrow(run, "file string, n_docs long, n_ids long"), "shards")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, file, place, start, n_tokens and ids_crc32 of every document, from the shard files in ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # at most DICTIONARY_BYTES
    dictionary = bytes(spark.read.format("binaryFile").option("pathGlobFilter", "dictionary").load(folder).select("content").first()[0])
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = ShardReader(content.as_py(), shared.value)
                n = shard.index[:, 1].astype(np.int64)
                crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(shard.n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.key(i) for i in range(shard.n)], pa.int64()), pa.array([name] * shard.n), pa.array(range(shard.n), pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["doc_id", "file", "place", "inner", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(run, "doc_id long, file string, place long, inner long, n_tokens long, ids_crc32 long")
    rows = stored(rows, "read")
    # one row a file: the ids of all files before it
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    lead = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lead"))
    return rows.join(lead, "file").select("doc_id", "file", "place", (F.col("lead") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def definition_of(path: str) -> str:
    """The tokenizer's definition, read on the driver; executors get its text, not its path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """``write`` to a new shared folder, then ``read``; no rows give no rows."""
    spark = docs.sparkSession
    folder = scratch(spark, "token-ids")
    shards = write(docs, folder, definition_of(tokenizer_path), end_id)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, file string, place long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder)
