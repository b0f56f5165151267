"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another.

A text's tokens under A and B are laid over the same bytes.  A two-pointer merge of
the cumulative token ends finds the offsets where both end; these cut the text into
groups, and every A token of a group is linked with every B token of it.  Over the
corpus, Spark counts in how many documents each id pair is linked, finds each id's
highest count, and joins both back to the documents.

Both tokenizers end a token before a space that stands between two other signs, so a text
is cut there; what is between is aligned once and found again in a table.  The bytes, the
groups and the links of the text are those of its parts.

Documents are handled in blocks of about ``BLOCK_BYTES`` of text.  A block's distinct
pairs are summed before anything is shuffled, and counts come back to blocks, not to
tokens, so a pair that is in every text costs one row for each block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, widened
from .tokenids import definition_of

#: Text of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Characters of parts of which a worker keeps the alignment, about; beyond, those that few texts have are dropped.
KNOWN_CHARS = 3_000_000
#: Bits of an id in a packed pair.
ID_BITS = 20

COLUMNS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("n_best", "long"), ("count_sum", "long"), ("groups_sha256", "string")]

#: A space beside white space, and one between two signs that are none.
_BESIDE, _BETWEEN = re.compile(r"\s | \s|^ | $"), re.compile(r"(?<=\S) (?=\S)")


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: visible Latin-1 signs for themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(seen))
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library over space+text; control strings in texts are plain text."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        signs = byte_signs()
        self.bytes = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
        self.size = np.array(list(map(len, self.bytes)), np.int64)
        spec = json.loads(definition)
        cut = spec.get("pre_tokenizer") or {}
        #: Whether a text may be cut before spaces.
        self.apart = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and spec.get("normalizer") is None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """``encode`` of parts that a text was cut into; those that don't begin with white space are encoded together, many in a text."""
        out: list[list[int] | None] = [None] * len(parts)
        plain = [i for i, p in enumerate(parts) if self.apart and p and not p[0].isspace()]
        runs = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        for run, ids in zip(runs, self.encode([" ".join([parts[i] for i in run]) for run in runs]), strict=True):
            ends = np.cumsum(self.size[np.array(ids, np.int64)])
            want = np.cumsum([1 + len(parts[i].encode()) for i in run])
            cut = np.searchsorted(ends, want) + 1
            if cut[-1] == len(ids) and (ends[cut - 1] == want).all():
                for i, a, b in zip(run, [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.encode([parts[i] for i in rest]), strict=True):
            out[i] = ids
        return out


class Pieces:
    """A sentencepiece model over texts, before each of which it puts a space."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.apart = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def groups(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """(A ids, B ids) between offsets where both sides end; both sides cover the same bytes, sizes are those of all ids.

    Two pointers over the cumulative ends: the side that is behind takes its next token.  A side of one token ends only once.
    """
    if len(a) == 1 or len(b) == 1:
        yield a, b
        return
    i = j = first_a = first_b = end_a = end_b = 0
    while i < len(a):
        if end_a <= end_b:
            end_a += a_size[a[i]]
            i += 1
        while end_b < end_a:
            end_b += b_size[b[j]]
            j += 1
        if end_a == end_b:
            yield a[first_a:i], b[first_b:j]
            first_a, first_b = i, j


def summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, ascending, with the sum of its times."""
    room = 63 - 2 * ID_BITS
    if times.max(initial=0) >> room:  # too large to be sorted along with the pair
        key, back = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, times)
        return key, total
    both = pairs << room | times
    both.sort()
    key = both >> room
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[first], np.add.reduceat(both & ((1 << room) - 1), first) if len(first) else first


class Aligner:
    """Alignment of texts by that of their parts, each of which gets a number and is aligned once.

    Of a part it keeps the tokens of A (-1: its A or B bytes aren't space+part) and B, the groups
    and their text, and its packed pairs with their occurrences, end to end with those of the others.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b, self.apart = a, b, a.apart and b.apart
        if max(len(a.bytes), len(b.bytes)) > 1 << ID_BITS:
            raise ValueError("a vocabulary is too large for a packed pair")
        self.a_size, self.b_size = list(map(len, a.bytes)), list(map(len, b.bytes))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.uses = array("i")  # texts since the last shrinking
        self.facts, self.first, self.pairs, self.times, self.chars = array("q"), array("q", [0]), array("q"), array("i"), 0

    def shrink(self) -> None:
        """Keep the parts that more than one text has had, the more frequent half at most."""
        uses, n = np.array(self.uses), len(self.said)
        keep = np.flatnonzero(uses > max(1, np.partition(uses, n // 2)[n // 2]))
        facts, first, pairs, times = np.array(self.facts).reshape(-1, 3)[keep], np.array(self.first), np.array(self.pairs), np.array(self.times)
        width = first[keep + 1] - first[keep]
        place = np.arange(width.sum()) + np.repeat(first[keep] - np.cumsum(width) + width, width)
        parts = list(self.number)  # in order of their numbers
        self.number = {parts[i]: k for k, i in enumerate(keep.tolist())}
        self.said = [self.said[i] for i in keep.tolist()]
        self.facts, self.first = array("q", facts.tobytes()), array("q", np.concatenate([[0], np.cumsum(width)]).astype(np.int64).tobytes())
        self.pairs, self.times, self.uses = array("q", pairs[place].tobytes()), array("i", times[place].tobytes()), array("i", bytes(4 * len(keep)))
        self.chars = sum(map(len, self.number))

    def parts(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        return _BETWEEN.split(text) if _BESIDE.search(text) else text.split(" ")

    def learn(self, parts: list[str]) -> None:
        a_bytes, b_bytes, a_size, b_size, pairs, times = self.a.bytes, self.b.bytes, self.a_size, self.b_size, self.pairs, self.times
        for part, a, b in zip(parts, self.a.encode_parts(parts), self.b.encode(parts), strict=True):
            raw, said, n_a = (" " + part).encode(), [], -1
            if b"".join([a_bytes[i] for i in a]) == raw and b"".join([b_bytes[i] for i in b]) == raw:
                n_a, own, n_own = len(a), [], []
                for x, y in groups(a, b, a_size, b_size):
                    if len(x) == len(y) == 1:
                        said.append(f"{x[0]}|{y[0]}")
                        own.append(x[0] << ID_BITS | y[0])
                        n_own.append(1)
                        continue
                    said.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
                    if len(x) * len(y) < 16:
                        own += [i << ID_BITS | j for i in x for j in y]
                        n_own += [1] * (len(x) * len(y))
                    else:  # ids that repeat are counted first
                        y = Counter(y).items()
                        for i, n in Counter(x).items():
                            own += [i << ID_BITS | j for j, _ in y]
                            n_own += [n * m for _, m in y]
                pairs.extend(own)
                times.extend(n_own)
            self.number[part] = len(self.said)
            self.facts.extend((n_a, len(b), len(said)))
            self.said.append(";".join(said))
            self.first.append(len(pairs))
            self.chars += len(part)
        self.uses.extend([0] * len(parts))

    def align(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(tokens of A, of B, groups, the groups as ``a1,a2|b1;a3|b2,b3``, packed pairs ascending, occurrences) of each text.

        A text that is null or empty, or whose A or B bytes aren't space+text, has no tokens.
        """
        cut = [self.parts(t) if t else [] for t in texts]
        if self.chars > KNOWN_CHARS:
            self.shrink()
        self.learn([p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.number])
        facts, first, pool, n_pool, uses = np.frombuffer(self.facts, np.int64).reshape(-1, 3), np.frombuffer(self.first, np.int64), np.frombuffer(self.pairs, np.int64), np.frombuffer(self.times, np.int32), np.frombuffer(self.uses, np.int32)
        none = 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for parts in cut:
            numbers = list(map(self.number.__getitem__, parts))
            at = np.array(numbers, np.int64)
            found = facts[at]
            if not len(at) or found[:, 0].min() < 0:
                out.append(none)
                continue
            own, n = np.unique(at, return_counts=True)
            uses[own] += 1
            width = first[own + 1] - first[own]
            place = np.arange(width.sum()) + np.repeat(first[own] - np.cumsum(width) + width, width)
            key, times = summed(pool[place], n_pool[place] * np.repeat(n, width))
            out.append((*found.sum(0).tolist(), ";".join(map(self.said.__getitem__, numbers)), key, times))
        return out


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner(definition: str, model: bytes) -> Aligner:
    key = hashlib.sha256(definition.encode() + model).digest()
    if key not in _ALIGNERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(ByteLevel(definition), Pieces(model))
    return _ALIGNERS[key]


def blocks(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its groups and links, and a row for each block with its distinct pairs; stored.

    ``docs`` hasn't columns that begin with ``__``.  A document's links are places (``__at``) in its block's ``__pairs``.
    """
    if any(c.startswith("__") for c in docs.columns):
        raise ValueError("columns that begin with __ are in use here")
    with open(b_path, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition_of(a_path), model))  # two vocabularies
    kept = docs.select([F.col(f"`{c}`") for c in docs.columns if c != text and c not in dict(COLUMNS)])
    schema = widened(
        kept, ("__block", "long"), *((c, k) for c, k in COLUMNS if c not in ("n_best", "count_sum")), ("__at", "array<int>"), ("__times", "array<long>"), ("__pairs", "array<long>"), ("__docs", "array<long>")
    )
    fed = docs.select([*(F.col(f"`{c}`") for c in kept.columns), F.col(f"`{text}`").alias("__text")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = aligner(*shared.value)
        number = TaskContext.get().partitionId() << 36
        for frame in frames:
            size = frame["__text"].str.len().fillna(0).cumsum().to_numpy(np.int64)
            at = 0
            while at < len(frame):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
                got = made.align([t if isinstance(t, str) else None for t in frame["__text"].iloc[at:end]])
                pairs, times = [g[4] for g in got], [g[5] for g in got]
                rows = [(number, n_a, n_b, n_groups, int(n.sum()), hashlib.sha256(said.encode()).hexdigest() if n_a else "") for n_a, n_b, n_groups, said, _, n in got]
                own, back, holds = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
                cuts = np.cumsum([len(x) for x in pairs])[:-1]
                out = frame.iloc[at:end].drop(columns="__text").reset_index(drop=True)
                out[["__block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]] = pd.DataFrame(rows, index=out.index)
                out["__at"] = np.split(back.astype(np.int32), cuts)
                out["__times"] = times
                out["__pairs"] = out["__docs"] = None
                yield out[schema.names]
                if len(own):
                    last = pd.DataFrame({c: [None] for c in schema.names})
                    last["__block"], last["__pairs"], last["__docs"] = [number], [own], [holds]
                    yield last
                number, at = number + 1, end

    return stored(fed.mapInPandas(run, schema), "aligned")


def pair_counts(held: DataFrame) -> DataFrame:
    """a, b, n_docs, and whether that is the highest count of its A id (best_a) or its B id (best_b), from ``blocks``."""
    pairs = held.where("__pairs IS NOT NULL").select(F.explode(F.arrays_zip("__pairs", "__docs")).alias("x")).select(F.col("x.__pairs").alias("pair"), F.col("x.__docs").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    counts = counts.select("pair", F.shiftright("pair", ID_BITS).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int").alias("b"), "n_docs")
    for side in ("a", "b"):
        most = counts.groupBy(side).agg(F.max("n_docs").alias("__most"))
        counts = counts.join(most, side).withColumn(f"best_{side}", F.col("n_docs") == F.col("__most")).drop("__most")
    return counts


def scored(held: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``blocks`` with what the corpus-wide ``counts`` (stored) say of their links."""
    own = held.where("__pairs IS NOT NULL").select(F.col("__block").alias("block"), F.posexplode("__pairs").alias("at", "pair"))
    # a pair that is in every block is a hot key of this join alone, which adaptive execution splits
    known = own.join(counts.select("pair", "n_docs", "best_a"), "pair").select("block", "at", "n_docs", "best_a")
    docs = held.where("__at IS NOT NULL").drop("__pairs", "__docs")
    fields = [f for f in docs.schema.fields if not f.name.startswith("__") and f.name not in dict(COLUMNS)]
    schema = widened(docs.select([f"`{f.name}`" for f in fields]), *COLUMNS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        at = np.asarray(left.column("at"))
        n[at], best[at] = np.asarray(left.column("n_docs")), np.asarray(left.column("best_a")).astype(np.int64)
        places, times = (right.column(c).combine_chunks() for c in ("__at", "__times"))
        total, top = [], []
        for k in range(right.num_rows):
            i, t = np.asarray(places[k].values), np.asarray(times[k].values)
            total.append(int((n[i] * t).sum()))
            top.append(int((best[i] * t).sum()))
        made = {"n_best": pa.array(top, pa.int64()), "count_sum": pa.array(total, pa.int64())}
        return pa.table({c: made[c] if c in made else right.column(c) for c in schema.names})

    return known.groupBy("block").cogroup(docs.groupBy("__block")).applyInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, and for each row n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Every row is a document of its own: repeated rows count each, null ids are kept.
    A text that is null or empty, or whose tokens' bytes aren't space+text, has zeros and
    an empty digest.  Columns with the names of the results are replaced; no rows give no
    rows.  A link is best if its pair's count is the highest of its A id, ties included.
    """
    held = blocks(docs, a_path, b_path, text)
    counts = stored(pair_counts(held).select("pair", "n_docs", "best_a"), "pairs")
    out = stored(scored(held, counts), "scored")
    discard(held)
    discard(counts)
    return out
