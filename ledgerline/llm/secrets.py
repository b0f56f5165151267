"""Secret scans through encodings: a recursive worklist of decoded layers.

A whole text is scanned first; what is found there stays.  Lines that hold an escape or
a run that could be base64 start a worklist of layers: bytes, each with the code points
of the text that it stands for.  A layer gives further layers where URL escapes,
Unicode escapes, base64 runs, UTF-16 or compressed streams can be unwrapped; each is
scanned again and unwrapped again until nothing new comes.  A layer whose content was
seen at the same place is not taken up again, so cycles (a stream that decompresses to
itself) end.  What is found in a layer is reported at the code points that it came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import widened

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN, ACCESS, HEX = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]{24,}"
_TEXT = [re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)]
_BYTES = [re.compile(ASSIGN.encode(), re.I), re.compile(ACCESS.encode()), re.compile(HEX.encode())]

#: The shortest secret, 12 bytes, is 16 signs of base64.
RUN = 16
_HINT = re.compile(r"%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}")
_URL = re.compile(rb"%([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(rb"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
_RUNS = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
#: Lines of one length, and what is left in a last one.
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]++)+")
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_WIDE = re.compile(rb"(?:[\x09-\x7e]\x00){12,}|(?:\x00[\x09-\x7e]){12,}")
_STANDARD = bytes.maketrans(b"-_", b"+/")


@dataclass(frozen=True)
class ScanParams:
    #: Bytes that one compressed stream may give.  A larger one isn't opened, and is counted.
    most_bytes: int = 64 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what stands in the text itself, by start, then kind."""
    assign, access, runs = _TEXT
    found = [(0, m.start(), m.end()) for m in assign.finditer(text) if m.end(1) - m.start(1) >= 6]
    found += [(1, m.start(), m.end()) for m in access.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in runs.finditer(text)]
    return sorted(found, key=lambda x: (x[1], x[0], x[2]))


@dataclass
class Layer:
    """Decoded bytes; byte i stands for the code points lo[i] up to hi[i] of the text."""

    data: bytes
    lo: np.ndarray
    hi: np.ndarray
    path: str

    def key(self) -> tuple:
        return hashlib.blake2b(self.data, digest_size=16).digest(), int(self.lo[0]), int(self.hi[-1])

    def spans(self) -> Iterator[tuple[int, int, int, str]]:
        for kind, pattern in enumerate(_BYTES):
            for m in pattern.finditer(self.data):
                if kind == 0 and m.end(1) - m.start(1) < 6 or kind == 1 and m.end() - m.start() < 20:
                    continue
                yield kind, int(self.lo[m.start()]), int(self.hi[m.end() - 1]), m[0].decode()


def _replaced(layer: Layer, found: list[tuple[int, int, bytes]], name: str) -> Layer:
    """The layer with some runs (start, end, bytes) decoded; each new byte stands for its whole run."""
    data, lo, hi, at = [], [], [], 0
    for start, end, new in [*found, (len(layer.data), len(layer.data), b"")]:
        data += [layer.data[at:start], new]
        lo += [layer.lo[at:start], np.full(len(new), layer.lo[start] if new else 0)]
        hi += [layer.hi[at:start], np.full(len(new), layer.hi[end - 1] if new else 0)]
        at = end
    return Layer(b"".join(data), np.concatenate(lo), np.concatenate(hi), f"{layer.path}>{name}")


def _sign(m: re.Match) -> bytes | None:
    """The UTF-8 bytes of an escaped sign; ``\\x`` gives the byte itself."""
    braced, high, low, four, eight, two = m.groups()
    if two:
        return bytes([int(two, 16)])
    code = 0x10000 + (int(high, 16) - 0xD800 << 10) + int(low, 16) - 0xDC00 if high else int(braced or four or eight, 16)
    return chr(code).encode("utf-8", "surrogatepass") if code <= 0x10FFFF else None


def _decoded(run: bytes, phase: int) -> bytes:
    n = len(run) - phase
    n -= n % 4 == 1
    return base64.b64decode(run[phase : phase + n].translate(_STANDARD) + b"=" * (-n % 4))


def _base64(layer: Layer) -> Iterator[Layer]:
    """Each run of base64 signs from each of its first four signs on (a prefix may stand before what is encoded), wrapped lines together too."""
    for pattern in (_RUNS, _WRAPPED):
        for m in pattern.finditer(layer.data):
            place = np.arange(m.start(), m.end())
            if pattern is _WRAPPED:
                place = place[~np.isin(np.frombuffer(m[0], np.uint8), (10, 13))]
            run = bytes(np.frombuffer(layer.data, np.uint8)[place])
            for phase in range(4):
                data = _decoded(run, phase)
                bit = 8 * np.arange(len(data))
                yield Layer(data, layer.lo[place[phase + bit // 6]], layer.hi[place[phase + (bit + 7) // 6]], f"{layer.path}>base64")


def _opened(data: bytes, most: int) -> bytes | None:
    """What the stream at the beginning of ``data`` holds, up to one byte more than ``most``; None if it is none."""
    try:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78":
            return zlib.decompressobj(47).decompress(data, most + 1)
        if data[:2] == b"BZ":
            return bz2.BZ2Decompressor().decompress(data, most + 1)
        if data[:1] == b"\xfd":
            return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=256 << 20).decompress(data, most + 1)
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as f:
            return f.read(most + 1)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return None


class Scan:
    """The worklist of one text."""

    def __init__(self, p: ScanParams):
        self.p, self.seen, self.found, self.unopened, self.layers = p, set(), {}, 0, 0

    def children(self, layer: Layer) -> Iterator[Layer]:
        escapes = [(m.start(), m.end(), bytes([int(m[1], 16)])) for m in _URL.finditer(layer.data)]
        if escapes:
            yield _replaced(layer, escapes, "url")
        signs = [(m.start(), m.end(), s) for m in _ESCAPE.finditer(layer.data) if (s := _sign(m)) is not None]
        if signs:
            yield _replaced(layer, signs, "unicode")
        yield from _base64(layer)
        if layer.path == "text":
            return  # a text holds neither streams nor UTF-16
        for m in _WIDE.finditer(layer.data):
            at = slice(m.start() + (m[0][0] == 0), m.end(), 2)
            yield Layer(layer.data[at], layer.lo[at], layer.hi[at], f"{layer.path}>utf-16")
        for m in _STREAM.finditer(layer.data):
            data = _opened(layer.data[m.start() :], self.p.most_bytes)
            if data and len(data) > self.p.most_bytes:
                self.unopened += 1
            elif data:
                first, last = layer.lo[m.start()], layer.hi[-1]
                yield Layer(data, np.broadcast_to(first, len(data)), np.broadcast_to(last, len(data)), f"{layer.path}>compressed")

    def run(self, first: Layer) -> None:
        todo = [first]
        while todo:
            layer = todo.pop()
            if len(layer.data) < 12 or (key := layer.key()) in self.seen:
                continue
            self.seen.add(key)
            if layer is not first:
                self.layers += 1
                for kind, start, end, value in layer.spans():
                    self.found.setdefault((kind, start, end), (layer.path, value))
            todo += self.children(layer)


def _fragments(text: str) -> Iterator[Layer]:
    """Neighbouring lines that hold a hint, together, as layers of their own."""
    at, start = 0, None
    for line in [*text.splitlines(keepends=True), None]:
        if line is not None and _HINT.search(line):
            start = at if start is None else start
        elif start is not None and line is not None and line.strip() and at - start and re.fullmatch(r"[A-Za-z0-9+/_-]+={0,2}\r?\n?", line):
            pass  # the last line of wrapped base64
        elif start is not None:
            part = text[start:at]
            data = part.encode("utf-8", "surrogatepass")
            width = np.fromiter((1 + (c > "\x7f") + (c > "\u07ff") + (c > "\uffff") for c in part), np.int64, len(part)) if len(data) > len(part) else np.ones(len(part), np.int64)
            lo = np.repeat(np.arange(start, at), width)
            yield Layer(data, lo, lo + 1, "text")
            start = None
        at += len(line or "")


def scan_text(text: str | None, p: ScanParams = ScanParams()) -> tuple[list[tuple[int, int, int, str, str]], int, int]:
    """((kind, start, end, path, value) by start, kind and end; layers; streams not opened) of a whole text; null is empty."""
    text = text or ""
    base = [(k, a, b, "text", text[a:b]) for k, a, b in base_spans(text)]
    if not _HINT.search(text):
        return base, 0, 0
    scan = Scan(p)
    for part in _fragments(text):
        scan.run(part)
    own = {x[:3] for x in base}
    more = [(*k, *v) for k, v in scan.found.items() if k not in own]
    return sorted(base + more, key=lambda x: (x[1], x[0], x[2])), scan.layers, scan.unopened


def find(docs: DataFrame, p: ScanParams = ScanParams(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with spans, n_layers and n_unopened.

    A span has kind, start and end (code points, end exclusive), path (``text``, or the encodings
    that were unwrapped, outermost first) and the decoded value.  A null or empty text has none;
    equal rows get equal results; columns with the names of the results are replaced.  Every
    layer is followed, however deep; only a stream of over ``most_bytes`` isn't, and n_unopened says so.
    """
    new = ["spans", "n_layers", "n_unopened"]
    kept = docs.select([F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in new])
    schema = widened(kept, ("spans", "array<struct<kind:string,start:int,end:int,path:string,value:string>>"), ("n_layers", "int"), ("n_unopened", "int"))
    fed = docs.select([*(F.col(f"`{c}`") for c in kept.columns), F.col(f"`{text}`").alias("__text")])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("path", pa.string()), ("value", pa.string())])

    def run(batches):
        for b in batches:
            got = [scan_text(t.as_py(), p) for t in b.column(b.num_columns - 1)]
            spans = [[{"kind": KINDS[k], "start": a, "end": e, "path": path, "value": value} for k, a, e, path, value in x] for x, _, _ in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spans, pa.list_(kind)), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=[*b.schema.names[:-1], *new])

    return fed.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the spans of the text itself, and all spans as one string; also the layers."""
    base = F.filter("spans", lambda s: s["path"] == "text")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_layers", "n_unopened")
