"""Secret scans against a plain search of the text, and planted layers whose place is known."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from ledgerline.llm import registry, secrets

SECRET = b'api_key = "s3cr3tValue.42"'


def base(text):
    """Base spans from the contract's own words: match, then drop."""
    out = []
    for k, (pattern, flags, least, group) in enumerate(
        ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2), (r"AKIA[A-Z0-9]+", 0, 20, 0), (r"[0-9a-f]+", 0, 24, 0))
    ):
        at = 0
        while m := re.compile(pattern, flags).search(text, at):
            if len(m[group]) >= least:
                out.append((k, *m.span()))
            at = m.end()
    return sorted(out, key=lambda x: (x[1], x[0]))


def spans(text):
    return [x[:3] for x in secrets.scan_text(text)[0]]


def b64(x):
    return base64.b64encode(x).decode()


def escaped(x):
    return "".join(f"\\u{b:04x}" for b in x)


WRAPS = {
    "base64": b64(SECRET),
    "urlsafe": base64.urlsafe_b64encode(SECRET + "ÿþýüû".encode()).decode(),
    "unpadded": b64(SECRET).rstrip("="),
    "twice": b64(b64(SECRET).encode()),
    "gzip": b64(gzip.compress(SECRET)),
    "zlib": b64(zlib.compress(SECRET)),
    "bz2": b64(bz2.compress(SECRET)),
    "xz": b64(lzma.compress(SECRET)),
    "zstd": b64(zstandard.compress(SECRET)),
    "gzip of gzip": b64(gzip.compress(gzip.compress(SECRET))),
    "utf-16": b64(SECRET.decode().encode("utf-16-le")),
    "unicode": escaped(SECRET),
    "braces": "".join(f"\\u{{{b:x}}}" for b in SECRET),
    "long": "".join(f"\\U{b:08X}" for b in SECRET),
    "bytes": "".join(f"\\x{b:02x}" for b in SECRET),
    "url": "".join(f"%{b:02X}" for b in SECRET),
    "url of url": urllib.parse.quote("".join(f"%{b:02x}" for b in SECRET)),
    "url of base64 of zlib": urllib.parse.quote(b64(zlib.compress(SECRET)), safe=""),
    "url of a stream": "".join(f"%{b:02X}" for b in gzip.compress(SECRET)),
    "base64 of url": b64("".join(f"%{b:02x}" for b in SECRET).encode()),
    "base64 of unicode of base64": b64(escaped(b64(SECRET).encode()).encode()),
}


@pytest.mark.parametrize("name", sorted(WRAPS))
def test_layers_map_to_their_place(name):
    payload = WRAPS[name]
    for lead in ("", "Größe 🙂 then ", "x/"):
        text = f"plain line\n{lead}{payload} and more, 100% of it\nlast"
        start = text.index(payload)
        found = [s for s in secrets.scan_text(text)[0] if s[3] != "text"]
        assert any(s[0] == 0 and s[4].startswith('api_key = "s3cr3t') and start <= s[1] < s[2] <= start + len(payload) + 30 for s in found), found
        if "of" not in name and name not in ("gzip", "zlib", "bz2", "xz", "zstd", "twice"):
            least = min(s[2] - s[1] for s in found)
            assert least <= len(payload)


def test_exact_place_in_escapes():
    text = "see token%3Dabc%64ef99 now"
    assert spans(text) == [(0, 4, 22)]
    text = "key: é \\u0074oken=abcdef!"
    assert spans(text) == [(0, 7, 24)]
    inner = b64(b"xx token=abcdef yy")
    found = [s for s in secrets.scan_text(f"ü {inner}")[0]]
    assert found == [(0, 2 + 4, 2 + 20, "text>base64", "token=abcdef")]


def test_base_spans_stay_and_decoded_ones_are_added():
    text = "token=abcdef%31%32 and secret=token: abcdef and passwd: abc"
    assert base(text)[0] == (0, 0, 12)
    assert set(base(text)) <= set(spans(text)) and (0, 0, 18) in spans(text)


def test_wrapped_lines():
    raw = b64(bytes(random.Random(5).randrange(32, 127) for _ in range(100)) + SECRET + b" " * 70)
    text = "-----BEGIN\r\n" + "\r\n".join(raw[i : i + 64] for i in range(0, len(raw), 64)) + "\r\n-----END"
    assert any(s[4].startswith("api_key") for s in secrets.scan_text(text)[0])


def test_cycles_and_bombs_end():
    bomb = b64(zlib.compress(b"\0" * 3_000_000))
    found, layers, unopened = secrets.scan_text(f"x {bomb} token=abcdef", secrets.ScanParams(most_bytes=1 << 20))
    assert unopened > 0 and [s[:3] for s in found] == base(f"x {bomb} token=abcdef")
    scan = secrets.Scan(secrets.ScanParams())
    layer = next(secrets._fragments("a" * 30))
    scan.children = lambda x: iter([secrets.Layer(x.data, x.lo, x.hi, x.path + ">same")])
    scan.run(layer)
    assert len(scan.seen) == 1
    deep = SECRET
    for _ in range(12):
        deep = base64.b64encode(deep)
    assert any(s[4].startswith("api_key") for s in secrets.scan_text(deep.decode())[0])


def test_random_texts_against_plain_search():
    r = random.Random(3)
    signs = ["token", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGHIJKLMNOP01", "abcdef0123456789abcdef99", "secret", "API_KEY", "ſecret", "toKen", "é", "\n", "ab", "passwd", "-", "_", "%", "\\u"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(14)))
        assert [s[:3] for s in secrets.scan_text(text)[0] if s[3] == "text"] == base(text)


def test_table(spark):
    rows = [(None, None, "x"), (1, "", "x"), (2, "token=abcdef", "y"), (2, "token=abcdef", "y"), (3, "z" * 200_000 + " " + WRAPS["gzip"], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = secrets.find(docs)
    assert found.columns == ["doc_id", "text", "spans", "n_layers", "n_unopened"]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_assign, r.spans) for r in secrets.digests(found).collect())
    end = 200_001 + len(WRAPS["gzip"])
    assert got[:3] == [(False, 1, 0, ""), (False, 2, 1, "assign:0:12"), (False, 2, 1, "assign:0:12")]
    assert got[3][3].startswith("assign:200001:") and int(got[3][3].split(":")[2]) <= end and got[4] == (True, 0, 0, "")
    assert secrets.digests(secrets.find(docs.where("false"))).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op11_secrets(spark, sf).collect():
        want = base(texts[r.doc_id] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for k, _, _ in want) for i in range(3))
        assert set(said.split(",")) <= set(r.spans.split(","))
