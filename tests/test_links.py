"""Links in texts against the standard library's parsers."""

import hashlib
import ipaddress
import random
import re

import pytest

from ledgerline.functions import links


def sites(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [(r.state, r.site) for r in sorted(links.with_site(df, "u").collect())]


def test_every_state(spark):
    cases = {
        "https://a.example.org/x?q=1": ("ok", "a.example.org"),
        "HTTP://A.Example.ORG:80/": ("ok", "a.example.org"),
        "http://a.example.org:443/": ("ok", "a.example.org:443"),
        "https://a.example.org.:08443/": ("ok", "a.example.org:8443"),
        "https://a.example.org#@x": ("ok", "a.example.org"),
        "https://bücher.example.org": ("ok", "xn--bcher-kva.example.org"),
        "https://straße.example.org": ("ok", "xn--strae-oqa.example.org"),
        "https://８.8.8.8/": ("host", None),
        "https://8.8.8.8:8443": ("ok", "8.8.8.8:8443"),
        "https://[2001:4860:0:0::8888]/": ("ok", "[2001:4860::8888]"),
        "https://[::ffff:8.8.8.8]:1/": ("ok", "[::ffff:8.8.8.8]:1"),
        "https://[::ffff:10.0.0.1]/": ("private", None),
        "https://[fe80::1]/": ("private", None),
        "https://[1::2::3]/": ("host", None),
        "https://[fe80::1%25eth0]/": ("host", None),
        "https://10.1.2.3/": ("private", None),
        "https://100.64.0.1": ("private", None),
        "https://0x7f.1/": ("host", None),
        "https://2130706433/": ("host", None),
        "https://010.1.2.3/": ("host", None),
        "https://256.1.2.3/": ("host", None),
        "https://localhost/": ("host", None),
        "https://x.local/": ("host", None),
        "https://-a.example.org/": ("host", None),
        "https://a_b.example.org/": ("host", None),
        "https://ab--c.example.org/": ("host", None),
        "https://" + "a" * 64 + ".org/": ("host", None),
        "https://" + "a" * 63 + ".org/": ("ok", "a" * 63 + ".org"),
        "https://☃☃.☃/": ("host", None),
        "ftp://a.example.org": ("scheme", None),
        "mailto:a@example.org": ("scheme", None),
        "https://u:p@a.example.org": ("credentials", None),
        "https://@a.example.org": ("credentials", None),
        "https://a.example.org:/": ("unreadable", None),
        "https://a.example.org:1:2/": ("unreadable", None),
        "https://a.example.org:0/": ("port", None),
        "https://a.example.org:65536/": ("port", None),
        "https://a.example.org:99999999999/": ("port", None),
        "https:///x": ("unreadable", None),
        "https://a.example.org/%zz": ("unreadable", None),
        "https://a.example.org/%": ("unreadable", None),
        "https://a.example.org/%41": ("ok", "a.example.org"),
        "https://a.example.org\\@b": ("unreadable", None),
        "https://a.example.org/​": ("unreadable", None),
        "https://a.example.org/ x": ("unreadable", None),
        "https://a.example.org/" + "x" * 8200: ("unreadable", None),
        "not a link": ("unreadable", None),
        "": ("unreadable", None),
        None: ("unreadable", None),
    }
    assert dict(zip(cases, sites(spark, list(cases)), strict=True)) == cases


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(7)
    nets = [ipaddress.ip_network(n) for n in links.CLOSED_4 + links.OPEN_4 + links.CLOSED_6 + links.OPEN_6 + ["::ffff:0:0/96", "::/0", "0.0.0.0/0", "2000::/3"]]
    found = {n[0] + d for n in nets for d in (0, -1) if int(n[0]) + d >= 0} | {n[-1] + d for n in nets for d in (0, 1) if int(n[-1]) + d < 2**n.max_prefixlen}
    found |= {ipaddress.ip_address(rng.choice(nets)[0]) + rng.randrange(2**20) for _ in range(100)}
    found |= {ipaddress.IPv6Address(int("".join(rng.choice(["0000", "0000", "00a1", "f000"]) for _ in range(8)), 16)) for _ in range(300)}
    found = sorted(found, key=lambda a: (a.version, int(a)))
    spelt = [(a, s) for a in found for s in ({str(a), a.exploded} if a.version == 6 else {str(a)})]
    got = sites(spark, [f"http://[{s}]/" if a.version == 6 else f"http://{s}/" for a, s in spelt])
    for (a, _), (state, site) in zip(spelt, got, strict=True):
        assert state == ("ok" if a.is_global else "private"), a
        assert site is None or site == (f"[{a.compressed}]" if a.version == 6 else str(a)), a
    broken = ["::1::", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "g::", ":1:2:3:4:5:6:7", "::1.2.3", "::1.2.3.256", "1.2.3.4", "", "1:2:3:4:5:6:7:1.2.3.4", "::1:"]
    for b, (state, _) in zip(broken, sites(spark, [f"http://[{b}]/" for b in broken]), strict=True):
        try:
            ok = ipaddress.IPv6Address(b).is_global
        except ValueError:
            ok = None
        assert (state == "ok") == bool(ok) and (state == "private") == (ok is False), b


def test_names_against_a_plain_encoder(spark):
    idna = pytest.importorskip("idna")
    names = ["bücher.example", "BÜCHER.example", "faß.de", "例え.テスト", "пример.рф", "σίγμας.gr", "ΣΊΓΜΑ.gr", "a。b.org", "ｆｕｌｌ.org", "münchen.xn--p1ai", "café.fr", "café.fr", "☃.net"]
    for n, (state, site) in zip(names, sites(spark, [f"https://{n}/" for n in names]), strict=True):
        try:
            want = idna.encode(n, uts46=True, std3_rules=True, transitional=False).decode()
        except idna.IDNAError:
            want = None
        assert (site if state == "ok" else None) == want, n


def plain_payloads(text):
    for m in re.finditer(r"https?://[^\s<>\"'。，；！？、]+", text or "", re.I):
        s, e = m.span()
        p = m.group()
        if p[-1] == ")" and text[s - 1 : s] == "(" and p.count(")") == p.count("(") + 1:
            e, p = e - 1, p[:-1]
        rest = text[e:]
        broken = bool(re.match(r"[\r\n]", rest)) and (p[-1] in "=/?&%-" or bool(re.match(r"[\r\n]+[/?&=%]", rest)))
        yield p, s, e, broken


def test_offsets_against_a_plain_search(spark):
    rng = random.Random(3)
    bits = ["https://a.example.org", "HTTP://b.example.net/x", "(", ")", "/", "?q=", "é", "🙂", " ", "\n", "\r\n", " ", "。", "<", '"', "word", "-", "http://", "h"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "https://a.example.org/" + "y" * 20000 + " https://b.example.net/x"]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, t string, start_of string")
    got = {}
    for r in links.payloads(df, "t").collect():
        got.setdefault(r.i, []).append(r)
        assert r.start_of == "kept" and (r.kind == "URL") == (r.reason == "") == (r.site is not None)
    for i, t in enumerate(texts):
        want = list(plain_payloads(t))
        rows = sorted(got.pop(i, []), key=lambda r: (r.start is not None, r.start or 0))
        assert [(r.digest, r.length) for r in rows] == [(hashlib.sha256(p.encode()).hexdigest(), len(p)) for p, *_ in want]
        for r, (p, s, e, broken) in zip(rows, want, strict=True):
            assert (r.payload, r.start, r.end) == ((p, s, e) if len(p) <= 16384 else (None, None, None))
            assert (r.reason == "ambiguous_line_break") == broken and (r.reason == "payload_too_long") == (len(p) > 16384 and not broken)
