"""Surrogates: nothing real stays, coreference and distinctness hold, formats stay."""

import re

import regex
from pyspark.sql import functions as F

from ledgerline.llm import pii


def luhn(s):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


TEXTS = [
    "write to Ann.Lee@Example.org or ANN.LEE@EXAMPLE.ORG, not bob@example.org.",
    "card 4111111111111111 and 4111 1111 1111 1111, order 4111111111111112",
    "call +1 (212) 555-0187 or 212-555-0187; ip 10.20.30.40, version 1.2.3 and 999.1.1.1",
    "IBAN DE89 3704 0044 0532 0130 00. SSN 078-05-1120",
    "Mrs Anna Novak met Mr Peter Stone and Frau Müller; Госпожа Иванова, Κύριος Παπας.",
    "nothing here, 42 things",
    None,
    "",
    "ann.lee@example.org " * 3000,
]


def test_surrogates(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "1 AS n_entities", "2 AS found", "3 AS kind")
    got = {r.doc_id: r for r in pii.replace(df, "k").collect()}
    a = got[0].text
    one, two, three = re.findall(r"\S+@[\w.]+\w", a)
    assert one == two.lower() and one != three and two.isupper() and one.endswith(".org") and len(one) == len("ann.lee@example.org")
    assert got[8].text.split() == [one] * 3000
    assert got[0].kinds == ["email"] and got[0].n_entities == 3
    cards = re.findall(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), order 4111111111111112", got[1].text)[0]
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111" and luhn(cards[0]) and cards[0][0] == "4"
    full, short = re.search(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4});", got[2].text).groups()
    assert re.sub(r"\D", "", full)[1:] == re.sub(r"\D", "", short) != "2125550187"
    assert "10.20.30.40" not in got[2].text and "version 1.2.3 and 999.1.1.1" in got[2].text
    iban = re.search(r"IBAN (DE\d\d(?: \d{4}){4} \d\d)\.", got[3].text)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "078-05-1120" not in got[3].text and re.search(r"SSN \d{3}-\d\d-\d{4}$", got[3].text)
    m = re.fullmatch(r"Mrs (\w+) \w+ met Mr (\w+) \w+ and Frau \w+; Госпожа ([А-Яа-я]+), Κύριος ([\u0370-\u03ff]+)\.", got[4].text)
    assert m and m[1] in pii.GIVEN["latin"]["f"].split() and m[2] in pii.GIVEN["latin"]["m"].split() and "Novak" not in got[4].text
    assert [got[i].text for i in (5, 6, 7)] == TEXTS[5:8]
    assert [got[i].n_entities for i in (5, 6, 7)] == [0, 0, 0]
    assert {r.doc_id: r.text for r in pii.replace(df, "k").collect()} == {k: r.text for k, r in got.items()}
    assert pii.replace(df, "other").where("doc_id = 0").first().text != a


PEOPLE = [
    "Mr JOHN SMITH and Mr John Smith",
    "Frau Maria Weber, Dr Maria Weber, Mrs Weber, Dr. MARIA WEBER",
    "Dr Kim Lee, Mr Jan Lee, Mrs Pia Lee",
    "call +49 30 1234567 or +49 (0)30 7654321, +49.30.1234567, +44 791 112 3456, +1 791 112 3456, 791-112-3456 or +33 1 23 45 67 89",
    "not a number: +1 23 45, 1 234 567",
    "Κύριος Παπας Ηλιου, Κυρία Μαρια Ηλιου, Herr Álvaro Müller",
]


def test_people_and_numbers(spark):
    df = spark.createDataFrame(list(enumerate(PEOPLE)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(df, "k").collect()}
    loud, quiet = re.fullmatch(r"Mr (.+) and Mr (.+)", got[0]).groups()
    assert loud == quiet.upper() != quiet and quiet.split()[0] in pii.GIVEN["latin"]["m"].split()
    frau, doctor, mrs, loud = re.fullmatch(r"Frau (.+), Dr (.+), Mrs (.+), Dr\. (.+)", got[1]).groups()
    assert frau == doctor and frau.split()[0] in pii.GIVEN["latin"]["f"].split() and mrs == frau.split()[1] and loud == frau.upper()
    three = re.fullmatch(r"Dr (.+) (.+), Mr (.+) (.+), Mrs (.+) (.+)", got[2]).groups()
    assert len(set(three[1::2])) == 1 and len(set(three[::2])) == 3 and "Lee" not in got[2]
    a, b, c, d, e, f, g = re.fullmatch(r"call (\+49 \d\d \d{7}) or (\+49 \(\d\)\d\d \d{7}), (\+49\.\d\d\.\d{7}), (\+44 \d{3} \d{3} \d{4}), (\+1 \d{3} \d{3} \d{4}), (\d{3}-\d{3}-\d{4}) or (\+33 \d \d\d \d\d \d\d \d\d)", got[3]).groups()
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(a) == digits(c) and digits(d)[2:] != digits(e)[1:] and digits(e)[1:] == digits(f)
    assert not {"1234567", "7654321", "7911123456", "23456789"} & {digits(x)[-k:] for x in (a, b, d, e, f, g) for k in (7, 8, 10)}
    assert got[4] == PEOPLE[4]
    man, woman = re.match(r"Κύριος (\S+ \S+), Κυρία (\S+ \S+), Herr \S+ \S+$", got[5]).groups()
    assert man.endswith("ς") and woman.split()[1] + "ς" == man.split()[1] and not re.search("Müller|Álvaro|Ηλιου", got[5])


def plain_entities(found):
    """[(kind, canonical form)] of a mention, written from the docstring."""
    digits = re.sub(r"\D", "", found)
    if "@" in found:
        return [("email", found.lower())]
    for sex, titles in pii.TITLES.items():
        if m := re.match(rf"(?:{titles})\.? ", found):
            words = found[m.end() :].lower().split(" ")
            return [("name", words[-1])] + ([("person", (" ".join(words), sex))] if len(words) > 1 else [])
    if re.match(r"[A-Z]{2}\d", found):
        return [("iban", found.replace(" ", ""))]
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", found):
        return [("ipv4", found)]
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", found):
        return [("ssn", digits)]
    if found[0].isdigit() and len(digits) > 12:
        return [("card", digits)] if luhn(digits) else []
    return [("phone", "1" + digits if len(digits) == 10 and found[0] != "+" else digits)]


def test_whole_table_against_plain_search(spark):
    """Every mention that a plain search finds in the documents is replaced, nothing else is, and the mapping is one to one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    after = {r.doc_id: r for r in pii.replace(docs, "k").collect()}
    to, sexes = {}, {}
    pairs = []
    for r in docs.collect():
        new, at, text = after[r.doc_id].text, 0, r.text
        found = list(regex.finditer(pii.PATTERN.replace("IsGreek", "Greek"), text)) if text else []
        known = [m for m in found if plain_entities(m[0])]
        assert after[r.doc_id].n_entities == len(known)
        if not known:
            assert new == text
            continue
        gaps = [text[a:b] for a, b in zip([0, *(m.end() for m in known)], [*(m.start() for m in known), len(text)])]
        got = re.fullmatch("(?s)" + "(.+?)".join(map(re.escape, gaps)), new)
        assert got, (text, new)
        pairs += [(m[0], x) for m, x in zip(known, got.groups())]
    for old, _ in pairs:
        for kind, canon in plain_entities(old):
            if kind == "person":
                sexes.setdefault(canon[0], set()).add(canon[1])
    for old, new in pairs:
        for (kind, canon), (_, other) in zip(plain_entities(old), plain_entities(new), strict=True):
            if kind == "person":
                canon = (canon[0], canon[1] if canon[1] != "n" else min(sexes[canon[0]] - {"n"} or {"n"}))
                other = other[0]
            assert to.setdefault((kind, canon), other) == other != canon
            assert re.sub(r"\w", "x", old) == re.sub(r"\w", "x", new) or kind in ("ipv4", "name", "person", "email")
    for kind in {k for k, _ in to}:
        own = {c: x for (k, c), x in to.items() if k == kind}
        assert len(set(own.values())) == len(own)
        assert not set(own.values()) & {c[0] if kind == "person" else c for c in own}
    assert len(pairs) > 50


def test_collisions_move_on(spark):
    """With a surrogate space of a few values, all are distinct and none is real."""

    def narrow(kind, canon, h, recoded, attempt):
        return F.concat((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 60).cast("string"), F.lit("@x.org"))

    people = [f"{i}@x.org" for i in range(20)]
    df = spark.createDataFrame([(i, f"to {p} and {people[0]}") for i, p in enumerate(people)], "doc_id long, text string")
    got = pii.replace(df, "k", make=narrow).collect()
    new = {r.doc_id: r.text.split()[1] for r in got}
    assert len(set(new.values())) == 20 and not set(new.values()) & set(people)
    assert all(r.text.split()[3] == new[0] for r in got)


def test_empty_table(spark):
    assert pii.replace(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []
