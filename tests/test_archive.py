"""Searches and lookups on small fixtures with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import archive, joins


def test_asked_dates():
    cases = {"1995年3月": (1995, 3, None), "2020/2/29": (2020, 2, 29), " 1999. ": (1999, None, None), "2020-13": None, "1899": None, "2101-01": None, "20200": None, "abc": None, "": None, "2020年2月3日": (2020, 2, 3)}
    assert {q: archive.asked_date(q) for q in cases} == cases


@pytest.fixture(scope="module")
def shelf(spark):
    docs = spark.createDataFrame([(1, "Scan A.pdf", "X", dt.date(2020, 2, 3)), (2, None, None, None), (3, "note", "Y", dt.date(2021, 1, 1)), (3, "note", "Y", dt.date(2021, 1, 1)), (None, "scan", "X", None)], "id int, file string, kind string, day date")
    pages = spark.createDataFrame([(1, "zzz  needle\nzzz"), (1, "a Needle first"), (2, None), (9, "needle of no document"), (3, "n" * 300 + " wide " + "n" * 300)], "id int, text string")
    # 1: the last correction takes the word away, 2: the last correction brings it, 3: its sequence is missing
    fixes = spark.createDataFrame([(1, "e", 1, "mended"), (1, "e", 2, "other"), (2, "e", 1, "other"), (2, "e", 2, "Mended now"), (2, "e", 2, "Mended now"), (3, "f", None, "late mended"), (3, None, 1, None)], "id int, entity string, sequence int, text string")
    return docs, pages, fixes


def found(shelf, query):
    docs, pages, fixes = shelf
    met = {"kind": archive.named_by(F.col("kind"), {"X": "Xray", "U": "Unknown"}, query, missing="U"), "day": F.when(archive.on_date(F.col("day"), query), F.col("day").cast("string"))}
    return {r.id: (r.found_in, r.excerpt, r.corrected) for r in archive.search(docs, "id", query, {"file": F.col("file")}, met, {"page": pages}, fixes).collect()}


def test_search_finds_in_every_source_once(shelf):
    assert found(shelf, "scan") == {1: ("file", "Scan A.pdf", False)}
    assert found(shelf, "needle") == {1: ("page", "a Needle first", False)}
    assert found(shelf, "zzz needle") == {1: ("page", "zzz needle zzz", False)}
    assert found(shelf, "XRAY") == {1: ("kind", "Xray", False)}
    assert found(shelf, "unknown") == {2: ("kind", "Unknown", False)}
    assert found(shelf, "2020年2月") == {1: ("day", "2020-02-03", False)}
    assert found(shelf, "note") == {3: ("file", "note", False)}
    assert found(shelf, "mended") == {2: ("correction", "Mended now", True), 3: ("correction", "late mended", True)}
    assert found(shelf, "%") == found(shelf, "") == found(shelf, "no such") == {}
    wide = found(shelf, "wide")[3][1]
    assert wide.startswith("…") and wide.endswith("…") and "wide" in wide and len(wide) == 142


def test_search_in_empty_tables(shelf):
    docs, pages, fixes = shelf
    assert archive.search(docs.limit(0), "id", "a", {"file": F.col("file")}, {}, {"page": pages.limit(0)}, fixes.limit(0)).count() == 0
    assert archive.search(docs, "id", "zz", {}, {}, {"page": pages}).count() == 1


def test_dictionary_lookup(spark):
    entries = [("Glu", "B1", "BLOOD", "生化"), ("glu", "U1", "URINE", "尿常规"), ("glu*", "U1", "URINE", "尿常规"), ("wbc", "B2", "BLOOD", "血常规"), ("wbc", "B3", "BLOOD", "炎症三项"), ("wbc", "U2", "URINE", "尿常规"), ("one", "B9", "BLOOD", "x"), ("non", None, "BLOOD", "x"), (None, "B0", None, None)]
    cases = [("GLU", "尿", None, "U1"), ("glu", "血清", None, "B1"), ("glu", "UNKNOWN", None, None), ("glu", "", "尿常规", "U1"), ("glu", None, "URINALYSIS", "U1"), ("glu", None, "粪便常规", None), ("wbc", "BLOOD", "CBC", "B2"), ("w b c", "血液", "INFLAMMATION", "B3"), ("wbc", "BLOOD", None, None), ("wbc", "BLOOD", "生化", None), ("one", None, "尿常规", "B9"), ("one", "URINE", None, None), ("non", None, None, None), ("nobody", None, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, name string, specimen string, panel string, want string")
    got = joins.dictionary_lookup(df, spark.createDataFrame(entries, "alias string, code string, specimen string, category string"), F.col("name"), F.col("specimen"), F.col("panel")).collect()
    assert len(got) == len(cases) and [r for r in got if r.code != r.want] == []


def test_patient_ranges_against_a_plain_loop(spark):
    sexes, ages, phases, codes = ("M", "F", None), (None, 0, 17, 18, 40, 41, 90), ("L", "O", None), ("a", "b", "c", "none", None)
    rules = [("a", "M", None, None, None, 1.0, 2.0), ("a", "F", 18, 40, None, 3.0, 4.0), ("a", "F", None, None, "L", 5.0, 6.0), ("b", None, None, 17, None, 7.0, 8.0), ("b", None, 18, None, None, 9.0, 10.0), ("b", "M", 40, 50, None, 11.0, 12.0), ("c", None, None, None, None, 1.0, 2.0), ("c", None, None, None, None, 1.0, 2.0), (None, None, None, None, None, 0.0, 0.0)]

    def plain(code, sex, age, phase):
        held = []
        for c, s, low_age, high_age, p, low, high in rules:
            in_band = (low_age is None and high_age is None) or (age is not None and (low_age or 0) <= age <= (high_age or 10**6))
            if c is not None and c == code and ((sex == "F" and phase == p) if p else (s in (None, sex) and in_band)):
                held.append((low, high))
        return held[0] if len(held) == 1 else (None, None)

    cases = [(c, s, a, p) for c in codes for s in sexes for a in ages for p in phases]
    df = spark.createDataFrame(cases, "code string, sex string, age int, phase string")
    got = joins.patient_range(df, spark.createDataFrame(rules, "code string, sex string, from_age int, to_age int, phase string, low double, high double"), "code", F.col("sex"), F.col("age"), F.col("phase")).collect()
    assert len(got) == len(cases)
    assert all((r.low, r.high) == plain(r.code, r.sex, r.age, r.phase) for r in got)
    assert sum(r.low is not None for r in got) > 40
