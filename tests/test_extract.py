"""Extraction, policy and matching on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions import extract, policy
from ledgerline.operators import matching


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_canaries_maps_and_json(spark):
    df = spark.createDataFrame([("a", "x secret%20%C3%A9 y"), ("b", "none"), ("c", "secret é and secret+%C3%A9"), ("d", 'secret \\u00e9')], "artifact string, content string")
    assert sorted(map(tuple, policy.canary_hits(df, ["secret é"]).collect())) == [("a", "secret é", "url"), ("c", "secret é", "form"), ("c", "secret é", "plain"), ("d", "secret é", "json")]
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "x map<string,int>, y map<string,int>")
    assert maps.select(policy.merged_maps(F.col("x"), F.col("y"))).first()[0] == {"a": 1, "b": 3}
    items = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3)],)], "i array<struct<k:string,v:int>>")
    assert [tuple(x) for x in items.select(policy.last_by_key(F.col("i"), "k")).first()[0]] == [("b", 2), ("a", 3)]
    kinds = {"n": "int", "ok": "bool", "how": "a|b"}
    good, bad = '{"n":1,"ok":true,"how":"a"}', ['{"n":1,"ok":true}', '{"n":"x","ok":true,"how":"a"}', '{"n":1,"ok":true,"how":"c"}', "no", '{"n":1,"ok":true,"how":"a","z":1}']
    assert one(spark, policy.closed(F.lit(good), kinds)) and not any(one(spark, policy.closed(F.lit(b), kinds)) for b in bad)


def test_facts(spark):
    got = one(spark, extract.dimensions(F.lit("a nodule 1.2 x 0.8 cm and one of 7 mm; 3 x 4 x 5mm")))
    assert [[round(v, 6) for v in r.mm] for r in got] == [[12.0, 8.0], [7.0], [3.0, 4.0, 5.0]]
    assert [tuple(r) for r in one(spark, extract.uptake(F.lit("SUVmax 4.5, SUV<2.0, suv max: 3")))] == [("EQ", 4.5), ("LE", 2.0), ("EQ", 3.0)]
    got = one(spark, extract.clauses(F.lit("No mass seen. Possible mass in liver; prior mass. A mass is there. Clear."), "mass"))
    assert [r.assertion for r in got] == ["negated", "uncertain", "historical", "present"]
    df = spark.createDataFrame([("abcde", "cdefg"), ("ab", "cd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(extract.joined_overlap("a", "b")).collect()] == ["abcdefg", "abcd", "x"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["header", "Findings: big", "more", "", "Impression", "fine"])], "document_id int, line int, text string")
    assert sorted((r.section or "", r.text) for r in extract.sections(lines, {"findings": "Findings", "impression": "Impression"}).collect()) == [("", "header"), ("findings", "big\nmore"), ("impression", "fine")]
    cells = spark.createDataFrame([(1, 1, 0, 0.1, "name"), (1, 1, 0, 0.5, "value"), (1, 1, 1, 0.12, "HB"), (1, 1, 1, 0.52, "10"), (1, 1, 2, 0.1, "WBC")], "version_id int, page_number int, row int, x double, text string")
    assert [tuple(r)[2:] for r in extract.table_rows(cells, ["name", "value"]).orderBy("row").collect()] == [(1, "HB", "10"), (2, "WBC", None)]


def test_matching(spark):
    scores = spark.createDataFrame([("g", 1, 1, 0.9), ("g", 1, 2, 0.9), ("g", 2, 1, 0.8), ("g", 2, 2, 0.5), ("g", 3, 3, 0.1)], "g string, left int, right int, score double")
    assert sorted(tuple(r) for r in matching.greedy(scores, "g", 0.3).collect()) == [("g", 1, 1, True), ("g", 2, 2, False)]
    t = dt.datetime(2024, 1, 1)
    images = spark.createDataFrame([(1, "p", 0, t), (2, "p", 255, t), (3, "p", 1, t), (4, "p", 2, t + dt.timedelta(1)), (5, "q", 0, t), (6, "p", 511, t)], "id int, patient_id string, phash long, created_at timestamp_ntz")
    got = {r.id: (r.match_id, r.distance) for r in matching.nearest_image(images).collect()}
    assert got[1] == (4, 1) and got[6] == (2, 1) and 5 not in got
    spans = matching.spans_within(spark.createDataFrame([(1, 1, 2, 4, "cd"), (2, 1, 2, 4, "xx"), (3, 9, 0, 1, "a")], "fragment_id int, text_id int, start int, end int, quote string"), spark.createDataFrame([(1, "abcdef")], "text_id int, body string"))
    assert {r.fragment_id: r.found for r in spans.collect()} == {1: True, 2: False, 3: False}
    stages = spark.createDataFrame([("r", 1, 1), ("r", 2, 3), ("r", 3, 2), ("r", 4, 3)], "k string, o int, s int")
    assert sorted(r.o for r in matching.monotone(stages, "k", "o", "s").collect()) == [1, 2, 4]
    graves = spark.range(1).select(F.sha2(F.lit("doc:7"), 256).alias("target_hash"))
    assert [r.d for r in matching.tombstoned(spark.createDataFrame([(7,), (8,)], "d int"), graves, "d", "doc").collect()] == [8]
    trash = spark.createDataFrame([(1, t), (2, t + dt.timedelta(40))], "k int, at timestamp_ntz")
    assert [r.k for r in matching.expired(trash, "at", F.lit(t + dt.timedelta(45)), 30).collect()] == [1]
