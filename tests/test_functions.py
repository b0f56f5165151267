"""Functions and operators on small fixtures with known answers."""

import datetime as dt
import hmac
import itertools
import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import crypto, dates, geometry, numeric, text
from ledgerline.operators import aggregates, joins, series
from ledgerline.sources import sinks, tables
from ledgerline.streaming import limits


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_digests(spark):
    ns = uuid.NAMESPACE_DNS
    df = spark.createDataFrame([("a",), ("é" * 100,), ("",)], "t string")
    for key in (b"k", b"long" * 30):
        for r in df.select("t", crypto.hmac_sha256(key, F.col("t")).alias("h"), crypto.uuid5(ns, F.col("t")).alias("u")).collect():
            assert r.h == hmac.new(key, r.t.encode(), "sha256").hexdigest()
            assert r.u == str(uuid.uuid5(ns, r.t))


def test_text(spark):
    df = spark.createDataFrame([("ﬁ １２",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(text.folded(F.col("t"))).collect()] == ["fi 12", "plain", None]
    values = ["=1", " +2", "x=1", "@a", "-", None]
    got = spark.createDataFrame([(v,) for v in values], "t string").select(text.csv_guard(F.col("t"))).collect()
    assert [r[0] for r in got] == ["'=1", "' +2", "x=1", "'@a", "'-", None]
    ranges = {"3.5--9.5": (3.5, 9.5, None), "1.20 ~ 2.40": (1.2, 2.4, None), "≤1.70": (None, 1.7, "<="), ">=2": (2.0, None, ">="), "n/a": (None, None, None)}
    for raw, want in ranges.items():
        assert tuple(one(spark, text.parse_reference(F.lit(raw)))[0]) == want
    kinds = {"1.5": "numeric", "<3": "numeric", "1-2": "range", "1:80": "ratio", "Positive": "qualitative", "see note": "text"}
    assert [one(spark, text.result_type(F.lit(k)))[0] for k in kinds] == list(kinds.values())
    assert one(spark, text.excerpt(F.lit("x" * 200 + "needle" + "y" * 200), "NEEDLE", 20))[0] == "…" + "x" * 7 + "needle" + "y" * 7 + "…"
    assert one(spark, text.redact_urls(F.lit('a "https://x.y/z?q" b')))[0] == 'a "[link]" b'
    assert one(spark, text.unit_key(F.lit("10⁹ /L")))[0] == "109/l"
    assert one(spark, text.sanitized_name(F.lit("../a b?.pdf")))[0] == "a_b_.pdf"


def test_dates(spark):
    d = dt.date
    cases = {"2020年2月29日": (d(2020, 2, 29), "DAY"), "2020/2": (d(2020, 2, 1), "MONTH"), "2020": (d(2020, 1, 1), "YEAR"), "2021-02-30": (None, "UNKNOWN"), "x": (None, "UNKNOWN")}
    for raw, want in cases.items():
        assert tuple(one(spark, dates.partial_date(F.lit(raw)))[0]) == want
    lit = lambda y, m, k: F.lit(d(y, m, k))
    assert one(spark, dates.completed_years(lit(2020, 2, 29), lit(2023, 2, 28)))[0] == 2
    assert one(spark, dates.completed_years(lit(2020, 2, 29), lit(2023, 3, 1)))[0] == 3
    state = lambda v, p: one(spark, dates.selection_state(v, F.lit(p), lit(2020, 2, 1), lit(2020, 12, 31)))[0]
    assert [state(lit(2020, 5, 5), p) for p in ("DAY", "MONTH", "YEAR", "UNKNOWN")] == ["included", "included", "uncertain", "uncertain"]
    assert state(lit(2019, 5, 5), "YEAR") == "excluded"


def test_numbers(spark):
    cases = {"1.50": "1.5", "+007": "7", "0.0": "0", "-0": "0", "10": "10", ".5": ".5"}
    assert [one(spark, numeric.canonical_number(F.lit(k)))[0] for k in cases] == list(cases.values())
    ok = {"1e-40": None, "9" * 40: None, "12.5": 12.5, "0" * 50 + "7": 7.0, "x": None, "": None}
    for raw, want in ok.items():
        got = one(spark, numeric.safe_decimal(F.lit(raw)))[0]
        assert (got if got is None else float(got)) == want
    labels = ["0", "1-5", "6-20", "21-100", "101-300", "301+"]
    got = [one(spark, numeric.bucket(F.lit(v), [0, 5, 20, 100, 300], labels))[0] for v in (0, 1, 5, 6, 20, 21, 100, 101, 300, 301)]
    assert got == ["0", "1-5", "1-5", "6-20", "6-20", "21-100", "21-100", "101-300", "101-300", "301+"]
    assert one(spark, numeric.hamming64(F.lit(0), F.lit(-1)))[0] == 64


def test_geometry(spark):
    p = lambda *xy: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))
    ell = p((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    assert one(spark, geometry.area(ell))[0] == 3
    inside = lambda x, y: one(spark, geometry.contains_point(ell, F.lit(x), F.lit(y)))[0]
    assert inside(0.5, 1.5) and not inside(1.5, 1.5)
    a, b = geometry.box(p((0, 0), (2, 2))), geometry.box(p((1, 1), (3, 3)))
    assert abs(one(spark, geometry.iou(a, b))[0] - 1 / 7) < 1e-12
    assert tuple(one(spark, geometry.union_box(a, b))[0]) == (0, 0, 3, 3)
    moved = one(spark, geometry.projected(ell, [1, 0, 5, 0, 1, 0, 0, 0, 1]))[0]
    assert [(r.x, r.y) for r in moved][:2] == [(5, 0), (7, 0)]


def test_assignment_is_the_best(spark):
    cost = [[4, 1, 3], [2, 0, 5], [3, 2, 2]]
    best = min(itertools.permutations(range(3)), key=lambda q: sum(cost[i][q[i]] for i in range(3)))
    assert joins.shortest_augmenting([[float(x) for x in r] for r in cost]) == list(best)


def test_lineage_and_hamming(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None), (20, 21), (21, 20)], "n int, p int")
    assert {(r.node, r.root, r.steps) for r in joins.lineage(edges, "n", "p").collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (9, 9, 0), (20, None, None), (21, None, None)}
    bits = spark.createDataFrame([(1, 0), (2, 255), (3, 511), (4, -1)], "k int, b long")
    assert {tuple(r) for r in joins.hamming_within(bits, bits, "b", "k", 8, 16).collect()} == {(1, 2, 8), (2, 3, 1)}


def test_ties_conflicts_and_scores(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 2, 7), ("b", 1, None), ("b", 1, 5)], "k string, o int, v int")
    assert sorted((r.k, r.v) for r in series.latest_with_ties(df.where("v IS NOT NULL"), ["k"], F.col("o").desc()).collect()) == [("a", 6), ("a", 7), ("b", 5)]
    assert {r.k: r.x for r in df.groupBy("k").agg(aggregates.exactly_one("v").alias("x")).collect()} == {"a": None, "b": None}
    none = spark.createDataFrame([("g", False, False)], "k string, t boolean, p boolean")
    r = aggregates.scores(none, ["k"], F.col("t"), F.col("p")).first()
    assert (r.precision, r.recall, r.f1) == (None, None, None)


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    (tmp_path / "in.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n\n')
    good, bad = tables.jsonl(spark, path, T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]
    df = spark.createDataFrame([(1, "=x", [1, 2], None)], "b int, a string, c array<int>, d string")
    sinks.write_jsonl(df, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first()[0]
    assert line == json.dumps({"a": "=x", "b": 1, "c": [1, 2], "d": None}, separators=(",", ":"))
    assert tuple(sinks.csv_view(df).first()) == ("1", "'=x", "[1,2]", "")
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, at int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, at int, v string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["k"], "at").collect()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")]
    metric = spark.createDataFrame([("m", {"b": 'x"', "a": "1"}, 2)], "name string, labels map<string,string>, value long")
    assert [r[0] for r in sinks.exposition(metric).collect()] == ["# TYPE m gauge", 'm{a="1",b="x\\""} 2']
    snap = tables.portable(spark.createDataFrame([(1,)], "id int"), {"items": "array<struct<a:int>>"})
    assert snap.first().items == []
    (tmp_path / "f").mkdir()
    for name, body in (("a", "1"), ("b", "1"), ("c", "2")):
        (tmp_path / "f" / name).write_text(body)
    assert sorted(r.copies for r in tables.discover(spark, str(tmp_path / "f")).collect()) == [1, 2]
    assert tables.synthetic(spark, 500, 1).collect() == tables.synthetic(spark, 500, 1).collect()


def test_resettable_limit_batch_and_stream_agree(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, t0 + dt.timedelta(seconds=100 * i), "purchase" if i == 13 else "click") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    batch = {r.event_id: r.allowed for r in limits.resettable_limit(df, limit=3).collect()}
    stream = limits.resettable_limit(limits.read_events(spark, str(tmp_path / "e")), limit=3)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == batch
    assert batch[13] and not all(batch.values())
    counted = limits.tumbling(limits.read_events(spark, str(tmp_path / "e")), ["user_id"], "10 minutes")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("counted").collect()) == 40
