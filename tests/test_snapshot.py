"""Export snapshots against a plain fixpoint, and micro-batch polling over stops and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import snapshot
from ledgerline.operators.snapshot import Reference
from ledgerline.streaming import polling

KEYS = {"person": ["id"], "note": ["person", "n"], "tag": ["name"], "place": ["id"]}
REFS = [Reference("note", ("person",), "person", owned=True), Reference("note", ("tag",), "tag"), Reference("tag", ("parent",), "tag"), Reference("person", ("home",), "place"), Reference("place", ("within",), "place"), Reference("note", ("about", "about_n"), "note")]
SCHEMAS = {"person": "id long, home long", "note": "person long, n long, tag string, about long, about_n long", "tag": "name string, parent string", "place": "id long, within long"}


def plain(data, seeds):
    names = {t: [c.split()[0] for c in SCHEMAS[t].split(", ")] for t in SCHEMAS}
    rows = {t: [dict(zip(names[t], r)) for r in data[t]] for t in data}
    key = lambda t, r: tuple(r[k] for k in KEYS[t])
    have, todo, lost = {t: set() for t in data}, [(t, k) for t, ks in seeds.items() for k in ks], {}
    while todo:
        t, k = todo.pop()
        if k in have[t] or k in lost.setdefault(t, set()):
            continue
        own = [r for r in rows[t] if key(t, r) == k]
        if not own:
            lost[t].add(k)
            continue
        have[t].add(k)
        for ref in REFS:
            if ref.child == t:
                todo += [(ref.parent, tuple(r[c] for c in ref.columns)) for r in own if all(r[c] is not None for c in ref.columns)]
            if ref.owned and ref.parent == t:
                todo += [(ref.child, key(ref.child, r)) for r in rows[ref.child] if tuple(r[c] for c in ref.columns) == k and None not in k]
    return {t: sorted((tuple(r.values()) for r in rows[t] if key(t, r) in have[t]), key=repr) for t in data}, {t: len(x) for t, x in lost.items() if x}


def frames(spark, data):
    return {t: spark.createDataFrame(rows, SCHEMAS[t]).repartition(3) for t, rows in data.items()}


def test_closed_set_and_nothing_else(spark, tmp_path):
    r = random.Random(2)
    maybe = lambda x: None if r.random() < 0.3 else x
    data = {
        "place": [(i, maybe(r.randrange(22))) for i in range(20)],  # rings and places that aren't there
        "tag": [(f"t{i}", maybe(f"t{r.randrange(16)}")) for i in range(15)],
        "person": [(i, maybe(r.randrange(20))) for i in range(30)] + [(3, 5), (None, 1)],
        "note": [(maybe(r.randrange(30)), maybe(r.randrange(4)), f"t{r.randrange(15)}", maybe(r.randrange(30)), r.randrange(4)) for _ in range(60)],
    }
    tables = frames(spark, data)
    for seeds in ({"person": [(3,), (99,)]}, {"note": [(None, None)], "place": [(1,)]}, {"person": []}):
        found = snapshot.closure(tables, KEYS, REFS, {t: spark.createDataFrame(ks, ", ".join(f"{k} long" for k in KEYS[t])) for t, ks in seeds.items()})
        rows, lost = plain(data, seeds)
        assert {t: sorted((tuple(x) for x in df.collect()), key=repr) for t, df in found.tables.items()} == rows
        assert {x.table: x.n_missing for x in found.missing.collect() if x.n_missing} == lost
        written = {x.table: (x.n_rows, x.digest) for x in snapshot.write(found, f"file://{tmp_path}/{len(seeds)}{len(rows['person'])}").collect()}
        assert {t: n for t, (n, _) in written.items()} == {t: len(x) for t, x in rows.items()}
        again = {x.table: (x.n_rows, x.digest) for x in snapshot.manifest({t: df.repartition(5) for t, df in found.tables.items()}).collect()}
        assert again == written


def test_digest_sees_repeats_and_changes(spark):
    digest = lambda rows: snapshot.manifest({"t": spark.createDataFrame(rows, "a long, b string")}).first().digest
    assert digest([(1, "x"), (2, None)]) == digest([(2, None), (1, "x")])
    assert len({digest(x) for x in ([(1, "x")], [(1, "x")] * 2, [(1, "x")] * 3, [(1, "y")], [(1, None)], [])}) == 6


def test_version_cut(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 3, "d"), (3, 2, "e"), (3, 2, "f"), (4, None, "g")], "id long, v long, x string")
    assert sorted(tuple(r) for r in snapshot.as_of(rows, ["id"], "v", 2).collect()) == [(1, 2, "b"), (3, 2, "f")]


ROWS = [[(k % 7, 10 * f + k % 3, f"{f}/{k}") for k in range(20)] for f in range(5)]


def files(spark, folder, batches):
    for i in batches:
        spark.createDataFrame(ROWS[i], "key long, at long, x string").coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema("key long, at long, x string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_stops_and_restarts_give_the_rows_of_one_run(spark, tmp_path, monkeypatch):
    folder, sink, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    args = (sink, state, ["key"], ["at"])
    files(spark, folder, [0, 1])
    polling.poll(stream(spark, folder), *args).awaitTermination(60)
    files(spark, folder, [2, 3])
    # a failure after a batch was written and before it was committed
    whole, calls = polling.latest_rows, []

    def breaks(rows, keys, order):
        calls.append(1)
        if len(calls) == 2:
            whole(rows, keys, order).write.parquet(f"{sink}/batch=3")
            raise RuntimeError("stopped")
        return whole(rows, keys, order)

    monkeypatch.setattr(polling, "latest_rows", breaks)
    with pytest.raises(Exception, match="stopped"):
        polling.poll(stream(spark, folder), *args).awaitTermination(60)
    monkeypatch.setattr(polling, "latest_rows", whole)
    files(spark, folder, [4])
    for _ in range(2):  # the second finds nothing new
        polling.poll(stream(spark, folder), *args).awaitTermination(60)
    got = sorted(tuple(r) for r in polling.current(spark, sink, "key long, at long, x string", ["key"], ["at"]).collect())
    want = {}
    for row in (r for f in ROWS for r in f):
        want[row[0]] = max(want.get(row[0], row), row, key=lambda r: (r[1], r[2]))
    assert got == sorted(want.values())
    assert spark.read.option("basePath", sink).parquet(f"{sink}/batch=*").select("batch").distinct().count() == 5
    with pytest.raises(ValueError):
        polling.poll(stream(spark, folder).withColumn("batch", F.lit(1)), *args)


def test_polling_at_intervals(spark, tmp_path):
    folder, sink, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    files(spark, folder, [0])
    running = polling.poll(stream(spark, folder), sink, state, ["key"], ["at"], seconds=1)
    try:
        running.processAllAvailable()
        files(spark, folder, [1])
        running.processAllAvailable()
        assert polling.current(spark, sink, "key long, at long, x string", ["key"], ["at"]).agg(F.min("at")).first()[0] >= 10
    finally:
        running.stop()
