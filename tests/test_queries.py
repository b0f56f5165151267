"""Every registered query against its SQL on the smallest tables, and the entry point."""

import glob
import os
from itertools import permutations

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else glob.escape(path) + '/*'}')")
    return c


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def by_customer(spark):
    groups = {}
    for r in spark.read.parquet(f"{SF}/orders.parquet").collect():
        groups.setdefault(r.o_custkey, []).append(r)
    return groups


def test_clusters_against_all_orders_of_joining(spark):
    want = set()
    for key, orders in by_customer(spark).items():
        clusters = []
        for r in sorted(orders, key=lambda r: r.o_orderkey):
            home = next((c for c in clusters if all(abs(r.o_totalprice - x.o_totalprice) < 100000 for x in c)), None)
            clusters.append([r]) if home is None else home.append(r)
        want |= {(key, r.o_orderkey, c[0].o_orderkey) for c in clusters for r in c}
    got = registry.QUERIES["cluster_complete_link"](spark, SF)
    assert {(r.o_custkey, r.node, r.cluster) for r in got.collect()} == want and len(want) == got.count()


def test_assignments_against_the_best_of_all(spark):
    got = {}
    for r in registry.QUERIES["assignment_matching"](spark, SF).collect():
        got.setdefault(r.o_custkey, []).append(r)
    n = 0
    for key, orders in by_customer(spark).items():
        left, right = ([r for r in orders if r.o_orderstatus == s] for s in "OF")
        found = got.get(key, [])
        assert len({r.left for r in found}) == len({r.right for r in found}) == len(found) == min(len(left), len(right))
        if 0 < len(left) and len(left) + len(right) <= 9 and right:
            few, many = sorted((left, right), key=len)
            score = lambda a, b: 1 / (1 + abs(a.o_totalprice - b.o_totalprice) / 1000)
            best = max(sum(score(a, b) for a, b in zip(few, p)) for p in permutations(many, len(few)))
            assert sum(r.score for r in found) == pytest.approx(best, abs=1e-6)
            n += 1
    assert n > 20


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
