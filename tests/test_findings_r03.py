"""What the third round's findings were about, on tables that hold the case."""

import datetime as dt

import duckdb
import pytest

from ledgerline.plans import registry


def against_sql(spark, folder, name, **tables):
    """Rows of a query over ``tables`` (DataFrames by name) and of its SQL, both sorted."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = c.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, str(folder)).select(*[f"`{x}`" for x in want.columns]).collect()
    return sorted(map(repr, (tuple(r) for r in got))), sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["observation_issues", "comparable_cells", "comparison_matrix", "lab_output", "report_groups"])
def test_ratios_at_the_bound_are_those_of_doubles(spark, tmp_path, name):
    # 0.3 / 0.1 is below 3 in doubles, 3 in decimals; 0.6 / 0.2 as well, 0.9 / 0.3 is 3.0000000000000004
    rows = [(3 * u + k, dt.datetime(2024, 1, 1 + k, 10), u, "click", v, '{"k": 13}') for u, pair in enumerate([(0.1, 0.3), (0.2, 0.6), (0.3, 0.9), (1.0, 3.0), (30.0, 10.0)]) for k, v in enumerate(pair)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got, want = against_sql(spark, tmp_path, name, events=events)
    assert got == want and len(want) > 0


def test_workspace_is_found_once(spark, tmp_path, monkeypatch):
    from ledgerline.operators import workspace

    calls, own = [], workspace.complete_link
    monkeypatch.setattr(workspace, "complete_link", lambda *xs: calls.append(1) or own(*xs))
    assert registry.QUERIES["report_workspace"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(calls) == 1


@pytest.mark.parametrize("whole", [1 << 18, 4])
def test_clusters_of_small_groups_cost_no_frame_each(spark, monkeypatch, whole):
    from ledgerline.operators import joins

    monkeypatch.setattr(joins, "WHOLE_GROUP", whole)
    # group 1 is over the small bound: a triangle, a chain behind it and a part of its own; group 2 isn't
    nodes = spark.createDataFrame([(1, k) for k in range(9)] + [(2, 1), (2, 2), (None, 3), (2, None)], "g long, node long")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (1, 4, 3), (1, 6, 7), (1, 6, 7), (1, 8, 99), (2, 2, 1), (None, 3, 4)], "g long, left long, right long")
    found = joins.complete_link(pairs, nodes, "g")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 3), (1, 4, 3), (1, 5, 5), (1, 6, 6), (1, 7, 6), (1, 8, 8), (2, 1, 1), (2, 2, 1)]


def test_matchings_of_small_groups_cost_no_frame_each(spark):
    from ledgerline.operators import joins

    # more rows than a batch holds, so that groups go on over a batch's end
    scores = spark.range(21_000).selectExpr("id div 3 AS g", "id % 3 div 2 AS left", "id % 3 % 2 AS right", "double(id % 3 + 1) AS score")
    found = joins.assigned(scores, "g")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    # scores 1 and 2 of left 0 for right 0 and 1, score 3 of left 1 for right 0
    assert found.groupBy("left", "right", "score").count().orderBy("left").collect() == [(0, 1, 2.0, 7000), (1, 0, 3.0, 7000)]


def test_lookup_holds_no_list_of_entries(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import joins

    entries = spark.createDataFrame([("k", "a", "BLOOD", "血常规"), ("k", "b", "URINE", "生化"), ("k", "b", "URINE", "生化"), ("k", "c", "BLOOD", None), ("k", "d", None, "炎症三项"), ("k", None, "STOOL", "生化")], "alias string, code string, specimen string, category string")
    asked = [("K*", None, None), ("k", "尿", None), ("k", "BLOOD", "CBC"), ("k", "BLOOD", "STOOL"), ("k", "", "尿常规"), ("k", None, "INFLAMMATION"), ("k", "STOOL", "CBC"), ("x", None, None), (None, None, None), ("k", "BLOOD", None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "id int, name string, specimen string, panel string")
    found = joins.dictionary_lookup(df, entries, F.col("name"), F.col("specimen"), F.col("panel"))
    assert "collect_set" not in found._jdf.queryExecution().toString()
    assert [r.code for r in found.orderBy("id").collect()] == [None, "b", "a", None, "b", "d", None, None, None, None]


def test_theta_join_meets_in_price_steps(spark, tmp_path):
    parts = spark.createDataFrame([(k, "B", 1, "T" + str(k % 3), p) for k, p in enumerate([0.0, 4.999, 5.0, 9.999, 10.0, -0.5, 14.9, None, 1e300, 1e300, -4.9])], "p_partkey long, p_brand string, p_size int, p_type string, p_retailprice double")
    got, want = against_sql(spark, tmp_path, "theta_pairs_blocked", part=parts)
    assert got == want and len(want) > 5
    plan = registry.QUERIES["theta_pairs_blocked"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "step" in plan.split("Physical Plan")[1]


def test_dates_and_times_are_found_without_distinct_lists(spark, tmp_path):
    day = lambda m: dt.datetime(2024, m, 3)
    rows = [(1, 1, "N", day(1)), (1, 3, "N", day(1)), (1, 5, "R", day(2)), (1, 2, "A", None), (2, 1, "N", day(1)), (2, 3, "N", day(2)), (3, 1, "R", None), (3, 3, "R", day(4)), (4, 1, None, day(5)), (4, 2, "R", day(5)), (4, 3, "N", None)]
    lines = spark.createDataFrame([(*r, 7) for r in rows], "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz, l_partkey long")
    for name, word in (("page_dates", "Window"), ("donated_times", "distinct date_trunc")):
        (tmp_path / name).mkdir()
        got, want = against_sql(spark, tmp_path / name, name, lineitem=lines)
        assert got == want and len(want) > 3
        assert word not in registry.QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().toString()


def test_pages_cost_no_function_call_of_their_own(spark):
    from ledgerline.operators import findings

    # 3,000 pages of four lines, out of order: pages go on over a batch's end
    lines = spark.range(12_000).selectExpr("concat('p', id % 3000) AS page", "3 - id div 3000 AS line", "element_at(array('PD-L1 TPS:5%', '', '检测项目:PD-L1检测', '标本编号:S1'), int(id div 3000 + 1)) AS text").repartition(3)
    found = findings.pathology(lines)
    assert "UDTF" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {(r.key, r.line, r.number, r.specimen, r.assay, r.marker): r["count"] for r in found.groupBy("key", "line", "number", "specimen", "assay", "marker").count().collect()}
    assert counts == {("specimen.identity", 0, 0, None, None, None): 3000, ("assay.identity", 1, 1, 0, None, None): 3000, ("ihc.marker", 3, 2, 0, 1, None): 3000, ("ihc.score", 3, 3, 0, 1, 2): 3000}
    grid = findings.molecular(spark.range(3).selectExpr("string(id) AS page", "1 AS row", "0 AS x", "'EGFR' AS text"))
    assert "UDTF" not in grid._jdf.queryExecution().executedPlan().toString()


def test_a_tail_is_walked_once(spark):
    from pyspark.sql import functions as F

    from ledgerline.functions import text

    cases = {"5 g/L 10–20 H": ("5", "g/L", "10–20", "H"), "5 ≤ 60": ("5", "", "≤ 60", ""), "5 < = 60": ("5", "", "< = 60", ""), "5 1 -- 2": ("5", "", "1 -- 2", ""), "5 ≤ ≤ 6": ("5", "≤", "≤ 6", ""), "5 10-": ("5", "10-", "", ""), "": None}
    found = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.result_tail(F.col("t")).alias("r")).select("t", "r.*", F.col("r").isNull().alias("none"))
    assert {r.t: None if r.none else tuple(r)[1:5] for r in found.collect()} == cases
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("aggregate(") == 1


def test_searches_read_each_table_once(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import archive

    plan = registry.QUERIES["archive_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 8  # orders twice, customer, lineitem five times: for 9 queries
    docs = spark.createDataFrame([(1, "Red  fox"), (2, "den"), (2, "Red"), (None, "red")], "id int, file string")
    said = spark.createDataFrame([(2, "a fox"), (2, " A  fox"), (3, "red")], "id int, text string")
    met = {"red": {"n": F.lit(None).cast("string")}, "red fox": {"n": F.lit(None).cast("string")}, "fox": {"n": F.when(F.col("id") == 2, "said")}, "": {"n": F.lit("x")}, "no": {"n": F.lit(None).cast("string")}}
    found = archive.searches(docs, "id", met, {"file": F.col("file")}, {"page": said})
    assert sorted(map(tuple, found.collect())) == [("fox", 1, "file", "Red fox", False), ("fox", 2, "n", "said", False), ("red", 1, "file", "Red fox", False), ("red", 2, "file", "Red", False), ("red fox", 1, "file", "Red fox", False)]
    assert archive.searches(docs, "id", {"": {}}, {"file": F.col("file")}, {"page": said}).count() == 0


def test_contexts_double_their_walks(spark, monkeypatch):
    from ledgerline.operators import contexts

    calls, own = [], contexts.settled
    monkeypatch.setattr(contexts, "settled", lambda df: calls.append(1) or own(df))
    nodes = [(k, "r", "CONFIRMED", True) for k in range(60)]
    # a chain of 12, and a node that leads to 40 others
    links = [(k, "A", k - 1, None) for k in range(1, 12)] + [(12, "B", k, None) for k in range(13, 53)] + [(53, "A", 12, None)]
    found = contexts.resolve(spark.createDataFrame(nodes, "node long, scope string, status string, source_valid boolean"), spark.createDataFrame(links, "node long, role string, target long, entity string"))
    got = {r.node: (r.state, r.reason, r.n_dependencies) for r in found.collect()}
    assert got == {k: ("INVALID", "too_deep", 0) if 8 < k < 12 else ("INVALID", "too_many", 0) if k in (12, 53) else ("RESOLVED", None, k if k < 9 else 0) for k in range(60)}
    assert len(calls) < 8
