"""Filters, joins, set operations, sorts and plain aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import aggregates, joins, series
from ledgerline.plans.registry import query
from ledgerline.sources.tables import table


@query("SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN NULL ELSE o_orderstatus END AS status FROM orders")
def exists_flag_case(spark, d):
    returned = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    flagged = joins.exists_flag(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), returned, ["o_orderkey"], "returned")
    return flagged.select("o_orderkey", F.when(~F.col("returned"), F.col("o_orderstatus")).alias("status"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR c_name LIKE '%7'")
def exists_or_search(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    rich = table(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    own = c.where(F.lower("c_mktsegment").contains("build") | F.col("c_name").endswith("7")).select("c_custkey")
    return joins.matched_by_any(c.select("c_custkey"), "c_custkey", [own, rich])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_missing(spark, d):
    return joins.without(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT o_orderkey, l_partkey, l_shipdate FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS rn FROM lineitem) l ON l_orderkey = o_orderkey AND rn = 1")
def scalar_subquery_first(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_linenumber").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.first_of(table(spark, d, "orders", "o_orderkey"), lines, ["o_orderkey"], [F.col(x).asc_nulls_last() for x in ("l_shipdate", "l_linenumber", "l_partkey")], ["l_partkey", "l_shipdate"])


@query("SELECT c_custkey, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n_orders FROM customer")
def agg_subquery_coalesce(spark, d):
    o = table(spark, d, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_total(table(spark, d, "customer", "c_custkey"), o, ["c_custkey"], F.count(F.lit(1)), "n_orders", 0)


@query("SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey HAVING count(DISTINCT p_brand) >= 3")
def having_distinct(spark, d):
    joined = table(spark, d, "lineitem", "l_orderkey", "l_partkey").join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("l_orderkey").agg(F.countDistinct("p_brand").alias("n")).where("n >= 3").select("l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority <> '1-URGENT' AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND o_totalprice > 1000 AND o_totalprice <= 300000")
def multi_facet_filter(spark, d):
    c = F.col
    facets = [c("o_orderstatus").isin("O", "F"), ~(c("o_orderpriority") == "1-URGENT"), (c("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")), c("o_totalprice") > 1000, c("o_totalprice") <= 300000]
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice").where(reduce(lambda a, b: a & b, facets)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 OR day(o_orderdate) = 17")
def date_component_filter(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").where(((F.year(t) == 1995) & (F.month(t) == 3)) | (F.dayofmonth(t) == 17)).select("o_orderkey")


@query("SELECT a.s_suppkey AS left, b.s_suppkey AS right FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join_pairs(spark, d):
    return joins.unordered_pairs(table(spark, d, "supplier", "s_nationkey", "s_suppkey"), ["s_nationkey"], "s_suppkey").select("left", "right")


@query("SELECT a.p_partkey AS left, b.p_partkey AS right FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND a.p_type <> b.p_type AND abs(a.p_retailprice - b.p_retailprice) < 5")
def theta_pairs_blocked(spark, d):
    # prices less than 5 apart are in the same step of 5 or in neighbouring ones, so strangers in price never meet
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_type", "p_retailprice").withColumn("step", F.floor(F.col("p_retailprice") / 5).cast("double"))
    q = p.select(F.col("p_partkey").alias("right"), "p_brand", "p_size", F.col("p_type").alias("t"), F.col("p_retailprice").alias("r"), F.explode(F.array_distinct(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))).alias("step"))
    # few bytes make many pairs: the tasks are as many as the blocks allow, not as the bytes do
    keys, tasks = ["p_brand", "p_size", "step"], max(400, 8 * spark.sparkContext.defaultParallelism)
    near = (F.col("p_partkey") < F.col("right")) & (F.col("p_type") != F.col("t")) & (F.abs(F.col("p_retailprice") - F.col("r")) < 5)
    return p.repartition(tasks, *keys).join(q.repartition(tasks, *keys).hint("shuffle_hash"), keys).where(near).select(F.col("p_partkey").alias("left"), "right")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P') AND c_acctbal < 0")
def reconcile_orphans(spark, d):
    edited = table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0").select("c_custkey")
    shown = table(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.without(edited, shown, ["c_custkey"])


@query("WITH s AS (SELECT o_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT CASE WHEN f = n THEN 'done' WHEN f > 0 THEN 'partial' ELSE 'open' END AS state, count(*) AS n_orders FROM s GROUP BY 1")
def status_rollup(spark, d):
    per = table(spark, d, "lineitem", "l_orderkey", "l_linestatus").join(table(spark, d, "orders", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    return per.groupBy(F.when(F.col("f") == F.col("n"), "done").when(F.col("f") > 0, "partial").otherwise("open").alias("state")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("SELECT c_custkey, round(coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_custkey = c_custkey), 0) + coalesce((SELECT sum(l_tax) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_linestatus = 'O'), 0), 2) AS total FROM customer")
def quota_totals(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    pending = table(spark, d, "lineitem", "l_orderkey", "l_tax", "l_linestatus").where("l_linestatus = 'O'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_tax").alias("v"))
    used = o.select("o_custkey", F.col("o_totalprice").alias("v")).union(pending).withColumnRenamed("o_custkey", "c_custkey")
    return joins.with_total(table(spark, d, "customer", "c_custkey"), used, ["c_custkey"], F.sum("v"), "total", 0.0).withColumn("total", F.round("total", 2))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 AND count(l_returnflag) = count(*) THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY l_orderkey")
def exactly_one_value(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(aggregates.exactly_one("l_returnflag").alias("flag"))


@query("SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_final, bool_or(l_returnflag = 'R') AS any_returned, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey")
def fold_bool_and_or(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag", "l_partkey", "l_linenumber")
    return aggregates.fold(lines, ["l_orderkey"], {"all_final": F.col("l_linestatus") == "F"}, {"any_returned": F.col("l_returnflag") == "R"}, "l_partkey", "l_linenumber")


@query("SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS click, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS view, round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS purchase FROM events GROUP BY user_id")
def pivot_long_matrix(spark, d):
    return aggregates.matrix(table(spark, d, "events", "user_id", "event_type", "value"), "user_id", "event_type", F.round(F.sum("value"), 4), ["click", "view", "purchase"])


@query("SELECT r_name, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def ordered_distinct_concat(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "supplier", "s_nationkey"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(aggregates.distinct_list("n_name").alias("nations"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def conflict_flags(spark, d):
    return aggregates.conflicts(table(spark, d, "lineitem", "l_partkey", "l_suppkey"), ["l_partkey"], "l_suppkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def topk_recent(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(5)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40")
def paged_total_order(spark, d):
    return table(spark, d, "documents", "doc_id", "n_chars").orderBy(F.col("n_chars").desc_nulls_last(), "doc_id").offset(40).limit(20)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey NULLS FIRST) AS place FROM orders")
def stable_priority_order(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", rank.alias("rank"))
    return series.placed(o, "rank", "o_orderkey", out="place").select("o_orderkey", "place")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'except', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def set_union_except_intersect(spark, d):
    a = table(spark, d, "orders", "o_orderkey", "o_totalprice").where("o_totalprice > 200000").select("o_orderkey")
    b = table(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    parts = {"union": a.union(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b)}
    return reduce(DataFrame.union, [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, p in parts.items()])


@query("WITH k AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k)) SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM l GROUP BY l_suppkey")
def scope_projection_recount(spark, d):
    scope = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'")
    kept = table(spark, d, "lineitem", "l_suppkey", "l_orderkey").join(scope, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return kept.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))


@query("SELECT 'missing_order' AS violation, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'missing_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'repeated_order', count(*) - count(DISTINCT o_orderkey) FROM orders")
def closure_violations(spark, d):
    lines, o = table(spark, d, "lineitem", "l_orderkey", "l_partkey"), table(spark, d, "orders", "o_orderkey")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("violation"), "n")
    # a null names nothing
    missing_order = lines.where("l_orderkey IS NOT NULL").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    missing_part = lines.where("l_partkey IS NOT NULL").join(table(spark, d, "part", "p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_anti")
    repeated = o.agg((F.count(F.lit(1)) - F.countDistinct("o_orderkey")).alias("n")).select(F.lit("repeated_order").alias("violation"), "n")
    return count(missing_order, "missing_order").union(count(missing_part, "missing_part")).union(repeated)


@query("SELECT n_name, count(*) AS n_customers, round(avg(c_acctbal), 4) AS mean_balance, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join_rollup(spark, d):
    c = table(spark, d, "customer", "c_nationkey", "c_acctbal").join(table(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.max("c_acctbal").alias("most"))


@query("SELECT o_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30 GROUP BY o_orderkey")
def prefetch_children(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").where("l_quantity > 30")
    kids = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("parts"))
    return table(spark, d, "orders", "o_orderkey").join(kids, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.array_join("parts", ",").alias("parts"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    lines = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


# Orders one after the other, each customer's clusters as lists of lists.
CLUSTERS = """
WITH RECURSIVE o AS (
  SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL
), f AS (
  SELECT o_custkey, i, [[{'k': o_orderkey, 'p': o_totalprice}]] AS c FROM o WHERE i = 1
  UNION ALL
  SELECT o_custkey, i, CASE WHEN coalesce(at_, 0) = 0 THEN c || [[x]] ELSE c[:at_ - 1] || [c[at_] || [x]] || c[at_ + 1:] END
  FROM (
    SELECT o.o_custkey, o.i, f.c, {'k': o.o_orderkey, 'p': o.o_totalprice} AS x, list_position(list_transform(f.c, lambda m: len(list_filter(m, lambda y: coalesce(abs(y.p - o.o_totalprice) < 100000, false))) = len(m)), true) AS at_
    FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1
  )
), ended AS (SELECT o_custkey, c FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY i DESC) = 1
), k AS (SELECT o_custkey, y.k AS node, m[1].k AS cluster FROM (SELECT o_custkey, m, unnest(m) AS y FROM (SELECT o_custkey, unnest(c) AS m FROM ended)))
"""


@query(CLUSTERS + "SELECT * FROM k")
def cluster_complete_link(spark, d):
    # a customer's orders, near in price: groups that don't grow with the tables
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_custkey IS NOT NULL AND o_orderkey IS NOT NULL")
    other = o.select("o_custkey", F.col("o_orderkey").alias("right"), F.col("o_totalprice").alias("p"))
    near = o.join(other, "o_custkey").where((F.col("o_orderkey") < F.col("right")) & (F.abs(F.col("o_totalprice") - F.col("p")) < 100000))
    return joins.complete_link(near.select("o_custkey", F.col("o_orderkey").alias("left"), "right"), o.select("o_custkey", F.col("o_orderkey").alias("node")), "o_custkey")


@query()
def assignment_matching(spark, d):
    # open and finished orders of a customer, by price
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice").where("o_custkey IS NOT NULL")
    done = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("right"), F.col("o_totalprice").alias("p"))
    scores = o.where("o_orderstatus = 'O'").join(done, "o_custkey").select("o_custkey", F.col("o_orderkey").alias("left"), "right", (1 / (1 + F.abs(F.col("o_totalprice") - F.col("p")) / 1000)).alias("score"))
    return joins.assigned(scores, "o_custkey").withColumn("score", F.round("score", 9))
