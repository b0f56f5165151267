"""Series, versions, calendars and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import dates
from ledgerline.operators import aggregates, joins, series
from ledgerline.plans.registry import query
from ledgerline.sources.tables import table
from ledgerline.streaming import limits

_DAILY = "SELECT * FROM (SELECT user_id, event_type, ts::DATE AS day, event_id, value, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def _daily(spark, d):
    return series.daily_latest(table(spark, d, "events", "user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")


@query(f"SELECT user_id, event_type, day::VARCHAR AS day, event_id, value FROM ({_DAILY})")
def series_daily_latest(spark, d):
    return _daily(spark, d).select("user_id", "event_type", F.col("day").cast("string").alias("day"), "event_id", "value")


@query(f"SELECT user_id, event_type, day::VARCHAR AS day, value, round(value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY day), 6) AS delta FROM ({_DAILY})")
def series_lag_delta(spark, d):
    return series.change(_daily(spark, d), ["user_id", "event_type"], ["day"], "value").select("user_id", "event_type", F.col("day").cast("string").alias("day"), "value", F.round("delta", 6).alias("delta"))


@query(f"SELECT user_id, event_type, day::VARCHAR AS day, value FROM ({_DAILY}) QUALIFY count(*) OVER (PARTITION BY user_id, event_type) >= 2")
def series_min_two_days(spark, d):
    return series.series_of_days(_daily(spark, d), ["user_id", "event_type"], "day", 2).select("user_id", "event_type", F.col("day").cast("string").alias("day"), "value")


@query("SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def series_scale_minmax(spark, d):
    return series.scaled(table(spark, d, "events", "event_id", "user_id", "value"), ["user_id"], "value").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("WITH t AS (SELECT o_custkey, o_orderdate, CASE WHEN count(*) = 1 THEN min(o_totalprice) END AS v FROM orders GROUP BY ALL), p AS (SELECT o_custkey, o_orderdate, lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS prior FROM t) SELECT o_orderkey, prior, CASE WHEN prior > 0 AND o_totalprice > 0 THEN greatest(o_totalprice / prior, prior / o_totalprice) >= 3 END AS jump FROM orders JOIN p USING (o_custkey, o_orderdate)")
def asof_prior_ratio(spark, d):
    from ledgerline.functions.numeric import symmetric_ratio

    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return joins.asof_prior(o, ["o_custkey"], "o_orderdate", "o_totalprice").select("o_orderkey", "prior", (symmetric_ratio(F.col("o_totalprice"), F.col("prior")) >= 3).alias("jump"))


@query("WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM f) SELECT user_id, run, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type")
def runs_gaps_islands(spark, d):
    e = series.runs(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return e.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS multiplicity FROM lineitem")
def multiplicity_window(spark, d):
    return series.multiplicity(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "multiplicity")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST) AS attempt FROM orders")
def attempt_numbers(spark, d):
    return series.numbered(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", out="attempt").select("o_orderkey", "attempt")


@query("WITH r AS (SELECT l_orderkey, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_linestatus DESC) AS rn FROM lineitem WHERE l_quantity > 25) SELECT o_orderkey, o_orderstatus, coalesce(l_linestatus, o_orderstatus) AS effective_o_orderstatus FROM orders LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON l_orderkey = o_orderkey")
def latest_revision_overlay(spark, d):
    base = table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    rev = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_quantity").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_linestatus").alias("sequence"), F.col("l_linestatus").alias("o_orderstatus"))
    return joins.overlay(base, rev, ["o_orderkey"], "sequence", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "effective_o_orderstatus")


@query("WITH RECURSIVE e AS (SELECT o_orderkey AS node, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST) AS prev FROM orders), r AS (SELECT node, node AS root, 0 AS steps FROM e WHERE prev IS NULL UNION ALL SELECT e.node, r.root, r.steps + 1 FROM e JOIN r ON e.prev = r.node) SELECT node, root, steps FROM r")
def recursive_lineage(spark, d):
    from pyspark.sql.window import Window

    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    edges = o.select(F.col("o_orderkey").alias("node"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("prev"))
    return joins.lineage(edges, "node", "prev")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def latest_ties_kept(spark, d):
    return series.latest_with_ties(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.col("o_orderdate").desc())


@query("WITH c AS (SELECT *, value > 50 AS chosen FROM events), w AS (SELECT event_id, value, chosen, lag(chosen) OVER w AS before, value - lag(value) OVER w AS delta FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, value, round(CASE WHEN before THEN delta END, 6) AS delta FROM w WHERE chosen")
def window_then_filter(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("place", F.struct("ts", "event_id"))
    return series.change_then_filter(e, ["user_id"], "place", "value", F.col("value") > 50).select("event_id", "value", F.round("delta", 6).alias("delta"))


@query("SELECT user_id, CAST(time_bucket(INTERVAL '60 seconds', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def tumbling_counts(spark, d):
    return limits.tumbling(table(spark, d, "events", "user_id", "ts"), ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH s AS (SELECT user_id, unnest(generate_series(time_bucket(INTERVAL '10 minutes', ts) - INTERVAL '50 minutes', time_bucket(INTERVAL '10 minutes', ts), INTERVAL '10 minutes')) AS start FROM events) SELECT user_id, start::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY ALL")
def sliding_windows(spark, d):
    return limits.sliding(table(spark, d, "events", "user_id", "ts"), ["user_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events")
def sliding_range_counts(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("sec", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    return series.counts_before(series.counts_before(e, ["user_id"], "sec", 3600, "last_hour"), ["user_id"], "sec", 86400, "last_day").select("event_id", "last_hour", "last_day")


@query("""
WITH RECURSIVE n AS (SELECT event_id, user_id, event_type = 'purchase' AS closes, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (
  SELECT event_id, user_id, i, CASE WHEN closes THEN -1 ELSE t END AS began, CASE WHEN closes THEN 0 ELSE 1 END AS used FROM n WHERE i = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.i, CASE WHEN closes THEN -1 WHEN began < 0 OR t - began >= 900 THEN t ELSE began END, CASE WHEN closes THEN 0 WHEN began < 0 OR t - began >= 900 THEN 1 ELSE used + 1 END FROM f JOIN n ON n.user_id IS NOT DISTINCT FROM f.user_id AND n.i = f.i + 1
)
SELECT event_id, user_id, used <= 5 AS allowed FROM f
""")
def resettable_window(spark, d):
    return limits.resettable_limit(table(spark, d, "events", "event_id", "user_id", "ts", "event_type"))


@query("WITH l AS (SELECT user_id, max(ts) AS heartbeat_at, count(*) AS attempts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, heartbeat_at, attempts, CASE WHEN attempts = 1 THEN 60 WHEN attempts = 2 THEN 300 ELSE 1800 END AS retry_seconds FROM l, n WHERE epoch_us(now) - epoch_us(heartbeat_at) >= 86400000000")
def stale_leases(spark, d):
    e = table(spark, d, "events", "user_id", "ts")
    now = e.agg(F.max("ts")).first()[0]
    return limits.stale_leases(e, "user_id", F.lit(now), 86400)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_idempotent(spark, d):
    return series.latest(table(spark, d, "events", "event_id", "user_id", "event_type"), ["user_id", "event_type"], F.col("event_id").asc_nulls_last()).select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM (SELECT event_id, date_part('day', ts) AS gen, max(date_part('day', ts)) OVER (PARTITION BY user_id) AS newest FROM events) WHERE gen = newest")
def fenced_results(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts").withColumn("gen", F.dayofmonth("ts"))
    return limits.fenced(e, "user_id", "gen").select("event_id")


@query("WITH b AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM events), g AS (SELECT unnest(generate_series(date_trunc('week', date_trunc('month', a)), z, INTERVAL 1 DAY))::DATE AS day FROM b), c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day::VARCHAR AS day, date_trunc('week', day)::DATE::VARCHAR AS week, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (day)")
def calendar_grid(spark, d):
    e = table(spark, d, "events", "ts").select(F.to_date("ts").alias("day"))
    ends = e.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    grid = ends.select(F.explode(F.sequence(F.trunc(F.trunc("a", "month"), "week"), "z")).alias("day"))
    return grid.join(e.groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day", "left").select(F.col("day").cast("string").alias("day"), F.trunc("day", "week").cast("string").alias("week"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, date_part('year', DATE '2020-02-28') - date_part('year', o_orderdate) - CASE WHEN (2, 28) < (date_part('month', o_orderdate), date_part('day', o_orderdate)) THEN 1 ELSE 0 END AS age FROM orders")
def age_completed_years(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.completed_years(F.col("o_orderdate"), F.lit("2020-02-28").cast("date")).cast("long").alias("age"))


@query("WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS v, CASE o_orderkey % 4 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'MONTH' WHEN 2 THEN 'DAY' ELSE 'UNKNOWN' END AS precision FROM orders), i AS (SELECT o_orderkey, precision, CASE precision WHEN 'YEAR' THEN date_trunc('year', v) WHEN 'MONTH' THEN date_trunc('month', v) WHEN 'DAY' THEN v END::DATE AS a, CASE precision WHEN 'YEAR' THEN make_date(year(v), 12, 31) WHEN 'MONTH' THEN last_day(v) WHEN 'DAY' THEN v END::DATE AS z FROM p) SELECT o_orderkey, CASE WHEN a IS NULL THEN 'uncertain' WHEN a >= DATE '1995-03-10' AND z <= DATE '1997-06-20' THEN 'included' WHEN z < DATE '1995-03-10' OR a > DATE '1997-06-20' THEN 'excluded' ELSE 'uncertain' END AS state FROM i")
def partial_date_tristate(spark, d):
    k = F.col("o_orderkey") % 4
    precision = F.when(k == 0, "YEAR").when(k == 1, "MONTH").when(k == 2, "DAY").otherwise("UNKNOWN")
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("v"), precision.alias("p"))
    return o.select("o_orderkey", dates.selection_state(F.col("v"), F.col("p"), F.lit("1995-03-10").cast("date"), F.lit("1997-06-20").cast("date")).alias("state"))


@query("SELECT user_id, event_type, round(sum(value), 4) AS value_sum, count(*) AS sample_count FROM events GROUP BY ALL")
def metric_series(spark, d):
    m = aggregates.metric_series(table(spark, d, "events", "user_id", "event_type", "value"), "events", ["user_id", "event_type"], "value")
    return m.select(F.get_json_object("labels", "$.user_id").cast("long").alias("user_id"), F.get_json_object("labels", "$.event_type").alias("event_type"), F.round("value_sum", 4).alias("value_sum"), "sample_count")


@query("SELECT user_id, ts AS at, date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0 AS latency FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def stage_latency(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "event_id").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return series.change(e, ["user_id"], ["ts", "event_id"], "us").select("user_id", F.col("ts").alias("at"), (F.col("delta") / 1000000.0).cast("double").alias("latency"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM events")
def carried_context(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("known", F.when(F.col("event_type") == "purchase", F.col("value")))
    return series.carried(e, ["user_id"], ["ts", "event_id"], "known", "context").select("event_id", "context")
