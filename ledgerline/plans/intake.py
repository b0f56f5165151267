"""What becomes of recognised pages, over the driver's tables read as blocks, statements and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import intake, joins, records
from ledgerline.plans import observations
from ledgerline.plans.registry import query
from ledgerline.sources.tables import table


@query("""
WITH b AS (SELECT l_suppkey AS version_id, l_orderkey % 8 AS page_number, l_linenumber % 2 AS row, l_partkey AS id, l_quantity AS x0, l_partkey % 4 AS n FROM lineitem),
w AS (SELECT *, x0 + 0.75 * n AS x1, CASE WHEN id % 3 = 0 THEN 'é' ELSE 'w' END AS ch FROM b WHERE n > 0),
g AS (SELECT *, x0 - lag(x1) OVER r AS gap, lag(n) OVER r AS before FROM w WINDOW r AS (PARTITION BY version_id, page_number, row ORDER BY x0, id)),
f AS (SELECT *, CASE WHEN gap >= -0.075 AND gap <= 1.6 * 0.75 THEN 0 ELSE 1 END AS starts FROM g),
l AS (SELECT *, sum(starts) OVER (PARTITION BY version_id, page_number, row ORDER BY x0, id ROWS UNBOUNDED PRECEDING)::BIGINT AS line FROM f)
SELECT version_id, page_number, row, line, string_agg(CASE WHEN starts = 1 OR n = 1 OR before = 1 THEN '' ELSE ' ' END || repeat(ch, n::BIGINT), '' ORDER BY x0, id) AS text, count(*) AS n_blocks FROM l GROUP BY ALL
""")
def source_lines(spark, d):
    n = F.col("l_partkey") % 4
    lines = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    word = F.expr("repeat(CASE WHEN l_partkey % 3 = 0 THEN 'é' ELSE 'w' END, CAST(l_partkey % 4 AS INT))")
    blocks = lines.select(
        F.col("l_suppkey").alias("version_id"),
        (F.col("l_orderkey") % 8).alias("page_number"),
        (F.col("l_linenumber") % 2).alias("row"),
        F.col("l_partkey").alias("reading_order"),
        F.col("l_quantity").alias("x0"),
        (F.col("l_quantity") + n * 0.75).alias("x1"),
        F.concat(F.lit(" "), word).alias("text"),
    )
    return intake.source_lines(blocks)


@query("""
WITH e AS (SELECT *, (props->>'$.k')::INT AS k, date_part('hour', ts)::BIGINT AS report FROM events),
p AS (SELECT user_id, report, CASE WHEN k % 3 <> 0 THEN ts::DATE END AS day, CASE WHEN k % 4 <> 0 THEN (report * 60 + k % 2) * 60 + CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END END AS clock, k % 5 = 0 AS sec, k % 23 = 0 AS invalid, k % 29 = 0 AS faint FROM e),
f AS (SELECT user_id, report, day, clock, sec FROM p WHERE day IS NOT NULL AND clock IS NOT NULL),
o AS (SELECT user_id, report, min(day) AS day FROM p GROUP BY ALL HAVING count(DISTINCT day) = 1),
c AS (SELECT * FROM f UNION ALL SELECT p.user_id, p.report, o.day, p.clock, p.sec FROM p JOIN o USING (user_id, report) WHERE p.clock IS NOT NULL AND (p.user_id, p.report) NOT IN (SELECT (user_id, report) FROM f)),
s AS (SELECT user_id, report, day, clock, sec FROM c QUALIFY row_number() OVER (PARTITION BY user_id, report ORDER BY sec DESC, day DESC, clock DESC) = 1),
a AS (SELECT p.user_id, p.report, any_value(s.day) AS sday, any_value(s.clock) AS sclock, any_value(s.sec) AS ssec, count(p.day) AS days, count(p.clock) AS clocks, bool_or(invalid) AS invalid, bool_or(faint) AS faint,
  coalesce(bool_or(p.day <> s.day), false) OR coalesce(bool_or(CASE WHEN p.sec AND s.sec THEN p.clock <> s.clock ELSE p.clock // 60 <> s.clock // 60 END), false) AS against FROM p LEFT JOIN s USING (user_id, report) GROUP BY p.user_id, p.report),
r AS (SELECT *, days > 0 AND clocks > 0 AND (sday IS NULL OR against) AS conflict FROM a)
SELECT user_id, report, CASE WHEN sday IS NOT NULL AND NOT conflict THEN strftime(sday, '%Y-%m-%d') || printf(' %02d:%02d:%02d', sclock // 3600, sclock // 60 % 60, sclock % 60) END AS sampled_at, CASE WHEN sday IS NULL OR conflict THEN '' WHEN ssec THEN 'SECOND' ELSE 'MINUTE' END AS precision,
  CASE WHEN conflict THEN 'REVIEW' WHEN sday IS NULL THEN 'REJECTED' WHEN invalid OR faint THEN 'REVIEW' ELSE 'ACCEPTED' END AS state,
  CASE WHEN conflict THEN 'sampling_datetime_conflict' WHEN sday IS NULL THEN CASE WHEN invalid THEN 'sampling_datetime_unreliable' WHEN days > 0 THEN 'sampling_time_missing' WHEN clocks > 0 THEN 'sampling_date_missing' ELSE 'sampling_datetime_missing' END WHEN invalid OR faint THEN 'sampling_datetime_unreliable' ELSE '' END AS reason FROM r
""")
def sampling_times(spark, d):
    k = F.col("k")
    e = table(spark, d, "events", "user_id", "ts", "props").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "report": F.hour("ts").cast("long")})
    parts = e.select(
        "user_id",
        "report",
        F.when(k % 3 != 0, F.to_date("ts")).alias("day"),
        F.when(k % 4 != 0, (F.col("report") * 60 + k % 2) * 60 + F.when(k % 5 == 0, 10).otherwise(0)).alias("clock"),
        (k % 5 == 0).alias("to_second"),
        (k % 23 == 0).alias("invalid"),
        F.when(k % 29 == 0, 0.9).otherwise(0.99).alias("confidence"),
    )
    return intake.sampling_times(parts, ["user_id", "report"]).withColumn("sampled_at", F.date_format("sampled_at", "yyyy-MM-dd HH:mm:ss"))


@query("WITH c AS (SELECT l_orderkey, l_linenumber % 2 AS page, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS priority, date_trunc('month', l_shipdate)::DATE AS day FROM lineitem), f AS (SELECT l_orderkey, page, min(priority) AS priority FROM c GROUP BY ALL) SELECT c.l_orderkey, c.page, (CASE WHEN count(DISTINCT day) FILTER (WHERE c.priority = f.priority) = 1 THEN min(day) FILTER (WHERE c.priority = f.priority) END)::VARCHAR AS observation_date, count(*) AS n_candidates, count(*) FILTER (WHERE c.priority = f.priority) AS n_selected FROM c JOIN f ON c.l_orderkey IS NOT DISTINCT FROM f.l_orderkey AND c.page IS NOT DISTINCT FROM f.page GROUP BY ALL")
def page_dates(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    priority = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    found = intake.page_dates(lines.select("l_orderkey", (F.col("l_linenumber") % 2).alias("page"), priority.alias("priority"), F.trunc("l_shipdate", "month").alias("day")), ["l_orderkey", "page"])
    return found.withColumn("observation_date", F.col("observation_date").cast("string"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_orderkey = l_orderkey AND o_orderkey % 2 = l_linenumber % 2 AND l_linenumber BETWEEN o_custkey % 3 + 1 AND o_custkey % 3 + 3)")
def rejected_regions(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    start = F.col("o_custkey") % 3 + 1
    units = o.select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 2).alias("page_number"), start.alias("start_order"), (start + 2).alias("end_order"))
    regions = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumns({"version_id": F.col("l_orderkey"), "page_number": F.col("l_linenumber") % 2, "reading_order": F.col("l_linenumber")})
    return intake.without_rejected(regions, units).select("l_orderkey", "l_linenumber", "l_partkey")


_SIDES = "['LEFT', 'RIGHT', 'BILATERAL', 'MIDLINE', 'BOTH']"


@query(f"""
WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber = 5 THEN 'lesion.size' WHEN l_linenumber % 3 = 0 THEN 'lesion.scoped_laterality' ELSE 'lesion.laterality' END AS field_key, CASE coalesce(l_partkey, 0) % 5 WHEN 0 THEN 'UNKNOWN_SCOPE' WHEN 1 THEN 'NAMED_MEMBERS_ONLY' ELSE 'WHOLE_ENTITY' END AS st, {_SIDES}[l_orderkey % 2 + l_suppkey % 7 // 5 * 3 + 1] AS code, l_quantity > 5 AS usable, l_quantity >= 48 AS conflict, s_acctbal > 0 AS here FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT *, st = 'WHOLE_ENTITY' AND field_key = 'lesion.laterality' AS whole, st = 'NAMED_MEMBERS_ONLY' AND field_key = 'lesion.scoped_laterality' AS named FROM f WHERE field_key <> 'lesion.size'),
g AS (SELECT l_orderkey, count(*) FILTER (WHERE whole) AS n_whole, count(*) FILTER (WHERE named) AS n_named, count(*) FILTER (WHERE NOT whole AND NOT named) AS n_unknown, list_distinct(list(code) FILTER (WHERE whole AND usable AND here AND NOT conflict AND code <> 'BOTH')) AS codes, bool_or(whole AND conflict) AS clash FROM w GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN coalesce(len(codes), 0) > 1 OR clash THEN 'CONFLICT' WHEN len(codes) = 1 THEN 'WHOLE_ENTITY' WHEN n_named > 0 THEN 'NAMED_MEMBERS_ONLY' WHEN n_unknown > 0 THEN 'UNKNOWN_SCOPE' ELSE 'UNAVAILABLE' END AS scope_state, CASE WHEN len(codes) = 1 AND NOT clash THEN codes[1] END AS side, n_whole, n_named, n_unknown FROM g
""")
def effective_side(spark, d):
    c = F.col
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    sides = F.array(*map(F.lit, [*intake.SIDES, "BOTH"]))
    fields = lines.select(
        "l_orderkey",
        F.when(c("l_linenumber") == 5, "lesion.size").when(c("l_linenumber") % 3 == 0, intake.SCOPED_SIDE_KEY).otherwise(intake.SIDE_KEY).alias("field_key"),
        F.when(c("l_partkey") % 5 == 1, "NAMED_MEMBERS_ONLY").when(c("l_partkey") % 5 > 1, "WHOLE_ENTITY").alias("scope_state"),
        c("l_suppkey").alias("parent_id"),
        F.element_at(sides, (c("l_orderkey") % 2 + F.floor(c("l_suppkey") % 7 / 5) * 3 + 1).cast("int")).alias("code"),
        (c("l_quantity") > 5).alias("usable"),
        (c("l_quantity") >= 48).alias("conflict"),
    )
    sites = table(spark, d, "supplier", "s_suppkey", "s_acctbal").select(c("s_suppkey").alias("parent_id"), (c("s_acctbal") > 0).alias("current"))
    return intake.effective_side(fields, sites, "l_orderkey")


@query("""
WITH e AS (SELECT event_id AS id, user_id AS patient_id, event_type AS code, (props->>'$.k')::INT AS k FROM events),
r AS (SELECT *, CASE WHEN coalesce(code, 'signup') = 'signup' THEN 'PROJECT' WHEN code = 'view' AND k % 4 = 0 THEN 'UNIT' END AS kind, CASE WHEN coalesce(code, 'signup') = 'signup' THEN CASE k % 3 WHEN 0 THEN 'Sign *Up' WHEN 1 THEN 'signup' ELSE 'sign-up' END ELSE 'mg' END AS term, CASE WHEN k % 7 = 0 THEN '' ELSE 'BLOOD' END AS specimen FROM e),
n AS (SELECT *, CASE WHEN kind = 'UNIT' THEN code ELSE '' END AS known, CASE WHEN term = 'Sign *Up' THEN 'signup' ELSE term END AS norm FROM r WHERE kind IS NOT NULL)
SELECT patient_id, sha256(kind || ':' || norm || ':' || known || ':' || specimen) AS normalized_key, arg_min(kind, id) AS kind, arg_min(term, id) AS raw_term, arg_min(known, id) AS standard_code, count(*) AS n_sources, min(id) AS first_source FROM n GROUP BY patient_id, normalized_key
""")
def term_candidates(spark, d):
    known = joins.rule_table(spark, "standard_code, unit_keys", [("view", "g"), ("click", "g,mg"), ("purchase", "g,mg"), ("error", "g,mg")])
    return intake.term_candidates(observations.observations(spark, d), known.select("standard_code", F.split("unit_keys", ",").alias("unit_keys")))


@query(observations.POINTS + """
, v AS (SELECT *, day - DATE '1970-01-01' AS n FROM q WHERE day IS NOT NULL AND role = 'CURRENT' AND comparator = 'EQ' AND NOT field_conflict),
b AS (SELECT lesion_id, kind, axis, min(n) AS n0, max(n) AS n1, min(value) AS v0, max(value) AS v1 FROM v GROUP BY ALL),
c AS (SELECT observation_id, CASE WHEN n1 > n0 THEN 50 + (n - n0) / (n1 - n0) * 720 ELSE 410 END AS x, CASE WHEN v1 > v0 THEN 205 - (value - v0) / (v1 - v0) * 170 ELSE 120 END AS y FROM v JOIN b ON b.lesion_id = v.lesion_id AND b.kind = v.kind AND b.axis = v.axis)
SELECT q.p_id AS previous_id, q.observation_id, round(s.x, 2) AS x1, round(s.y, 2) AS y1, round(t.x, 2) AS x2, round(t.y, 2) AS y2, round(q.value - q.p_value, 6) AS delta FROM q JOIN c t ON t.observation_id = q.observation_id JOIN c s ON s.observation_id = q.p_id WHERE len(reasons) = 0 AND lesion_id % 10 <> 0
""")
def chart_segments(spark, d):
    c = F.col
    own = observations.points(spark, d)
    eligible = (c("role") == "CURRENT") & (c("comparator") == "EQ") & ~c("field_conflict")
    changes = records.measurement_changes(own).withColumn("barrier", F.when(c("lesion_id") % 10 == 0, "group_conflict"))
    got = intake.chart_segments(changes, own.withColumn("eligible", eligible), ["lesion_id", "kind", "axis"])
    return got.select("previous_id", "observation_id", *[F.round(n, 2).alias(n) for n in ("x1", "y1", "x2", "y2")], F.round("delta", 6).alias("delta"))


@query("""
WITH g AS (SELECT o_orderkey AS id, round(o_totalprice) AS value, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS unit, o_orderpriority AS name FROM orders WHERE o_orderkey % 7 <> 0),
r AS (SELECT o_orderkey AS id, round(o_totalprice) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS value, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END AS unit, CASE WHEN o_orderkey % 17 = 0 THEN '?' ELSE o_orderpriority END AS name, o_custkey % 3 = 0 AS stopped FROM orders WHERE o_orderkey % 5 <> 0),
p AS (SELECT g.id IS NOT NULL AS hg, r.id IS NOT NULL AS hr, stopped, g.value AS gv, g.unit AS gu, g.name AS gn, r.value AS rv, r.unit AS ru, r.name AS rn, coalesce(g.value = r.value, false) AS ev, coalesce(g.unit = r.unit, false) AS eu, coalesce(g.name = r.name, false) AS en FROM g FULL JOIN r ON g.id = r.id),
m AS (
  SELECT 'value' AS measure, count(*) FILTER (WHERE gv IS NOT NULL AND ev) AS tp, count(*) FILTER (WHERE rv IS NOT NULL AND NOT ev AND (NOT hg OR gv IS NOT NULL)) AS fp, count(*) FILTER (WHERE gv IS NOT NULL AND NOT ev) AS fn FROM p
  UNION ALL SELECT 'unit', count(*) FILTER (WHERE gu IS NOT NULL AND eu), count(*) FILTER (WHERE ru IS NOT NULL AND NOT eu AND (NOT hg OR gu IS NOT NULL)), count(*) FILTER (WHERE gu IS NOT NULL AND NOT eu) FROM p
  UNION ALL SELECT 'name', count(*) FILTER (WHERE gn IS NOT NULL AND en), count(*) FILTER (WHERE rn IS NOT NULL AND NOT en AND (NOT hg OR gn IS NOT NULL)), count(*) FILTER (WHERE gn IS NOT NULL AND NOT en) FROM p
  UNION ALL SELECT 'joint', count(*) FILTER (WHERE ev AND eu AND en), count(*) FILTER (WHERE hr AND (NOT hg OR (gu IS NOT NULL AND NOT (ev AND eu AND en)))), count(*) FILTER (WHERE hg AND gu IS NOT NULL AND NOT (ev AND eu AND en)) FROM p
  UNION ALL SELECT 'severe', count(*) FILTER (WHERE bad AND stopped), count(*) FILTER (WHERE ev AND eu AND en AND stopped), count(*) FILTER (WHERE bad AND NOT stopped) FROM (SELECT *, hr AND (NOT hg OR NOT ev OR (gu IS NOT NULL AND NOT eu)) AS bad FROM p)
)
SELECT measure, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM m
""")
def field_evaluation(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority").withColumn("price", F.round("o_totalprice"))
    gold = o.where(k % 7 != 0).select(k.alias("id"), F.lit(True).alias("g"), F.col("price").alias("gold_value"), F.when(k % 13 != 0, F.col("o_orderstatus")).alias("gold_unit"), F.col("o_orderpriority").alias("gold_name"))
    read = o.where(k % 5 != 0).select(
        k.alias("id"),
        F.lit(True).alias("r"),
        (F.col("price") + F.when(k % 11 == 0, 1).otherwise(0)).alias("read_value"),
        F.when(k % 6 != 0, F.col("o_orderstatus")).alias("read_unit"),
        F.when(k % 17 == 0, "?").otherwise(F.col("o_orderpriority")).alias("read_name"),
        (F.col("o_custkey") % 3 == 0).alias("intercepted"),
    )
    pairs = gold.join(read, "id", "full").withColumns({"has_gold": F.coalesce("g", F.lit(False)), "has_read": F.coalesce("r", F.lit(False)), "intercepted": F.coalesce("intercepted", F.lit(False))})
    return intake.field_evaluation(pairs, ["value", "unit", "name"], ["value", "unit", "name"], ["value", "unit"])
