"""Composite record views over the driver's events, read as laboratory observations, and policies over other tables.

An event is an observation: its user the patient, its day and user the report, its
type the code; unit, method, specimen, flag and confidence come from its property k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import dates, text
from ledgerline.operators import joins, records, views
from ledgerline.plans.registry import query
from ledgerline.sources.tables import table

# The same observations in SQL, with the issues of each row by itself.
_OBS = """
WITH e AS (SELECT *, (props->>'$.k')::INT AS k FROM events),
obs AS (
  SELECT event_id AS observation_id, user_id AS patient_id, concat_ws('/', user_id, ts::DATE) AS report_id, event_type AS standard_code, CASE WHEN k % 7 = 0 THEN '' ELSE 'BLOOD' END AS specimen,
    CASE WHEN k % 5 = 0 THEN '' ELSE 'M' || (k % 2) END AS method_raw, CASE WHEN k % 20 = 3 THEN 'n/a' ELSE printf('%.2f', value) END AS raw_value, CASE WHEN k % 4 = 0 THEN 'mg' ELSE 'g' END AS raw_unit,
    CASE k % 10 WHEN 1 THEN 0.85 WHEN 2 THEN 0.70 ELSE 0.97 END AS confidence, ts::DATE AS observation_date, ts AS sampled_at, ['north', 'south', ''][k % 3 + 1] AS institution,
    ['5--80', '<=60', '<60', ''][k % 4 + 1] AS reference_range_raw, CASE k % 11 WHEN 1 THEN 'H' WHEN 2 THEN 'low' WHEN 3 THEN 'N' WHEN 4 THEN '?' ELSE '' END AS report_flag_raw, k = 99 AS deleted
  FROM e
), own AS (
  SELECT *, try_cast(raw_value AS DECIMAL(28, 10)) AS value, list_filter([
    CASE WHEN deleted THEN 'source_unavailable' END, CASE WHEN confidence < 0.95 THEN 'recognition_uncertain' END, CASE WHEN coalesce(standard_code, 'signup') = 'signup' THEN 'mapping_unknown' END,
    CASE WHEN standard_code = 'error' AND specimen = 'BLOOD' THEN 'specimen_conflict' END, CASE WHEN standard_code <> 'signup' AND specimen = '' THEN 'specimen_unknown' END,
    CASE WHEN coalesce(raw_value, 'n/a') = 'n/a' THEN 'type_conflict' END, CASE WHEN coalesce(raw_value, 'n/a') = 'n/a' THEN 'numeric_unsupported' END, CASE WHEN standard_code = 'view' AND raw_unit = 'mg' THEN 'unit_unknown' END,
    CASE WHEN observation_date IS NULL THEN 'date_uncertain' END], lambda x: x IS NOT NULL) AS base
  FROM obs
), usable AS (SELECT * FROM own WHERE len(base) = 0 AND method_raw <> '' AND specimen <> ''
), days AS (
  SELECT patient_id, standard_code, specimen, method_raw, raw_unit, observation_date, lag(one) OVER (PARTITION BY patient_id, standard_code, specimen, method_raw, raw_unit ORDER BY observation_date) AS prior
  FROM (SELECT patient_id, standard_code, specimen, method_raw, raw_unit, observation_date, CASE WHEN count(*) = 1 THEN min(value) END AS one FROM usable GROUP BY ALL)
), suspect AS (
  SELECT observation_id FROM usable JOIN days USING (patient_id, standard_code, specimen, method_raw, raw_unit, observation_date)
  WHERE standard_code IN ('click', 'purchase') AND raw_unit = 'g' AND value > 0 AND prior > 0 AND greatest(value::DOUBLE / prior::DOUBLE, prior::DOUBLE / value::DOUBLE) >= 3
), once AS (SELECT report_id, specimen, method_raw, standard_code, min(value) AS v FROM own WHERE len(base) = 0 GROUP BY ALL HAVING count(*) = 1
), conflict AS (
  SELECT o.observation_id FROM own o JOIN once a ON a.report_id = o.report_id AND a.specimen = o.specimen AND a.method_raw = o.method_raw AND a.standard_code = 'click'
  JOIN once b ON b.report_id = o.report_id AND b.specimen = o.specimen AND b.method_raw = o.method_raw AND b.standard_code = 'view' WHERE o.standard_code = 'purchase' AND len(o.base) = 0 AND abs(a.v + b.v - o.value) > 5
), checked AS (
  SELECT own.*, s.observation_id IS NOT NULL AS magnitude_suspect, c.observation_id IS NOT NULL AS internal_conflict, base || list_filter([CASE WHEN s.observation_id IS NOT NULL THEN 'magnitude_suspect' END, CASE WHEN c.observation_id IS NOT NULL THEN 'internal_conflict' END], lambda x: x IS NOT NULL) AS issues
  FROM own LEFT JOIN suspect s USING (observation_id) LEFT JOIN conflict c USING (observation_id)
), flagged AS (
  SELECT *, len(issues) > 0 AS blocked, len(list_filter(issues, lambda x: x NOT IN ('mapping_unknown', 'specimen_unknown', 'specimen_conflict'))) > 0 AS review, len(list_filter(issues, lambda x: x <> 'specimen_unknown')) > 0 AS no_reference FROM checked
), based AS (
  SELECT *, CASE WHEN standard_code = 'click' AND specimen = 'BLOOD' AND raw_unit = 'g' AND ((institution = 'north' AND method_raw IN ('', 'M1')) OR (institution = 'south' AND method_raw = 'M0')) THEN 'rule:P1' ELSE method_raw END AS method_basis FROM flagged
), cell AS (
  SELECT *, CASE WHEN blocked OR specimen = '' OR method_basis = '' THEN 'insufficient' WHEN raw_unit = 'mg' AND standard_code IN ('click', 'error', 'purchase') THEN 'converted' ELSE 'direct' END AS state,
    CASE WHEN raw_value = 'n/a' OR no_reference THEN 'unavailable' ELSE CASE reference_range_raw WHEN '5--80' THEN CASE WHEN value < 5 THEN 'below' WHEN value > 80 THEN 'above' ELSE 'within' END WHEN '<=60' THEN CASE WHEN value > 60 THEN 'above' ELSE 'within' END WHEN '<60' THEN CASE WHEN value >= 60 THEN 'above' ELSE 'within' END ELSE 'unavailable' END END AS reference_status,
    CASE report_flag_raw WHEN 'H' THEN 'above' WHEN 'low' THEN 'below' WHEN 'N' THEN 'within' END AS said
  FROM based
), shown AS (
  SELECT *, CASE state WHEN 'direct' THEN value::DOUBLE WHEN 'converted' THEN value::DOUBLE * 0.001 END AS shown_value, CASE WHEN state = 'converted' THEN 'g' ELSE raw_unit END AS shown_unit,
    CASE WHEN review THEN 'review' WHEN no_reference THEN 'unavailable' WHEN report_flag_raw = '?' OR (said IS NOT NULL AND reference_status <> 'unavailable' AND said <> reference_status) THEN 'review' ELSE coalesce(nullif(reference_status, 'unavailable'), said, 'unavailable') END AS abnormal
  FROM cell
)
"""


def observations(spark, d) -> DataFrame:
    k = F.col("k")
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value", "props").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k % len(xs) + 1)
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.col("user_id").alias("patient_id"),
        F.concat_ws("/", "user_id", F.to_date("ts")).alias("report_id"),
        F.col("event_type").alias("standard_code"),
        F.when(k % 3 == 0, "Sign *Up").when(k % 3 == 1, "signup").otherwise("sign-up").alias("raw_name"),
        F.when(k % 7 == 0, "").otherwise("BLOOD").alias("specimen"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("M"), (k % 2).cast("string"))).alias("method_raw"),
        F.when(k % 20 == 3, "n/a").when(F.col("value").isNotNull(), F.format_string("%.2f", "value")).alias("raw_value"),
        F.when(k % 4 == 0, "mg").otherwise("g").alias("raw_unit"),
        F.lit("numeric").alias("result_type"),
        F.when(k % 10 == 1, 0.85).when(k % 10 == 2, 0.70).otherwise(0.97).alias("confidence"),
        F.to_date("ts").alias("observation_date"),
        F.col("ts").alias("sampled_at"),
        pick("north", "south", "").alias("institution"),
        pick("5--80", "<=60", "<60", "").alias("reference_range_raw"),
        F.when(k % 11 == 1, "H").when(k % 11 == 2, "low").when(k % 11 == 3, "N").when(k % 11 == 4, "?").otherwise("").alias("report_flag_raw"),
        (k == 99).alias("deleted"),
    )


def _checked(spark, d) -> DataFrame:
    words = lambda name: F.split(name, ",").alias(name)
    known = joins.rule_table(spark, "standard_code, d_specimen, unit_keys, result_types", [("view", "BLOOD", "g", "numeric"), ("click", "BLOOD", "g,mg", "numeric"), ("purchase", "BLOOD", "g,mg", "numeric"), ("error", "URINE", "g,mg", "numeric")])
    dictionary = known.select("standard_code", "d_specimen", words("unit_keys"), words("result_types"))
    ratios = joins.rule_table(spark, "standard_code, specimen, method_raw, unit, minimum_ratio", [(c, "BLOOD", m, "g", 3.0) for c in ("click", "purchase") for m in ("M0", "M1")])
    sums = joins.rule_table(spark, "standard_code, component_codes, absolute_tolerance", [("purchase", "click,view", 5.0)]).select("standard_code", words("component_codes"), "absolute_tolerance")
    rows = records.base_issues(observations(spark, d), dictionary)
    return records.all_issues(records.sum_issues(records.history_issues(rows, ratios), sums))


def _cells(spark, d) -> DataFrame:
    policies = joins.rule_table(spark, "policy_id, standard_code, specimen, unit, institution, method", [("P1", "click", "BLOOD", "g", i, m) for i, m in (("north", ""), ("north", "M1"), ("south", "M0"), ("south", ""))] + [("P2", "click", "BLOOD", "g", "south", "")])
    conversions = joins.rule_table(spark, "standard_code, source_unit, target_unit, factor", [(c, "mg", "g", 0.001) for c in ("click", "error", "purchase")])
    cells = records.comparable(records.with_method_rule(_checked(spark, d), policies), conversions)
    r = text.parse_reference(F.col("reference_range_raw"))
    cells = cells.withColumn("r", r).withColumn("reference_status", F.when(F.col("no_reference"), "unavailable").otherwise(text.compare_to_reference(F.col("value").cast("double"), F.col("r.low"), F.col("r.high"), F.col("r.comparator"))))
    return cells.withColumn("abnormal", text.abnormal_status(F.col("report_flag_raw"), F.col("result_type"), F.col("reference_status"), F.col("review"), F.col("no_reference")))


@query(_OBS + "SELECT observation_id, issues, blocked, review, no_reference FROM flagged")
def observation_issues(spark, d):
    return _checked(spark, d).select("observation_id", "issues", "blocked", "review", "no_reference")


@query(_OBS + "SELECT observation_id, state, method_basis, round(shown_value, 6) AS shown_value, shown_unit, abnormal FROM shown")
def comparable_cells(spark, d):
    return _cells(spark, d).select("observation_id", "state", "method_basis", F.round("shown_value", 6).alias("shown_value"), "shown_unit", "abnormal")


_MATRIX = """, folds AS (
  SELECT patient_id, standard_code, specimen, method_basis, report_id, CASE WHEN shown_value IS NULL THEN raw_value ELSE round(shown_value, 6)::VARCHAR END AS result, shown_unit, coalesce(list(observation_id ORDER BY observation_id) FILTER (WHERE observation_id IS NOT NULL), []) AS sources, min(round(shown_value, 6)) AS value, list(raw_value) AS printed, min(abnormal) AS least, max(abnormal) AS most,
    count(DISTINCT (reference_range_raw, report_flag_raw)) > 1 AS reference_difference, bool_or(review) AS review_required
  FROM shown GROUP BY ALL
), placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY patient_id ORDER BY CASE standard_code WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END, standard_code, specimen, method_basis) AS row_no, dense_rank() OVER (PARTITION BY patient_id ORDER BY report_id) AS column_no FROM folds
)
SELECT patient_id, row_no::INT AS row_no, column_no::INT AS column_no, standard_code, specimen, method_basis, report_id, count(*) AS n_results, sum(len(sources))::BIGINT AS n_sources, bool_or(reference_difference) AS reference_difference, bool_or(review_required) AS review_required, min(sources[1]) AS first_source,
  CASE WHEN count(*) = 1 THEN min(value) END AS value, CASE WHEN count(*) = 1 THEN min(shown_unit) END AS unit, CASE WHEN min(least) = max(most) THEN min(least) ELSE 'review' END AS abnormal, coalesce(array_to_string(list_sort(list_distinct(flatten(list(printed)))), ' | '), '') AS results
FROM placed GROUP BY ALL
"""


@query(_OBS + _MATRIX)
def comparison_matrix(spark, d):
    order = [("purchase", 1), ("click", 2), ("view", 3)]
    return views.comparison_matrix(_cells(spark, d), order)


_DAILY = """, dated AS (SELECT *, max(sampled_at) OVER w AS latest, bool_and(confidence >= 0.8) OVER w AS sound FROM shown WHERE state <> 'insufficient' WINDOW w AS (PARTITION BY patient_id, institution, standard_code, observation_date))
SELECT patient_id, institution, standard_code, observation_date, max(latest) AS latest, count(*) AS n_results, count(DISTINCT report_id) AS report_count, count(DISTINCT (reference_range_raw, report_flag_raw)) > 1 AS reference_difference,
  NOT bool_and(sound) OR count(DISTINCT CASE WHEN sampled_at = latest THEN round(shown_value, 6) END) <> 1 OR institution = '' AS disputed, CASE WHEN bool_and(sound) AND count(DISTINCT CASE WHEN sampled_at = latest THEN round(shown_value, 6) END) = 1 AND institution <> '' THEN min(CASE WHEN sampled_at = latest THEN round(shown_value, 6) END) END AS value
FROM dated GROUP BY patient_id, institution, standard_code, observation_date
"""


@query(_OBS + _DAILY)
def lab_output(spark, d):
    cells = _cells(spark, d).where("state <> 'insufficient'").withColumn("shown_value", F.round("shown_value", 6)).withColumn("accepted", (F.col("confidence") >= records.VISIBLE) & (F.col("institution") != ""))
    return views.lab_output(cells, ["patient_id", "institution", "standard_code", "observation_date"])


_GROUPS = """, c AS (
  SELECT DISTINCT patient_id, date_trunc('month', observation_date)::DATE AS month, report_id AS report, standard_code AS code, round(shown_value / 50) AS value, shown_unit FROM shown WHERE state <> 'insufficient'
), r AS (
  SELECT patient_id, month, report, string_agg(code || ':' || coalesce(value::VARCHAR, '') || ':' || shown_unit, ',' ORDER BY code, value, shown_unit) AS said, list_sort(list_distinct(list(code))) AS codes, count(*) AS n FROM c GROUP BY ALL
), g AS (SELECT patient_id, month, said, any_value(codes) AS codes, any_value(n)::INT AS n_values, string_agg(report, ',' ORDER BY report) AS reports, min(report) AS first FROM r GROUP BY ALL
), p AS (SELECT *, row_number() OVER w AS group_no, first_value(codes) OVER w AS own FROM g WINDOW w AS (PARTITION BY patient_id, month ORDER BY first))
SELECT patient_id, month, group_no, reports, n_values, CASE WHEN group_no = 1 THEN 'first' WHEN codes = own THEN 'same_indicators' WHEN list_has_all(own, codes) THEN 'part' WHEN list_has_all(codes, own) THEN 'wider' WHEN list_has_any(codes, own) THEN 'overlapping' ELSE 'apart' END AS relation FROM p
"""


@query(_OBS + _GROUPS)
def report_groups(spark, d):
    # a month's reports, with values in steps of 50
    cells = _cells(spark, d).where("state <> 'insufficient'").withColumn("shown_value", F.round(F.col("shown_value") / 50)).withColumn("month", F.trunc("observation_date", "month"))
    return views.report_groups(cells, ["patient_id", "month"]).withColumn("reports", F.array_join("reports", ","))


@query(_OBS + ", v AS (SELECT * FROM obs WHERE confidence >= 0.8) SELECT standard_code, count(*) AS visible, count(*) FILTER (WHERE confidence >= 0.9) AS named, count(*) FILTER (WHERE confidence >= 0.95) AS trend FROM v GROUP BY standard_code")
def confidence_gates(spark, d):
    o = observations(spark, d).where(records.visible(F.col("confidence")))
    return o.groupBy("standard_code").agg(F.count(F.lit(1)).alias("visible"), F.count_if(F.col("confidence") >= records.NAMED).alias("named"), F.count_if(F.col("confidence") >= records.TREND).alias("trend"))


@query(_OBS + ", s AS (SELECT observation_id, confidence AS c, CASE WHEN institution <> '' THEN confidence + 0.1 END AS ev FROM obs WHERE method_raw <> '') SELECT observation_id FROM s WHERE c < 0.8 OR ev < 0.9 OR ev IS NULL")
def unreliable_dates(spark, d):
    o = observations(spark, d).where("method_raw <> ''").withColumn("ev", F.when(F.col("institution") != "", F.col("confidence") + 0.1))
    return o.where(records.unreliable_date(F.col("confidence"), F.col("ev") - 0.1)).select("observation_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 1000")
def label_search(spark, d):
    labels = {"O": "Open order", "P": "Pending", "F": "Finished"}
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").where(views.label_matches(F.col("o_orderstatus"), labels, "PEN") & (F.col("o_totalprice") > 1000)).select("o_orderkey")


@query("SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'A') THEN 'DOCUMENT' WHEN bool_and(l_returnflag = 'R') THEN 'NON_DOCUMENT' ELSE 'UNCERTAIN' END AS status FROM lineitem GROUP BY l_orderkey")
def page_rollup(spark, d):
    status = F.when(F.col("l_returnflag") == "A", "DOCUMENT").when(F.col("l_returnflag") == "R", "NON_DOCUMENT").otherwise("UNCERTAIN")
    return table(spark, d, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(views.material_status(status).alias("status"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x::DOUBLE > m))::INT AS bits FROM (SELECT *, list_median(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings)")
def median_bits(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    # the median is a field of a struct, so that it is found once for each vector
    counted = F.transform(F.array(F.struct("v", views.array_median(F.col("v")).alias("m"))), lambda s: F.size(F.filter(s["v"], lambda x: x > s["m"])))
    return e.select("vec_id", counted[0].alias("bits"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE AS before, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS after FROM orders")
def month_arithmetic(spark, d):
    m = dates.month_of(F.col("o_orderdate"))
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", m.alias("month"), F.add_months(m, -1).alias("before"), F.add_months(m, 1).alias("after"))


@query("SELECT event_id, strftime(date_trunc('second', ts - INTERVAL 8 HOURS), '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def local_to_utc(spark, d):
    return table(spark, d, "events", "event_id", "ts").select("event_id", dates.canonical_utc(F.col("ts"), "Asia/Shanghai").alias("at"))


@query("WITH p AS (SELECT l_orderkey, l_shipdate::DATE AS day, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority FROM lineitem), b AS (SELECT *, min(priority) OVER (PARTITION BY l_orderkey) AS best FROM p) SELECT l_orderkey, CASE WHEN count(DISTINCT CASE WHEN priority = best THEN day END) = 1 THEN min(CASE WHEN priority = best THEN day END) END AS day, count(*) AS n_candidates FROM b GROUP BY l_orderkey")
def date_by_label(spark, d):
    label = F.when(F.col("l_returnflag") == "R", "采样日期").when(F.col("l_returnflag") == "A", "报告日期").otherwise("日期")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_shipdate").select("l_orderkey", label.alias("label"), F.to_date("l_shipdate").alias("day"))
    return views.date_by_label(lines, ["l_orderkey"], "label", "day", F.lit("LAB"))


@query("WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), w AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS was, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS hour, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) - 1 AS day FROM e) SELECT event_id, coalesce(was > t - 60000000, false) AS cooling, hour >= 5 AS over_hour, day >= 15 AS over_day FROM w")
def durable_limits(spark, d):
    return views.durable_limits(table(spark, d, "events", "event_id", "user_id", "ts"), "event_id", "user_id", "ts")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS code FROM customer")
def tokenised_lookup(spark, d):
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    aliases = n.select("n_name", "n_nationkey").union(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "n_nationkey")).toDF("alias", "code")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    raw = c.select("c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("  N"), ((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25).cast("string")).alias("raw"))
    return joins.tokenised_lookup(raw, "c_custkey", "raw", aliases)


@query("WITH b AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS processing, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) SELECT o_custkey, total, processing, completed, failed, CASE WHEN processing > 0 THEN 'PROCESSING' WHEN failed = total THEN 'FAILED' WHEN failed > 0 THEN 'PARTIAL' ELSE 'COMPLETED' END AS main_status FROM b WHERE processing > 0 OR last >= TIMESTAMP '2001-06-01'")
def task_cards(spark, d):
    state = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    items = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderdate").select("o_custkey", state.alias("state"), F.col("o_orderdate").alias("at"))
    return views.task_cards(items, "o_custkey", F.lit("2001-06-01").cast("timestamp_ntz"))


@query("WITH g AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day), c AS (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT day, datediff('day', DATE '2024-01-01', day)::INT // 7 AS week, isodow(day)::INT AS weekday, month(day) = 1 AS in_month, CASE WHEN month(day) = 1 THEN coalesce(n, 0) ELSE 0 END AS n, CASE WHEN month(day) = 1 THEN coalesce(kinds, 0) ELSE 0 END AS kinds FROM g LEFT JOIN c USING (day)")
def month_view(spark, d):
    e = table(spark, d, "events", "user_id", "ts", "event_type").where("user_id % 2 = 0").select(F.to_date("ts").alias("day"), F.col("event_type").alias("kind"))
    return views.month_view(e, "2024-01-01")


@query("WITH r AS (SELECT o_custkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '5' THEN NULL ELSE 'B' END AS profile, o_totalprice > 20000 AS eligible FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice < 100000) SELECT c_custkey, CASE WHEN reason = 'reported_diagnosis' THEN profile ELSE 'GENERAL' END AS profile, reason FROM (SELECT c_custkey, min(profile) AS profile, CASE WHEN count(o_custkey) = 0 THEN 'no_reported_diagnosis' WHEN count(DISTINCT coalesce(profile, '-')) > 1 THEN 'reported_diagnoses_differ' WHEN count(profile) = 0 THEN 'unsupported_reported_diagnosis' WHEN NOT bool_and(eligible) THEN 'original_review_required' ELSE 'reported_diagnosis' END AS reason FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY c_custkey)")
def profile_resolution(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").where("o_orderstatus <> 'P' AND o_totalprice < 100000")
    first = F.left("o_orderpriority", F.lit(1))
    said = o.select(F.col("o_custkey").alias("c_custkey"), F.when(first == "1", "A").when(first != "5", "B").alias("profile"), (F.col("o_totalprice") > 20000).alias("eligible"))
    return views.profile_resolution(table(spark, d, "customer", "c_custkey"), said, "c_custkey")


@query("SELECT rule, count(*) AS assessed, count(*) FILTER (WHERE a) AS applicable, count(*) FILTER (WHERE a AND t) AS triggered, CASE WHEN count(*) FILTER (WHERE a) > 0 THEN 'exercised' ELSE 'not_evaluated' END AS status FROM (SELECT 'late' AS rule, l_returnflag = 'R' AS a, l_shipdate > TIMESTAMP '1998-01-01' AS t FROM lineitem UNION ALL SELECT 'small', l_quantity < 10, l_discount > 0.05 FROM lineitem UNION ALL SELECT 'none', l_quantity < 0, true FROM lineitem) GROUP BY rule")
def rule_coverage(spark, d):
    c = F.col
    rules = [("late", c("l_returnflag") == "R", c("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz")), ("small", c("l_quantity") < 10, c("l_discount") > 0.05), ("none", c("l_quantity") < 0, F.lit(True))]
    return views.rule_coverage(table(spark, d, "lineitem", "l_returnflag", "l_shipdate", "l_quantity", "l_discount"), rules)


@query("SELECT o_custkey, sha256(string_agg('{' || concat_ws(',', '\"o_orderkey\":' || o_orderkey, '\"o_orderstatus\":\"' || o_orderstatus || '\"') || '}', chr(10) ORDER BY o_orderkey NULLS FIRST)) AS fingerprint FROM orders GROUP BY o_custkey")
def dependency_fingerprint(spark, d):
    from ledgerline.operators import aggregates

    return aggregates.fingerprint(table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderstatus"], "o_orderkey")


POINTS = """
WITH p AS (SELECT event_id, user_id AS lesion, (props->>'$.k')::INT AS k, ts::DATE AS day, value, user_id || '/' || ts::DATE AS report FROM events WHERE event_type = 'view'),
m AS (SELECT event_id AS observation_id, CASE WHEN k % 9 = 0 THEN NULL ELSE lesion END AS lesion_id, CASE WHEN k % 3 = 0 THEN 'SUV' ELSE 'DIMENSION' END AS kind, CASE WHEN k % 4 = 0 THEN '' ELSE 'long' END AS axis, CASE WHEN k % 5 = 0 THEN 'cm' ELSE 'mm' END AS unit, CASE WHEN k % 13 = 0 THEN NULL ELSE day END AS day, value, CASE WHEN k % 8 = 0 THEN 'LT' ELSE 'EQ' END AS comparator, CASE WHEN k % 6 = 0 THEN 'PRIOR' ELSE 'CURRENT' END AS role, CASE WHEN k % 7 = 0 THEN '' ELSE 'CT' END AS method, report AS report_id, k % 17 = 0 AS field_conflict FROM p),
o AS (SELECT *, list_filter([CASE WHEN lesion_id IS NULL THEN 'unassigned_observation' END, CASE WHEN role <> 'CURRENT' THEN 'historical_or_unknown_role' END, CASE WHEN comparator <> 'EQ' THEN 'bounded_value' END, CASE WHEN field_conflict THEN 'field_conflict' END, CASE WHEN day IS NULL THEN 'date_unreliable' END, CASE WHEN method = '' THEN 'method_unknown' END, CASE WHEN kind = 'DIMENSION' AND axis = '' THEN 'axis_unknown' END, CASE WHEN kind = 'DIMENSION' AND unit <> 'mm' THEN 'unit_unrecognized' END], lambda x: x IS NOT NULL) AS own,
  day IS NOT NULL AND count(*) FILTER (WHERE day IS NOT NULL AND role = 'CURRENT') OVER (PARTITION BY lesion_id, kind, axis, day) > 1 AS twice FROM m),
l AS (SELECT *, lag(observation_id) OVER s AS p_id, lag(own) OVER s AS p_own, lag(twice) OVER s AS p_twice, lag(value) OVER s AS p_value, lag(day) OVER s AS p_day, lag(method) OVER s AS p_method, lag(unit) OVER s AS p_unit, lag(report_id) OVER s AS p_report FROM o WINDOW s AS (PARTITION BY lesion_id, kind, axis ORDER BY day NULLS LAST, observation_id)),
q AS (SELECT *, list_distinct(p_own || own || list_filter([CASE WHEN report_id = p_report THEN 'same_report' END, CASE WHEN method <> p_method THEN 'method_changed' END, CASE WHEN unit <> p_unit THEN 'unit_changed' END, CASE WHEN p_day >= day THEN 'date_not_later' END, CASE WHEN twice OR p_twice THEN 'ambiguous_measurement' END], lambda x: x IS NOT NULL)) AS reasons FROM l)
"""


def points(spark, d) -> DataFrame:
    k = F.col("k")
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value", "props").where("event_type = 'view'").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.select(
        F.col("event_id").alias("observation_id"),
        F.when(k % 9 != 0, F.col("user_id")).alias("lesion_id"),
        F.when(k % 3 == 0, "SUV").otherwise("DIMENSION").alias("kind"),
        F.when(k % 4 == 0, "").otherwise("long").alias("axis"),
        F.when(k % 5 == 0, "cm").otherwise("mm").alias("unit"),
        F.when(k % 13 != 0, F.to_date("ts")).alias("day"),
        "value",
        F.when(k % 8 == 0, "LT").otherwise("EQ").alias("comparator"),
        F.when(k % 6 == 0, "PRIOR").otherwise("CURRENT").alias("role"),
        F.when(k % 7 == 0, "").otherwise("CT").alias("method"),
        F.concat_ws("/", "user_id", F.to_date("ts")).alias("report_id"),
        (k % 17 == 0).alias("field_conflict"),
    )


@query(POINTS + "SELECT observation_id, p_id AS previous_id, CASE WHEN p_id IS NOT NULL THEN list_sort(reasons) END AS reasons, CASE WHEN p_id IS NOT NULL AND len(reasons) = 0 THEN round(value - p_value, 6) END AS delta FROM q")
def measurement_changes(spark, d):
    return records.measurement_changes(points(spark, d)).select("observation_id", "previous_id", F.array_sort("reasons").alias("reasons"), F.round("delta", 6).alias("delta"))


@query("WITH rep AS (SELECT o_orderkey AS report_id, o_custkey AS patient_id, substr(o_orderpriority, 1, 1) AS nr, o_orderdate AS t FROM orders WHERE o_orderpriority <> '5-LOW'), v AS (SELECT DISTINCT l_orderkey AS report_id, l_returnflag AS code, l_linestatus AS result FROM lineitem), s AS (SELECT report_id, code, list(result ORDER BY result) AS res FROM v GROUP BY ALL), p AS (SELECT a.report_id AS l, b.report_id AS r, a.t = b.t AS same_time FROM rep a JOIN rep b ON a.patient_id = b.patient_id AND a.nr = b.nr AND a.report_id < b.report_id), f AS (SELECT l, r, bool_or(x.res <> y.res) AS conflict, count(*) AS overlap FROM p JOIN s x ON x.report_id = l JOIN s y ON y.report_id = r AND x.code = y.code GROUP BY ALL) SELECT l AS \"left\", r AS \"right\", coalesce(conflict, false) AS conflict, coalesce(overlap, 0) AS overlap, CASE WHEN coalesce(conflict, false) OR NOT same_time THEN 'REVIEW' ELSE 'AUTO' END AS state FROM p LEFT JOIN f USING (l, r)")
def report_pairs(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    reports = o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("patient_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.left("o_orderpriority", F.lit(1))).alias("report_number"), F.col("o_orderdate").alias("sampled_at"))
    results = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").select(F.col("l_orderkey").alias("report_id"), F.col("l_returnflag").alias("standard_code"), F.col("l_linestatus").alias("result"))
    return records.report_pairs(reports, results).select("left", "right", "conflict", "overlap", "state")


@query("WITH p AS (SELECT l_orderkey, l_linenumber AS page, l_partkey, CASE WHEN l_linenumber = 1 OR l_returnflag = 'R' THEN date_trunc('month', l_shipdate) END AS t FROM lineitem), one AS (SELECT DISTINCT l_orderkey, page, t FROM p WHERE (SELECT count(*) FROM p q WHERE q.l_orderkey = p.l_orderkey AND q.page = 1) = 1), f AS (SELECT l_orderkey, max(CASE WHEN page = 1 THEN t END) AS donor, count(DISTINCT t) AS n FROM one GROUP BY l_orderkey) SELECT l_orderkey AS report_number, page AS page_index, coalesce(t, CASE WHEN n = 1 THEN donor END)::TIMESTAMP AS sampled_at, t IS NULL AND n = 1 AND donor IS NOT NULL AS borrowed FROM one JOIN f USING (l_orderkey)")
def donated_times(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    single = lines.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    at = F.when((F.col("l_linenumber") == 1) | (F.col("l_returnflag") == "R"), F.date_trunc("month", "l_shipdate"))
    pages = lines.join(single, "l_orderkey", "left_semi").select(F.lit("p").alias("patient_id"), F.col("l_orderkey").alias("report_number"), F.col("l_linenumber").alias("page_index"), at.alias("sampled_at")).distinct()
    return records.donated_times(pages).select("report_number", "page_index", F.col("sampled_at").cast("timestamp_ntz").alias("sampled_at"), "borrowed")
