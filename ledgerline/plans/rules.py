"""Dimensions, rules, conversions, validation, scores and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import numeric, text
from ledgerline.operators import aggregates, joins
from ledgerline.plans.registry import query
from ledgerline.sources.tables import table


@query("WITH d AS (SELECT p_type, count(DISTINCT p_brand) AS n, min(p_brand) AS b FROM part GROUP BY p_type) SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN b END AS p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN d USING (p_type)")
def dim_unique_lookup(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return joins.unique_lookup(lines, p.select("p_type", "p_brand"), ["p_type"], "p_brand").select("l_orderkey", "l_linenumber", "p_brand")


_BANDS = [("small", 1, 15), ("middle", 10, 35), ("large", 30, 50)]


@query("WITH r(band, low, high) AS (VALUES ('small', 1, 15), ('middle', 10, 35), ('large', 30, 50)) SELECT p_partkey, CASE WHEN count(DISTINCT band) = 1 THEN min(band) END AS band FROM part LEFT JOIN r ON p_size BETWEEN low AND high GROUP BY p_partkey")
def conditional_range_lookup(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", joins.only_rule([(band, size.between(low, high)) for band, low, high in _BANDS]).alias("band"))


@query("WITH r(l_returnflag, factor) AS (VALUES ('A', 2.0), ('N', 0.5), ('N', 0.5)), o AS (SELECT l_returnflag, count(*) AS n, min(factor) AS factor FROM r GROUP BY 1) SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN 'converted' WHEN o.l_returnflag IS NULL THEN 'direct' ELSE 'insufficient' END AS state, round(CASE WHEN n = 1 THEN l_quantity * factor WHEN o.l_returnflag IS NULL THEN l_quantity END, 4)::DOUBLE AS value FROM lineitem LEFT JOIN o USING (l_returnflag)")
def unit_conversion_rules(spark, d):
    hits = F.filter(F.array(*(F.when(F.col("l_returnflag") == flag, F.lit(factor)) for flag, factor in [("A", 2.0), ("N", 0.5), ("N", 0.5)])), lambda x: x.isNotNull())
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").withColumn("hits", hits).withColumns({"n": F.nullif(F.size("hits"), F.lit(0)), "factor": F.array_min("hits")})
    state = F.when(F.col("n") == 1, "converted").when(F.col("n").isNull(), "direct").otherwise("insufficient")
    value = F.when(F.col("n") == 1, F.col("l_quantity") * F.col("factor")).when(F.col("n").isNull(), F.col("l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", state.alias("state"), F.round(value, 4).alias("value"))


@query("SELECT o_orderkey, round(s, 2) AS parts_sum, n AS n_parts, abs(s - o_totalprice) <= 50000 AS holds FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def component_sum_check(spark, d):
    parts = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice").withColumnRenamed("l_orderkey", "o_orderkey")
    got = joins.component_sums(table(spark, d, "orders", "o_orderkey", "o_totalprice"), parts, "o_orderkey", "o_totalprice", "l_extendedprice", 50000)
    return got.select("o_orderkey", F.round("parts_sum", 2).alias("parts_sum"), "n_parts", "holds")


@query("SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' WHEN n <= 100 THEN '21-100' WHEN n <= 300 THEN '101-300' ELSE '301+' END AS bucket, count(*) AS n_users FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) GROUP BY 1")
def bucketize_counts(spark, d):
    per = table(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(numeric.bucket(F.col("n"), [0, 5, 20, 100, 300], ["0", "1-5", "6-20", "21-100", "101-300", "301+"]).alias("bucket")).agg(F.count(F.lit(1)).alias("n_users"))


@query("WITH m AS (SELECT 'events_total' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'mean_value', round(avg(value), 4) FROM events) SELECT 'too_many' AS alert, metric, value, value > 1000 AS firing FROM m WHERE metric = 'events_total' UNION ALL SELECT 'too_high', metric, value, value > 1e9 FROM m WHERE metric = 'mean_value'")
def threshold_alerts(spark, d):
    e = table(spark, d, "events", "value").agg(F.count(F.lit(1)).cast("double").alias("a"), F.round(F.avg("value"), 4).alias("b"))
    metrics = e.select(F.inline(F.array(F.struct(F.lit("events_total").alias("metric"), F.col("a").alias("value")), F.struct(F.lit("mean_value").alias("metric"), F.col("b").alias("value")))))
    return aggregates.alerts(metrics, [("too_many", "events_total", 1000.0), ("too_high", "mean_value", 1e9)])


_PRF = "count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn"


@query(f"SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT lang, {_PRF} FROM (SELECT lang, quality = 1 AS t, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)) GROUP BY lang)")
def prf_scores(spark, d):
    both = table(spark, d, "labels", "doc_id", "quality").join(table(spark, d, "documents", "doc_id", "lang", "n_chars"), "doc_id")
    return aggregates.scores(both, ["lang"], F.col("quality") == 1, F.col("n_chars") > 1000)


@query(f"WITH s AS (SELECT lang, k, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM (SELECT lang, k, {_PRF} FROM (SELECT lang, k, quality = 1 AS t, n_chars > k AS p FROM labels JOIN documents USING (doc_id), (VALUES (1000), (1500)) v(k)) GROUP BY lang, k)), j AS (SELECT coalesce(a.lang, b.lang) AS lang, round(a.f1, 6) AS now, round(b.f1, 6) AS base FROM (SELECT * FROM s WHERE k = 1000) a FULL JOIN (SELECT * FROM s WHERE k = 1500) b USING (lang)) SELECT lang, now, base, round(now - base, 6) AS delta, coalesce(round(now - base, 6) >= -0.01, false) AS passes FROM j")
def metric_delta_gate(spark, d):
    both = table(spark, d, "labels", "doc_id", "quality").join(table(spark, d, "documents", "doc_id", "lang", "n_chars"), "doc_id")
    now, base = (aggregates.scores(both, ["lang"], F.col("quality") == 1, F.col("n_chars") > k) for k in (1000, 1500))
    return aggregates.gate(now, base, "lang", "f1", 0.01)


@query("WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 4 WHEN 0 THEN '10--30' WHEN 1 THEN '<=24.50' WHEN 2 THEN '12 ~ 40.0' ELSE 'n/a' END AS ref FROM lineitem) SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_quantity < 10 THEN 'below' WHEN l_quantity > 30 THEN 'above' ELSE 'within' END WHEN 1 THEN CASE WHEN l_quantity > 24.5 THEN 'above' ELSE 'within' END WHEN 2 THEN CASE WHEN l_quantity < 12 THEN 'below' WHEN l_quantity > 40 THEN 'above' ELSE 'within' END ELSE 'unavailable' END AS state FROM v")
def range_parse_compare(spark, d):
    k = F.col("l_linenumber") % 4
    ref = F.when(k == 0, "10--30").when(k == 1, "≤24.50").when(k == 2, "12 ~ 40.0").otherwise("n/a")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumn("r", text.parse_reference(ref))
    return lines.select("l_orderkey", "l_linenumber", text.compare_to_reference(F.col("l_quantity"), F.col("r.low"), F.col("r.high"), F.col("r.comparator")).alias("state"))


@query("SELECT l_orderkey, l_linenumber, list_filter(['low_quantity', 'no_discount', 'late'], lambda c: CASE c WHEN 'low_quantity' THEN l_quantity < 5 WHEN 'no_discount' THEN l_discount = 0 ELSE l_shipdate > TIMESTAMP '1998-01-01' END) AS issues FROM lineitem")
def validation_issues(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate")
    rules = [("low_quantity", F.col("l_quantity") < 5), ("no_discount", F.col("l_discount") == 0), ("late", F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz"))]
    return lines.select("l_orderkey", "l_linenumber", F.filter(F.array(*(F.when(c, name) for name, c in rules)), lambda x: x.isNotNull()).alias("issues"))


@query("SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal / 1000 ELSE c_acctbal * 0.45359237 END, 6) AS kg FROM customer")
def quantity_units(spark, d):
    unit = F.when(F.col("c_custkey") % 3 == 0, "kg").when(F.col("c_custkey") % 3 == 1, "g").otherwise("lb")
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.round(numeric.quantity(F.col("c_acctbal"), unit), 6).alias("kg"))


@query("SELECT p_partkey, p_partkey::VARCHAR AS canonical, try_cast(p_partkey::VARCHAR || '.50' AS DECIMAL(28,10))::DOUBLE AS value FROM part")
def safe_numbers(spark, d):
    raw = F.concat(F.lit("+00"), F.col("p_partkey").cast("string"), F.lit(".500"))
    whole = F.concat(F.lit("00"), F.col("p_partkey").cast("string"), F.lit(".000"))
    return table(spark, d, "part", "p_partkey").select("p_partkey", numeric.canonical_number(whole).alias("canonical"), numeric.safe_decimal(raw).cast("double").alias("value"))


@query("SELECT s_nationkey, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT s_nationkey, (s_suppkey % 3) AS v, count(*) AS n FROM supplier GROUP BY ALL) GROUP BY s_nationkey")
def histogram_entropy(spark, d):
    s = table(spark, d, "supplier", "s_nationkey", "s_suppkey").withColumn("v", F.col("s_suppkey") % 3)
    return aggregates.entropy(s, ["s_nationkey"], "v").select("s_nationkey", F.round("entropy", 6).alias("entropy"))


@query("WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS x, l_discount AS y FROM lineitem) SELECT l_orderkey, l_linenumber, round((x + 0.2) * 0.5, 6)::DOUBLE AS area, (CASE WHEN y < 0.05 THEN x >= 0.1 AND x < 0.9 ELSE false END) AS inside, round(CASE WHEN x > 0 THEN (least(x, 0.9) - 0.1 + abs(least(x, 0.9) - 0.1)) / 2 * 0.5 / (x * 0.5 + 0.4 - (least(x, 0.9) - 0.1 + abs(least(x, 0.9) - 0.1)) / 2 * 0.5) END, 6)::DOUBLE AS iou FROM b")
def polygon_checks(spark, d):
    from ledgerline.functions import geometry

    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    square = F.array(point(0.1, 0.0), point(0.9, 0.0), point(0.9, 0.5), point(0.1, 0.5))
    small = F.array(point(0.1, 0.0), point(0.9, 0.0), point(0.9, 0.05), point(0.1, 0.05))
    x = F.col("l_quantity") / 50.0
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    slanted = F.array(corner(F.lit(0.0), 0.0), corner(x, 0.0), corner(x + 0.1, 0.5), corner(F.lit(-0.3), 0.5))
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), x.alias("x1"), F.lit(0.5).alias("y1"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return lines.select("l_orderkey", "l_linenumber", F.round(geometry.area(slanted), 6).alias("area"), geometry.contains_point(small, x, F.col("l_discount")).alias("inside"), F.round(geometry.iou(box, geometry.box(square)), 6).alias("iou"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NOT NULL THEN printf('%.1f', l_quantity) END AS value, CASE WHEN l_quantity IS NOT NULL THEN ['g/L', '10^9 / L', 'mmol/L', ''][l_partkey % 4 + 1] END AS unit, CASE WHEN l_quantity IS NOT NULL THEN ['10--30', '≤ 24.50', '12 ~ 40.0', ''][l_suppkey % 4 + 1] END AS reference, CASE WHEN l_quantity IS NOT NULL THEN coalesce(CASE l_returnflag WHEN 'A' THEN 'H' WHEN 'R' THEN '↓' END, '') END AS flag FROM lineitem""")
def result_tail(spark, d):
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col(k) % len(xs) + 1).cast("int"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    unit, reference = pick("l_partkey", "g/L", "10^9 / L", "mmol/L", ""), pick("l_suppkey", "10--30", "≤ 24.50", "12 ~ 40.0", "")
    printed = F.when(F.col("l_quantity").isNotNull(), F.concat_ws("  ", F.format_string("%.1f", "l_quantity"), unit, reference, F.when(F.col("l_returnflag") == "A", "H").when(F.col("l_returnflag") == "R", "↓")))
    return lines.select("l_orderkey", "l_linenumber", text.result_tail(printed).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


_RULES = [(0, "M", None, None, None, 1, 10), (0, "F", None, None, None, 2, 9), (1, None, None, 17, None, 3, 8), (1, None, 18, 40, None, 4, 7), (1, None, 35, None, None, 5, 6), (2, None, None, None, "FOLLICULAR", 6, 12), (2, None, None, None, "LUTEAL", 7, 13), (3, None, None, None, None, 8, 14), (4, None, 20, 90, None, 9, 15), (4, "F", None, None, "LUTEAL", 1, 2)]
_RULE_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in _RULES)


@query(
    f"""WITH r(code, sex, from_age, to_age, phase, low, high) AS (VALUES {_RULE_ROWS}), o AS (
  SELECT o_orderkey, o_orderkey % 5 AS code, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' END AS sex, CASE o_orderpriority WHEN '1-URGENT' THEN 'FOLLICULAR' WHEN '2-HIGH' THEN 'LUTEAL' END AS phase,
    date_sub('year', make_date(1950 + c_custkey % 45, 1 + c_custkey % 12, 15), o_orderdate::DATE) AS age FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), h AS (SELECT o_orderkey, low, high FROM o JOIN r ON r.code = o.code AND CASE WHEN r.phase IS NOT NULL THEN o.sex = 'F' AND r.phase = o.phase ELSE (r.sex IS NULL OR r.sex = o.sex) AND ((from_age IS NULL AND to_age IS NULL) OR age BETWEEN coalesce(from_age, 0) AND coalesce(to_age, 1000)) END)
, n AS (SELECT o_orderkey, min(low) AS low, min(high) AS high FROM h GROUP BY o_orderkey HAVING count(*) = 1)
SELECT o_orderkey, low, high FROM o LEFT JOIN n USING (o_orderkey)"""
)
def patient_reference(spark, d):
    from ledgerline.functions import dates

    c = F.col
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(table(spark, d, "customer", "c_custkey"), c("c_custkey") == c("o_custkey"), "left")
    rules = spark.createDataFrame(_RULES, "code long, sex string, from_age int, to_age int, phase string, low int, high int")
    sex = F.when(c("c_custkey") % 3 == 0, "M").when(c("c_custkey") % 3 == 1, "F")
    birth = F.make_date((1950 + c("c_custkey") % 45).cast("int"), (1 + c("c_custkey") % 12).cast("int"), F.lit(15))
    phase = F.when(c("o_orderpriority") == "1-URGENT", "FOLLICULAR").when(c("o_orderpriority") == "2-HIGH", "LUTEAL")
    found = joins.patient_range(o.withColumn("item", c("o_orderkey") % 5), rules, "item", sex, dates.completed_years(birth, c("o_orderdate").cast("date")), phase)
    return found.select("o_orderkey", "low", "high")


_ASKED = """
WITH e AS (SELECT DISTINCT 'n' || s_nationkey AS alias, s_suppkey AS code, ['URINE', 'STOOL', 'BLOOD'][s_suppkey % 3 + 1] AS specimen, ['血常规', '炎症三项', '生化'][s_suppkey % 5 % 3 + 1] AS category FROM supplier WHERE s_suppkey IS NOT NULL), c AS (
  SELECT c_custkey, 'n' || c_nationkey AS alias, CASE c_custkey % 7 WHEN 0 THEN 'URINE' WHEN 1 THEN 'BLOOD' WHEN 2 THEN 'STOOL' END AS said, CASE WHEN c_custkey % 5 = 0 THEN 'URINE' WHEN c_custkey % 5 = 3 THEN 'STOOL' END AS told, CASE c_custkey % 5 WHEN 1 THEN '血常规' WHEN 2 THEN '炎症三项' END AS panel FROM customer
), f AS (SELECT c.*, code, specimen, category, count(*) OVER (PARTITION BY c_custkey) AS n FROM c JOIN e ON e.alias = c.alias AND (said IS NULL OR specimen = said)
), k AS (SELECT c_custkey, code FROM f WHERE n = 1 OR (told IS NULL AND panel IS NULL) OR CASE WHEN told IS NOT NULL THEN specimen = told ELSE category = panel END
), g AS (SELECT c_custkey, min(code) AS code FROM k GROUP BY c_custkey HAVING count(*) = 1)
SELECT c_custkey, g.code FROM c LEFT JOIN g USING (c_custkey)
"""


@query(_ASKED)
def panel_lookup(spark, d):
    c = F.col
    pick = lambda k, *xs: F.get(F.array(*(F.lit(x).cast("string") for x in xs)), k.cast("int"))
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    entries = s.select(F.concat(F.lit("N"), "s_nationkey").alias("alias"), c("s_suppkey").alias("code"), pick(c("s_suppkey") % 3, "URINE", "STOOL", "BLOOD").alias("specimen"), pick(c("s_suppkey") % 5 % 3, "血常规", "炎症三项", "生化").alias("category"))
    names = table(spark, d, "customer", "c_custkey", "c_nationkey")
    specimen = pick(c("c_custkey") % 7, "尿液", "血清", "大便", "UNKNOWN", "", None, "UNSPECIFIED")
    panel = pick(c("c_custkey") % 5, "尿常规", "血常规（急诊）", "INFLAMMATION", "STOOL", None)
    return joins.dictionary_lookup(names, entries, F.concat(F.lit("* n "), "c_nationkey"), specimen, panel).select("c_custkey", "code")
