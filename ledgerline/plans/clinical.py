"""Contexts over graphs of records, report units, findings in report lines, exports of a scope."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.operators import contexts
from ledgerline.plans.registry import query
from ledgerline.plans.relational import CLUSTERS
from ledgerline.sources.tables import table

# Links from an event to earlier (and few later) ones of its user; every step of the walk is a row of its own.
_CONTEXT = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id::VARCHAR AS scope, coalesce((props->>'$.k')::INT, 0) AS k, lag(event_id) OVER w AS one, lag(event_id, 3) OVER w AS three, lead(event_id) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), node AS (
  SELECT event_id AS node, scope, CASE WHEN k % 13 = 0 THEN 'EXCLUDED' WHEN k % 9 = 1 THEN 'PENDING' ELSE 'CONFIRMED' END AS status, k % 41 <> 7 AS valid FROM e WHERE event_id IS NOT NULL
), link AS (
  SELECT event_id AS node, 'SPECIMEN' AS role, one AS target, 'S' || one % 3 AS entity FROM e WHERE k % 3 = 1
  UNION SELECT event_id, 'ASSAY', CASE WHEN k % 5 > 0 THEN three END, 'A' || three % 50 FROM e WHERE k % 4 = 2
  UNION SELECT event_id, 'MARKER', later, 'M' FROM e WHERE k % 37 = 5
  UNION SELECT event_id, 'MARKER', event_id - 1, 'N' FROM e WHERE k % 43 = 1
), tied AS (
  SELECT l.*, l.target IS NOT NULL AND (t.node IS NULL OR t.scope <> n.scope OR t.node = l.node) AS bad, coalesce(t.status = 'EXCLUDED', false) AS excluded FROM link l JOIN node n ON n.node = l.node LEFT JOIN node t ON t.node = l.target
), step AS (SELECT DISTINCT node, target FROM tied WHERE target IS NOT NULL AND NOT bad
), walk AS (SELECT node AS root, target AS at_, 1 AS depth FROM step UNION SELECT root, target, depth + 1 FROM walk JOIN step ON at_ = node WHERE depth < 9
), reach AS (SELECT DISTINCT root, at_ FROM walk
), many AS (SELECT root FROM reach GROUP BY root HAVING count(*) > 32
), ring AS (SELECT DISTINCT root FROM reach WHERE at_ IN (SELECT root FROM reach WHERE root = at_ AND root NOT IN (FROM many))
), deep AS (SELECT DISTINCT root FROM walk WHERE depth = 9
), bound AS (
  SELECT node AS root, role, entity FROM tied WHERE target IS NOT NULL AND NOT bad AND entity IS NOT NULL UNION SELECT root, role, entity FROM reach JOIN tied ON node = at_ WHERE target IS NOT NULL AND NOT bad AND entity IS NOT NULL
), merged AS (SELECT root, count(*) > count(DISTINCT role) AS torn, string_agg(role || '=' || entity, ',' ORDER BY role, entity) AS context FROM bound GROUP BY root
), own AS (SELECT node AS root, bool_or(bad) AS bad, bool_or(excluded) AS excluded, bool_or(target IS NULL) AS unknown FROM tied GROUP BY node
), below AS (
  SELECT r.root, list(at_ ORDER BY at_) AS dependencies, bool_or(coalesce(o.bad, false)) AS bad, bool_or(NOT n.valid) AS source, bool_or(n.status <> 'CONFIRMED' OR coalesce(o.unknown, false)) AS open FROM reach r JOIN node n ON n.node = at_ LEFT JOIN own o ON o.root = at_ GROUP BY r.root
), found AS (
  SELECT n.node, m.context, b.dependencies, o.excluded, o.unknown, b.open,
    CASE WHEN n.node IN (FROM many) THEN 'too_many' WHEN n.node IN (FROM ring) THEN 'cycle' WHEN n.node IN (FROM deep) THEN 'too_deep' WHEN coalesce(o.bad, false) OR coalesce(b.bad, false) THEN 'bad_link' WHEN b.source THEN 'source' WHEN m.torn THEN 'conflict' END AS reason
  FROM node n LEFT JOIN own o ON o.root = n.node LEFT JOIN below b ON b.root = n.node LEFT JOIN merged m ON m.root = n.node
), shown AS (SELECT *, coalesce(reason IN ('too_many', 'cycle', 'too_deep'), false) AS stopped FROM found)
SELECT node, CASE WHEN reason IS NOT NULL THEN 'INVALID' WHEN excluded THEN 'EXCLUDED' WHEN unknown THEN 'UNLINKED' WHEN open THEN 'UNREVIEWED' ELSE 'RESOLVED' END AS state, reason,
  CASE WHEN stopped THEN 0 ELSE coalesce(len(dependencies), 0) END::INT AS n_dependencies, CASE WHEN stopped THEN '' ELSE coalesce(array_to_string(dependencies, ','), '') END AS dependencies, CASE WHEN stopped THEN '' ELSE coalesce(context, '') END AS context
FROM shown
"""


@query(_CONTEXT)
def context_states(spark, d):
    c, k = F.col, F.col("k")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events", "event_id", "user_id", "ts", "props").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)))
    e = e.select("event_id", c("user_id").cast("string").alias("scope"), "k", F.lag("event_id").over(w).alias("one"), F.lag("event_id", 3).over(w).alias("three"), F.lead("event_id").over(w).alias("later"))
    nodes = e.select(c("event_id").alias("node"), "scope", F.when(k % 13 == 0, "EXCLUDED").when(k % 9 == 1, "PENDING").otherwise("CONFIRMED").alias("status"), (k % 41 != 7).alias("source_valid"))
    tied = lambda on, role, target, entity: F.when(on, F.struct(F.lit(role).alias("role"), target.alias("target"), entity.alias("entity")))
    name = lambda x, at: F.concat(F.lit(x), at.cast("string"))
    bindings = F.array(
        tied(k % 3 == 1, "SPECIMEN", c("one"), name("S", c("one") % 3)),
        tied(k % 4 == 2, "ASSAY", F.when(k % 5 > 0, c("three")), name("A", c("three") % 50)),
        tied(k % 37 == 5, "MARKER", c("later"), F.lit("M")),
        tied(k % 43 == 1, "MARKER", c("event_id") - 1, F.lit("N")),
    )
    links = e.select(c("event_id").alias("node"), F.explode(F.filter(bindings, lambda x: x.isNotNull())).alias("x")).select("node", "x.*")
    found = contexts.resolve(nodes, links)
    return found.withColumn("dependencies", F.array_join("dependencies", ",")).withColumn("context", F.array_join(F.transform("context", lambda x: F.concat_ws("=", x["role"], x["entity"])), ","))


# Borders from joins of numbered lines, each by the line it looks at.
_UNITS = """
WITH r AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'signup' AS title, event_type = 'view' AND k % 2 = 0 AS head, event_type = 'click' AS marker, event_type = 'purchase' AS result, event_type = 'error' AS counter
  FROM (SELECT *, coalesce((props->>'$.k')::INT, 0) AS k FROM events)
), t AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM r WHERE title
), up1 AS (SELECT t.user_id, t.n, t.n - CASE WHEN a.head THEN 1 ELSE 0 END AS p FROM t LEFT JOIN r a ON a.user_id = t.user_id AND a.n = t.n - 1 WHERE k > 1
), up2 AS (SELECT u.user_id, u.n, u.p, coalesce(a.counter, false) AS moved FROM up1 u LEFT JOIN r a ON a.user_id = u.user_id AND a.n = u.p - 1
), up3 AS (SELECT u.user_id, CASE WHEN moved THEN p - 1 - CASE WHEN a.head AND NOT a.title THEN 1 ELSE 0 END ELSE p END AS p FROM up2 u LEFT JOIN r a ON a.user_id = u.user_id AND a.n = u.p - 2
), firsts AS (SELECT DISTINCT user_id, p FROM up3 WHERE p > 1
), parts AS (SELECT r.*, (SELECT count(*) FROM firsts f WHERE f.user_id = r.user_id AND f.p <= r.n) AS part FROM r
), marks AS (
  SELECT m.user_id, m.part, m.n, max(x.n) AS prior FROM parts m JOIN parts x ON x.user_id = m.user_id AND x.part = m.part AND x.n < m.n AND x.result WHERE m.marker AND EXISTS (FROM parts y WHERE y.user_id = m.user_id AND y.part = m.part AND y.n > m.n AND y.result) GROUP BY ALL
), cuts AS (
  SELECT user_id, part, prior, min(n) AS n FROM marks m WHERE EXISTS (FROM parts z WHERE z.user_id = m.user_id AND z.part = m.part AND z.marker AND z.n < m.prior) GROUP BY ALL
), begins AS (
  SELECT c.user_id, coalesce((SELECT max(h.n) FROM parts h WHERE h.user_id = c.user_id AND h.head AND h.n > c.prior AND h.n < c.n), c.n) AS p FROM cuts c UNION SELECT user_id, p FROM firsts
)
SELECT event_id, (1 + (SELECT count(*) FROM begins b WHERE b.user_id = r.user_id AND b.p <= r.n))::INT AS unit FROM r
"""


@query(_UNITS)
def report_units(spark, d):
    k, kind = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)), F.col("event_type")
    lines = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "props")
    signs = {"title": kind == "signup", "head": (kind == "view") & (k % 2 == 0), "marker": kind == "click", "result": kind == "purchase", "counter": kind == "error"}
    return contexts.units(lines.withColumns(signs), "user_id", ["ts", "event_id"]).select("event_id", "unit")


# The findings of lines that are made from events, from the events themselves: what stands where, and how many anchors a page has.
_FINDINGS = """
WITH e AS (
  SELECT event_id, user_id || '/' || ts::DATE AS page, event_type, coalesce((props->>'$.k')::INT, 0) AS k, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS n FROM events
), s AS (
  SELECT *, coalesce(last_value(CASE WHEN event_type = 'error' THEN false WHEN event_type = 'purchase' THEN true END IGNORE NULLS) OVER (PARTITION BY page ORDER BY n), true) AS counts FROM e
), spec AS (SELECT page, 'S' || k % 2 AS raw, min(event_id) AS line FROM s WHERE counts AND event_type = 'signup' GROUP BY ALL
), anchored AS (SELECT page, count(*) AS specimens FROM spec GROUP BY page
), assays AS (SELECT page, count(*) AS assays FROM s WHERE counts AND event_type = 'view' GROUP BY page
), stained AS (
  SELECT s.*, coalesce(specimens, 0) = 1 AS bound_specimen, coalesce(assays, 0) = 1 AS bound_assay FROM s LEFT JOIN anchored USING (page) LEFT JOIN assays USING (page) WHERE counts AND event_type = 'click'
)
SELECT page, line, 'specimen.identity' AS key, 5 AS start, 7 AS "end", raw, '' AS links FROM spec
UNION ALL SELECT s.page, event_id, 'assay.identity', 5, 12, 'PD-L1检测', CASE WHEN specimens = 1 THEN 'specimen' ELSE '' END FROM s LEFT JOIN anchored USING (page) WHERE counts AND event_type = 'view'
UNION ALL SELECT page, event_id, 'ihc.marker', 0, 5, 'PD-L1', concat_ws(',', CASE WHEN bound_specimen THEN 'specimen' END, CASE WHEN bound_assay THEN 'assay' END) FROM stained
UNION ALL SELECT page, event_id, CASE WHEN k % 3 = 0 THEN 'ihc.result' ELSE 'ihc.score' END, 6, CASE WHEN k % 3 = 0 THEN 8 ELSE 11 + length(k::VARCHAR) END, CASE WHEN k % 3 = 0 THEN '阳性' ELSE 'TPS:' || k || '%' END, concat_ws(',', CASE WHEN bound_specimen THEN 'specimen' END, CASE WHEN bound_assay THEN 'assay' END, 'marker') FROM stained
"""


@query(_FINDINGS)
def pathology_findings(spark, d):
    from ledgerline.operators import findings

    k, kind = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)), F.col("event_type")
    text = F.when(kind == "signup", F.concat(F.lit("标本编号:S"), (k % 2).cast("string"))).when(kind == "view", "检测项目:PD-L1检测").when(kind == "error", "质控结果:").when(kind == "purchase", "检测结果:")
    text = F.coalesce(text, F.when(kind == "click", F.when(k % 3 == 0, "PD-L1:阳性").otherwise(F.concat(F.lit("PD-L1 TPS:"), k.cast("string"), F.lit("%")))))
    lines = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "props").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("page"), F.col("event_id").alias("line"), text.alias("text"))
    links = F.concat_ws(",", *(F.when(F.col(x).isNotNull(), x) for x in ("specimen", "assay", "marker")))
    return findings.pathology(lines).select("page", "line", "key", "start", "end", "raw", links.alias("links"))


_ROWS = """
WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) AND o_orderdate <= TIMESTAMP '1997-01-01'),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)),
k AS (
  SELECT 'customer' AS "table", c_custkey::VARCHAR AS key FROM c UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM o UNION ALL SELECT 'lineitem', l_orderkey || '/' || l_linenumber FROM l UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM s
  UNION ALL SELECT 'part', p_partkey::VARCHAR FROM part WHERE p_partkey IN (SELECT l_partkey FROM l) UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM n UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)
)
"""
_WORDS = " || ',' || ".join(f"sum(('0x' || substr(sha256(key), {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(_ROWS + f'SELECT "table", count(*) AS n_rows, sha256({_WORDS}) AS digest FROM k GROUP BY "table"')
def export_snapshot(spark, d):
    from ledgerline.operators import snapshot
    from ledgerline.operators.snapshot import Reference

    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"]}
    tables = {t: table(spark, d, t) for t in keys}
    # orders as they were known at the cut
    tables["orders"] = snapshot.as_of(tables["orders"], keys["orders"], "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    references = [
        Reference("orders", ("o_custkey",), "customer", owned=True),
        Reference("lineitem", ("l_orderkey",), "orders", owned=True),
        Reference("lineitem", ("l_partkey",), "part"),
        Reference("lineitem", ("l_suppkey",), "supplier"),
        Reference("customer", ("c_nationkey",), "nation"),
        Reference("supplier", ("s_nationkey",), "nation"),
        Reference("nation", ("n_regionkey",), "region"),
    ]
    found = snapshot.closure(tables, keys, references, {"customer": tables["customer"].where("c_mktsegment = 'BUILDING'")})
    return snapshot.manifest(found.tables, keys)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1")
def polled_latest(spark, d):
    from ledgerline.operators.joins import scratch
    from ledgerline.streaming import polling

    # the stream is read to its end in micro-batches, each of which upserts
    source = f"{d}/events.parquet*"  # a file or a folder
    rows = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(source)
    sink, keys, order = scratch(spark, "polled"), ["user_id", "event_type"], ["ts", "event_id"]
    polling.poll(stream, f"{sink}/rows", f"{sink}/state", keys, order).awaitTermination()
    return polling.current(spark, f"{sink}/rows", rows.schema, keys, order).select("user_id", "event_type", "event_id")


# Rows of a grid that are made from events: what a row has is reckoned from the last header, heading and gene before it.
_VARIANTS = """
WITH e AS (
  SELECT event_id, concat_ws('/', user_id, date_trunc('month', ts)::DATE) AS page, event_type AS kind, coalesce((props->>'$.k')::INT, 0) AS k FROM events
), s AS (
  SELECT *, last_value(CASE WHEN kind = 'signup' THEN true WHEN kind = 'error' THEN false END IGNORE NULLS) OVER w AS under, last_value(CASE WHEN kind = 'error' THEN k % 2 END IGNORE NULLS) OVER w AS heading, coalesce(bool_or(kind = 'error' AND k % 2 = 1) OVER w, false) AS somatic,
    sum(CASE WHEN kind IN ('signup', 'error') THEN 1 ELSE 0 END) OVER w AS part FROM e WINDOW w AS (PARTITION BY page ORDER BY event_id)
), g AS (
  SELECT *, last_value(CASE WHEN kind = 'view' THEN ['EGFR', 'KRAS', 'MET'][k % 3 + 1] END IGNORE NULLS) OVER (PARTITION BY page, part ORDER BY event_id) AS gene FROM s
)
SELECT page, event_id AS row, CASE heading WHEN 0 THEN 'HISTORICAL' ELSE 'CURRENT' END AS role, CASE WHEN somatic THEN 'SOMATIC' ELSE 'UNKNOWN' END AS scope,
  CASE WHEN kind = 'click' AND k % 4 = 0 THEN 'UNRESOLVED' WHEN gene IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status, gene, 'p.L' || k || 'R' || CASE WHEN kind = 'click' AND k % 4 = 0 THEN ' | p.T' || k || 'M' ELSE '' END AS protein, 'EQ ' || k || '%' AS fraction
FROM g WHERE under AND kind IN ('view', 'click', 'purchase')
"""


@query(_VARIANTS)
def molecular_variants(spark, d):
    from ledgerline.operators import findings

    k, kind = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)), F.col("event_type")
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "props").withColumn("k", k)
    cell = lambda x, text: F.struct(F.lit(float(x)).alias("x"), text.alias("text"))
    change, number = F.concat(F.lit("p.L"), F.col("k"), F.lit("R")), F.concat(F.col("k"), F.lit("%"))
    row = F.when(kind == "signup", F.array(cell(0, F.lit("基因")), cell(4, F.lit("变异")), cell(8, F.lit("丰度")))).when(kind == "error", F.array(cell(0, F.when(F.col("k") % 2 == 0, "历史结果").otherwise("体细胞变异"))))
    row = row.when(kind == "view", F.array(cell(0, F.element_at(F.array(*map(F.lit, ("EGFR", "KRAS", "MET"))), F.col("k") % 3 + 1)), cell(4, change), cell(8, number)))
    row = row.when(kind == "click", F.array(cell(4, F.when(F.col("k") % 4 == 0, F.concat(change, F.lit(" p.T"), F.col("k"), F.lit("M"))).otherwise(change)), cell(8, number))).when(kind == "purchase", F.array(cell(4, change), cell(8, number)))
    cells = e.select(F.concat_ws("/", "user_id", F.trunc("ts", "month")).alias("page"), F.col("event_id").alias("row"), F.explode(row).alias("c")).select("page", "row", "c.*")
    return findings.molecular(cells).select("page", "row", "role", "scope", "status", "gene", "protein", "fraction")


_SUMS = ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::BIGINT AS x{i}" for i in range(8))
_TOKEN = "sha256(concat_ws(',', " + ", ".join(f"coalesce({t}.x{i}, 0)" for t in ("a", "b", "c") for i in range(8)) + "))"
_WORKSPACE = (
    CLUSTERS
    + f""", a AS (SELECT cluster, any_value(k.o_custkey) AS scope, count(*) AS n_units, {_SUMS} FROM (SELECT k.*, sha256(concat_ws('/', node, coalesce(o_orderstatus, ''))) AS h FROM k JOIN o ON o_orderkey = node) k GROUP BY cluster
), b AS (SELECT cluster, count(*) AS n_rows, count(*) FILTER (WHERE l_quantity > 45) AS n_problems, {_SUMS} FROM (SELECT cluster, l_quantity, sha256(concat_ws('/', l_orderkey, coalesce(l_linenumber::VARCHAR, ''), coalesce(l_returnflag, ''))) AS h FROM lineitem JOIN k ON node = l_orderkey) GROUP BY cluster
), p AS (SELECT x.o_custkey, x.o_orderkey AS l, y.o_orderkey AS r, CASE WHEN abs(x.o_totalprice - y.o_totalprice) < 100000 THEN 'JOINED' ELSE 'CONFLICT' END AS state FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND abs(x.o_totalprice - y.o_totalprice) < 110000
), c AS (SELECT cluster, bool_or(state = 'CONFLICT') AS clash, {_SUMS} FROM (SELECT DISTINCT cluster, state, sha256(l || '/' || r || '/' || state) AS h FROM p JOIN k ON node IN (l, r)) GROUP BY cluster
)
SELECT a.scope, a.cluster AS report, n_units, coalesce(n_rows, 0) AS n_rows, coalesce(clash, false) AS relation_conflict, coalesce(n_problems, 0) AS n_problems, {_TOKEN} AS token, a.cluster % 2 = 0 AS confirmed FROM a LEFT JOIN b USING (cluster) LEFT JOIN c USING (cluster)
"""
)


@query(_WORKSPACE)
def report_workspace(spark, d):
    from ledgerline.operators import joins, workspace

    c = F.col
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus").where("o_custkey IS NOT NULL AND o_orderkey IS NOT NULL")
    units = o.select(c("o_custkey").alias("scope"), c("o_orderkey").alias("unit"), c("o_orderstatus").alias("state"))
    other = o.select("o_custkey", c("o_orderkey").alias("right"), c("o_totalprice").alias("p"))
    apart = F.abs(c("o_totalprice") - c("p"))
    pairs = o.join(other, "o_custkey").where((c("o_orderkey") < c("right")) & (apart < 110000))
    relations = pairs.select(c("o_custkey").alias("scope"), c("o_orderkey").alias("left"), "right", F.when(apart < 100000, "JOINED").otherwise("CONFLICT").alias("state"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").select(c("l_orderkey").alias("unit"), c("l_linenumber").alias("row"), c("l_returnflag").alias("state"), (c("l_quantity") > 45).alias("problem"))
    found = joins.settled(workspace.reports(units, relations, rows))
    # reports of even numbers were confirmed as they are, all others as something else
    past = found.select("report", F.when(c("report") % 2 == 0, c("token")).otherwise("other").alias("token"), F.lit(1).cast("long").alias("at"))
    return workspace.with_confirmation(found, past)


_PLANTED = [
    ("http://user:pw@a.example.org/", "link_credentials", None),
    ("https://10.1.2.3/x", "link_private", None),
    ("https://8.8.8.8:8443/x", "", "8.8.8.8:8443"),
    ("http://[2001:4860:0:0::8888]:80/", "", "[2001:4860::8888]"),
    ("http://[fe80::1]/", "link_private", None),
    ("https://bücher.example.org/a", "", "xn--bcher-kva.example.org"),
    ("https://straße.example.org/", "", "xn--strae-oqa.example.org"),
    ("https://a.example.org/%zz", "link_unreadable", None),
    ("https://a.example.org/x?", "ambiguous_line_break", None),
    ("https://printer.local/", "link_host", None),
    ("HTTPS://A.Example.ORG:443/Q", "", "a.example.org"),
]
_VALUES = ", ".join(f"({i}, '{u}', '{r}', {'NULL' if x is None else repr(x)})" for i, (u, r, x) in enumerate(_PLANTED))


# Each page with its own address in brackets and one of the planted links behind it.
@query(
    f"""WITH v(k, link, reason, site) AS (VALUES {_VALUES}), p AS (SELECT page_id, length(coalesce(html, '')) AS n, coalesce(url, '') AS url, v.* FROM pages JOIN v ON page_id % {len(_PLANTED)} = k), r AS (
  SELECT page_id, 1 AS place, n + 2 AS start, url AS payload, '' AS reason, regexp_extract(url, '^https?://([^/?#]*)', 1) AS site FROM p WHERE url <> ''
  UNION ALL SELECT page_id, 2, n + 4 + length(url), link, reason, site FROM p)
SELECT page_id, payload, sha256(payload) AS digest, start::INT AS start, (start + length(payload))::INT AS "end", CASE WHEN reason = '' THEN 'URL' ELSE 'UNSUPPORTED' END AS kind, reason, site FROM r"""
)
def link_payloads(spark, d):
    from ledgerline.functions import links

    p = table(spark, d, "pages", "page_id", "url", "html")
    k = F.col("page_id") % len(_PLANTED)
    planted = F.get(F.array(*(F.lit(u) for u, *_ in _PLANTED)), k.cast("int"))
    said = F.concat(F.coalesce("html", F.lit("")), F.lit(" ("), F.coalesce("url", F.lit("")), F.lit(") "), planted, F.when(k == 8, "\nnext").otherwise(" next"))
    return links.payloads(p.select("page_id", said.alias("said")), "said").drop("length")


_SEARCHES = ["urgent", "part 17", "s9", "z1", "1995年3月", "finished", "BUILD", "20 kg", "n5"]
_SAID = """
WITH q(query) AS (VALUES {}), l AS (SELECT *, 1 - 2 * l_discount AS confidence FROM lineitem), z AS (
  SELECT l_orderkey, 'Z' || l_suppkey AS text FROM l WHERE l_tax > 0.03 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate DESC NULLS LAST, l_linenumber DESC NULLS LAST, l_suppkey DESC NULLS LAST) = 1
), s AS (
  SELECT o_orderkey, 0 AS place, 'file' AS name, 'order-' || o_orderkey || '.pdf' AS text FROM orders UNION ALL SELECT o_orderkey, 1, 'title', o_orderpriority FROM orders
  UNION ALL SELECT l_orderkey, 4, 'page', concat(l_returnflag, l_linestatus, ' part ', l_partkey) FROM l
  UNION ALL SELECT o_orderkey, 5, 'summary', c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT l_orderkey, 6, 'name', 'S' || l_suppkey FROM l WHERE confidence >= 0.9 UNION ALL SELECT l_orderkey, 7, 'standard', 'N' || l_suppkey % 7 FROM l WHERE confidence >= 0.95
  UNION ALL SELECT l_orderkey, 8, 'value', l_quantity::INT || ' kg' FROM l WHERE confidence >= 0.9 UNION ALL SELECT l_orderkey, 9, 'correction', text FROM z
), h AS (
  SELECT query, s.* FROM s JOIN q ON contains(lower(text), lower(query))
  UNION ALL SELECT query, o_orderkey, 2, 'status', t FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Pending' WHEN 'F' THEN 'Finished' END AS t FROM orders) JOIN q ON contains(lower(t), lower(query))
  UNION ALL SELECT query, o_orderkey, 3, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders JOIN q ON query = '1995年3月' WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3
)
SELECT query, o_orderkey, name AS found_in, text AS excerpt, name = 'correction' AS corrected FROM h WHERE o_orderkey IN (SELECT o_orderkey FROM orders) QUALIFY row_number() OVER (PARTITION BY query, o_orderkey ORDER BY place, text) = 1
""".format(", ".join(f"('{x}')" for x in _SEARCHES))


@query(_SAID)
def archive_search(spark, d):
    from ledgerline.operators import archive

    c, text = F.col, lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x)).alias("text")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    lines = lines.withColumnRenamed("l_orderkey", "o_orderkey").withColumn("confidence", 1 - 2 * c("l_discount"))
    customers = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    sure, surer = lines.where("confidence >= 0.9D"), lines.where("confidence >= 0.95D")
    said = {
        "page": lines.select("o_orderkey", F.concat_ws("", "l_returnflag", "l_linestatus", F.lit(" part "), "l_partkey").alias("text")),
        "summary": o.join(customers, c("c_custkey") == c("o_custkey")).select("o_orderkey", c("c_mktsegment").alias("text")),
        "name": sure.select("o_orderkey", text("S", c("l_suppkey"))),
        "standard": surer.select("o_orderkey", text("N", c("l_suppkey") % 7)),
        "value": sure.select("o_orderkey", text(c("l_quantity").cast("int"), " kg")),
    }
    fixes = lines.where("l_tax > 0.03D").select("o_orderkey", c("l_returnflag").alias("entity"), F.struct("l_shipdate", "l_linenumber", "l_suppkey").alias("sequence"), text("Z", c("l_suppkey")))
    own = {"file": text("order-", c("o_orderkey"), ".pdf"), "title": c("o_orderpriority")}
    labels = {"O": "Open", "P": "Pending", "F": "Finished"}

    met = {q: {"status": archive.named_by(c("o_orderstatus"), labels, q), "date": F.when(archive.on_date(c("o_orderdate"), q), F.date_format("o_orderdate", "yyyy-MM-dd"))} for q in _SEARCHES}
    return archive.searches(o, "o_orderkey", met, own, said, fixes)


# What is said of each kind of event, from the events themselves.
_SUBJECTS = """
WITH v(kind, term, start, "end", clause_start, clause_end, subject) AS (VALUES
  ('signup', '肺癌', 5, 7, 0, 7, 'CURRENT_PRIMARY'), ('view', '肺癌', 3, 5, 0, 15, 'OTHER_PERSON'), ('view', '胰腺癌', 12, 15, 0, 15, 'CURRENT_PRIMARY'),
  ('purchase', '肺癌', 4, 6, 0, 6, 'HISTORICAL'), ('purchase', '胰腺癌', 12, 15, 7, 15, 'CURRENT_PRIMARY'), ('error', '肺癌', 4, 6, 1, 8, 'METASTATIC_SITE')
), c AS (SELECT event_id, coalesce((props->>'$.k')::INT, 0) % 3 AS k, ts FROM events WHERE event_type = 'click' AND ts IS NOT NULL
), t AS (SELECT event_id, ts::DATE + (k - 1) AS day, ['HISTORICAL', 'CURRENT_PRIMARY', 'UNKNOWN'][k + 1] AS time FROM c)
SELECT event_id, term, start, "end", clause_start, clause_end, NULL::DATE AS day, NULL AS time, subject FROM events JOIN v ON kind = event_type
UNION ALL SELECT event_id, '肺癌', 15, 17, 0, 17, day, time, time FROM t
"""


@query(_SUBJECTS)
def narrative_subjects(spark, d):
    from ledgerline.functions import narrative

    kind, k = F.col("event_type"), F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    e = table(spark, d, "events", "event_id", "ts", "event_type", "props").withColumn("record", F.to_date("ts"))
    said = F.when(kind == "signup", "患者诊断为肺癌。").when(kind == "view", "父亲患肺癌,但患者确诊为胰腺癌").when(kind == "purchase", "1、既往肺癌；目前诊断为胰腺癌").when(kind == "error", "\n转移性肺癌可能")
    said = said.when(kind == "click", F.concat(F.date_format(F.date_add("record", k % 3 - 1), "yyyy年MM月dd日"), F.lit("CT提示肺癌")))
    return narrative.subjects(e.select("event_id", "record", said.alias("said")), "said", F.col("record"), F.lit("AUXILIARY_FINDINGS")).drop("record")


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_totalprice IS NULL) AS n_missing, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders")
def observed_export(spark, d):
    from ledgerline.operators.joins import scratch
    from ledgerline.sources.sinks import write_observed

    # the metrics of an export, from the pass that writes it
    price = F.col("o_totalprice")
    metrics = {"n_rows": F.count(F.lit(1)), "n_open": F.count_if(F.col("o_orderstatus") == "O"), "n_missing": F.count_if(price.isNull()), "total": F.sum(price.cast("decimal(18,2)")).cast("double"), "first": F.min("o_orderkey"), "last": F.max("o_orderkey")}
    seen = write_observed(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), scratch(spark, "observed"), metrics)
    return spark.createDataFrame([tuple(seen[x] for x in metrics)], "n_rows long, n_open long, n_missing long, total double, first long, last long")


_PRINTED = """
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, replace(p_brand, '#', 'x') AS b FROM part)
SELECT p_partkey, CASE WHEN b IS NULL OR k IS NULL THEN NULL WHEN k IN (0, 1) THEN b WHEN k = 2 THEN '白细胞 ' || b WHEN k = 3 THEN '患者姓名 ' || b WHEN k = 4 THEN b || ',结果' ELSE '' END AS name, b IS NULL OR k IS NULL OR k > 2 AS rejected FROM p
"""


@query(_PRINTED)
def candidate_names(spark, d):
    from ledgerline.functions import names

    p = table(spark, d, "part", "p_partkey", "p_brand")
    b, k = F.replace(F.col("p_brand"), F.lit("#"), F.lit("x")), F.col("p_partkey") % 6
    forms = [("1. ", " 5.2 ↑"), ("★", "：阴性"), ("白 细 胞 ", " H"), ("患者姓名 ", ""), ("", "，结果"), (" 阳性 ", "")]
    printed = F.get(F.array(*(F.concat(F.lit(x), b, F.lit(y)) for x, y in forms)), k.cast("int"))
    name = names.candidate_name(printed)
    return p.select("p_partkey", name.alias("name")).select("p_partkey", "name", names.no_name(F.col("name")).alias("rejected"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL OR o_orderkey IS NULL OR o_orderkey % 11 = 0 THEN 'source' WHEN o_orderkey % 13 = 0 THEN 'changed' WHEN o_orderstatus = 'P' THEN 'status' WHEN o_custkey % 7 = 0 THEN 'parent' WHEN (o_orderkey % 5 <> 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) THEN 'label' ELSE 'selectable' END AS state FROM orders""")
def selectable_candidates(spark, d):
    from ledgerline.functions import policy

    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), F.col
    status, parent = F.when(c("o_orderstatus") == "P", "EXCLUDED").otherwise("CONFIRMED"), F.when(c("o_custkey") % 7 == 0, "DEFERRED")
    valid = c("o_orderpriority").isNotNull() & (c("o_orderkey") % 11 != 0)
    state = policy.selectable(valid, c("o_orderkey") % 13 == 0, status, parent, c("o_orderpriority"), c("o_orderkey") % 5 == 0, ["1-URGENT", "2-HIGH"])
    return o.select("o_orderkey", state.alias("state"))
