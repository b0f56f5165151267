"""Text, JSON, arrays, digests and near matches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.functions import crypto, text
from ledgerline.operators import joins, series
from ledgerline.plans.registry import query
from ledgerline.sources.tables import EVENT_PROPS, table


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents")
def exact_dedup_first(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("h"))
    # texts that are null are one text
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("h", "of")
    return docs.join(first, F.col("h").eqNullSafe(F.col("of"))).select("doc_id", "first_id")


_HALF = "list_sum(list_transform(range({0}, {0} + 32), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << (i - {0})::INT) ELSE 0::BIGINT END))::BIGINT"


@query(f"WITH s AS (SELECT vec_id, {_HALF.format(0)} AS a, {_HALF.format(32)} AS b FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT x.vec_id AS left, y.vec_id AS right, (bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b)))::INT AS distance FROM s x JOIN s y ON x.vec_id < y.vec_id) SELECT * FROM p WHERE distance <= 8")
def embedding_sign_hamming(spark, d):
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    v = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", bits.alias("bits"))
    return joins.hamming_within(v.where("bits IS NOT NULL"), v.where("bits IS NOT NULL"), "bits", "vec_id", 8)


@query("WITH p AS (SELECT doc_id, text, length(text) AS n, position('license' IN lower(text)) AS pos FROM documents), s AS (SELECT *, greatest(1, pos - 66) AS b FROM p) SELECT doc_id, n, CASE WHEN pos > 0 THEN CASE WHEN b > 1 THEN '…' ELSE '' END || substring(text, b::INT, 140) || CASE WHEN b + 139 < n THEN '…' ELSE '' END END AS hit FROM s")
def search_excerpt(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.length("text").alias("n"), text.excerpt(F.col("text"), "license").alias("hit"))


@query("WITH h AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1), lambda x: trim(x)), lambda x: x <> '') AS a FROM pages) SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, a[1] AS heading FROM h")
def title_from_heading(spark, d):
    p = table(spark, d, "pages", "page_id", "html")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return p.select("page_id", F.when(title != "", title).alias("title"), text.heading_title(F.col("html"), most=1, suffix="").alias("heading"))


@query("WITH n AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '<h[1-3][^>]*>([^<]*)</h[1-3]>', 1), lambda x: trim(x)), lambda x: x <> '') AS a FROM pages), u AS (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM n) SELECT page_id, CASE WHEN len(a) > 0 THEN array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' and more' ELSE '' END END AS title FROM u")
def title_from_headings(spark, d):
    return table(spark, d, "pages", "page_id", "html").select("page_id", text.heading_title(F.col("html")).alias("title"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN 'other' WHEN regexp_matches(text, '(?i)license') THEN 'legal' WHEN regexp_matches(text, '@') THEN 'contact' WHEN regexp_matches(text, '!!') THEN 'shout' ELSE 'other' END AS kind FROM documents")
def keyword_classifier(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.first_match(F.col("text"), [("legal", "(?i)license"), ("contact", "@"), ("shout", "!!")], "other").alias("kind"))


@query(r"WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS clause FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(clause, '(?:^|[^\p{L}])(?:not|no|nicht|pas)(?:$|[^\p{L}])')) AS negated, count(*) FILTER (WHERE regexp_matches(clause, '(?:^|[^\p{L}])(?:may|or|oder|ou)(?:$|[^\p{L}])') AND NOT regexp_matches(clause, '(?:^|[^\p{L}])(?:not|no|nicht|pas)(?:$|[^\p{L}])')) AS uncertain FROM c WHERE length(trim(clause)) > 0 GROUP BY doc_id")
def negation_assertion(spark, d):
    # each text's clauses in an array of their own: no row leaves its task
    no = lambda c: c.rlike(r"(?:^|[^\p{L}])(?:not|no|nicht|pas)(?:$|[^\p{L}])")
    maybe = lambda c: c.rlike(r"(?:^|[^\p{L}])(?:may|or|oder|ou)(?:$|[^\p{L}])")
    said = F.filter(F.split("text", r"[.\n]", -1), lambda c: F.length(F.trim(c)) > 0)
    kinds = F.transform(said, lambda c: F.when(no(c), "negated").when(maybe(c), "uncertain").otherwise(""))
    count = lambda kind: F.size(F.filter("kinds", lambda x: x == kind)).cast("long").alias(kind)
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0).select("doc_id", count("negated"), count("uncertain"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(w, '^\s*[=+\-@]') THEN '''' || w ELSE w END AS guarded FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' || text WHEN 1 THEN ' +' || text ELSE text END AS w FROM documents)")
def csv_guard(spark, d):
    w = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" +"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.csv_guard(w).alias("guarded"))


@query("SELECT doc_id, sha256(text) AS digest, sha256(sha256('k' || text)) AS keyed FROM documents")
def sha_digest(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.sha2(F.concat(F.lit("k"), "text"), 256), 256).alias("keyed"))


_KEY = b"ledgerline"
_PAD = "unhex('{}')"
_INNER, _OUTER = (_PAD.format(bytes(b ^ pad for b in _KEY.ljust(64, b"\0")).hex()) for pad in (0x36, 0x5C))


@query(
    f"WITH h AS (SELECT c_custkey, c_name, sha256({_OUTER} || unhex(sha256({_INNER} || encode(c_name)))) AS pseudonym, sha1({_PAD.format(uuid.NAMESPACE_URL.hex)} || encode(c_name)) AS s FROM customer) "
    "SELECT c_custkey, pseudonym, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', s[17]) - 1) % 4 + 1, 1) || s[18:20] || '-' || s[21:32] AS stable_id, c_name AS folded FROM h"
)
def keyed_pseudonyms(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name")
    return c.select("c_custkey", crypto.hmac_sha256(_KEY, F.col("c_name")).alias("pseudonym"), crypto.uuid5(uuid.NAMESPACE_URL, F.col("c_name")).alias("stable_id"), text.folded(F.col("c_name")).alias("folded"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_keys(props) = ['k'] AS closed FROM events")
def json_props_extract(spark, d):
    e = table(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.from_json("props", EVENT_PROPS)["k"].alias("k"), (F.json_object_keys("props") == F.array(F.lit("k"))).alias("closed"))


@query("SELECT conv_id, turn, ord, w[ord] AS word FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), LATERAL (SELECT unnest(generate_series(1, len(w))) AS ord)")
def explode_linked_tables(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("ord", "word")).select("conv_id", "turn", (F.col("ord") + 1).cast("long").alias("ord"), "word")


@query(r'''SELECT page_id, len(regexp_extract_all(html, 'https?://[^\s"''<>]+')) AS n_links, position('http' IN regexp_replace(html, 'https?://[^\s"''<>]+', '[link]', 'g')) > 0 AS rest FROM pages''')
def url_redaction(spark, d):
    clean = text.redact_urls(F.col("html"))
    return table(spark, d, "pages", "page_id", "html").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))).alias("n_links"), (F.instr(clean, F.lit("http")) > 0).alias("rest"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents) SELECT doc_id, len(list_distinct(a)) AS n_distinct, list_has_any(a, ['the', 'der', 'de']) AS any_article, NOT list_has_any(a, ['of', 'und']) AS disjoint, len(list_filter(a, lambda x: length(x) > 4)) AS n_long FROM w")
def array_set_ops(spark, d):
    a = F.col("a")
    w = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.split("text", " ").alias("a"))
    lits = lambda *x: F.array(*map(F.lit, x))
    return w.select("doc_id", F.size(F.array_distinct(a)).alias("n_distinct"), F.arrays_overlap(a, lits("the", "der", "de")).alias("any_article"), (~F.arrays_overlap(a, lits("of", "und"))).alias("disjoint"), F.size(F.filter(a, lambda x: F.length(x) > 4)).alias("n_long"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def document_census(spark, d):
    return table(spark, d, "documents", "doc_id", "source", "lang", "n_chars").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"))


@query("SELECT conv_id, count(*) AS turns, coalesce(string_agg(role, '>' ORDER BY turn), '') AS roles FROM conversations GROUP BY conv_id")
def conversation_shape(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "role")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"))


@query("""SELECT o_orderkey, '{"o_custkey":' || coalesce(o_custkey::VARCHAR, 'null') || ',"o_orderkey":' || coalesce(o_orderkey::VARCHAR, 'null') || ',"o_totalprice":' || coalesce(o_totalprice::VARCHAR, 'null') || '}' AS line FROM orders""")
def portable_json(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    from ledgerline.sources.sinks import canonical_json

    return o.select("o_orderkey", canonical_json(o).alias("line"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderpriority = '5-LOW'")
def page_ordinals(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority").where("o_orderpriority = '5-LOW'")
    return series.numbered(o, ["o_custkey"], "o_orderkey", out="place").select("o_orderkey", "place")

