"""DuckDB SQL for the queries that SQL can express; written from the contracts, not from the plans."""

from .chat import ChatParams

MIX = r"""
WITH doc AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM doc GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((number - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total FROM src
), lv AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS own_level
  FROM weighed WINDOW b AS (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), tgt AS (SELECT *, least(cap, weight * max(own_level) OVER ()) AS target, ceil(total / 32)::BIGINT AS house FROM lv
), src_quotients AS (
  SELECT number, house, target / (2 * k + 1) AS q, k FROM tgt, LATERAL (SELECT unnest(generate_series(0, ceil(house * target / greatest(total, 1))::BIGINT + 50)) AS k) WHERE target > 0
), src_seats AS (SELECT number, count(*) AS blocks FROM (SELECT * FROM src_quotients QUALIFY row_number() OVER (ORDER BY q DESC, number, k) <= house) GROUP BY number
), quota AS (SELECT t.*, coalesce(blocks, 0) AS blocks, least(ceil(n_docs / 1000.0), 4096)::BIGINT AS shards FROM tgt t LEFT JOIN src_seats USING (number)
), placed AS (
  SELECT d.*, q.number, q.source_size, q.target, ('0x' || substr(ord, 1, 8))::BIGINT % q.shards AS shard FROM doc d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source
), shard AS (SELECT number, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY number, shard
), shard_house AS (SELECT s.*, q.blocks, q.source_size FROM shard s JOIN quota q USING (number)
), shard_quotients AS (
  SELECT number, shard, blocks, shard_size / (2 * k + 1) AS q, k FROM shard_house, LATERAL (SELECT unnest(generate_series(0, ceil(blocks * shard_size / source_size)::BIGINT + 50)) AS k) WHERE shard_size > 0
), shard_seats AS (SELECT number, shard, count(*) AS quota FROM (SELECT * FROM shard_quotients QUALIFY row_number() OVER (PARTITION BY number ORDER BY q DESC, shard, k) <= blocks) GROUP BY number, shard
), chosen AS (
  SELECT number, shard, whole, least(coalesce(quota, 0), 3 * whole) AS quota, ('0x' || substr(md5('mix/' || number || '/' || shard), 1, 8))::BIGINT % whole AS run_from
  FROM (SELECT *, greatest(ceil(shard_size / 32.0), 1)::BIGINT AS whole FROM shard) LEFT JOIN shard_seats USING (number, shard)
), laid AS (
  SELECT p.*, sum(size) OVER (PARTITION BY p.number, p.shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING) AS hi, quota // whole AS passes, run_from * 32 AS a, (run_from + quota % whole) * 32 AS b, whole * 32 AS n
  FROM placed p JOIN chosen c ON p.number = c.number AND p.shard = c.shard
)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(hi, least(b, n)) - greatest(hi - size, a)) + greatest(0, least(hi, b - n) - (hi - size)))::BIGINT AS taken FROM laid
"""

_C = ChatParams()

# A window's new turns, context and text are reckoned turn by turn in a recursion over the spans' numbers, without the plan's windows.
CHAT = rf"""
WITH RECURSIVE turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), coded AS (
  SELECT *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) + {_C.overhead} AS tokens,
    length(replace(replace(replace(body, '\', '\b'), '###', '\h'), '</turn>', '\t')) + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + length('### ' || ': ' || '</turn>' || chr(10)) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body) AS pos
  FROM turn
), conv AS (
  SELECT conv_id, list({{'role': role, 'tokens': tokens, 'chars': chars}} ORDER BY pos) AS line, min(CASE WHEN role = 'system' THEN pos END) AS sys FROM coded GROUP BY conv_id
), room AS (
  SELECT *, coalesce(line[sys].tokens, 0) AS kept, greatest(({_C.budget} - {_C.history_tokens} - coalesce(line[sys].tokens, 0)) // 2, 1) AS half FROM conv
), summed AS (
  SELECT *, list_transform(range(1, len(line) + 1), lambda i: list_sum(list_transform(line[1:i], lambda x: x.tokens))::BIGINT - line[i].tokens) AS before FROM room
), walk AS (
  SELECT conv_id, 1 AS pos, 1 AS span FROM summed
  UNION ALL
  SELECT w.conv_id, w.pos + 1, w.span + CASE WHEN line[pos + 1].tokens > half OR line[pos].tokens > half OR before[pos + 1] // half <> before[pos] // half THEN 1 ELSE 0 END
  FROM walk w JOIN summed USING (conv_id) WHERE w.pos < len(line)
), known AS (
  SELECT c.*, w.span, s.sys, s.kept, max(w.span) OVER (PARTITION BY conv_id) AS spans, sum(tokens) OVER (PARTITION BY conv_id, w.span ORDER BY c.pos DESC) AS back_tokens, count(*) OVER (PARTITION BY conv_id, w.span ORDER BY c.pos DESC) AS back_turns
  FROM coded c JOIN walk w USING (conv_id, pos) JOIN summed s USING (conv_id)
), following AS (SELECT conv_id, span - 1 AS span, sum(tokens) AS next FROM known GROUP BY conv_id, span
), shown AS (
  SELECT known.*, 1 + CASE WHEN pos IS NOT DISTINCT FROM sys THEN spans - span WHEN span < spans AND back_turns <= {_C.history_turns} AND back_tokens <= least({_C.history_tokens}, {_C.budget} - kept - next) THEN 1 ELSE 0 END AS times FROM known LEFT JOIN following USING (conv_id, span)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY pos)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(body, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars * times)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5
"""


def _clusters(k: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64) -> str:
    """Each round compares every vector with every centroid, without bounds; the rounds are written out one after the other."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS number, e FROM (SELECT e, sha256('3:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, e LIMIT {k}))",
    ]
    near = "SELECT row, arg_min(number, (d, number)) AS number, min(d) AS d FROM (SELECT row, number, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{} c) GROUP BY row"
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        parts.append(
            f"""c{i + 1} AS MATERIALIZED (
  SELECT c.number, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (
    SELECT number, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS e
    FROM (SELECT number, place, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.number, unnest(v.e) AS x, unnest(range(1, {width + 1})) AS place FROM v JOIN a{i} a USING (row)) GROUP BY number, place) GROUP BY number
  ) m USING (number)
)"""
        )
    return f"""WITH {", ".join(parts)}, last AS MATERIALIZED ({near.format(rounds)})
SELECT v.vec_id, l.number::INT AS cluster, l.d AS distance, sum(l.d) OVER (PARTITION BY l.number)::BIGINT AS cluster_inertia, sum(l.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM v JOIN last l USING (row) JOIN c{rounds} c ON c.number = l.number
"""


CLUSTERS = _clusters()
