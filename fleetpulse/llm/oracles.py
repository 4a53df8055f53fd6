"""SQL of the training-data queries that SQL can express, each held against its query row by row."""

from __future__ import annotations

EXACT_DEDUP = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

#: Damage, faults, then one row for each state after each message; strings stand where the operator has integers.
CONVERSATION_REPAIR = r"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c : ord(c)::BIGINT)),
               lambda crc, byte : list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i : xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))) % 20 AS fault
      FROM conversations),
    damaged AS MATERIALIZED (
      SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM keyed WHERE fault <> 0),
    placed AS (SELECT *, row_number() OVER c AS i, lag(left(role, 1)) OVER c || left(role, 1) AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
               FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    told AS MATERIALIZED (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
                     WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS kind
      FROM placed),
    steps AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) t(state, initial, next)),
    fills AS (SELECT * FROM (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a'), (0, 3, 'ua'), (1, 3, 'ua')) t(state, next, roles)),
    edges AS MATERIALIZED (
      SELECT state, next AS to, 'D' AS letter, '' AS initial, 4 + 3 * len(roles) AS cost, roles FROM fills
      UNION ALL SELECT f.state, s.next, 'K', s.initial, 3 * len(roles), roles FROM fills f JOIN steps s ON f.next = s.state
      UNION ALL SELECT f.state, s.next, 'R', s.initial, 3 + 3 * len(roles), roles FROM fills f JOIN steps s ON f.next = s.state WHERE s.initial <> 's'),
    walk AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS done FROM told
      UNION ALL
      SELECT w.conv_id, t.i, e.to, min(w.cost + e.cost + CASE WHEN kind = 3 AND letter <> 'D' THEN 3 ELSE 0 END),
             arg_min(audit || repeat('I', len(roles)) || letter, {'c': w.cost + e.cost + CASE WHEN kind = 3 AND letter <> 'D' THEN 3 ELSE 0 END, 'a': audit || repeat('I', len(roles)) || letter}),
             arg_min(done || list_transform(string_split(roles, ''), lambda r : CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[1:len(roles)]
                     || CASE letter WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE e.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END,
                     {'c': w.cost + e.cost + CASE WHEN kind = 3 AND letter <> 'D' THEN 3 ELSE 0 END, 'a': audit || repeat('I', len(roles)) || letter})
      FROM walk w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1
      JOIN edges e ON e.state = w.state AND (letter = 'D' OR kind IN (0, 3) AND (letter = 'R' OR e.initial = left(role, 1)))
      GROUP BY w.conv_id, t.i, e.to),
    facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank, count(*) FILTER (kind = 2) AS duplicate,
                     count(*) FILTER (kind = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
              FROM told GROUP BY conv_id),
    ends AS (SELECT w.conv_id, w.cost + 3 * len(roles) AS cost, audit || repeat('I', len(roles)) AS audit, done || list_transform(string_split(roles, ''), lambda r : CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[1:len(roles)] AS done
             FROM walk w JOIN facts f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.n JOIN fills USING (state) WHERE next IN (0, 3)),
    least AS (SELECT conv_id, min(cost) AS cost, arg_min(audit, {'c': cost, 'a': audit}) AS audit, arg_min(done, {'c': cost, 'a': audit}) AS done FROM ends GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(done, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON o.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN least l ON o.conv_id IS NOT DISTINCT FROM l.conv_id"""

_ASSIGNED = """
    a{k} AS MATERIALIZED (
      SELECT vec_id, p, any_value(x) AS x, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d
      FROM (SELECT v.vec_id, v.p, v.x, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i : (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d FROM parts v JOIN b{k} b USING (p))
      GROUP BY vec_id, p),"""
_AVERAGED = """
    m{k} AS (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i) GROUP BY p, e),
    b{n} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (p, e)),"""

#: Every distance, where the operator searches; ids are unique in the driver's tables.
VECTOR_CODES = """
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x : CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept CROSS JOIN range(16) r(p)),
    b0 AS MATERIALIZED (SELECT p, e, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (vec_id)),""" + "".join(
    _ASSIGNED.format(k=k) + (_AVERAGED.format(k=k, n=k + 1) if k < 2 else "") for k in range(3)) + """
    codes AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
    SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
    FROM codes c JOIN kept USING (vec_id)"""
