"""DuckDB SQL for the queries whose results SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (
  SELECT rid, dw.m, i, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win
), n AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid
), its AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items
  FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN its USING (rid)
"""

OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars,
         length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) AS role_chars,
         role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN opens THEN role_chars + 24 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op5_decontaminate": OP5, "op10_chat": OP10}

OP2 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

ORACLES["op2_warc"] = OP2

OP13 = """
WITH c AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), digits AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base,
         list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
                        lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS UBIGINT)) AS bytes
  FROM c
), h AS (
  SELECT conv_id, own, base, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS UBIGINT[])), lambda x, k:
      xor(x >> 1, (x & 1) * CAST(3988292384 AS UBIGINT)))), CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h
  FROM digits
), b AS (
  SELECT h.conv_id, list_concat(coalesce(c.own, h.own[1:0])[1:h.h], h.own[h.h + 1:]) AS turns
  FROM h LEFT JOIN c ON c.conv_id = h.base
), p AS (
  SELECT conv_id, d, turns[1:d] AS pre, len(turns) AS n, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)
), nodes AS (
  SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM p GROUP BY pre, d
), kids AS (
  SELECT pre[1:d - 1] AS pre, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL
), up AS (
  SELECT pre[1:a] AS pre, sum(cost) AS saved, count(*) FILTER (k IS NULL) AS leaves
  FROM (SELECT pre, (n_convs - 1) * chars AS cost, k, unnest(range(0, d + 1)) AS a FROM nodes LEFT JOIN kids USING (pre))
  GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(k, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN up USING (pre) LEFT JOIN kids USING (pre)
LEFT JOIN nodes parent ON n.d > 0 AND parent.pre = n.pre[1:n.d - 1]
"""

ORACLES["op13_prefix_trie"] = OP13
