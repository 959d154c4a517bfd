"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_warc"] = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, url, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT d.page_id, d.url, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_bytes >= 100 AND d.payload_digest = f.payload_digest
"""

ORACLE_SQL["op2_decontaminate"] = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (
    SELECT item_id, w, least(13, len(w)) AS n,
      unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
    FROM iw WHERE len(w) > 0)
), spot AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
    FROM dw CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), occ AS (
  SELECT doc_id, spot.n, p, item_id FROM spot JOIN win ON spot.n = win.n AND spot.s = win.s
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
    SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM occ))
  GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM occ)
  GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op6_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body
  FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""

ORACLE_SQL["op3_substring_dedup"] = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS s FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), gone AS (
  SELECT DISTINCT doc_id, q FROM (
    SELECT doc_id, unnest(range(p, p + 35)) AS q FROM win
    WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1))
), lost AS (
  SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d
), left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept
  FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

ORACLE_SQL["op8_near_dedup"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 1], ' ') AS x FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) AS p FROM d)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sized AS MATERIALIZED (
  SELECT doc_id, x, n FROM s JOIN n USING (doc_id)
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.x = b.x
    AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.root = ways.a
), least_root AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_root LEFT JOIN n USING (doc_id)
"""


def _codes_sql() -> str:
    """Four rounds and the last assignment, a step each. Parts of equal length, as in the table."""
    steps = ["""
v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE len([x FOR x IN coalesce(embedding, [NULL]) IF x IS NULL OR NOT isfinite(x)]) = 0
), pv AS MATERIALIZED (
  SELECT rid, part, q[part * len(q) // 4 + 1:(part + 1) * len(q) // 4] AS x
  FROM v CROSS JOIN (SELECT unnest(range(0, 4)) AS part)
), b0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, x AS c FROM pv WHERE rid <= 256
)"""]
    for k in range(5):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, part, min({{'far': far, 'entry': entry}}) AS best FROM (
    SELECT rid, pv.part, entry,
      list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)]) AS far
    FROM pv JOIN b{k} ON pv.part = b{k}.part)
  GROUP BY rid, part
)""")
        if k < 4:
            steps.append(f"""
m{k} AS (
  SELECT part, entry, pos, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (
    SELECT a{k}.part, best.entry AS entry, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS y
    FROM a{k} JOIN pv USING (rid, part))
  GROUP BY part, entry, pos
), b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(y ORDER BY pos) AS c FROM m{k} GROUP BY part, entry) n
    ON b.part = n.part AND b.entry = n.entry
)""")
    return "WITH" + ",".join(steps) + """, coded AS (
  SELECT rid, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code,
    CAST(sum(best.far) AS BIGINT) AS error
  FROM a4 GROUP BY rid
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  h AS codebooks_sha256
FROM coded JOIN v USING (rid) CROSS JOIN books
"""


ORACLE_SQL["op11_codes"] = _codes_sql()

# crc32 is written out bit by bit: a value is exclusive-or-ed in, -1 shifts by one bit.
ORACLE_SQL["op13_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations
), c AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_concat([4294967295], flatten([
      [CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
      FOR i IN range(1, len(CAST(conv_id AS VARCHAR)) + 1)])),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
      ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations)
), size AS (
  SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id
), r AS MATERIALIZED (
  SELECT c.conv_id, p AS d, role, text FROM c JOIN t ON t.conv_id = base AND p <= h
  UNION ALL
  SELECT c.conv_id, least(h, coalesce(n, 0)) + p - h, role, text
  FROM c JOIN t ON t.conv_id = c.conv_id AND p > h LEFT JOIN size ON size.conv_id = base
), seq AS MATERIALIZED (
  SELECT conv_id, count(d) AS len,
    coalesce(list(sha256(len(role) || ':' || role || text) ORDER BY d) FILTER (d IS NOT NULL), []) AS s,
    coalesce(list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY d)
      FILTER (d IS NOT NULL), []) AS w
  FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id
), m AS MATERIALIZED (
  SELECT conv_id, len, d, md5(array_to_string(s[1:d], ',')) AS k,
    CASE WHEN d > 0 THEN md5(array_to_string(s[1:d - 1], ',')) END AS up,
    CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len + 1)) AS d FROM seq)
), node AS MATERIALIZED (
  SELECT d, k, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (len = d), '')) AS ends_sha256
  FROM m GROUP BY d, k
), child AS (
  SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2
), sized AS MATERIALIZED (
  SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN child USING (d, k)
), below AS (
  SELECT m.d, m.k, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * sized.words) AS saved
  FROM sized JOIN m ON m.conv_id = sized.conv_id AND m.d <= sized.d GROUP BY m.d, m.k
)
SELECT sized.conv_id, CAST(sized.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id,
  sized.n_convs, sized.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sized.ends_sha256
FROM sized JOIN below USING (d, k)
LEFT JOIN node parent ON parent.d = sized.d - 1 AND parent.k = sized.up
"""
