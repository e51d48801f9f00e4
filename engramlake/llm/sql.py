"""SQL (DuckDB) for the queries that it can express over whole tables, each by the plainest way."""

from __future__ import annotations

#: Bytes as hex digits, cut to segments of 1,000 bytes with the 199 that follow, so no window is sought in a long string.
OP2 = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), segments AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 2398) AS part
  FROM (SELECT doc_id, h, unnest(generate_series(0, greatest(CAST(length(h) / 2 AS BIGINT) - 200, -1), 1000)) AS s FROM texts)
), windows AS (
  SELECT doc_id, s + i AS p, md5_number(substr(part, 2 * i + 1, 400)) AS w
  FROM (SELECT doc_id, s, part, unnest(generate_series(0, least(999, CAST(length(part) / 2 AS BIGINT) - 200))) AS i FROM segments)
), twice AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
  SELECT DISTINCT doc_id, p FROM windows WHERE w IN (SELECT w FROM twice)
), bytes AS (
  SELECT doc_id, j, substr(part, 2 * (j - s) + 1, 2) AS b
  FROM (SELECT doc_id, s, part, unnest(generate_series(s, s + least(999, CAST(length(part) / 2 AS BIGINT) - 1))) AS j
        FROM (SELECT doc_id, s, substr(h, 2 * s + 1, 2000) AS part
              FROM (SELECT doc_id, h, unnest(generate_series(0, greatest(CAST(length(h) / 2 AS BIGINT) - 1, -1), 1000)) AS s FROM texts)))
), marked AS (
  SELECT doc_id, j, b, coalesce(j - max(p) OVER (PARTITION BY doc_id ORDER BY j) < 200, false) AS gone
  FROM bytes LEFT JOIN (SELECT doc_id AS d, p FROM hits) ON doc_id = d AND j = p
), spans AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS first FROM marked
), told AS (
  SELECT doc_id, count_if(gone) AS n_removed, count_if(first) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY j) FILTER (NOT gone), ''))) AS kept
  FROM spans GROUP BY doc_id
)
SELECT t.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       coalesce(kept, sha256('')) AS kept_sha256
FROM texts t LEFT JOIN told USING (doc_id)
"""

#: Lines, their sets of 5-character shingles, all pairs that share one of the rarest shingles that similar sets must share, exact Jaccard, components.
OP3 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, n, ls[n] AS line, regexp_replace(ls[n], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS core
  FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS n FROM split)
), named AS (
  SELECT core, row_number() OVER (ORDER BY core) AS k FROM (SELECT DISTINCT core FROM lines WHERE core <> '')
), shingles AS (
  SELECT DISTINCT k, substr(core, i, 5) AS g FROM (SELECT k, core, unnest(generate_series(1, length(core) - 4)) AS i FROM named)
), rare AS (
  SELECT g, count(*) AS df FROM shingles GROUP BY g
), ranked AS (
  SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY df, g) AS r, count(*) OVER (PARTITION BY k) AS size FROM shingles JOIN rare USING (g)
), prefix AS (
  SELECT k, g, size FROM ranked WHERE r <= size - CAST(ceil(0.8 * size) AS BIGINT) + 1
), near AS (
  SELECT DISTINCT a.k AS a, b.k AS b, a.size AS na, b.size AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.k < b.k AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
), links AS (
  SELECT a, b FROM near JOIN shingles x ON x.k = a JOIN shingles y ON y.k = b AND x.g = y.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
), arcs AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS k, a AS r FROM arcs UNION SELECT reach.k, arcs.b FROM reach JOIN arcs ON reach.r = arcs.a
), roots AS (
  SELECT k, min(r) AS root FROM reach GROUP BY k
), placed AS (
  SELECT l.doc_id, l.n, l.line, coalesce(root, k) AS root FROM lines l LEFT JOIN named USING (core) LEFT JOIN roots USING (k)
), judged AS (
  SELECT *, root IS NOT NULL AND row_number() OVER (PARTITION BY root ORDER BY doc_id, n) > 1 AS gone FROM placed
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, length(regexp_replace(replace(role, chr(10), '<|nl|>'), '<(\\*)\|', '<\1\\|', 'g')) AS role_chars,
         length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + role_chars + text_chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

#: A word goes if one of the 20 windows that cover it also starts earlier.
OP8 = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 19 <= len(ws) THEN md5_number(array_to_string(ws[i:i + 19], ' ')) END AS w
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM texts)
), flagged AS (
  SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS later FROM words
), marked AS (
  SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM flagged
), told AS (
  SELECT doc_id, count_if(gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept FROM marked GROUP BY doc_id
)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256
FROM texts t LEFT JOIN told USING (doc_id)
"""

#: Sets of 5-word shingles, all pairs of different sets that share any, exact Jaccard, components.
OP9 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM texts)
), sets AS (
  SELECT doc_id, count(*) AS size, md5(string_agg(CAST(g AS VARCHAR), ',' ORDER BY g)) AS k FROM shingles GROUP BY doc_id
), members AS (
  SELECT k, any_value(size) AS size, min(doc_id) AS least FROM sets GROUP BY k
), held AS (
  SELECT k, size, g FROM members JOIN shingles ON doc_id = least
), links AS (
  SELECT x.k AS a, y.k AS b FROM held x JOIN held y ON x.g = y.g AND x.k < y.k AND 100 * least(x.size, y.size) >= 80 * greatest(x.size, y.size)
  GROUP BY x.k, y.k HAVING 100 * count(*) >= 80 * (any_value(x.size) + any_value(y.size) - count(*))
), arcs AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT k, k AS r FROM members UNION SELECT reach.k, arcs.b FROM reach JOIN arcs ON reach.r = arcs.a
), named AS (
  SELECT reach.k, min(least) AS component_id FROM reach JOIN members ON reach.r = members.k GROUP BY reach.k
), degree AS (
  SELECT a AS k, count(*) AS n FROM arcs GROUP BY a
)
SELECT t.doc_id, CAST(coalesce(size, 0) AS BIGINT) AS n_shingles, coalesce(component_id, t.doc_id) AS component_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM texts t LEFT JOIN sets USING (doc_id) LEFT JOIN named USING (k) LEFT JOIN degree USING (k)
"""
