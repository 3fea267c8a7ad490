"""DuckDB SQL for operators whose results SQL can express, by brute force over all rows."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Components of links (x, y) over row numbers: the smallest id each row reaches.
_REACH = """
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x)
"""

MINHASH = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORD}) AS w FROM documents
), sh AS (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM base)
), sizes AS (
  SELECT rid, count(*) AS n FROM sh GROUP BY rid
), met AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * i >= 75 * (p.n + q.n - i)
), {_REACH}, least_id AS (
  SELECT x AS rid, min(doc_id) AS other FROM reach JOIN base ON base.rid = reach.y GROUP BY x
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM base LEFT JOIN sizes USING (rid) LEFT JOIN least_id USING (rid)
"""

FLATGRAPH = f"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, vec_id, label, len(embedding) AS dim, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT *, sqrt(list_sum(list_transform(v, lambda e: e * e))) AS norm FROM base
  WHERE label IS NOT NULL AND dim > 0 AND len(list_filter(v, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(v, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.rid AS x, b.rid AS y FROM sound a JOIN sound b ON a.label = b.label AND a.dim = b.dim AND a.rid < b.rid WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), {_REACH}, least_id AS (
  SELECT x AS rid, min(vec_id) AS other FROM reach JOIN base ON base.rid = reach.y GROUP BY x
), degrees AS (
  SELECT x AS rid, count(*) AS n FROM ways GROUP BY x
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept
FROM base LEFT JOIN degrees USING (rid) LEFT JOIN least_id USING (rid)
"""

LINEDEDUP = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS raw_lines FROM documents
), every AS (
  SELECT rid, doc_id, unnest(raw_lines) AS line, generate_subscripts(raw_lines, 1) AS raw FROM base
), worded AS (
  SELECT rid, doc_id, raw, array_to_string(w, ' ') AS line, len(w) AS words FROM (SELECT *, regexp_extract_all(line, {_WORD}) AS w FROM every) WHERE len(w) > 0
), placed AS (
  SELECT *, row_number() OVER d AS ord, CAST(sum(words) OVER d AS BIGINT) AS past, CAST(sum(words) OVER d AS BIGINT) - words AS upto FROM worded WINDOW d AS (PARTITION BY rid ORDER BY raw)
), runs AS (
  SELECT a.rid, a.doc_id, min(b.ord) AS start, count(*) AS m, sum(b.words) AS w, string_agg(b.line, chr(10) ORDER BY b.ord) AS content, list(b.raw) AS raws
  FROM placed a JOIN placed b ON a.rid = b.rid AND b.ord >= a.ord AND b.upto - a.upto < 50 GROUP BY a.rid, a.doc_id, a.ord
  UNION ALL
  SELECT a.rid, a.doc_id, min(b.ord), count(*), sum(b.words), string_agg(b.line, chr(10) ORDER BY b.ord), list(b.raw)
  FROM placed a JOIN placed b ON a.rid = b.rid AND b.ord <= a.ord AND a.past - b.past < 50 GROUP BY a.rid, a.doc_id, a.ord
), full_runs AS (
  SELECT *, min((doc_id, rid, start)) OVER (PARTITION BY content) AS origin FROM runs WHERE w >= 50
), cuts AS (
  SELECT DISTINCT rid, unnest(raws) AS raw FROM full_runs WHERE (doc_id, rid, start) <> origin
), cleaned AS (
  SELECT e.rid, count(c.raw) AS n_cut, coalesce(string_agg(e.line, chr(10) ORDER BY e.raw) FILTER (WHERE c.raw IS NULL), '') AS t
  FROM every e LEFT JOIN cuts c ON c.rid = e.rid AND c.raw = e.raw GROUP BY e.rid
)
SELECT doc_id, CAST(coalesce(len(raw_lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut,
       CAST(len(regexp_extract_all(coalesce(t, ''), {_WORD})) AS BIGINT) AS n_words, sha256(coalesce(t, '')) AS text_sha256
FROM base LEFT JOIN cleaned USING (rid)
"""
