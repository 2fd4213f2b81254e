from __future__ import annotations

from oracle import sqltext as S
from oracle.statements import STATEMENTS as T

# Walked in order over the documents that have an earlier neighbour; all others are kept.
T["dedupe_documents"] = f"""
WITH RECURSIVE rows AS (SELECT doc_id, {S.toks('text')} AS tokens FROM documents),
words AS (SELECT DISTINCT doc_id, unnest(tokens) AS token FROM rows),
sizes AS (SELECT doc_id, len(list_distinct(tokens)) AS n FROM rows),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM words a JOIN words b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL
  UNION ALL SELECT a.doc_id, b.doc_id, 0 FROM sizes a JOIN sizes b ON a.n = 0 AND b.n = 0 AND a.doc_id < b.doc_id),
near AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE CASE WHEN x.n + y.n = 0 THEN 1e0 ELSE met::DOUBLE / (x.n + y.n - met) END >= 0.88e0),
later AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM near GROUP BY b),
walk AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS gone
  UNION ALL
  SELECT l.i, CASE WHEN len(list_filter(l.earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, l.b) ELSE gone END
  FROM walk w JOIN later l ON l.i = w.i + 1),
gone AS (SELECT arg_max(gone, i) AS ids FROM walk),
led AS (SELECT b, list_min(list_filter(earlier, lambda x: NOT list_contains(ids, x))) AS leader FROM later, gone WHERE list_contains(ids, b))
SELECT r.doc_id, leader IS NULL AS kept, leader, CASE WHEN leader IS NOT NULL THEN r.tokens = h.tokens END AS exact
FROM rows r LEFT JOIN led ON led.b = r.doc_id LEFT JOIN rows h ON h.doc_id = leader
"""
