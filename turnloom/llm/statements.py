"""DuckDB statements for the queries of the package that SQL can express."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op10_url_filter"] = r"""
WITH parsed AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
keyed AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS key FROM parsed),
listed AS (SELECT DISTINCT key FROM keyed WHERE regexp_matches(url, '[?&](utm_source|ref)=')),
rules(action, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT k.*, (SELECT max_by(h || p || chr(9) || action, length(h || p)) FROM rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS fit
  FROM keyed k)
SELECT page_id, host, path, nullif(split_part(fit, chr(9), 1), '') AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, chr(9), 2)
       WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""

STATEMENTS["op8_mix_sources"] = r"""
WITH items AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, count(*) AS copies
  FROM documents GROUP BY ALL),
sources AS (
  SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_rank
  FROM items GROUP BY source),
weighed AS (SELECT *, CASE source_rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
budget AS (SELECT sum(source_size)::DOUBLE * 1.5 AS b FROM weighed),
sorted AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS spent, (SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0) AS rest
  FROM weighed
  WINDOW w AS (ORDER BY 2 * source_size / weight::DOUBLE, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((b - spent::DOUBLE) / rest::DOUBLE, spent) AS level FROM sorted, budget
  WHERE weight * ((b - spent::DOUBLE) / rest::DOUBLE) <= 2 * source_size),
targets AS (
  SELECT source, source_size, source_rank, least(weight * level, (2 * source_size)::DOUBLE) AS target FROM weighed, level),
queued AS (
  SELECT i.*, source_size, source_rank, target, pass, size * copies AS words,
    md5('mix:' || pass || ':' || coalesce(doc_id::VARCHAR, '')) AS lot
  FROM items i JOIN targets t ON i.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) p(pass)),
timed AS (
  SELECT *, sum(words) OVER (PARTITION BY source_rank ORDER BY pass, lot, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / target AS finish
  FROM queued WHERE words > 0),
merged AS (
  SELECT *, sum(words) OVER (ORDER BY finish, source_rank, pass, lot, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM timed),
taken AS (SELECT doc_id, source_rank, size, count(*) AS passes FROM merged, budget WHERE total <= b GROUP BY ALL)
SELECT i.doc_id, i.source, i.size, t.source_size, t.target, i.size * coalesce(k.passes, 0) AS taken
FROM items i JOIN targets t ON i.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON k.doc_id IS NOT DISTINCT FROM i.doc_id AND k.source_rank = t.source_rank AND k.size = i.size,
LATERAL (SELECT unnest(range(i.copies))) c
"""

STATEMENTS["op4_pivot_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

STATEMENTS["op3_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?ROLE\]|ROLE:|/?s>)', '\1\\\2\3', 'g') AS safe FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

STATEMENTS["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT row_id, lang, source, unnest(terms) AS term FROM docs),
vocabulary AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 10),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN vocabulary USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(c), 0)::BIGINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
lang_totals AS (SELECT lang, sum(n)::BIGINT AS n FROM totals GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, w.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (g.n + 2 * s.v) AS p
  FROM totals g JOIN vocabulary w USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = w.term),
of_lang AS (
  SELECT c.lang, c.term, 1 + (1000000000 * (sum(c.c)::BIGINT + 2)) // (any_value(l.n) + 2 * any_value(s.v)) AS q
  FROM counts c JOIN lang_totals l USING (lang) JOIN sizes s USING (lang) GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
telling AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM shares s JOIN of_lang o USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM telling))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

STATEMENTS["op12_tree_forest"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM reach LEFT JOIN counts USING (vec_id) GROUP BY vec_id
"""

STATEMENTS["op11_dual_tree_search"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
sizes AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM docs WHERE len(terms) > 0),
counts AS (
  SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, sizes GROUP BY term),
scored AS (
  SELECT item_id, row_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term), sizes GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
