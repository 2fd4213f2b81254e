from __future__ import annotations

from oracle import sqltext as S
from oracle.blocks import draw, pick
from oracle.statements import STATEMENTS as T
from turnloom.functions import credentials as CR
from turnloom.functions import guard as G
from turnloom.functions import text as X
from turnloom.plans import text_and_guard as P


def rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


T["text_normalize"] = f"SELECT doc_id, length(n) AS chars, md5(n) AS digest FROM (SELECT doc_id, {S.norm('text')} AS n FROM documents)"
T["text_tokens"] = f"""SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens,
 len({S.bigrams('t')}) AS bigrams, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.toks('text')} AS t FROM documents)"""
T["text_all_words"] = f"""SELECT doc_id, len(t) AS words, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {S.words(S.norm('text'))} AS t FROM documents)"""
T["text_jaccard"] = f"""SELECT doc_id, round_even({S.jac('a', 'b')}, 6) AS jaccard
FROM (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, {S.toks('text')} AS a FROM documents) JOIN (SELECT item_id, {S.toks('text')} AS b FROM benchmark) USING (item_id)"""
T["text_sentences"] = f"""SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest
FROM (SELECT doc_id, {S.sentences('text')} AS s FROM documents)"""
# Fixed values, restated.
_LEADS = ["Actually, also, ", "By the way: ", "Note ", "As of May 3, now, ", "", "Update: well, so, hey "]
_CORRECTIONS = [
    "actually", "correction", "correct that", "instead of", "no longer", "not anymore", "changed to", "change to", "switched to",
    "migrated to", "moved to", "upgraded to", "now uses", "now use", "as of", "replaced", "superseded", "was wrong", "my mistake"]
T["text_discourse"] = f"""SELECT doc_id, md5(CASE doc_id % 6 WHEN 4 THEN text WHEN 5 THEN 'hey ' || bare ELSE bare END) AS stripped,
 {S.any_phrase('n', _CORRECTIONS)} AS correction
FROM (SELECT doc_id, text, regexp_replace(text, '[ ,;:]+$', '') AS bare, {S.norm(f"({pick(_LEADS, 'doc_id % 6')} || text)")} AS n FROM documents)"""
T["text_preview"] = f"SELECT doc_id, {S.preview('text')} AS preview FROM documents"
T["text_timestamps"] = """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN epoch(date_trunc('second', ts))::BIGINT - 7200
 ELSE epoch(date_trunc('second', ts))::BIGINT END AS epoch FROM events"""
T["text_answers"] = f"""SELECT conv_id, turn, md5(n) AS digest, {S.any_phrase('n', X.NORMALIZED_ABSTENTIONS)} AS abstains,
 contains(' ' || n || ' ', ' in der ') AS has_phrase FROM (SELECT conv_id, turn, {S.answer('text')} AS n FROM conversations)"""
T["text_token_costs"] = f"""SELECT doc_id, {S.est('text')} AS estimate, ceil(length(text) / 3.5e0)::BIGINT AS ratio,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words,
 md5(CASE WHEN length(text) <= 200 THEN text ELSE rtrim(left(text, 198)) || ' …' END) AS cut FROM documents"""
_MESSAGE = """CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant', 'tool') THEN lower(trim(role)) ELSE 'user' END
 || E'\\n' || coalesce(text, '') || E'\\n'"""
T["text_conversation_digest"] = f"""SELECT conv_id, n AS messages, digest, first_id FROM {S.ordered_digest('conversations', 'conv_id', 'turn', _MESSAGE)}
JOIN (SELECT conv_id, min(left(sha256(sha256({_MESSAGE})), 12)) AS first_id FROM conversations GROUP BY conv_id) USING (conv_id)"""
T["text_message_costs"] = f"SELECT conv_id, CAST(sum({S.est('text')} + 4) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id"

_BODY = f"(SELECT doc_id, {pick(P.PROBES, draw('doc_id', 31, len(P.PROBES)))} || E'\\n' || text AS body FROM documents)"
_LEAKY = f"(SELECT doc_id, text || E'\\n' || {pick(P.LEAKS, draw('doc_id', 32, len(P.LEAKS)))} || ' end' AS body FROM documents)"


def variants(source: str, key: str, text: str) -> str:
    """Unicode-aware word edges: letters outside ASCII become a plain letter first."""
    return f"""(SELECT *, replace(folded, ' ', '') AS squeezed FROM (SELECT *, {S.norm('spaced')} AS folded, regexp_replace(spaced, '[^\\x00-\\x7F]', 'q', 'g') AS plain
 FROM (SELECT *, regexp_replace(visible, {rx(G.CONTROL)}, ' ', 'g') AS spaced
 FROM (SELECT {key}, {text}, regexp_replace({text}, {rx(G.INVISIBLE)}, '', 'g') AS visible FROM {source}))))"""


def families() -> str:
    hits = []
    for name, pattern in G.FAMILIES.items():
        p = rx("(?im)" + pattern)
        found = f"regexp_matches(plain, {p}) OR regexp_matches(folded, {p}) OR regexp_matches(regexp_replace(visible, '[^\\x00-\\x7F]', 'q', 'g'), {p})"
        for phrase in G.COMPACT_PHRASES.get(name, ()):
            found += f" OR contains(squeezed, '{phrase}')"
        hits.append(f"CASE WHEN {found} THEN '{name}' END")
    return "list_filter([" + ", ".join(hits) + "], lambda f: f IS NOT NULL)"


_INTENT = f"list_filter(families, lambda f: list_contains({S.listing(G.INTENT)}, f))"
T["guard_families"] = f"""SELECT doc_id, array_to_string(families, '|') AS families, array_to_string({_INTENT}, '|') AS intent
FROM (SELECT doc_id, {families()} AS families FROM {variants(_BODY, 'doc_id', 'body')})"""
_D, _M, _R = rx("(?i)" + G.DELIMITER), rx("(?i)" + G.TEMPLATE_MARKER), rx("(?im)" + G.ROLE_PREFIX.replace(r"[^\S\n]", r"[ \t\r\f\v]"))


def guarded(source: str, key: str) -> str:
    """Neutralised ``body`` of every row, with what was found and removed."""
    return f"""(SELECT *, {_INTENT} AS intent, {S.collapse(f"regexp_replace(lines, {_R}, '', 'g')")} AS clean,
  list_filter([CASE WHEN regexp_matches(body, {rx(G.CONTROL)}) THEN 'control_characters' END,
   CASE WHEN regexp_matches(body, {rx(G.INVISIBLE)}) THEN 'invisible_characters' END,
   CASE WHEN regexp_matches(visible, {_D}) OR regexp_matches(visible, {_M}) THEN 'delimiter_breakout' END,
   CASE WHEN regexp_matches(lines, {_R}) THEN 'role_smuggling' END], lambda v: v IS NOT NULL) AS removed
 FROM (SELECT *, {families()} AS families, replace(regexp_replace(regexp_replace(spaced, {_D}, '', 'g'), {_M}, '', 'g'), E'\\r', E'\\n') AS lines
  FROM {variants(source, key, 'body')}))"""


GUARDED = guarded(_BODY, "doc_id")
T["guard_neutralize"] = f"""SELECT doc_id, CASE WHEN length(clean) > 600 THEN rtrim(left(clean, 600)) || ' …' ELSE clean END AS text,
 len(intent) > 0 AS suspicious, array_to_string(removed, '|') AS neutralized, length(clean) > 600 AS truncated FROM {GUARDED}"""
T["guard_invisible"] = f"""SELECT doc_id, regexp_matches(body, {rx(G.INVISIBLE)}) AS had, length(regexp_replace(body, {rx(G.INVISIBLE)}, '', 'g')) AS chars FROM {_BODY}"""
_red, _hits = "body", []
for _s in sorted(P.SECRETS, key=lambda s: (-len(s), s)):
    _hits.append(f"(length({_red}) - length(replace({_red}, '{_s}', ''))) / {len(_s)}")
    _red = f"replace({_red}, '{_s}', '[redacted]')"
T["guard_redaction"] = f"SELECT doc_id, CAST({' + '.join(_hits)} AS BIGINT) AS hits, md5({_red}) AS digest FROM {_BODY}"
T["guard_pattern_redaction"] = f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(body, {rx(G.BEARER)}, '\\1[redacted]', 'g'),
 {rx(G.KEY_VALUE)}, '\\1[redacted]', 'g'), {rx(G.SHORT_KEY)}, '[redacted]', 'g')) AS digest FROM {_LEAKY}"""
T["guard_secret_fields"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE 'k|note' END AS keys FROM events"
T["guard_history_roles"] = """SELECT conv_id, count(*) FILTER (WHERE lower(role) NOT IN ('assistant')) AS as_user,
 count(*) FILTER (WHERE lower(role) IN ('system', 'tool', 'developer', 'function')) AS downgraded FROM conversations GROUP BY conv_id"""
FINDINGS = f"""(SELECT 'injection_detected' AS category, 'flagged' AS action, 'memory' AS route, 'selection' AS stage, family, count(*) AS n
 FROM (SELECT unnest(intent) AS family FROM {GUARDED}) GROUP BY ALL
UNION ALL SELECT category, 'neutralized', 'memory', 'prompt', '', count(*) FROM (SELECT unnest(removed) AS category FROM {GUARDED}) GROUP BY ALL
UNION ALL SELECT 'role_downgraded', 'downgraded', 'history', 'prompt', '', count(*) FROM conversations WHERE lower(role) IN ('system', 'tool', 'developer', 'function'))"""
T["guard_findings"] = f"SELECT * FROM {FINDINGS}"
_F = ["category", "action", "route", "stage", "family"]
T["guard_finding_totals"] = f"WITH f AS {FINDINGS} " + " UNION ALL ".join(
    f"SELECT {c} AS value, '{c}' AS field, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY {c}" for c in _F) + \
    " UNION ALL SELECT 'total', 'total', CAST(sum(n) AS BIGINT) FROM f"


def shape(pattern: str) -> str:
    return pattern.replace("<b>", r"\b")


def mask(x: str) -> str:
    return f"CASE WHEN length({x}) <= 8 THEN '[' || length({x}) || ' chars]' ELSE left({x}, 3) || '…[' || length({x}) || ' chars]' END"


_SCANS = []
for _c, _p in CR.CREDENTIALS.items():
    if _c == "key_value_assignment":
        _SCANS.append(f"""SELECT doc_id, '{_c}' AS category, strlen(body[:strpos(body, m) - 1]) AS offset_, {mask('m')} AS preview FROM (
 SELECT doc_id, body, unnest(regexp_extract_all(body, {rx(shape(_p))})) AS m, unnest(regexp_extract_all(body, {rx(shape(_p))}, 1)) AS v FROM {_LEAKY})
 WHERE body[strpos(body, m) + length(m)] <> '(' AND NOT regexp_matches(v, {rx(shape(CR.PLACEHOLDER))})
 AND (regexp_matches(v, '[0-9]') OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')))""")
    else:
        _SCANS.append(f"""SELECT doc_id, '{_c}' AS category, strlen(body[:strpos(body, m) - 1]) AS offset_, {mask('m')} AS preview
 FROM (SELECT doc_id, body, unnest(regexp_extract_all(body, {rx(shape(_p))})) AS m FROM {_LEAKY})""")
SCAN = "(" + " UNION ALL ".join(_SCANS) + ")"
T["scan_findings"] = f'SELECT doc_id, category, offset_ AS "offset", preview FROM {SCAN}'
# Pattern after pattern: the text between the strings found, and their masks in between.
_SHOWN = f"""(SELECT doc_id, {S.collapse(f"regexp_replace(b, {rx(G.INVISIBLE)}, '', 'g')")} AS t
 FROM (SELECT doc_id, string_split(body, E'\\n')[-1] || ' ' || body AS b FROM {_LEAKY}))"""
for _p in CR.CREDENTIALS.values():
    _SHOWN = f"""(SELECT doc_id, CASE WHEN len(m) = 0 THEN t ELSE array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce({mask('m[i]')}, '')), '') END AS t
 FROM (SELECT doc_id, t, regexp_extract_all(t, {rx(shape(_p))}) AS m, regexp_split_to_array(t, {rx(shape(_p))}) AS g FROM {_SHOWN}))"""
T["guard_previews"] = f"SELECT doc_id, CASE WHEN length(t) <= 160 THEN t ELSE left(t, 159) || '…' END AS preview FROM {_SHOWN}"
_KNOWN = [P._KEY, "-----BEGIN RSA"]
T["scan_known_secrets"] = " UNION ALL ".join(
    f"SELECT doc_id, 'known_secret' AS category, {mask(S.quote(k))} AS preview FROM {_LEAKY} WHERE contains(body, {S.quote(k)})" for k in _KNOWN)
T["scan_json_fields"] = """SELECT event_id, 'api_key' AS name, '$.config.api_key' AS pointer, 'val…[12 chars]' AS preview FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'openai_key', '$.list[2][0]', 'sk-…[23 chars]' FROM events WHERE event_id % 4 = 1
UNION ALL SELECT event_id, 'client_secret', '$.Client-Secret', '[3 chars]' FROM events WHERE event_id % 4 = 2
UNION ALL SELECT event_id, 'key_value_assignment', '@' || (strlen(props) + 10), 'api…[28 chars]' FROM events WHERE event_id % 4 = 3"""
T["scan_report"] = f"""SELECT count(*) AS files_scanned, CAST(sum(strlen(body)) AS BIGINT) AS bytes_scanned, 0::BIGINT AS files_skipped,
 (SELECT count(*) FROM {SCAN}) AS finding_count, (SELECT count(*) FROM {SCAN}) = 0 AS clean FROM {_LEAKY}"""
T["scan_quarantine"] = f"SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM {SCAN}) THEN 'held' ELSE 'published' END AS fate FROM documents"
_PAGES = " UNION ALL ".join(
    f"SELECT page_id, unnest(regexp_extract_all(html, {rx(shape(p))})) AS m FROM pages" for c, p in CR.CREDENTIALS.items() if c != "key_value_assignment")
T["scan_pages"] = f"""SELECT page_id, array_to_string({families()}, '|') AS families, (SELECT count(*) FROM ({_PAGES}) x WHERE x.page_id = v.page_id) AS credentials
FROM {variants('pages', 'page_id', 'html')} v"""
