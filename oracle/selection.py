"""Claims of memories, and the fate of every recalled candidate, in SQL. Constants are restated."""

from __future__ import annotations

from oracle import retrieval  # noqa: F401  (its blocks)
from oracle import sqltext as S
from oracle.blocks import block, compose
from oracle.statements import STATEMENTS as T
from oracle.text_and_guard import guarded, rx

# Fixed values, restated.
_PREFIX = (r"(?i)^(?:(?:actually|also|btw|by the way|note|correction|update|updated|fyi|hey|well|so|now|today|yesterday|"
           r"as of [^,]{1,40}|heads up)\s*[,:]?\s+[ ,;:]*){1,3}([^ ,;:])")
_PATTERNS = [
    r"(?i)^([^.?!]{2,60}?)\s+\b(?:is|are|uses|use|runs on|runs|hosted on|based on)\b\s+([^.?!]{1,60})$",
    r"(?i)^(?:we\s+|i\s+)?\b(?:migrated|switched|moved|changed|upgraded|downgraded)\b\s+(?:the\s+|our\s+)?([^.?!]{1,50}?)\s+\bto\b\s+([^.?!]{1,50})$",
    r"^([^:=?!]{1,49}?[^:=?!0-9])\s*[:=]\s*([^:=?!0-9][^:=?!]{0,49})$"]
_KINDS = {
    "number": r"\d", "proper": r"\b[A-Z][A-Za-z0-9_.+-]{2,}\b",
    "day": r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december)\b",
    "time": r"(?i)\b\d{1,2}:\d{2}\b|\b(?:utc|est|pst|cet)\b", "boolean": r"(?i)\b(true|false|enabled|disabled|on|off|yes|no)\b"}
_CORRECTIONS = [
    "actually", "correction", "correct that", "instead of", "no longer", "not anymore", "changed to", "change to", "switched to",
    "migrated to", "moved to", "upgraded to", "now uses", "now use", "as of", "replaced", "superseded", "was wrong", "my mistake"]


def claims(source: str, keys: str, text: str) -> str:
    """One row per claim: the first pattern that gives a subject and a value of some kind with no word in common."""
    trimmed = lambda x: f"regexp_replace({x}, '^[ ,;]+|[ ,;]+$', '', 'g')"
    options = ", ".join(
        f"{{'i': {i}, 's': {trimmed(f'regexp_extract(c, {rx(p)}, 1)')}, 'v': {trimmed(f'regexp_extract(c, {rx(p)}, 2)')}}}" for i, p in enumerate(_PATTERNS))
    kinds = ", ".join(f"CASE WHEN regexp_matches(o.v, {rx(p)}) THEN '{k}' END" for k, p in _KINDS.items())
    peeled = f"CASE WHEN regexp_matches(s, {rx(_PREFIX)}) THEN regexp_replace(regexp_replace(s, {rx(_PREFIX)}, '\\1'), '^[ ,;:]+|[ ,;:]+$', '', 'g') ELSE s END"
    return f"""(SELECT {keys}, claim, o.s AS subject, o.v AS value, kinds, st, list_distinct(vt) AS vt FROM (
  SELECT *, list_filter([{kinds}], lambda k: k IS NOT NULL) AS kinds, list_distinct({S.toks('o.s')}) AS st, {S.toks('o.v')} AS vt FROM (
   SELECT *, unnest([{options}]) AS o FROM (
    SELECT *, trim(regexp_replace({peeled}, '^[.!?;:, ]+|[.!?;:, ]+$', '', 'g')) AS c FROM (
     SELECT {keys}, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS claim FROM (SELECT {keys}, {S.sentences(text)} AS parts FROM {source})))
    WHERE length(c) BETWEEN 1 AND 160))
 WHERE len(st) > 0 AND len(vt) BETWEEN 1 AND 8 AND len(kinds) > 0 AND NOT list_has_any(st, vt)
 QUALIFY row_number() OVER (PARTITION BY {keys}, claim ORDER BY o.i) = 1)"""


T["retrieval_claims"] = compose(["observed"], f"""SELECT conv_id, memory_id, claim::BIGINT AS claim, subject, value, array_to_string(kinds, '|') AS kinds
FROM {claims('observed', 'conv_id, memory_id', 'text')}""")

_BODY = "(SELECT conv_id, memory_id, text AS body FROM observed)"
block("features", ["observed"], f"""
SELECT conv_id, memory_id, g AS guarded, suspicious, {S.norm('g')} AS norm, {S.toks('g')} AS gt, families FROM (
 SELECT conv_id, memory_id, len(intent) > 0 AS suspicious, families, CASE WHEN length(clean) > 600 THEN rtrim(left(clean, 600)) || ' …' ELSE clean END AS g
 FROM {guarded(_BODY, 'conv_id, memory_id')})""")
block("claim_lists", ["features"], f"""
SELECT conv_id, memory_id, list({{'subject': subject, 'kinds': kinds, 'st': st, 'vt': vt}} ORDER BY claim) AS claims
FROM {claims('features', 'conv_id, memory_id', 'guarded')} GROUP BY ALL""")
block("ranked", ["scored", "features", "claim_lists"], f"""
SELECT s.conv_id, s.mode, s.rn, memory_id, s.relevance, s.floor_, s.ratio, s.resolve, s.source_turn, CASE WHEN s.lot = 3 THEN 1 END AS seen,
 f.norm, f.gt, f.suspicious, s.memory_type = 'CORRECTION' OR {S.any_phrase('f.norm', _CORRECTIONS)} AS replaces, c.claims
FROM scored s JOIN features f USING (conv_id, memory_id) LEFT JOIN claim_lists c USING (conv_id, memory_id)""")
# Rank by rank: a row is merged into the first kept one that it equals or resembles.
block("merge_walk", ["ranked"], f"""@merge_walk(conv_id, mode, rn, kept, into_) AS (
 SELECT DISTINCT conv_id, mode, 0::BIGINT, []::STRUCT(id VARCHAR, tokens VARCHAR[])[], NULL::STRUCT(id VARCHAR, tokens VARCHAR[]) FROM ranked
 UNION ALL SELECT w.conv_id, w.mode, r.rn, CASE WHEN near IS NULL THEN list_append(w.kept, {{'id': r.memory_id, 'tokens': r.gt}}) ELSE w.kept END, near
 FROM merge_walk w JOIN ranked r ON r.conv_id = w.conv_id AND r.mode = w.mode AND r.rn = w.rn + 1,
  LATERAL (SELECT list_filter(w.kept, lambda k: k.tokens = r.gt OR {S.jac('k.tokens', 'r.gt')} >= 0.88e0)[1] AS near))""")
block("merged", ["ranked", "merge_walk"], """
SELECT r.*, w.into_.id AS into_id, w.into_.tokens = r.gt AS exact FROM ranked r JOIN merge_walk w USING (conv_id, mode, rn)""")
block("reports", ["facts", "tasks"], """
SELECT conv_id, min_by(subject, j) FILTER (WHERE role = 'forbidden') AS subject, left(sha256(min_by(text, j) FILTER (WHERE role = 'forbidden')), 12) AS older_id,
 CASE WHEN conv_id % 4 <> 0 THEN min_by(text, j) FILTER (WHERE role = 'required') ELSE '' END AS newer_text
FROM facts WHERE category IN ('temporal', 'conflict') AND conv_id % 2 = 0 GROUP BY conv_id""")
block("reported", ["merged", "reports", "facts"], f"""
SELECT *, into_id IS NULL AND older_id IS NOT NULL AND newer IS NULL AND resolve AS reported_contested,
 CASE WHEN into_id IS NOT NULL THEN 'duplicate' WHEN resolve AND older_id IS NOT NULL AND newer IS NOT NULL THEN 'superseded' WHEN resolve AND stale_id IS NOT NULL THEN 'stale' END AS reason,
 CASE WHEN into_id IS NOT NULL THEN CASE WHEN exact THEN 'exact' ELSE 'near' END || ' duplicate of ' || into_id
  WHEN resolve AND older_id IS NOT NULL AND newer IS NOT NULL THEN 'superseded by ' || newer || ' (subject=' || coalesce(nullif(subject, ''), 'unknown') || ', source=runtime)'
  WHEN resolve AND stale_id IS NOT NULL THEN 'reported stale by runtime (subject=unknown, source=runtime)' END AS why
FROM (SELECT m.*, p.older_id, p.subject, st.stale_id, (SELECT min_by(x.memory_id, x.rn) FROM merged x WHERE x.conv_id = m.conv_id AND x.mode = m.mode
   AND x.into_id IS NULL AND x.norm = {S.norm('p.newer_text')} AND length(p.newer_text) > 0) AS newer
 FROM merged m LEFT JOIN reports p ON p.conv_id = m.conv_id AND p.older_id = m.memory_id
 LEFT JOIN (SELECT conv_id, left(sha256(min_by(text, fact_id)), 12) AS stale_id FROM facts WHERE role = 'irrelevant' AND conv_id % 5 = 0 GROUP BY conv_id) st
  ON st.conv_id = m.conv_id AND st.stale_id = m.memory_id)""")
_FITS = (f"list_has_any(a.kinds, b.kinds) AND list_has_any(a.st, b.st) AND {S.jac('a.st', 'b.st')} >= 0.6e0 "
         f"AND NOT list_has_any(a.vt, b.vt) AND {S.jac('a.vt', 'b.vt')} < 0.6e0")
block("claim_pairs", ["reported"], f"""
SELECT conv_id, mode, subject, left_id, right_id, l_rn, r_rn, older_id,
 CASE WHEN older_id = left_id THEN right_id WHEN older_id IS NOT NULL THEN left_id END AS newer_id,
 CASE WHEN older_id IS NULL THEN 'unordered' WHEN CASE WHEN older_id = left_id THEN r_replaces ELSE l_replaces END THEN 'superseded' ELSE 'contested' END AS outcome
FROM (SELECT l.conv_id, l.mode, l.memory_id AS left_id, r.memory_id AS right_id, l.rn AS l_rn, r.rn AS r_rn, l.replaces AS l_replaces, r.replaces AS r_replaces,
  list_filter(l.claims, lambda a: len(list_filter(r.claims, lambda b: {_FITS})) > 0)[1].subject AS subject,
  CASE WHEN l.seen < r.seen THEN l.memory_id WHEN r.seen < l.seen THEN r.memory_id
   WHEN l.source_turn < r.source_turn THEN l.memory_id WHEN r.source_turn < l.source_turn THEN r.memory_id END AS older_id
 FROM reported l JOIN reported r ON r.conv_id = l.conv_id AND r.mode = l.mode AND l.rn < r.rn
 WHERE l.reason IS NULL AND r.reason IS NULL AND l.resolve AND l.claims IS NOT NULL AND r.claims IS NOT NULL) WHERE subject IS NOT NULL""")
block("resolved", ["reported", "claim_pairs"], """
SELECT p.* EXCLUDE (reason, why), CASE WHEN x.lost IS NOT NULL THEN 'superseded' ELSE reason END AS reason,
 CASE WHEN x.lost IS NOT NULL THEN 'superseded by ' || x.lost.newer || ' (subject=' || x.lost.subject || ', source=heuristic)' ELSE why END AS why,
 reported_contested OR coalesce(x.open_, false) AS contested
FROM reported p LEFT JOIN (
 SELECT conv_id, mode, memory_id, bool_or(outcome <> 'superseded') AS open_,
  max_by({'newer': newer_id, 'subject': subject}, l_rn * 1000 + r_rn) FILTER (WHERE outcome = 'superseded' AND older_id = memory_id) AS lost
 FROM (SELECT *, left_id AS memory_id FROM claim_pairs UNION ALL SELECT *, right_id FROM claim_pairs) GROUP BY ALL) x USING (conv_id, mode, memory_id)""")
block("floored", ["resolved"], """
SELECT *, sum(CASE WHEN below IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, mode ORDER BY rn) AS place FROM (
 SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN round(relevance, 12) < floor_ THEN 'low_relevance'
   WHEN round(relevance, 12) < round(best * ratio, 12) THEN 'weak_relevance' END AS below
 FROM (SELECT *, max(round(relevance, 12)) FILTER (WHERE reason IS NULL) OVER (PARTITION BY conv_id, mode) AS best FROM resolved))""")
block("decided", ["floored", "judged", "features"], """
SELECT conv_id, mode, memory_id, CASE WHEN below IS NULL AND place > 6 THEN 'cap' ELSE below END AS drop_reason, why AS detail,
 CASE WHEN below IS NULL AND place <= 6 THEN place END::BIGINT AS rank, contested, coalesce((SELECT string_agg(m.memory_id, '|' ORDER BY m.rn) FROM floored m
  WHERE m.conv_id = f.conv_id AND m.mode = f.mode AND m.into_id = f.memory_id), '') AS merged_ids, suspicious
FROM floored f
UNION ALL SELECT conv_id, mode, memory_id, gone, NULL, NULL, false, '', suspicious FROM judged JOIN features USING (conv_id, memory_id) WHERE gone IS NOT NULL""")
T["retrieval_decisions"] = compose(["decided"], "SELECT * FROM decided")
T["retrieval_resolutions"] = compose(["claim_pairs"], "SELECT conv_id, mode, subject, left_id, right_id, older_id, newer_id, outcome FROM claim_pairs")
T["retrieval_reason_counts"] = compose(["decided"], "SELECT mode, drop_reason, count(*) AS n FROM decided WHERE drop_reason IS NOT NULL GROUP BY ALL")
_COUNTS = {"empty_count": "'empty'", "duplicate_count": "'duplicate'", "stale_count": "'stale', 'expired'", "conflict_count": "'superseded'",
           "low_relevance_count": "'low_relevance', 'weak_relevance'", "cap_count": "'cap', 'suspicious'"}
T["retrieval_report"] = compose(["decided"], f"""SELECT conv_id, mode, count(*) AS candidate_count,
 {', '.join(f"count(*) FILTER (WHERE drop_reason IN ({v})) AS {k}" for k, v in _COUNTS.items())},
 count(*) FILTER (WHERE drop_reason IS NULL) AS selected_count, count(*) FILTER (WHERE suspicious AND (drop_reason IS NULL OR drop_reason = 'suspicious')) AS suspicious_count,
 count(*) FILTER (WHERE suspicious) AS suspicious_candidate_count FROM decided GROUP BY conv_id, mode""")
