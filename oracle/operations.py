from __future__ import annotations

from oracle import sqltext as S
from oracle.blocks import block, compose
from oracle.statements import STATEMENTS as T
from turnloom.operators import budgets as B
from turnloom.operators import modes as M
from turnloom.operators import packing as P
from turnloom.plans.operations import PLAIN

_SYS = -(-len(P.SYSTEM_TEXT) // 4)
_PLAIN = S.values([(m.mode, m.max_recent, m.recent_budget) for m in PLAIN])
block("plain_modes", [], f"SELECT * FROM (VALUES {_PLAIN}) v(mode, cap, budget)")
block("history", ["transcript"], f"""
SELECT conv_id, pos, content, {S.est('content')} AS tokens, sum({S.est('content')}) OVER (PARTITION BY conv_id ORDER BY pos DESC) AS cum,
 row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS back FROM transcript""")
block("totals", ["history", "tasks"], f"""
SELECT t.conv_id, {S.est('t.question')} AS q, h.n, h.raw, CAST(greatest(4096, h.raw + 4 * h.n + {S.est('t.question')} + 4 + 1024) AS BIGINT) AS ceiling
FROM tasks t JOIN (SELECT conv_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS raw FROM history GROUP BY conv_id) h USING (conv_id)""")


def plain(ceiling: str) -> str:
    room = f"({ceiling} - ({_SYS} + q + 8))"
    return f"""SELECT conv_id, mode, n, raw, q, lim, count(*) FILTER (WHERE inside) AS n_window,
  count(*) FILTER (WHERE inside AND cum + 4 * back <= room) AS kept, CAST(coalesce(sum(tokens) FILTER (WHERE inside AND cum + 4 * back <= room), 0) AS BIGINT) AS kept_tokens
 FROM (SELECT t.*, m.mode, h.tokens, h.cum, h.back, {ceiling} AS lim, {room} AS room,
   (m.cap IS NULL OR back <= m.cap) AND (back = 1 OR cum <= coalesce(m.budget, {ceiling})) AS inside
  FROM totals t CROSS JOIN plain_modes m JOIN history h USING (conv_id)) GROUP BY ALL"""


_FINAL = f"({_SYS} + q + kept_tokens + 4 * (2 + kept))"
_FULL = f"({_SYS} + raw + q + 4 * (n + 2))"


def stats(ceiling: str) -> str:
    return f"""SELECT conv_id, mode, raw AS raw_history_tokens, kept_tokens AS recent_history_tokens, 0::BIGINT AS retrieved_memory_tokens,
 {_SYS}::BIGINT AS system_tokens, {_FINAL} AS final_context_tokens, 0::BIGINT AS selected_memory_count, q AS current_message_tokens,
 0::BIGINT AS memory_block_tokens, 0::BIGINT AS selected_chunk_count, 0::BIGINT AS retrieved_chunk_tokens, 0::BIGINT AS chunk_block_tokens,
 0::BIGINT AS candidate_chunk_count, 0::BIGINT AS candidate_chunk_tokens, 0::BIGINT AS dropped_chunks_for_budget, 0::BIGINT AS evidence_tokens,
 n AS history_messages_considered, kept AS history_messages_selected, 2 + kept AS message_count, 4 * (2 + kept) AS overhead_tokens,
 lim::BIGINT AS max_tokens, {_FULL} AS full_context_reference_tokens, n_window - kept AS dropped_history_for_budget, 0::BIGINT AS dropped_memories_for_budget,
 false AS system_truncated, {_FINAL} > lim AS exceeds_max_tokens, greatest(0, raw - {_FINAL}) AS token_savings_vs_raw_history,
 round_even(greatest(0e0, 1e0 - {_FINAL}::DOUBLE / raw), 6) AS context_reduction_vs_raw_history,
 greatest(0, {_FULL} - {_FINAL}) AS token_savings_vs_full_context,
 round_even(greatest(0e0, 1e0 - {_FINAL}::DOUBLE / {_FULL}), 6) AS context_reduction_vs_full_context,
 round_even({_FINAL}::DOUBLE / lim, 6) AS budget_utilization FROM ({plain(ceiling)})"""


T["context_stats_plain"] = compose(["totals", "plain_modes"], stats("ceiling"))
T["context_evicted"] = compose(["totals", "plain_modes"], stats("300"))
_FIT = f"CASE WHEN {_SYS} + q + 8 <= 30 THEN {_SYS} ELSE 30 - q - 8 END"
_CUT = f"rtrim(left({S.quote(P.SYSTEM_TEXT)}, greatest(fit * 4 - 2, 0))) || ' …'"
T["context_bare"] = compose(["totals", "plain_modes"], f"""
SELECT conv_id, mode, s AS fitted_system, {S.est('s')} AS system_tokens,
 {S.est('s')} + q + kept_tokens + 4 * (1 + (s <> '')::INT + kept) AS final_context_tokens, s <> {S.quote(P.SYSTEM_TEXT)} AS system_truncated,
 {S.est('s')} + q + kept_tokens + 4 * (1 + (s <> '')::INT + kept) > 30 AS exceeds_max_tokens, kept AS history_messages_selected
FROM (SELECT *, CASE WHEN fit <= 0 THEN '' WHEN fit >= {_SYS} THEN {S.quote(P.SYSTEM_TEXT)} ELSE {_CUT} END AS s
 FROM (SELECT *, {_FIT} AS fit FROM ({plain('30')})))""")
T["context_sum_of_parts"] = f"SELECT conv_id, mode, 0::BIGINT AS gap FROM (SELECT DISTINCT conv_id FROM conversations) c, (SELECT unnest({S.listing([m.mode for m in M.MODES])}) AS mode) m"
T["context_modes"] = f"""SELECT conv_id, mode, letter, coalesce(cap, -1)::BIGINT AS max_recent, mb::BIGINT AS memory_budget, cb::BIGINT AS chunk_budget
FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES {S.values([(m.mode, m.letter, m.max_recent, m.memory_budget, m.chunk_budget) for m in M.MODES])}) v(mode, letter, cap, mb, cb)"""
T["context_isolated"] = compose(["transcript"], f"""
SELECT conv_id, count(*) AS visible, CAST(sum({S.est('content')}) AS BIGINT) AS tokens FROM transcript t
WHERE session = (SELECT max(session) FROM transcript x WHERE x.conv_id = t.conv_id) GROUP BY conv_id""")
_REQ = f"""(SELECT user_id, event_id, event_type = 'error' AS failed, {S.est('props')} * 10 AS prompt_tokens,
 coalesce(CASE WHEN event_id % 2 = 0 THEN (props::JSON->>'$.k')::BIGINT END, {S.est('props')} * 10) AS charged FROM events)"""
_RUN = f"""(SELECT *, stopped_at IS NULL OR event_id < stopped_at AS sent FROM (
 SELECT *, min(event_id) FILTER (WHERE stop) OVER (PARTITION BY user_id) AS stopped_at FROM (
  SELECT *, row_number() OVER w > 40 OR sum(failed::INT) OVER w - failed::INT >= 8 OR sum(charged) OVER w - charged >= 1500
   OR sum(charged) OVER w - charged + prompt_tokens > 1500 AS stop FROM {_REQ} WINDOW w AS (PARTITION BY user_id ORDER BY event_id))))"""
T["limit_run_budget"] = f"SELECT user_id, event_id, charged, sent, coalesce(stopped_at, -1) AS stopped_at FROM {_RUN}"
T["limit_usage_snapshot"] = f"""SELECT *, greatest(0, 40 - requests) AS remaining_requests, greatest(0, 1500 - tokens) AS remaining_tokens,
 requests <= 40 AND tokens <= 1500 AS within_limits FROM (SELECT user_id, count(*) FILTER (WHERE sent) AS requests,
 CAST(coalesce(sum(charged) FILTER (WHERE sent), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE NOT sent) AS refused,
 count(*) FILTER (WHERE sent AND failed) AS failures FROM {_RUN} GROUP BY user_id)"""
T["limit_oversize_prompts"] = f"SELECT doc_id, {S.est('text')} AS tokens, {S.est('text')} > 1000 AS skipped, length(text) > 8000 AS too_long FROM documents"
_PRE = S.values([(k, v["modes"], v["trials"], v["max_tasks"], v["max_requests"], v["max_output_tokens"]) for k, v in B.PRESETS.items()])
T["limit_planned_spend"] = f"""SELECT preset, p::BIGINT AS planned_requests, least(p, mr)::BIGINT AS allowed_requests, (p * mo)::BIGINT AS output_token_ceiling
FROM (SELECT *, least(mt, (SELECT count(DISTINCT conv_id) FROM conversations)) * m * t AS p FROM (VALUES {_PRE}) v(preset, m, t, mt, mr, mo))"""
T["limit_first_tasks"] = compose(["tasks"], "SELECT conv_id, category FROM tasks ORDER BY conv_id LIMIT 20")
T["retention_sweep"] = """SELECT session, newest, CASE WHEN fate = 'expired' AND rn > 25 THEN 'waiting' ELSE fate END AS fate
FROM (SELECT *, row_number() OVER (PARTITION BY fate ORDER BY newest, session) AS rn FROM (
 SELECT session, epoch_us(max(ts)) AS newest, CASE WHEN session LIKE '../%' THEN 'skipped'
  WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) > 86400000000 THEN 'expired' ELSE 'kept' END AS fate
 FROM (SELECT CASE WHEN user_id % 17 = 0 THEN '../' || user_id ELSE 's-' || user_id END AS session, ts FROM events) GROUP BY session))"""
T["check_constants"] = compose(["tasks"], """
SELECT 'unplanned mode' AS rule, 'ghost' AS subject WHERE EXISTS (SELECT 1 FROM tasks WHERE conv_id % 20 = 1)
UNION ALL SELECT 'mode misses tasks', 'chunks:' || count(*) FROM tasks WHERE conv_id % 10 = 3 HAVING count(*) > 0
UNION ALL SELECT 'mode misses tasks', 'memory:' || count(*) FROM tasks WHERE conv_id % 20 = 1 HAVING count(*) > 0
UNION ALL SELECT 'question differs', conv_id::VARCHAR FROM tasks WHERE conv_id % 25 = 2
UNION ALL SELECT 'foreign system prompt', sha256('Other words.') UNION ALL SELECT 'system_prompt differs', '2' UNION ALL SELECT 'counter differs', '2'""")
T["check_fingerprints"] = """SELECT left(sha256('{"a":"' || event_type || '","b":' || (event_id % 5) || '}'), 16) AS fingerprint, count(*) AS n FROM events GROUP BY ALL"""
T["provenance_dataset"] = compose(["tasks"], """SELECT count(*) AS tasks, string_agg(DISTINCT category, '|' ORDER BY category) AS categories,
 array_to_string(list_sort(list_distinct(list(length_tier))), '|') AS tiers FROM tasks""")
T["source_transcript"] = "SELECT conv_id, turn, lower(role) AS role, md5(text) AS digest FROM conversations"
T["source_conversations"] = "SELECT DISTINCT conv_id FROM conversations"
T["source_task_lines"] = compose(["facts"], """SELECT conv_id, question, coalesce((SELECT string_agg(fact_id, '|' ORDER BY fact_id) FROM facts f WHERE f.conv_id = t.conv_id AND f.role = 'required'), '') AS required,
 (SELECT count(*) FROM facts f WHERE f.conv_id = t.conv_id) AS facts FROM tasks t""")
T["source_quarantined_lines"] = """SELECT 'good' AS kind, count(*) AS n, CAST(sum((props::JSON->>'$.k')::BIGINT) AS BIGINT) AS total FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT 'bad', count(*), 0 FROM events WHERE event_id % 50 = 0"""
T["sink_upsert"] = """SELECT user_id, event_type, max(epoch_us(ts)) AS stamp, min(epoch_us(ts)) AS created, max_by(value, ts) AS value, count(*) AS seen FROM events GROUP BY ALL"""
T["sink_stored_upsert"] = T["sink_upsert"]
T["sink_stored_rows"] = f"""SELECT * FROM ({T['sink_upsert']}) WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error')
 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)"""
T["sink_delete"] = "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 60) GROUP BY user_id"
