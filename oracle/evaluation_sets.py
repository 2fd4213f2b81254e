from __future__ import annotations

from oracle import sqltext as S
from oracle.blocks import compose
from oracle.statements import STATEMENTS
from turnloom.operators import evalset as E

_VARIANTS = "list_filter(list_distinct_keep, lambda v: v <> '')"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: v <> '' AND list_position({x}, v) = i)"


def ids(role: str) -> str:
    return (f"coalesce((SELECT string_agg(fact_id, '|' ORDER BY fact_id) FROM facts f "
            f"WHERE f.conv_id = t.conv_id AND f.role = '{role}'), '')")


_ACCEPTED = ("list_concat([expected_answer, expected_answer, string_split(expected_answer, ' ')[1]], "
             "string_split(extra, '|'), coalesce((SELECT list(value ORDER BY j) FROM facts f "
             "WHERE f.conv_id = t.conv_id AND f.role = 'required'), []::VARCHAR[]))")

STATEMENTS["eval_tasks"] = compose(["facts", "fact_sizes"], f"""
SELECT conv_id, category, length_tier, question, expected_answer, abstention_expected, n_facts,
 {ids('required')} AS required, {ids('supporting')} AS supporting, {ids('forbidden')} AS forbidden,
 {S.join_list(distinct_in_order('acc'))} AS accepted
FROM (SELECT t.*, s.n_facts, {_ACCEPTED} AS acc FROM tasks t JOIN fact_sizes s USING (conv_id)) t""")
STATEMENTS["eval_facts"] = compose(["facts"], """
SELECT conv_id, fact_id, role, fact_type, text, subject, value, array_to_string(markers, '|') AS markers,
 supersedes, superseded_by, introduced_turn::BIGINT AS introduced_turn FROM facts""")
STATEMENTS["eval_transcript"] = compose(["transcript"], """
SELECT conv_id, pos::BIGINT AS pos, role, content, fact_id, session::BIGINT AS session FROM transcript""")
STATEMENTS["eval_given_turns"] = "SELECT conv_id, count(*) AS given_turns FROM conversations GROUP BY conv_id"
STATEMENTS["eval_answer_variants"] = compose(["facts"], f"""
SELECT conv_id, fact_id, {S.join_list(distinct_in_order("[value, string_split(value, ' ')[1]]"))} AS variants
FROM facts WHERE value <> ''""")
STATEMENTS["eval_grid"] = compose(["tasks"], f"""
SELECT 'cr-' || replace(category, '_', '-') || '-' || target_tokens || '-' || lpad(variant::VARCHAR, 2, '0') AS task_id,
 category, target_tokens::BIGINT AS target_tokens, variant::BIGINT AS variant,
 (SELECT count(*) FROM tasks t WHERE t.category = g.category AND t.length_tier = g.target_tokens) AS tasks
FROM (SELECT unnest({S.listing(E.CATEGORIES)}) AS category) g0,
 LATERAL (SELECT unnest({E.TIERS}) AS target_tokens) g1, LATERAL (SELECT unnest([0, 1]) AS variant) g2,
 LATERAL (SELECT g0.category AS category) g""".replace("g.target_tokens", "g1.target_tokens")
    .replace("SELECT 'cr-' || replace(category", "SELECT 'cr-' || replace(g0.category")
    .replace(" category, target_tokens::BIGINT", " g0.category, target_tokens::BIGINT"))
STATEMENTS["eval_issues"] = compose(["facts", "transcript"], """
SELECT DISTINCT conv_id, problem FROM (
 SELECT conv_id, 'duplicate task id' AS problem FROM tasks WHERE conv_id % 11 = 0
 UNION ALL SELECT conv_id, 'question is empty' FROM tasks WHERE conv_id % 5 = 0
 UNION ALL SELECT conv_id, 'conversation is empty' FROM tasks WHERE conv_id % 7 = 0
 UNION ALL SELECT conv_id, 'no markers: ' || fact_id FROM facts WHERE conv_id % 3 = 0 AND fact_type <> 'absent'
 UNION ALL SELECT conv_id, 'unknown related fact: ' || fact_id FROM facts WHERE conv_id % 8 = 0
 UNION ALL SELECT conv_id, 'an abstention task cannot require evidence' FROM tasks WHERE abstention_expected AND conv_id % 6 = 0
 UNION ALL SELECT conv_id, 'unknown role' FROM tasks WHERE conv_id % 9 = 0 AND conv_id % 7 <> 0
 UNION ALL SELECT conv_id, 'session count differs from the transcript' FROM tasks t WHERE session_count > 1 AND conv_id % 7 <> 0
   AND (SELECT count(DISTINCT session) FROM transcript x WHERE x.conv_id = t.conv_id) <> session_count
 UNION ALL SELECT conv_id, 'unknown fact in required' FROM tasks WHERE conv_id % 6 = 0
 UNION ALL SELECT conv_id, 'unknown fact in forbidden' FROM tasks WHERE conv_id % 4 = 0)""")
STATEMENTS["eval_clean"] = "SELECT DISTINCT conv_id, 0::BIGINT AS issues FROM conversations"
STATEMENTS["eval_distances"] = compose(["facts", "transcript"], f"""
SELECT t.conv_id, messages, achieved_tokens, fact_turns, messages - last_fact - 1 AS last_fact_distance,
 messages - required_turn - 1 AS required_fact_distance
FROM (SELECT conv_id, count(*) AS messages, CAST(sum({S.est('content')}) AS BIGINT) AS achieved_tokens FROM transcript GROUP BY conv_id) t
JOIN (SELECT conv_id, max(introduced_turn) FILTER (WHERE role <> 'absent') AS last_fact,
  min(introduced_turn) FILTER (WHERE role = 'required') AS required_turn,
  string_agg(fact_id || ':' || introduced_turn, '|' ORDER BY fact_id || ':' || introduced_turn) FILTER (WHERE role <> 'absent') AS fact_turns
 FROM facts GROUP BY conv_id) f USING (conv_id)""")
STATEMENTS["eval_manifest"] = compose(["tasks", "transcript"], f"""
SELECT category, count(*) AS tasks, round_even(avg(tokens), 1) AS mean_tokens, any_value(digest) AS digest
FROM tasks JOIN (SELECT conv_id, sum({S.est('content')}) AS tokens FROM transcript GROUP BY conv_id) USING (conv_id)
JOIN {S.ordered_digest('tasks', 'category', 'conv_id', "conv_id || E'\\n' || question || E'\\n' || expected_answer")} d USING (category) GROUP BY category""")
