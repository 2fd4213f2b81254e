from __future__ import annotations

from oracle import sqltext as S
from oracle.blocks import block, compose, draw, pick
from oracle.evaluation_sets import distinct_in_order, _ACCEPTED
from oracle.statements import STATEMENTS
from turnloom.functions import text as X
from turnloom.operators import failures as FT
from turnloom.operators import modes as M
from turnloom.operators import paired as P
from turnloom.operators import rollups as R
from turnloom.plans.scoring import MODE_NAMES, REASONS, SETS

_MODES = S.values([(m, i) for i, m in enumerate(MODE_NAMES)])
block("mode_list", [], f"SELECT * FROM (VALUES {_MODES}) v(mode, no)")
_K = "conv_id * 131 + pos"
block("items", ["transcript", "mode_list"], f"""
SELECT * FROM (SELECT conv_id, mode, no, pos, content, chosen, chosen AND evicted AS lost,
  no = 0 OR back <= CASE WHEN no = 1 THEN 8 ELSE 2 END OR (chosen AND NOT evicted) AS shown
 FROM (SELECT *, no BETWEEN 2 AND 7 AND {draw(_K, 'no', 3)} = 0 AS chosen, {draw(_K, 'no + 40', 5)} = 0 AS evicted
  FROM (SELECT t.*, count(*) OVER (PARTITION BY conv_id) - pos AS back FROM transcript t), mode_list)) WHERE chosen OR shown""")
block("message_facts", ["transcript", "facts"], f"""
SELECT conv_id, pos, fact_id FROM (
 SELECT t.conv_id, t.pos, f.fact_id, len(f.markers) AS wanted, unnest(list_transform(f.markers, lambda m: {S.answer('m')})) AS m, t.n
 FROM (SELECT conv_id, pos, {S.answer('content')} AS n FROM transcript) t JOIN facts f USING (conv_id) WHERE f.role <> 'absent')
WHERE contains(' ' || n || ' ', ' ' || m || ' ') GROUP BY ALL HAVING count(*) = wanted""")
block("drops", ["items"], f"""
SELECT conv_id, mode, pos AS seq, {pick(REASONS, draw(_K, 'no + 80', len(REASONS)))} AS reason, {S.preview('content')} AS text
FROM items WHERE lost""")
_V = "CASE WHEN abstention_expected THEN 'I do not have that information.' ELSE expected_answer END"
block("answers", ["tasks", "facts", "mode_list"], f"""
SELECT conv_id, mode, no, trial, CASE WHEN lot < 4 THEN {_V} WHEN lot = 4 THEN old WHEN lot = 5 THEN 'I don''t know.'
 WHEN lot = 6 THEN 'It is Firebird_9, surely' WHEN lot = 7 THEN '' WHEN lot = 8 THEN 'Not ' || old || ' but ' || {_V}
 ELSE 'There is no record of that' END AS answer
FROM (SELECT t.*, m.*, r.trial, {draw('conv_id', 'no * 17 + trial * 7 + 3', 10)} AS lot,
  coalesce((SELECT max(value) FROM facts f WHERE f.conv_id = t.conv_id AND f.role = 'forbidden'), 'Oracle 23') AS old
 FROM tasks t, mode_list m, (VALUES (0), (1)) r(trial))""")
block("seen", ["items", "message_facts"], """
SELECT conv_id, mode, list(DISTINCT fact_id ORDER BY fact_id) FILTER (WHERE chosen) AS retrieved,
 list(DISTINCT fact_id ORDER BY fact_id) FILTER (WHERE shown) AS in_prompt
FROM items JOIN message_facts USING (conv_id, pos) GROUP BY ALL""")
block("costs", ["items"], f"SELECT conv_id, mode, CAST(sum({S.est('content')} + 4) FILTER (WHERE shown) AS BIGINT) AS final_tokens FROM items GROUP BY ALL")
block("full_costs", ["transcript"], f"SELECT conv_id, CAST(sum({S.est('content')} + 4) AS BIGINT) AS full_tokens FROM transcript GROUP BY ALL")


def _role(role: str) -> str:
    return (f"coalesce((SELECT list(fact_id ORDER BY fact_id) FROM facts f WHERE f.conv_id = t.conv_id AND f.role = '{role}'), "
            "[]::VARCHAR[])")


block("ledger", ["tasks", "facts"], f"""
SELECT *, {distinct_in_order('acc')} AS accepted FROM (
 SELECT t.*, {_role('required')} AS required, {_role('supporting')} AS supporting, {_role('forbidden')} AS forbidden, {_ACCEPTED} AS acc,
 coalesce((SELECT list(value ORDER BY j) FROM facts f WHERE f.conv_id = t.conv_id AND f.role = 'forbidden' AND value <> ''), []::VARCHAR[]) AS stale_values
 FROM tasks t)""")


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def both(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: list_contains({b}, x))"


_W = "list_concat(required, supporting)"
block("retrieval", ["ledger", "mode_list", "seen", "costs", "full_costs"], f"""
SELECT *, {minus('required', 'retrieved')} AS missing, {both('forbidden', 'retrieved')} AS forbidden_retrieved,
 {both('forbidden', 'in_prompt')} AS prompt_forbidden, {minus('required', 'in_prompt')} AS absent,
 {minus(both('required', 'retrieved'), 'in_prompt')} AS lost_after_selection, {minus('in_prompt', _W)} AS unneeded,
 CASE WHEN len(required) = 0 THEN 1e0 ELSE round_even(len({both('required', 'retrieved')})::DOUBLE / len(required), 6) END AS recall,
 CASE WHEN len(retrieved) = 0 THEN CASE WHEN len({_W}) > 0 THEN 0e0 ELSE 1e0 END
  ELSE round_even(len({both('retrieved', _W)})::DOUBLE / len(retrieved), 6) END AS precision,
 len(required) > 0 AND len({minus('required', 'in_prompt')}) = 0 AS evidence_in_prompt,
 len({both('forbidden', 'in_prompt')}) > 0 AS prompt_contains_forbidden
FROM (SELECT l.*, m.mode, m.no, coalesce(s.retrieved, []) AS retrieved, coalesce(s.in_prompt, []) AS in_prompt,
  coalesce(c.final_tokens, 0) AS final_tokens, f.full_tokens
 FROM ledger l CROSS JOIN mode_list m LEFT JOIN seen s USING (conv_id, mode) LEFT JOIN costs c USING (conv_id, mode) JOIN full_costs f USING (conv_id))""")
_HAS = "contains(' ' || n || ' ', ' ' || {v} || ' ')".format(v=S.answer("v"))
block("graded", ["retrieval", "answers"], f"""
SELECT *, CASE WHEN first = 'abstained' AND evidence_in_prompt THEN 'wrong_abstention' ELSE first END AS verdict
FROM (SELECT *, CASE WHEN answer = '' THEN 'ungraded' WHEN abstention_expected THEN CASE WHEN declined THEN 'correct' ELSE 'incorrect' END
  WHEN matched_answer <> '' THEN 'correct' WHEN declined THEN 'abstained' WHEN stale_value <> '' THEN 'stale_answer' ELSE 'incorrect' END AS first
 FROM (SELECT *, coalesce(list_filter(accepted, lambda v: {_HAS})[1], '') AS matched_answer,
   coalesce(list_filter(stale_values, lambda v: {_HAS})[1], '') AS stale_value,
   {S.any_phrase('n', X.NORMALIZED_ABSTENTIONS)} AS declined
  FROM (SELECT r.*, a.trial, a.answer, {S.answer('a.answer')} AS n FROM retrieval r JOIN answers a USING (conv_id, mode))))""")
block("scores", ["graded"], f"""
SELECT *, CASE verdict WHEN 'correct' THEN '' WHEN 'ungraded' THEN 'ungraded' WHEN 'wrong_abstention' THEN 'wrong_abstention'
  WHEN 'abstained' THEN 'missed_memory' WHEN 'stale_answer' THEN CASE WHEN category = 'conflict' THEN 'conflicting_memory' ELSE 'stale_memory' END
  ELSE CASE WHEN abstention_expected OR evidence_in_prompt THEN 'hallucination' ELSE 'missed_memory' END END AS error_type,
 CASE WHEN verdict = 'ungraded' THEN NULL WHEN abstention_expected THEN CASE WHEN verdict = 'correct' THEN 1e0 ELSE 0e0 END
  WHEN verdict IN ('abstained', 'wrong_abstention') THEN CASE WHEN evidence_in_prompt THEN 0e0 ELSE 1e0 END
  WHEN verdict = 'correct' THEN CASE WHEN evidence_in_prompt THEN 1e0 ELSE 0e0 END
  WHEN verdict = 'stale_answer' AND prompt_contains_forbidden THEN 1e0 ELSE 0e0 END AS faithfulness,
 CASE WHEN verdict = 'ungraded' THEN NULL WHEN final_tokens > 0 AND verdict = 'correct' THEN 1e0 / final_tokens ELSE 0e0 END AS qae,
 greatest(0, full_tokens - final_tokens) AS token_savings,
 round_even(greatest(0e0, 1e0 - final_tokens::DOUBLE / full_tokens), 6) AS context_reduction,
 category IN ('conflict', 'temporal') AS conflict_task,
 CASE WHEN {draw('conv_id', 'no + 60', 4)} > 0 THEN ({draw('conv_id', 'no + trial + 61', 900)} + 100)::DOUBLE END AS latency_ms FROM graded""")


def ids(*names) -> str:
    return ", ".join(f"array_to_string({n}, '|') AS {n}" for n in names)


STATEMENTS["score_retrieval"] = compose(["retrieval"], f"""
SELECT conv_id, mode, {ids('retrieved', 'in_prompt', 'missing', 'forbidden_retrieved', 'prompt_forbidden', 'absent', 'lost_after_selection', 'unneeded')},
 recall, precision, evidence_in_prompt, prompt_contains_forbidden FROM retrieval""")
STATEMENTS["score_answers"] = compose(["scores"], """
SELECT conv_id, mode, trial::BIGINT AS trial, answer, matched_answer, stale_value, verdict, error_type, faithfulness,
 round_even(qae, 6) AS qae, token_savings, context_reduction FROM scores""")
STATEMENTS["score_answer_lookup"] = compose(["answers", "tasks"], """
SELECT t.conv_id, m.mode, coalesce(a.answer, p.answer) AS answer FROM tasks t CROSS JOIN mode_list m
LEFT JOIN (SELECT * FROM answers WHERE no % 3 <> 1 AND trial = 1) a USING (conv_id, mode)
LEFT JOIN (SELECT * FROM answers WHERE no = 1 AND trial = 1 AND conv_id % 4 <> 0) p ON p.conv_id = t.conv_id""")
STATEMENTS["score_isolated_abstention"] = compose(["tasks"], """
SELECT conv_id, category, category IN ('abstention', 'cross_session') AS expects_abstention FROM tasks""")
STATEMENTS["score_length_tier"] = compose(["tasks"], """
SELECT conv_id, coalesce(CASE WHEN conv_id % 3 = 1 THEN length_tier END, CASE WHEN conv_id % 2 = 0 THEN length_tier + 1 END,
 CASE WHEN conv_id % 5 = 0 THEN 7 END, n_turns)::BIGINT AS length FROM tasks""")
STATEMENTS["score_loose_answer_flag"] = compose(["items", "tasks"], """
SELECT conv_id, mode, bool_or(expected_answer <> '' AND contains(lower(content), lower(expected_answer))) AS answer_text_in_prompt
FROM items JOIN tasks USING (conv_id) WHERE shown GROUP BY ALL""")
STATEMENTS["score_benchmark_markers"] = f"""
WITH marks AS (SELECT item_id, {S.answer("regexp_split_to_array(text, '[.] *')[1]")} AS mark FROM benchmark),
 docs AS (SELECT doc_id, ' ' || {S.answer('text')} || ' ' AS body FROM documents)
SELECT item_id, doc_id FROM marks JOIN docs ON contains(body, ' ' || mark || ' ') WHERE length(mark) > 40"""


STATEMENTS["score_benchmark_passages"] = f"""
WITH marks AS (SELECT DISTINCT item_id, {S.answer('sentence')} AS mark FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.] *')) AS sentence FROM benchmark)),
 docs AS (SELECT doc_id, ' ' || {S.answer('text')} || ' ' AS body FROM documents)
SELECT DISTINCT item_id, mark, doc_id FROM marks JOIN docs ON contains(body, ' ' || mark || ' ') WHERE length(mark) > 0"""


def rate(n: str, d: str) -> str:
    return f"round_even(coalesce(count(*) FILTER (WHERE {n}) / nullif(count(*) FILTER (WHERE {d}), 0)::DOUBLE, 0), 6)"


def mean(v: str) -> str:
    return f"round_even(coalesce(avg({v}), 0) + 1e-10, 6)"


_G = "verdict <> 'ungraded'"
_COLS = ["mode", "trial", "category", "length_tier"]
_MEASURES = {
    "task_count": "count(*)", "graded_answer_count": f"count(*) FILTER (WHERE {_G})",
    "retrieval_recall": mean("CASE WHEN len(required) > 0 THEN recall END"), "retrieval_precision": mean("precision"),
    "evidence_in_prompt_rate": rate("evidence_in_prompt", "len(required) > 0"),
    "answer_accuracy": rate("verdict = 'correct'", _G), "faithfulness": rate("faithfulness = 1", "faithfulness IS NOT NULL"),
    "faithfulness_count": "count(faithfulness)",
    "conflict_resolution_accuracy": rate("conflict_task AND verdict = 'correct'", f"conflict_task AND {_G}"),
    "conflict_task_count": f"count(*) FILTER (WHERE conflict_task AND {_G})",
    "abstention_accuracy": rate("abstention_expected AND verdict = 'correct'", "abstention_expected"),
    "stale_answer_rate": rate("verdict = 'stale_answer'", _G),
    "forbidden_in_prompt_rate": rate("conflict_task AND prompt_contains_forbidden", "conflict_task"),
    "mean_context_reduction": mean("context_reduction"), "mean_final_context_tokens": mean("final_tokens"),
    "mean_full_context_reference_tokens": mean("full_tokens"), "mean_token_savings": mean("token_savings"),
    "mean_quality_adjusted_efficiency": mean("qae"), "mean_latency_ms": "round_even(avg(latency_ms), 6)",
    "latency_count": "count(latency_ms)"}
_RAW_ACC = "count(*) FILTER (WHERE verdict = 'correct') / nullif(count(*) FILTER (WHERE verdict <> 'ungraded'), 0)::DOUBLE"
_ALL = ", ".join(f"{v} AS {k}" for k, v in _MEASURES.items())
_QPT = f"round_even(coalesce({_RAW_ACC}, 0) / nullif(round_even(avg(final_tokens), 6), 0), 6)"
_SLICE = "concat_ws('+', " + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in sorted(_COLS)) + ")"
_SETS = ", ".join("(" + ", ".join(g) + ")" for g in SETS)
STATEMENTS["aggregate_slices"] = compose(["scores"], f"""
SELECT {_SLICE} AS slice, mode, coalesce(trial, -1)::BIGINT AS trial, category, coalesce(length_tier, -1)::BIGINT AS length_tier, {_ALL}, {_QPT} AS quality_per_token
FROM scores GROUP BY GROUPING SETS ({_SETS})""")
block("points", ["scores"], f"SELECT mode, trial, length_tier, coalesce({_RAW_ACC}, 0) AS acc, {_ALL} FROM scores GROUP BY mode, trial, length_tier")
block("curves", ["points"], """
SELECT *, round_even(acc, 6) AS accuracy, first(acc) OVER (PARTITION BY mode, trial ORDER BY length_tier) AS ref FROM points""")
STATEMENTS["aggregate_degradation"] = compose(["curves"], """
SELECT mode, trial::BIGINT AS trial, length_tier::BIGINT AS length_tier, accuracy, round_even(ref, 6) AS reference_accuracy,
 round_even(ref - acc, 6) AS absolute_degradation, round_even(CASE WHEN ref <= 0 THEN 0 ELSE (ref - acc) / ref END, 6) AS relative_degradation FROM curves""")
STATEMENTS["aggregate_degradation_areas"] = compose(["curves"], """
SELECT mode, trial::BIGINT AS trial, count(*) AS point_count, round_even(sum(w * (a0 + accuracy) / 2), 6) AS area_under_accuracy_curve,
 round_even(sum(w * ((ref - a0) + (ref - accuracy)) / 2), 6) AS area_under_degradation_curve,
 round_even(sum(w * ((ref - a0) + (ref - accuracy)) / 2) / nullif(max(length_tier) - min(length_tier), 0), 6) AS mean_degradation
FROM (SELECT *, length_tier - lag(length_tier) OVER o AS w, lag(accuracy) OVER o AS a0 FROM curves WINDOW o AS (PARTITION BY mode, trial ORDER BY length_tier))
GROUP BY ALL""")
_TCASE = "CASE n - 1 " + " ".join(f"WHEN {k} THEN {v}e0" for k, v in R.T_CRITICAL_95.items())
_Z = R.Z_95


def t_crit(df: str) -> str:
    table = " ".join(f"WHEN {k} THEN {v}e0" for k, v in R.T_CRITICAL_95.items())
    return (f"CASE {df} {table} ELSE {_Z}e0 + {(_Z ** 3 + _Z)!r}e0 / (4e0 * ({df})) + "
            f"{(5 * _Z ** 5 + 16 * _Z ** 3 + 3 * _Z)!r}e0 / (96e0 * ({df}) * ({df})) END")


def summary(keys: str) -> str:
    return f"""SELECT {keys}, n, round_even(m + 1e-10, 6) AS mean, round_even(s, 6) AS sd,
 round_even(m - CASE WHEN n > 1 THEN {t_crit('n - 1')} * s / sqrt(n) ELSE 0 END, 6) AS ci_low,
 round_even(m + CASE WHEN n > 1 THEN {t_crit('n - 1')} * s / sqrt(n) ELSE 0 END, 6) AS ci_high
FROM (SELECT {keys}, count(*) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM long WHERE value IS NOT NULL GROUP BY ALL)"""


_RAW = {k: v.replace("round_even(coalesce(count(*)", "(coalesce(count(*)").replace(", 0), 6)", ", 0))")
        if v.startswith("round_even(coalesce(count(*)") else v for k, v in _MEASURES.items()}
_RAW["quality_per_token"] = f"coalesce({_RAW_ACC}, 0) / nullif(round_even(avg(final_tokens), 6), 0)"


def long_rows(keys: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, CAST({_RAW[m]} AS DOUBLE) AS value FROM scores GROUP BY {keys}, trial" for m in metrics)


block("long", ["scores"], long_rows("mode", R.HEADLINE))
STATEMENTS["aggregate_trial_summaries"] = compose(["long"], "SELECT * REPLACE (round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high) FROM (" + summary("mode, metric") + ")")
STATEMENTS["aggregate_length_summaries"] = compose(["scores"], "SELECT * REPLACE (length_tier::BIGINT AS length_tier) FROM (" + summary(
    "mode, length_tier, metric").replace("FROM long", "FROM (" + long_rows(
        "mode, length_tier", ["answer_accuracy", "mean_final_context_tokens"]) + ")") + ")")
STATEMENTS["aggregate_label_counts"] = compose(["scores"], """
SELECT mode, coalesce(nullif(error_type, ''), 'none') AS label, count(*) AS n, 'error' AS kind FROM scores GROUP BY ALL
UNION ALL SELECT mode, verdict, count(*), 'verdict' FROM scores GROUP BY ALL""")
STATEMENTS["aggregate_answer_side"] = compose(["scores"], f"""
SELECT mode, CASE WHEN h THEN 0 ELSE graded_answer_count END::BIGINT AS graded_answer_count, {', '.join(
    f'CASE WHEN NOT h THEN {c} END AS {c}' for c in ('answer_accuracy', 'faithfulness', 'stale_answer_rate', 'mean_quality_adjusted_efficiency'))}
FROM (SELECT mode, mode IN ('chunks', 'memory') AS h, {_ALL} FROM scores GROUP BY mode)""")
STATEMENTS["aggregate_headline_pivot"] = compose(["scores"], f"""
SELECT metric, {', '.join(f"round_even(avg(value) FILTER (WHERE mode = '{m}'), 6) AS {m}" for m in M.BASELINES)}
FROM ({long_rows('mode', ['answer_accuracy', 'retrieval_recall', 'mean_final_context_tokens'])}) GROUP BY metric""")
STATEMENTS["aggregate_usage"] = f"""
SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE event_id % 10 = 0) AS failures,
 CAST(sum(coalesce(CASE WHEN event_id % 3 <> 0 THEN (props::JSON->>'$.k')::BIGINT END, {S.est('props')})) AS BIGINT) AS tokens,
 round_even(avg(value) FILTER (WHERE value > 5), 6) AS mean_ms, max(value) FILTER (WHERE value > 5) AS max_ms FROM events GROUP BY event_type"""
_MEANS = " UNION ALL ".join(
    "SELECT conv_id, mode, '%s' AS metric, avg(%s) AS value FROM scores GROUP BY ALL" % (
        n, q.replace("1D", "1e0").replace("0D", "0e0")) for n, q in P.PAIR_METRICS.items())
_PAIRS = S.values(P.comparison_pairs(MODE_NAMES))
block("means", ["scores"], f"SELECT * FROM ({_MEANS}) WHERE value IS NOT NULL")


def effect(d: str) -> str:
    return f"CASE WHEN abs({d}) < 0.2 THEN 'negligible' WHEN abs({d}) < 0.5 THEN 'small' WHEN abs({d}) < 0.8 THEN 'medium' ELSE 'large' END"


def hedges(d: str, df: str) -> str:
    return f"CASE WHEN {df} <= 1 THEN {d} ELSE {d} * (1e0 - 3e0 / (4e0 * ({df}) - 1e0)) END"


STATEMENTS["compare_modes"] = compose(["means"], f"""
SELECT mode_a, mode_b, metric, n AS sample_size, round_even(ma, 6) AS mean_a, round_even(mb, 6) AS mean_b, round_even(md, 6) AS mean_difference,
 round_even(sd, 6) AS sd_difference, round_even(sd / sqrt(n), 6) AS standard_error,
 round_even(md - margin, 6) AS ci_low, round_even(md + margin, 6) AS ci_high, round_even(CASE WHEN sd > 0 THEN md / (sd / sqrt(n)) ELSE 0 END, 4) AS t_statistic,
 round_even(d, 4) AS cohens_d, round_even({hedges('d', 'n - 1')}, 4) AS hedges_g, {effect('d')} AS magnitude, wins, losses, ties,
 round_even(wins::DOUBLE / n, 4) AS win_rate,
 round_even(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1e0, 2e0 * list_sum(list_transform(range(0, least(wins, losses) + 1),
   lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2e0))))) END + 1e-10, 6) AS sign_test_p
FROM (SELECT *, CASE WHEN sd > 0 THEN md / sd ELSE 0 END AS d, CASE WHEN n > 1 THEN {t_crit('n - 1')} * sd / sqrt(n) ELSE 0 END AS margin
 FROM (SELECT mode_a, mode_b, metric, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a - b) AS md,
   CASE WHEN coalesce(stddev_samp(a - b), 0) < 1e-12 THEN 0 ELSE stddev_samp(a - b) END AS sd,
   count(*) FILTER (WHERE a > b) AS wins, count(*) FILTER (WHERE a < b) AS losses, count(*) FILTER (WHERE a = b) AS ties
  FROM (SELECT p.mode_a, p.mode_b, x.metric, x.value AS a, y.value AS b FROM (VALUES {_PAIRS}) p(mode_a, mode_b)
   JOIN means x ON x.mode = mode_a JOIN means y ON y.mode = mode_b AND y.metric = x.metric AND y.conv_id = x.conv_id) GROUP BY ALL))""")
# The t distribution of whole degrees of freedom is a finite sum over powers of the cosine of atan(t / sqrt(df)).
_EVEN = "sin(th) * list_sum(list_transform(range(0, df // 2), lambda j: exp(lgamma(j + 0.5e0) - lgamma(0.5e0) - lgamma(j + 1)) * pow(cos(th), 2 * j)))"
_ODD = ("2e0 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), "
        "lambda j: exp(lgamma(j + 1) + lgamma(1.5e0) - lgamma(j + 1.5e0)) * pow(cos(th), 2 * j + 1))), 0))")
STATEMENTS["compare_p_values"] = compose(["means"], f"""
SELECT mode_a, mode_b, metric, round_even(t, 4) AS t_statistic, round_even(CASE WHEN df < 1 THEN 1e0 WHEN sd = 0 THEN CASE WHEN md = 0 THEN 1e0 ELSE 0e0 END
  WHEN t = 0 THEN 1e0 ELSE greatest(0e0, 1e0 - CASE WHEN df % 2 = 0 THEN {_EVEN} ELSE {_ODD} END) END, 6) AS p_value
FROM (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM (SELECT *, n - 1 AS df, CASE WHEN sd > 0 THEN md / (sd / sqrt(n)) ELSE 0 END AS t
 FROM (SELECT mode_a, mode_b, metric, count(*) AS n, avg(a - b) AS md,
   CASE WHEN coalesce(stddev_samp(a - b), 0) < 1e-12 THEN 0 ELSE stddev_samp(a - b) END AS sd
  FROM (SELECT p.mode_a, p.mode_b, x.metric, x.value AS a, y.value AS b FROM (VALUES {_PAIRS}) p(mode_a, mode_b)
   JOIN means x ON x.mode = mode_a JOIN means y ON y.mode = mode_b AND y.metric = x.metric AND y.conv_id = x.conv_id) GROUP BY ALL)))""")
STATEMENTS["compare_label_groups"] = f"""
SELECT lang, n_a, n_b, round_even(ma, 6) AS mean_a, round_even(mb, 6) AS mean_b, round_even(d, 4) AS cohens_d,
 round_even({hedges('d', 'n_a + n_b - 2')}, 4) AS hedges_g, {effect('d')} AS magnitude
FROM (SELECT *, CASE WHEN n_a > 0 AND n_b > 0 AND pooled > 0 THEN (ma - mb) / sqrt(pooled) ELSE 0 END AS d
 FROM (SELECT *, ((n_a - 1) * va + (n_b - 1) * vb) / nullif(n_a + n_b - 2, 0) AS pooled FROM (
  SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_a, count(*) FILTER (WHERE quality <> 1) AS n_b,
   avg(n_chars) FILTER (WHERE quality = 1) AS ma, avg(n_chars) FILTER (WHERE quality <> 1) AS mb,
   coalesce(var_samp(n_chars) FILTER (WHERE quality = 1), 0) AS va, coalesce(var_samp(n_chars) FILTER (WHERE quality <> 1), 0) AS vb
  FROM documents JOIN labels USING (doc_id) GROUP BY lang)))"""

# --- failures -----------------------------------------------------------------
_LABEL = "CASE coalesce({r}, '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FT.DROP_LABELS.items()) + " ELSE '' END"
block("drop_facts", ["drops", "facts"], f"""
SELECT conv_id, mode, fact_id, min_by(reason, seq) AS reason FROM (
 SELECT conv_id, mode, seq, reason, fact_id, wanted FROM (
  SELECT d.*, f.fact_id, len(f.markers) AS wanted, unnest(list_transform(f.markers, lambda m: {S.answer('m')})) AS m
  FROM (SELECT *, {S.answer('text')} AS n FROM drops WHERE text <> '') d JOIN facts f USING (conv_id) WHERE f.role <> 'absent')
 WHERE contains(' ' || n || ' ', ' ' || m || ' ') GROUP BY ALL HAVING count(*) = wanted) GROUP BY ALL""")
block("reasons", ["drops"], """SELECT conv_id, mode, bool_or(reason IN ('low_relevance', 'weak_relevance')) AS rel,
 bool_or(reason IN ('cap', 'budget', 'memory_budget', 'chunk_budget', 'chunk_ceiling')) AS vol FROM drops GROUP BY ALL""")
block("blamed", ["retrieval", "drop_facts", "reasons"], f"""
SELECT conv_id, mode, list(label ORDER BY fact_id) AS blame_labels, string_agg(fact_id || ':' || label, '|' ORDER BY fact_id) AS blame FROM (
 SELECT r.conv_id, r.mode, r.fact_id, CASE WHEN lab <> '' THEN lab
   WHEN list_contains(r.retrieved, r.fact_id) THEN CASE WHEN coalesce(q.rel, false) AND NOT coalesce(q.vol, false) THEN 'irrelevant_memory' ELSE 'over_compression' END
   WHEN r.mode <> 'full_context' THEN 'missed_memory' ELSE 'over_compression' END AS label
 FROM (SELECT x.*, {_LABEL.format(r='d.reason')} AS lab FROM (SELECT conv_id, mode, retrieved, unnest(absent) AS fact_id FROM retrieval) x
   LEFT JOIN drop_facts d USING (conv_id, mode, fact_id)) r LEFT JOIN reasons q USING (conv_id, mode)) GROUP BY ALL""")
block("failed", ["scores", "blamed"], f"""
SELECT *, labels[1] AS failure_type, labels[2:] AS contributors, verdict NOT IN ('correct', 'ungraded') AS observed_failure,
 verdict <> 'ungraded' AS graded, list_contains(labels, 'over_compression') AS evidence_lost,
 CASE labels[1] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FT.STAGES.items())} END AS stage,
 CASE WHEN error_type IN ('', 'ungraded') THEN 'unlabelled' WHEN error_type = labels[1] THEN 'agree'
  WHEN error_type IN {tuple(FT.REFINABLE)} THEN 'refined' ELSE 'unexpected' END AS agreement
FROM (SELECT *, list_filter({S.listing(FT.ATTRIBUTION_ORDER)}, lambda l: list_contains(sig2, l)) AS labels
 FROM (SELECT *, CASE WHEN len(sig) = 0 AND verdict = 'incorrect' AND len(required) > 0 AND len(absent) = 0
    THEN [CASE WHEN len(unneeded) > 0 THEN 'wrong_memory' ELSE 'hallucination' END] ELSE sig END AS sig2
  FROM (SELECT s.*, coalesce(b.blame, '') AS blame, list_filter(list_concat([
    CASE WHEN verdict = 'incorrect' AND abstention_expected THEN 'hallucination' END,
    CASE WHEN verdict = 'stale_answer' THEN CASE WHEN category = 'conflict' THEN 'conflicting_memory' ELSE 'stale_memory' END END,
    CASE WHEN verdict IN ('abstained', 'wrong_abstention') AND evidence_in_prompt THEN 'wrong_abstention' END,
    CASE WHEN len(absent) > 0 THEN 'over_compression' END, CASE WHEN len(prompt_forbidden) > 0 THEN 'under_compression' END],
    coalesce(b.blame_labels, [])), lambda v: v IS NOT NULL) AS sig FROM scores s LEFT JOIN blamed b USING (conv_id, mode))))
WHERE len(labels) > 0""")
block("mix", ["failed"], f"""SELECT *, n / sum(n) OVER (PARTITION BY mode) AS share FROM (
 SELECT m.mode, l.label, (SELECT count(*) FROM failed f WHERE f.mode = m.mode AND list_contains(f.labels, l.label)) AS n
 FROM (SELECT DISTINCT mode FROM failed) m, (SELECT unnest({S.listing(FT.ATTRIBUTION_ORDER)}) AS label) l)""")
STATEMENTS["compare_failure_mix"] = compose(["mix"], """
SELECT mode, 'full_context' AS base, CAST(sum(n) AS BIGINT) AS label_total, round_even(sum(gap) / 2, 6) AS distance,
 max_by(label, lpad(n::VARCHAR, 12, '0') || label) AS top_label,
 CASE WHEN max(round(gap, 12)) > 0 THEN min_by(label, lpad((1000000000000 - (round(gap, 11) * 1e11)::BIGINT)::VARCHAR, 15, '0') || label) END AS largest_divergence
FROM (SELECT g.mode, g.label, g.n, abs(g.share - b.share) AS gap FROM mix g JOIN mix b ON b.mode = 'full_context' AND b.label = g.label)
GROUP BY mode""")
STATEMENTS["failure_records"] = compose(["failed"], """
SELECT conv_id, mode, trial::BIGINT AS trial, failure_type, stage, array_to_string(contributors, '|') AS contributors, observed_failure,
 evidence_lost, agreement, blame, coalesce((SELECT string_agg(CASE WHEN f.subject <> '' AND f.value <> '' THEN f.subject || ' = ' || f.value ELSE f.text END, '; ' ORDER BY f.fact_id)
  FROM facts f WHERE f.conv_id = x.conv_id AND f.role = 'required'), '') AS expected_memory FROM failed x""")
STATEMENTS["failure_slices"] = compose(["failed"], """
SELECT concat_ws('+', CASE WHEN grouping(category) = 0 THEN 'category' END, CASE WHEN grouping(length_tier) = 0 THEN 'length_tier' END,
  CASE WHEN grouping(mode) = 0 THEN 'mode' END) AS slice, mode, category, coalesce(length_tier, -1)::BIGINT AS length_tier, count(*) AS defect_count,
 count(*) FILTER (WHERE graded) AS graded_count, count(*) FILTER (WHERE observed_failure) AS observed_failure_count,
 count(*) FILTER (WHERE NOT observed_failure) AS latent_defect_count,
 round_even(count(*) FILTER (WHERE observed_failure) / nullif(count(*) FILTER (WHERE graded), 0)::DOUBLE, 6) AS failure_rate,
 count(*) FILTER (WHERE evidence_lost) AS evidence_lost_count, CAST(sum(len(absent)) AS BIGINT) AS absent_required_fact_count,
 count(*) FILTER (WHERE prompt_contains_forbidden) AS forbidden_in_prompt_count, count(*) FILTER (WHERE len(unneeded) > 0) AS unneeded_in_prompt_count
FROM failed GROUP BY GROUPING SETS ((), (mode), (category), (length_tier), (category, mode), (length_tier, mode))""")
STATEMENTS["failure_concentration"] = compose(["failed"], """
SELECT c.mode, c.category, failure_type, stage, n, defects_in_cell, round_even(n::DOUBLE / defects_in_cell, 6) AS share_of_cell, observed_failure_count
FROM (SELECT mode, category, failure_type, stage, count(*) AS n FROM failed GROUP BY ALL) c
JOIN (SELECT mode, category, count(*) AS defects_in_cell, count(*) FILTER (WHERE observed_failure) AS observed_failure_count FROM failed GROUP BY ALL) t
 ON t.mode = c.mode AND t.category = c.category ORDER BY n DESC, c.mode, c.category, failure_type LIMIT 10""")
STATEMENTS["failure_examples"] = compose(["failed"], """
SELECT mode, failure_type, conv_id, trial::BIGINT AS trial, verdict FROM failed
QUALIFY row_number() OVER (PARTITION BY mode, failure_type ORDER BY conv_id, trial) <= 2""")
STATEMENTS["failure_agreement"] = compose(["failed"], "SELECT error_type, failure_type, agreement, count(*) AS n FROM failed GROUP BY ALL")
STATEMENTS["failure_drop_labels"] = compose(["drops"], f"SELECT mode, reason, {_LABEL.format(r='reason')} AS label, count(*) AS n FROM drops GROUP BY ALL")
STATEMENTS["failure_totals"] = compose(["failed"], """
SELECT 'scored' AS measure, count(*) AS n FROM scores UNION ALL SELECT 'graded', count(*) FROM scores WHERE verdict <> 'ungraded'
UNION ALL SELECT 'records', count(*) FROM failed UNION ALL SELECT 'observed', count(*) FROM failed WHERE observed_failure
UNION ALL SELECT 'latent', count(*) FROM failed WHERE NOT observed_failure""")
