"""Common table expressions shared by the statements, and their composer."""

from __future__ import annotations

from oracle import sqltext as S
from turnloom.operators import evalset as E

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: list[str], sql: str) -> None:
    BLOCKS[name] = (needs, sql)


def compose(needs: list[str], final: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in BLOCKS[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return final
    head = ", ".join(
        f"{n} AS ({BLOCKS[n][1]})" if not BLOCKS[n][1].startswith("@") else BLOCKS[n][1][1:]
        for n in ordered)
    return f"WITH RECURSIVE {head} {final}"


def draw(key: str, salt: str | int, n: int) -> str:
    return (f"CAST(((({key})::BIGINT * 7919 + ({salt})::BIGINT * 104729 + 1299709) % 1000003 "
            f"* 48271 % 2147483647) % {n} AS INTEGER)")


def pick(options, index: str) -> str:
    return f"({S.listing(options)})[1 + ({index}) % {len(options)}]"


def render(template: str, names) -> str:
    for name, value in names.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


_N = {n: n for n in ("project", "database", "new_database", "region", "old_day", "new_day",
                     "old_time", "new_time", "topic")}
_D1, _D2 = draw("conv_id", 1, 12), draw("conv_id", 2, 8)
_DAY, _HOUR = draw("conv_id", 4, 6), draw("conv_id", 6, 5)

block("sized", [], f"SELECT conv_id, count(*) AS n_turns, CAST(sum({S.est('text')}) AS BIGINT) AS raw_tokens "
                   "FROM conversations GROUP BY conv_id")
block("named", ["sized"], f"""
SELECT *, {pick(E.CATEGORIES, 'conv_id')} AS category, CASE WHEN raw_tokens <= 500 THEN 500 WHEN raw_tokens <= 1000 THEN 1000 ELSE 3000 END AS length_tier,
 {pick(E.PROJECTS, _D1)} AS project, {pick(E.DATABASES, _D2)} AS database,
 {pick(E.DATABASES, _D2 + ' + 1')} AS new_database, {pick(E.REGIONS, draw('conv_id', 3, 6))} AS region,
 {pick(E.DAYS, _DAY)} AS old_day, {pick(E.DAYS, _DAY + ' + 1 + ' + draw('conv_id', 5, 5))} AS new_day,
 {pick(E.TIMES, _HOUR)} AS old_time, {pick(E.TIMES, _HOUR + ' + 1')} AS new_time,
 {pick(E.TOPICS, draw('conv_id', 7, 5))} AS topic FROM sized""")
block("tasks", ["named"], f"""
SELECT n.*, {render('c.q', _N)} AS question, {render('c.expected', _N)} AS expected_answer,
 {render('c.extra', _N)} AS extra, c.first_no,
 least(11, CASE WHEN category = 'abstention' THEN greatest(2, raw) ELSE raw END) AS n_distractors,
 category = 'abstention' AS abstention_expected,
 CASE WHEN category = 'cross_session' THEN 2 ELSE 1 END AS session_count
FROM (SELECT *, greatest(1, least(10, (1 + length_tier // 3000) * CASE WHEN category = 'distractor' THEN 3 ELSE 1 END)) AS raw
      FROM named) n
JOIN (VALUES {S.values(E.CONTRACTS)}) c(category, q, expected, extra, factor, first_no) USING (category)""")
block("plan_rows", [], f"""
SELECT * FROM (VALUES {S.values(E.PLANS)}) p(category, no, role, fact_type, position, t, s, v, m, supersedes, superseded_by)""")
_STEP = f"({E.SPREAD_HIGH}e0 - {E.SPREAD_LOW}e0)"
_KIND = draw("conv_id", "i + 50", 4)
_DF = {"project": "dp", "database": "dd", "period": "pd"}
block("facts_raw", ["tasks", "plan_rows"], f"""
SELECT t.conv_id, t.n_turns, category, 'fact-' || no AS fact_id, role, fact_type, position::DOUBLE AS position, {render('t', _N)} AS text,
 {render('s', _N)} AS subject, {render('v', _N)} AS value,
 list_filter(string_split({render('m', _N)}, '|'), lambda x: x <> '') AS markers, supersedes, superseded_by
FROM tasks t JOIN plan_rows USING (category)
UNION ALL
SELECT conv_id, n_turns, category, 'fact-' || (first_no + i), 'irrelevant', 'irrelevant',
 CASE WHEN n_distractors = 1 THEN {round((E.SPREAD_LOW + E.SPREAD_HIGH) / 2, 4)}e0
  ELSE round_even({E.SPREAD_LOW}e0 + i * ({_STEP} / (n_distractors - 1)), 4) END,
 {render(pick([d[0] for d in E.DISTRACTORS], _KIND), _DF)}, 'Project ' || dp, '',
 ['Project ' || dp, {render(pick([d[1] for d in E.DISTRACTORS], _KIND), _DF)}], '', ''
FROM (SELECT *, {pick(E.PROJECTS, _D1 + ' + 1 + i')} AS dp, {pick(E.DATABASES, _D2 + ' + 2 + i % 6')} AS dd,
       {pick(E.PERIODS, 'i')} AS pd
      FROM (SELECT *, unnest(range(0, n_distractors))::INTEGER AS i FROM tasks))""")
block("facts_ranked", ["facts_raw"], """
SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY role = 'absent', position, fact_id) - 1)::INTEGER AS j,
 count(*) FILTER (WHERE role <> 'absent') OVER (PARTITION BY conv_id) AS n_facts FROM facts_raw""")
block("facts", ["facts_ranked"], f"""
SELECT * EXCLUDE (before), CASE WHEN role = 'absent' THEN 0 ELSE before END AS turns_before,
 CASE WHEN role = 'absent' THEN 0 ELSE before + 2 * j END AS introduced_turn,
 {pick(E.ACKNOWLEDGEMENTS, draw('conv_id', 'j + 90', 5))} AS ack
FROM (SELECT *, least(n_turns + n_facts - 1 - j, max(round_even(position * (n_turns + n_facts), 0) - j)
       OVER (PARTITION BY conv_id ORDER BY j))::INTEGER AS before FROM facts_ranked)""")
block("fact_sizes", ["facts"], f"""
SELECT conv_id, max(n_facts) AS n_facts, max(introduced_turn) FILTER (WHERE role <> 'absent') AS last_fact,
 CAST(sum({S.est('text')} + {S.est('ack')}) FILTER (WHERE role <> 'absent') AS BIGINT) AS fact_tokens FROM facts GROUP BY conv_id""")
block("messages", ["facts"], """
SELECT conv_id, (turn + 2 * (SELECT count(*) FROM facts f WHERE f.conv_id = c.conv_id AND f.role <> 'absent' AND f.turns_before <= c.turn))::INTEGER AS pos,
 lower(role) AS role, text AS content, '' AS fact_id FROM conversations c
UNION ALL SELECT conv_id, introduced_turn, 'user', text, fact_id FROM facts WHERE role <> 'absent'
UNION ALL SELECT conv_id, introduced_turn + 1, 'assistant', ack, '' FROM facts WHERE role <> 'absent'""")
block("transcript", ["messages", "tasks"], f"""
SELECT m.*, CASE WHEN m.pos >= b.boundary THEN 1 ELSE 0 END AS session FROM messages m LEFT JOIN (
 SELECT conv_id, min(pos) AS boundary FROM messages JOIN (
   SELECT conv_id, greatest(1, round_even({E.SESSION_FRACTION}e0 * count(*), 0)) AS start FROM messages GROUP BY conv_id) USING (conv_id)
 WHERE role = 'user' AND pos >= start
  AND conv_id IN (SELECT conv_id FROM tasks WHERE session_count > 1) GROUP BY conv_id) b USING (conv_id)""")
