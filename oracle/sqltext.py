"""SQL snippets (DuckDB dialect) that restate the text rules."""

from __future__ import annotations

from turnloom.functions import text as X


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)


def norm(x: str) -> str:
    return ("trim(regexp_replace(replace(lower(strip_accents(coalesce(%s, ''))), 'ß', 'ss'), "
            "'\\s+', ' ', 'g'))" % x)


STEM = ("CASE WHEN length(w) > 4 AND w LIKE '%ing' THEN "
        "CASE WHEN length(w) > 5 AND w[-4] = w[-5] AND NOT regexp_matches(w[-4], '[aeiou]') "
        "THEN w[:-5] ELSE w[:-4] END "
        "WHEN length(w) > 4 AND w LIKE '%ed' THEN w[:-3] "
        "WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END")


def words(normalized: str) -> str:
    pattern = X.TOKEN_PATTERN.replace("'", "''")
    return f"list_transform(regexp_extract_all({normalized}, '{pattern}'), lambda w: {STEM})"


def toks(x: str) -> str:
    return f"list_filter({words(norm(x))}, lambda w: NOT list_contains({listing(X.STOPWORDS)}, w))"


def bigrams(t: str) -> str:
    return (f"list_distinct(list_transform(range(1, greatest(len({t}), 1)), "
            f"lambda i: ({t})[i] || ' ' || ({t})[i + 1]))")


def jac(a: str, b: str) -> str:
    return (f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1e0 ELSE "
            f"len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / "
            f"len(list_distinct(list_concat({a}, {b}))) END)")


def est(x: str) -> str:
    return f"CAST(ceil(length(coalesce({x}, '')) / 4e0) AS BIGINT)"


def answer(x: str) -> str:
    return ("trim(regexp_replace(regexp_replace(translate(replace(lower(coalesce(%s, '')), 'ß', 'ss'), "
            "'-_', '  '), '[^\\p{L}\\p{M}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))" % x)


def has_phrase(h: str, n: str) -> str:
    return f"(length({answer(n)}) > 0 AND contains(' ' || {answer(h)} || ' ', ' ' || {answer(n)} || ' '))"


def any_phrase(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(p)})" for p in phrases) + ")"


def sentences(x: str) -> str:
    """Mark the breaks (no look-behind in RE2), then split on the mark."""
    marked = f"regexp_replace(trim({x}, E' \\n\\t\\r'), '([.!?])\\s+', E'\\\\1\\x01', 'g')"
    return (f"list_filter(list_transform(string_split({marked}, E'\\x01'), lambda s: trim(s, E' \\n\\t\\r')), "
            "lambda s: length(s) > 0)")


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def preview(x: str, limit: int = 160) -> str:
    flat = collapse(x)
    return (f"CASE WHEN length({flat}) <= {limit} THEN {flat} "
            f"ELSE rtrim(left({flat}, {limit - 1})) || '…' END")


def join_list(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, '{sep}')"


def ordered_digest(source: str, key: str, order: str, leaf: str, fan: int = 256, levels: int = 5) -> str:
    """(key, n, digest) of a hash tree over the rows of each key in their order."""
    nodes = (f"(SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY {order} NULLS FIRST, node) - 1 AS place, 1 AS n, node "
             f"FROM (SELECT {key}, {order}, sha256({leaf}) AS node FROM {source}))")
    for _ in range(levels):
        nodes = (f"(SELECT {key}, place // {fan} AS place, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(node) "
                 f"ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node FROM {nodes} t GROUP BY {key}, place // {fan})")
    return f"(SELECT {key}, n, sha256(n || ':' || node) AS digest FROM {nodes} t)"
