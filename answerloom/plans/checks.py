"""SQL building blocks of the comparison queries (DuckDB dialect)."""

from __future__ import annotations

from answerloom.functions import text as X

QUOTE = lambda s: "'" + s.replace("'", "''") + "'"
WORDS = QUOTE(r"[\p{L}\p{N}_]+")


def strip(e: str) -> str:
    return f"regexp_replace({e}, {QUOTE(X.STRIP)}, '', 'g')"


def collapse(e: str) -> str:
    return strip(f"regexp_replace({e}, {QUOTE(X.WS + '+')}, ' ', 'g')")


def clean(e: str) -> str:
    base = strip(f"coalesce({e}, '')")
    cut = collapse(f"regexp_replace({base}, {QUOTE(X.LEADING_MARK)}, '')")
    return f"(CASE WHEN {cut} = '' THEN {base} ELSE {cut} END)"


def key(e: str) -> str:
    body = collapse(f"regexp_replace({clean(e)}, ':+\\z', '')")
    return f"replace(replace(lower({body}), 'ß', 'ss'), 'ς', 'σ')"


def exact_key(e: str) -> str:
    return f"lower({strip(f'coalesce({e}, {QUOTE(str())})')})"


def any_match(e: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({e}, {QUOTE(p)})" for p in patterns) + ")"


def is_question(e: str, least: str = "10") -> str:
    s = strip(e)
    return f"(length({s}) >= {least} AND {any_match(s, X.QUESTION + X.LABEL)} AND NOT {any_match(s, X.NOT_QUESTION)})"


def stamp(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


def vectors(name: str, source: str, text: str = "question") -> str:
    """CTEs with the sparse hashed vector of every row of (id, text): name(id, b, w)."""
    return f"""{name}_tok AS (SELECT id, unnest(regexp_extract_all(lower({text}), {WORDS})) AS t FROM ({source}) s),
    {name}_cnt AS (SELECT id, CAST(concat('0x', substr(md5(t), 1, 2)) AS INTEGER) AS b, count(*) AS c FROM {name}_tok GROUP BY ALL),
    {name} AS (SELECT id, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM {name}_cnt)"""


def best(name: str, left: str, right: str, entries: str) -> str:
    """CTE name(a, b, s): the best right id per left id; without overlap the lowest id at 0."""
    return f"""{name}_dot AS (SELECT l.id AS a, r.id AS b, sum(l.w * r.w) AS s FROM {left} l JOIN {right} r ON l.b = r.b GROUP BY ALL),
    {name}_all AS (SELECT a, b, s FROM {name}_dot UNION ALL
      SELECT x.id, (SELECT min(id) FROM ({entries}) e), 0.0 FROM (SELECT DISTINCT id FROM {left}_src) x),
    {name} AS (SELECT a, b, s FROM {name}_all QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) = 1)"""


def components(pairs: str) -> str:
    """Recursive CTEs reach(id, other) and comp(id, root) over pairs(a, b)."""
    return f"""edge AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}),
    reach(id, other) AS (SELECT a, a FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON r.other = e.a),
    comp AS (SELECT id, min(other) AS root FROM reach GROUP BY id)"""
