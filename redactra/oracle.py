"""SQL for the redaction queries, made from the catalogue: an independent way to the same rows.

The rules' expressions are fixed values, here written for an engine without
look-behind: what must stand before a match is a group of its own.  Offsets
come from splitting at sentinels.  Non-ASCII letters are replaced by an ASCII
one before matching, so that word borders are those of Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from .catalog import CONTEXT_WINDOW, CONTEXTS, LANGUAGES, MARKERS, RULES, SKIP, RuleSpec
from .functions.text import EDGES, HONORIFIC

_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shadow(text: str) -> str:
    return f"regexp_replace({text}, '[À-ÖØ-öø-ɏ]', 'x', 'g')"


def lines(table: str = "documents") -> str:
    """CTEs ``lines`` (all lines) and ``units`` (doc_id, unit_seq, text, context) of a table's texts."""
    return f"""lines AS (SELECT doc_id, i - 1 AS unit_seq, parts[i] AS text FROM (
  SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {table})),
units AS (SELECT doc_id, unit_seq, text, coalesce(lag(substr(text, 1, 90)) OVER (PARTITION BY doc_id ORDER BY unit_seq), '') AS context
  FROM lines WHERE regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]'))"""


def _digits(value: str, places: str, weight: str) -> str:
    return f"list_sum(list_transform(range({places}), lambda i: TRY_CAST(substr({value}, CAST(i AS INT) + 1, 1) AS INT) * ({weight})))"


def valid(check: str, v: str) -> str:
    """Whether a check digit holds, as an expression."""
    clean = f"upper(regexp_replace({v}, '[^0-9A-Za-z]', '', 'g'))"
    letter = lambda number, last: f"substr('{_LETTERS}', CAST(TRY_CAST({number} AS BIGINT) % 23 AS INT) + 1, 1) = {last}"
    if check == "rut":
        body = f"upper(regexp_replace({v}, '[^0-9kK]', '', 'g'))"
        number = f"left({body}, -1)"
        rest = f"(11 - {_digits(f'reverse({number})', f'length({number})', 'i % 6 + 2')} % 11)"
        return f"(length({body}) BETWEEN 8 AND 9 AND right({body}, 1) = CASE {rest} WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST({rest} AS VARCHAR) END)"
    if check == "dni":
        return f"(regexp_matches({clean}, '^[0-9]{{8}}[A-Z]$') AND {letter(f'left({clean}, 8)', f'right({clean}, 1)')})"
    if check == "nie":
        number = f"translate(left({clean}, 1), 'XYZ', '012') || substr({clean}, 2, 7)"
        return f"(regexp_matches({clean}, '^[XYZ][0-9]{{7}}[A-Z]$') AND {letter(number, f'right({clean}, 1)')})"
    if check == "cif":
        d = f"TRY_CAST(substr({clean}, CAST(i AS INT) + 2, 1) AS INT)"
        total = f"list_sum(list_transform(range(7), lambda i: CASE WHEN i % 2 = 1 THEN {d} ELSE {d} * 2 // 10 + {d} * 2 % 10 END))"
        control = f"CAST((10 - {total} % 10) % 10 AS INT)"
        as_digit, as_letter = f"right({clean}, 1) = CAST({control} AS VARCHAR)", f"right({clean}, 1) = substr('JABCDEFGHI', {control} + 1, 1)"
        fits = f"CASE WHEN left({clean}, 1) IN ('P', 'Q', 'R', 'S', 'N', 'W') THEN {as_letter} WHEN left({clean}, 1) IN ('A', 'B', 'E', 'H') THEN {as_digit} ELSE {as_digit} OR {as_letter} END"
        return f"(regexp_matches({clean}, '^[ABCDEFGHJNPQRSUVW][0-9]{{7}}[0-9A-Z]$') AND {fits})"
    if check == "iban":
        tight = f"upper(regexp_replace({v}, '\\s', '', 'g'))"
        values = f"list_transform(string_split(substr({tight}, 5) || left({tight}, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN CAST(x AS INT) ELSE ascii(x) - 55 END)"
        rest = f"list_reduce({values}, lambda a, c: (a * (CASE WHEN c > 9 THEN 100 ELSE 10 END) + c) % 97)"
        return f"(length({tight}) BETWEEN 15 AND 34 AND regexp_matches({tight}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') AND {rest} = 1)"
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    d = f"TRY_CAST(substr(reverse({digits}), CAST(i AS INT) + 1, 1) AS INT)"
    total = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} >= 5 THEN {d} * 2 - 9 ELSE {d} * 2 END))"
    return f"(length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"


def _matches(k: int, rule: RuleSpec) -> str:
    """All matches of a rule in ``units``, with offsets in code points."""
    pattern, before = rule.pattern.replace(r"(?!\w)", r"\b"), re.match(r"\(\?<!(\[[^\]]*\])\)", rule.pattern)
    if before:
        kept = before[1].replace("[", "[^", 1)
        pattern, put = f"(^|{kept})({pattern[before.end():]})", r"'\1' || chr(1) || '\2' || chr(1)"
    elif rule.group:
        put = r"chr(1) || '\0' || chr(2) || '\1' || chr(1)"
    else:
        put = r"chr(1) || '\0' || chr(1)"
    value = "split_part(p, chr(2), 2)" if rule.group else "p"
    flag = "(?i)" if rule.ignore_case else ""
    return f"""SELECT doc_id, unit_seq, text, context, {k} AS rule, pos + length(split_part(p, chr(2), 1)) - length({value}) AS s, pos + length(split_part(p, chr(2), 1)) AS e
FROM (SELECT doc_id, unit_seq, text, context, parts[i] AS p, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(split_part(x, chr(2), 1)))), 0) AS pos
  FROM (SELECT doc_id, unit_seq, text, context, parts, unnest(range(2, len(parts) + 1, 2)) AS i
    FROM (SELECT doc_id, unit_seq, text, context, string_split(regexp_replace({shadow("text")}, {quoted(flag + pattern)}, {put}, 'g'), chr(1)) AS parts FROM units)))
WHERE length({value}) > 0"""


def _by_rule(rules: list[tuple[int, RuleSpec]], value, default: str) -> str:
    return "CASE rule " + " ".join(f"WHEN {k} THEN {v}" for k, r in rules if (v := value(r)) is not None) + f" ELSE {default} END"


def raw(rules: Iterable[tuple[int, RuleSpec]]) -> str:
    """CTE ``raw`` (doc_id, unit_seq, rule, s, e, kind, value, priority, lvl): spans of the rules in ``units``."""
    rules = list(rules)
    found = "\nUNION ALL ".join(_matches(k, r) for k, r in rules)
    near = f"substr(text, CAST(greatest(0, s - {CONTEXT_WINDOW}) AS BIGINT) + 1, CAST(e + {CONTEXT_WINDOW} - greatest(0, s - {CONTEXT_WINDOW}) AS BIGINT))"
    said = lambda r: r.context and f"regexp_matches({near}, {quoted('(?i)' + CONTEXTS[r.context])}) OR regexp_matches(context, {quoted('(?i)' + CONTEXTS[r.context])})"
    checks = {r.check for _, r in rules if r.check}
    ok = "CASE " + " ".join(f"WHEN rule IN ({', '.join(str(k) for k, r in rules if r.check == c)}) THEN {valid(c, 'value')}" for c in sorted(checks)) + " ELSE false END" if checks else "false"
    needs = ", ".join(str(k) for k, r in rules if r.check and r.required) or "-1"
    with_rules = [(k, r) for k, r in rules if r.context]
    context = _by_rule(with_rules, said, "true") if with_rules else "true"
    return f"""found AS ({found}),
near AS (SELECT *, substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS value FROM found WHERE {context}),
raw AS (SELECT doc_id, unit_seq, rule, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, {_by_rule(rules, lambda r: quoted(r.kind), "''")} AS kind, value,
  {_by_rule(rules, lambda r: str(r.priority), "0")} + CASE WHEN ok THEN 10 ELSE 0 END AS priority, {_by_rule(rules, lambda r: str(r.level), "0")} AS lvl
  FROM (SELECT *, coalesce({ok}, false) AS ok FROM near) WHERE ok OR rule NOT IN ({needs}))"""


def chosen(source: str = "raw", name: str = "spans", partition: str = "doc_id, unit_seq") -> str:
    """CTE ``name``: the disjoint spans, taken in order of priority, length and place."""
    same = " AND ".join(f"w.{c} = r.{c}" for c in partition.split(", "))
    own = ", ".join(f"w.{c}" for c in partition.split(", "))
    span = "{'s': r.s, 'e': r.e, 'kind': r.kind, 'value': r.value, 'priority': r.priority}"
    return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY priority DESC, e - s DESC, s, rule) AS rn FROM {source}),
{name}_walk AS (SELECT {partition}, rn, [{span.replace("r.", "")}] AS got FROM {name}_ranked WHERE rn = 1
  UNION ALL SELECT {own}, r.rn, CASE WHEN len(list_filter(w.got, lambda o: r.s < o.e AND o.s < r.e)) > 0 THEN w.got ELSE list_append(w.got, {span}) END
  FROM {name}_walk w JOIN {name}_ranked r ON {same} AND r.rn = w.rn + 1),
{name} AS (SELECT {partition}, x.s AS s, x.e AS e, x.kind AS kind, x.value AS value, x.priority AS priority
  FROM (SELECT {partition}, unnest(got) AS x FROM (SELECT *, max(rn) OVER (PARTITION BY {partition}) AS top FROM {name}_walk) WHERE rn = top) WHERE x.kind <> '{SKIP}')"""


def key(value: str) -> str:
    """An entity's key (for all kinds but organisations)."""
    tight = f"trim(regexp_replace(regexp_replace({value}, {quoted(EDGES)}, '', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(replace(lower(strip_accents({tight})), 'ß', 'ss'), {quoted(HONORIFIC)}, ''))"


def marker(kind: str, n: str, language: str = "en") -> str:
    at = LANGUAGES.index(language)
    return f"('[' || CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{v[at]}'" for k, v in MARKERS.items()) + f" ELSE {kind} END || '_' || {n} || ']')"


def numbered(source: str = "spans") -> str:
    """CTE ``numbered``: spans with key, n and marker."""
    return f"""keyed AS (SELECT *, {key("value")} AS key FROM {source}),
placed AS (SELECT *, min({{'u': unit_seq, 's': s}}) OVER (PARTITION BY doc_id, kind, key) AS first FROM keyed),
numbered AS (SELECT *, {marker("kind", "n")} AS marker FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, kind ORDER BY first) AS n FROM placed))"""


#: CTE ``redacted`` (doc_id, unit_seq, redacted, replaced): units in which something was replaced.
REDACTED = """pieces AS (SELECT n.*, u.text, coalesce(lag(n.e) OVER (PARTITION BY n.doc_id, n.unit_seq ORDER BY n.s), 0) AS upto
  FROM numbered n JOIN units u ON n.doc_id = u.doc_id AND n.unit_seq = u.unit_seq),
redacted AS (SELECT doc_id, unit_seq, string_agg(substr(text, upto + 1, s - upto) || marker, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS redacted, count(*) AS replaced
  FROM pieces GROUP BY doc_id, unit_seq)"""


def rules_of(kinds: Iterable[str] | None = None, level: int = 3) -> list[tuple[int, RuleSpec]]:
    return [(k, r) for k, r in enumerate(RULES) if r.level <= level and (kinds is None or r.kind in kinds)]
