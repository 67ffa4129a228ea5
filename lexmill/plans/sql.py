"""Pieces of DuckDB SQL that the compared queries share, written apart from the Spark code."""

from __future__ import annotations

# The code points that Python's str.strip() and str.split() treat as white space, for RE2.
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"(CASE WHEN coalesce({collapse(c)}, '') = '' THEN []::VARCHAR[] ELSE string_split({collapse(c)}, ' ') END)"


def grams(c: str, n: int = 13) -> str:
    found = f"[regexp_extract_all(lower({c}), '[a-z0-9]+')]"  # in a list of one, so that the words are found once
    return f"(list_transform({found}, lambda w: list_distinct(list_transform(range(1, greatest(len(w) - {n} + 2, 1)::BIGINT), lambda i: array_to_string(w[i:i+{n - 1}], ' ')))))[1]"


def literal(v: object) -> str:
    """A Python value as a literal: lists and dictionaries as LIST and STRUCT."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"'{v}'::DOUBLE" if v != v or v in (float("inf"), float("-inf")) else repr(v)
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, dict):
        return "{" + ", ".join(f"'{k}': {literal(x)}" for k, x in v.items()) + "}"
    return "[" + ", ".join(map(literal, v)) + "]"


def values(rows: list[tuple], names: str) -> str:
    """A table of literals."""
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names}))"


#: Conversations as arrays of (role, content), and their canonical form.
CONVERSATIONS = "conv AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id)"
ROLE = "(CASE WHEN {r} IN ('human', 'prompter') THEN 'user' WHEN {r} IN ('gpt', 'bot') THEN 'assistant' ELSE {r} END)"


def canonical(c: str, exact: bool = False) -> str:
    role = ROLE.format(r="m.role" if exact else f"lower({strip('m.role')})")
    content = strip("coalesce(m.content, '')")
    return f"list_filter(list_transform({c}, lambda m: struct_pack(role := {role}, content := {content})), lambda x: x.content <> '')"


def identity(c: str) -> str:
    return f"sha256(to_json(list_transform({c}, lambda m: struct_pack(content := {collapse('m.content')}, role := m.role)))::VARCHAR)"
