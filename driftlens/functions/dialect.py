"""Constructs of other dialects, rewritten as Spark SQL.

The text is edited in place: strings, quoted names and comments are masked
first, so nothing inside them is taken for syntax, and all that no rule knows
stays as it was written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

_HIDDEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)
#: A name, perhaps qualified; masked quoted names count.
_NAME = r"[\w\x00]+(?:\.[\w\x00]+)*"


@dataclass(frozen=True)
class Versioned:
    """What makes rows of a table versions of one another: equal keys; the greatest version is the last."""

    keys: Sequence[str]
    version: str


def _masked(sql: str) -> str:
    """sql of the same length, with names in quotes as NULs and strings and comments as blanks between marks."""
    return _HIDDEN.sub(lambda m: ("\x00" if m[0][0] in "\"`" else "\x01" if m[0][0] == "'" else " ") * len(m[0]), sql)


def _closing(masked: str, at: int) -> int:
    """The place of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(masked)):
        depth += {"(": 1, ")": -1}.get(masked[i], 0)
        if not depth:
            return i
    raise ValueError("a parenthesis is never closed")


def _edited(sql: str, pattern: str, edit: Callable[[re.Match, str], tuple[int, str]]) -> str:
    """sql with every match replaced; edit gets the match and the original text and says up to where it replaces by what."""
    out, at, masked = [], 0, _masked(sql)
    for m in re.finditer(pattern, masked, re.I):
        if m.start() >= at:
            end, text = edit(m, sql)
            out += [sql[at : m.start()], text]
            at = end
    return "".join(out) + sql[at:]


def exclude(sql: str) -> str:
    """* EXCLUDE (a, b) and * EXCLUDE a: Spark says EXCEPT and wants parentheses."""

    def edit(m: re.Match, text: str) -> tuple[int, str]:
        names = text[m.start(1) : m.end(1)]
        return m.end(), f"* EXCEPT {names if names.startswith('(') else f'({names})'}"

    return _edited(sql, rf"\*\s*EXCLUDE\s*(\([^()]*\)|{_NAME})", edit)


def flatten(sql: str) -> str:
    """, LATERAL FLATTEN(INPUT => x [, OUTER => TRUE]) f: f.value and f.index by a lateral view."""

    def edit(m: re.Match, text: str) -> tuple[int, str]:
        opening = m.end() - 1
        end = _closing(_masked(text), opening)
        body, outer = text[opening + 1 : end], ""
        found = re.search(r",\s*OUTER\s*=>\s*(TRUE|FALSE)\s*$", body, re.I)
        if found:
            body, outer = body[: found.start()], " OUTER" if found[1].upper() == "TRUE" else ""
        body = re.sub(r"^\s*INPUT\s*=>\s*", "", body, flags=re.I)
        alias = re.compile(rf"\s*(?:AS\s+)?({_NAME})", re.I).match(_masked(text), end + 1)
        if not alias:
            raise ValueError("FLATTEN without an alias")
        name = text[alias.start(1) : alias.end(1)]
        return alias.end(), f" LATERAL VIEW{outer} posexplode({body.strip()}) {name} AS index, value"

    return _edited(sql, r"\s*,\s*(?:LATERAL\s+|TABLE\s*\(\s*)?FLATTEN\s*\(", edit)


def array_join(sql: str) -> str:
    """[LEFT] ARRAY JOIN xs AS x: one row for each element; LEFT keeps rows without any."""

    def edit(m: re.Match, text: str) -> tuple[int, str]:
        name = text[m.start(3) : m.end(3)]
        return m.end(), f"LATERAL VIEW{' OUTER' if m[1] else ''} explode({text[m.start(2) : m.end(2)]}) {name}_rows AS {name}"

    return _edited(sql, rf"\b(LEFT\s+)?ARRAY\s+JOIN\s+({_NAME}(?:\([^()]*\))?)\s+AS\s+({_NAME})", edit)


def final(sql: str, versioned: Mapping[str, Versioned]) -> str:
    """FROM t FINAL: only the last version of each key, which the table's declaration names."""

    def edit(m: re.Match, text: str) -> tuple[int, str]:
        table = text[m.start(2) : m.end(2)]
        if table not in versioned:
            raise ValueError(f"the keys of {table} are not known")
        how = versioned[table]
        last = f"row_number() OVER (PARTITION BY {', '.join(how.keys)} ORDER BY {how.version} DESC)"
        rows = f"(SELECT * EXCEPT (last_version) FROM (SELECT *, {last} AS last_version FROM {table}) WHERE last_version = 1)"
        return m.end(), f"{text[m.start(1) : m.end(1)]} {rows} AS {table.rpartition('.')[2]}"

    return _edited(sql, rf"\b(FROM|JOIN)\s+({_NAME})\s+FINAL\b", edit)


def without_hints(sql: str) -> str:
    """Index hints and modifiers that say how, not what."""
    sql = _edited(sql, r"\b(?:USE|FORCE|IGNORE)\s+(?:INDEX|KEY)\s*(?:FOR\s+(?:JOIN|ORDER\s+BY|GROUP\s+BY)\s*)?\([^()]*\)", lambda m, _: (m.end(), ""))
    sql = _edited(sql, r"\bSELECT\s+(?:(?:STRAIGHT_JOIN|SQL_NO_CACHE|SQL_CALC_FOUND_ROWS|HIGH_PRIORITY)\s+)+", lambda m, _: (m.end(), "SELECT "))
    return _edited(sql, r"\bSTRAIGHT_JOIN\b", lambda m, _: (m.end(), "JOIN"))


def to_spark(sql: str, dialect: str, versioned: Mapping[str, Versioned] | None = None) -> str:
    """The statement as Spark reads it; constructs of the dialect that Spark has anyway stay."""
    sql = exclude(sql)
    if dialect == "snowflake":
        sql = flatten(sql)
    elif dialect == "clickhouse":
        sql = final(array_join(sql), versioned or {})
    elif dialect == "mysql":
        sql = without_hints(sql)
    return sql
