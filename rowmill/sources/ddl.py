"""CREATE TABLE text to a Spark schema.

Declared types keep their value class, not their width: every ``int`` is 64-bit, every ``decimal`` is a double
and text is never padded or cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# The accepted column types.
TYPES = {
    "char": T.StringType(),
    "varchar": T.StringType(),
    "string": T.StringType(),
    "int": T.LongType(),
    "decimal": T.DoubleType(),
    "date": T.DateType(),
}

_HEAD = re.compile(r"^\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([`\"\w.]+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_COLUMN = re.compile(r"^([`\"]?\w+[`\"]?)\s+(\w+)\s*(?:\([\d\s,]*\))?\s*(.*)$", re.S)
_TABLE_CONSTRAINT = re.compile(r"^(?:constraint\s+\w+\s+)?(primary\s+key|foreign\s+key|unique|check|index|key)\b\s*(?:\w+\s*)?\(?([^)]*)\)?", re.I)


class DdlError(ValueError):
    """A CREATE TABLE statement that cannot be mapped."""


@dataclass(frozen=True)
class TableDef:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()


def strip_comments(sql: str) -> str:
    """Blank out ``--`` and ``/* */`` comments that stand outside quotes."""
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", sql, flags=re.S)


def _split_top_level(body: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(body[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, body[last:]]]


def parse_create_table(sql: str) -> TableDef:
    """Map one CREATE TABLE statement; an unknown type or an unreadable column raises ``DdlError``."""
    head = _HEAD.match(strip_comments(sql))
    if not head:
        raise DdlError(f"not a CREATE TABLE statement with columns: {sql.strip()[:80]!r}")
    fields: list[T.StructField] = []
    key: list[str] = []
    for item in _split_top_level(head[2]):
        constraint = _TABLE_CONSTRAINT.match(item)
        if constraint and not (re.match(r"\w+\s+(\w+)", item) and re.match(r"\w+\s+(\w+)", item)[1].lower() in TYPES):
            if constraint[1].lower().startswith("primary"):
                key += [c.strip(' `"') for c in constraint[2].split(",")]
            continue
        column = _COLUMN.match(item)
        if not column:
            raise DdlError(f"cannot read column definition {item!r}")
        name, kind, rest = column[1].strip('`"'), column[2].lower(), column[3]
        if kind not in TYPES:
            raise DdlError(f"column {name}: type {kind!r} is not one of {', '.join(TYPES)}")
        fields.append(T.StructField(name, TYPES[kind], True))
        if re.search(r"\bprimary\b", rest, re.I):
            key.append(name)
    names = [f.name.lower() for f in fields]
    if len(set(names)) < len(names):
        raise DdlError(f"table {head[1]}: a column is declared twice")
    if unknown := [k for k in key if k.lower() not in names]:
        raise DdlError(f"table {head[1]}: key column {unknown[0]} is not declared")
    return TableDef(head[1].strip('`"'), T.StructType(fields), tuple(key))
