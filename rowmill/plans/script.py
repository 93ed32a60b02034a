"""SQL scripts: CREATE TABLE and SELECT statements, split at top-level semicolons."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from rowmill.sources.catalog import Catalog
from rowmill.sources.ddl import strip_comments

_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", re.S)


class UnsupportedStatement(ValueError):
    """A statement that is neither CREATE TABLE nor a query."""


def split_statements(text: str) -> list[str]:
    """Statements of a script; semicolons in quotes and comments don't end one, empty statements are left out."""
    out, last = [], 0
    for token in _TOKEN.finditer(text):
        if token[0] == ";":
            out.append(text[last : token.start()])
            last = token.end()
    return [s.strip() for s in [*out, text[last:]] if strip_comments(s).strip()]


def kind_of(statement: str) -> str:
    """``create``, ``query``, or the first word of anything else."""
    words = re.findall(r"[\w]+|\(", strip_comments(statement).lower())
    if words[:2] == ["create", "table"]:
        return "create"
    first = next((w for w in words if w != "("), "")
    return "query" if first in ("select", "with", "values") else first


def run_script(spark: SparkSession, catalog: Catalog, text: str, load: bool = False) -> Iterator[DataFrame]:
    """Run the statements in order and yield one lazy DataFrame a query. With ``load`` only CREATE TABLE is allowed."""
    for statement in split_statements(text):
        kind = kind_of(statement)
        if kind == "create":
            (catalog.load if load else catalog.register)(statement)
        elif kind == "query" and not load:
            yield spark.sql(statement)
        else:
            raise UnsupportedStatement(f"{kind or 'empty'} statement is not allowed {'in load mode' if load else 'here'}: {statement[:80]!r}")
