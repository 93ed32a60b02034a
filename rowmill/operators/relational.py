"""One thin helper for each relational operator; every one is a declarative plan node that Catalyst optimises."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def select(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows whose condition is true (three-valued logic)."""
    return df.filter(condition)


def project(df: DataFrame, *items: Column | str) -> DataFrame:
    """Columns, ``*``, ``t.*`` or expressions with aliases, as in a SELECT list."""
    return df.select(*(i if isinstance(i, Column) or i.endswith("*") else F.expr(i) for i in items))


def rename(df: DataFrame, alias: str) -> DataFrame:
    """Qualify the output with ``alias``."""
    return df.alias(alias)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cartesian product, asked for by name."""
    return left.crossJoin(right)


def join(left: DataFrame, right: DataFrame, condition: Column | str) -> DataFrame:
    """Inner join; equalities become join keys and the rest a residual filter."""
    return left.join(right, _column(condition), "inner")


def aggregate(df: DataFrame, keys: Sequence[Column | str], *aggregates: Column | str, having: Column | str | None = None) -> DataFrame:
    """Grouped or, without keys, global aggregation. ``having`` sees keys and output names."""
    keyed = [_column(k) for k in keys]
    out = df.groupBy(*keyed).agg(*map(_column, aggregates)) if aggregates else df.select(*keyed).distinct()
    return out if having is None else out.filter(having)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def order_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sort by columns, expressions or ``expr DESC`` text."""

    def key(k: Column | str) -> Column:
        if isinstance(k, Column):
            return k
        head, _, tail = k.strip().rpartition(" ")
        return {"desc": lambda: F.expr(head).desc(), "asc": lambda: F.expr(head).asc()}.get(tail.lower(), lambda: F.expr(k))()

    return df.orderBy(*map(key, keys))


def limit(df: DataFrame, rows: int) -> DataFrame:
    return df.limit(rows)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenation by position; names come from the first input."""
    return reduce(DataFrame.union, others, first)
