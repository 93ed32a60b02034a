"""Aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def avg_trunc(column: str) -> Column:
    """Mean of the integer column named, truncated toward zero; NULL over no rows."""
    quoted = f"`{column}`"
    return F.expr(f"sum({quoted}) div nullif(count({quoted}), 0)")
