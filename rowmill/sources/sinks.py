"""Text and timing sinks."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = "_rowmill_line"


def delimited_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: the row's fields joined by ``|``, NULL and booleans spelled out, in row order."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in flat.columns]
    return flat.select(F.concat_ws("|", *fields).alias("value"))


def print_lines(df: DataFrame) -> Iterator[str]:
    """Stream a result to the client, a partition at a time."""
    for row in delimited_lines(df).toLocalIterator():
        yield row.value


def write_delimited(df: DataFrame, path: str) -> None:
    """Write the lines from the executors."""
    delimited_lines(df).write.mode("overwrite").text(path)


def timed_scan(df: DataFrame) -> float:
    """Seconds to read every column of every row, with no output."""
    began = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - began
