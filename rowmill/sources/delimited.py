"""Pipe-delimited text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = "_rowmill_fields"


def _typed(field: Column, name: str, kind: T.DataType) -> Column:
    """A field as its column's type; one that isn't of it stops the query, whatever the session's cast rules."""
    if isinstance(kind, T.StringType):
        return F.coalesce(field, F.lit(""))
    value = field.try_cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"malformed field of column {name}: "), field))
    return F.when(F.coalesce(field, F.lit("")) == "", F.lit(None)).when(value.isNull(), wrong.cast(kind)).otherwise(value)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sequence: str | None = None) -> DataFrame:
    """Scan ``path``: one row a line, ``|`` between fields, no header, quoting or escapes.

    A trailing separator is allowed. An empty text field is the empty string; an empty field of another type and
    a field that a short line lacks are NULL. A line with more fields than the schema stops a query that reads any column,
    a field that does not parse one that reads its column. Empty lines are no rows. ``sequence`` names three
    extra columns (suffixes ``_file``, ``_start``, ``_id``) that order the rows as they stand in the files.
    """
    width = len(schema)
    fields = F.split("value", r"\|")
    surplus = (F.size(fields) > width + 1) | ((F.size(fields) == width + 1) & (F.get(fields, F.lit(width)) != ""))
    checked = F.when(surplus, F.raise_error(F.concat(F.lit(f"malformed line, of more than {width} fields: "), F.col("value"))).cast("array<string>")).otherwise(fields)
    lines = spark.read.text(path)
    extra = []
    if sequence:
        extra = [
            F.col("_metadata.file_path").alias(f"{sequence}_file"),
            F.col("_metadata.file_block_start").alias(f"{sequence}_start"),
            F.monotonically_increasing_id().alias(f"{sequence}_id"),
        ]
    rows = lines.filter("value <> ''").select(checked.alias(_FIELDS), *extra)
    columns = [_typed(F.get(_FIELDS, F.lit(i)), f.name, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]
    return rows.select(*columns, *([F.col(f"{sequence}_{part}") for part in ("file", "start", "id")] if sequence else []))
