"""Bulk load of delimited text into Parquet, with last-row-wins keys and a layout for range scans.

A table of one index column is sorted by it. One of several is laid out along a Z-order curve: each column is cut into
STEPS ranges of about equal rows, and the bits of the range numbers are interleaved, so that Parquet's statistics of
row groups and pages prune by every one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.sources.ddl import TableDef
from rowmill.sources.delimited import read_delimited

# The columns that range predicates address, by table.
INDEX_COLUMNS = {
    "LINEITEM": ("shipdate", "discount", "quantity", "returnflag", "shipmode"),
    "CUSTOMER": ("mktsegment",),
    "ORDERS": ("orderdate",),
    "REGION": ("name",),
}

_SEQ = "_rowmill_seq"
_CURVE = "_rowmill_curve"

#: Ranges of a column on the curve, as a power of two, and distinct texts up to which all are counted to find them.
STEP_BITS, COUNTED_TEXTS = 4, 10_000


def keyed_rows(spark: SparkSession, definition: TableDef, path: str) -> DataFrame:
    """The rows to store: of several rows with one key the last in file order; all rows where no key is declared."""
    if not definition.primary_key:
        return read_delimited(spark, path, definition.schema)
    rows = read_delimited(spark, path, definition.schema, sequence=_SEQ)
    order = [F.col(f"{_SEQ}_{part}").desc() for part in ("file", "start", "id")]
    newest = Window.partitionBy(*definition.primary_key).orderBy(*order)
    kept = rows.withColumn(_SEQ, F.row_number().over(newest)).filter(F.col(_SEQ) == 1)
    return kept.select(*definition.schema.names)


def _borders(rows: DataFrame, layout: list[str]) -> dict[str, list]:
    """For each column values that cut it into ranges of about equal rows. They only shape the layout."""
    steps = 1 << STEP_BITS
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    numbers = [c for c in layout if not isinstance(kinds[c], T.StringType)]
    cuts = [i / steps for i in range(1, steps)]
    found = rows.agg(*(F.percentile_approx(c, cuts, 1000).alias(c) for c in numbers)).first() if numbers else {}
    out = {c: sorted(set(found[c] or [])) for c in numbers}
    for c in layout:
        if c not in out:
            # The most frequent texts; ranges between them are as even as these are.
            counts = sorted((r[c], r["count"]) for r in rows.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(COUNTED_TEXTS).collect())
            total, seen, out[c] = sum(n for _, n in counts), 0, []
            for text, n in counts:
                if seen and seen * steps // total > (seen - before) * steps // total:
                    out[c].append(text)
                before, seen = n, seen + n
    return out


def _curve(rows: DataFrame, layout: list[str]) -> Column:
    """The place on the curve of a row's ranges."""
    borders = _borders(rows, layout)
    above = {c: sum((F.coalesce((F.col(c) >= F.lit(b)).cast("int"), F.lit(0)) for b in borders[c]), F.lit(0)) for c in layout}
    # Few ranges are spread over all steps, so that their first bits differ.
    step = {c: F.floor(n * (1 << STEP_BITS) / (len(borders[c]) + 1)).cast("int") for c, n in above.items()}
    place = F.lit(0).cast("long")
    for bit in range(STEP_BITS - 1, -1, -1):
        for c in layout:
            place = place * 2 + F.shiftright(step[c], bit).bitwiseAND(1)
    return place


def load_table(spark: SparkSession, definition: TableDef, path: str, out: str, **options: str) -> None:
    """Write the table to ``out`` as Parquet, replacing it, laid out by the index columns that the definition has.
    ``options`` go to the Parquet writer."""
    rows = keyed_rows(spark, definition, path)
    declared = {name.lower(): name for name in definition.schema.names}
    layout = [declared[c] for c in INDEX_COLUMNS.get(definition.name.upper(), ()) if c in declared]
    if len(layout) > 1:
        rows = rows.withColumn(_CURVE, _curve(rows, layout)).repartitionByRange(_CURVE).sortWithinPartitions(_CURVE, *layout).drop(_CURVE)
    elif layout:
        rows = rows.repartitionByRange(*layout).sortWithinPartitions(*layout)
    rows.write.mode("overwrite").options(**options).parquet(out)
