"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.common import forget, left_join_groups, scratch


def _is_finished(edges: DataFrame) -> bool:
    """Whether every node either points to one other node or is only pointed to, so that edges are whole components."""
    ends = edges.selectExpr("u AS node", "1 AS up", "0 AS down").union(edges.selectExpr("v", "0", "1"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def _with_least(rows: DataFrame, ends: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v) with the smallest v that u has in ``ends``. A hub may have any share of the rows."""
    least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return left_join_groups(rows, least, "u", "degree", total, F.col("v")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b; longs), root being the component's smallest node.

    Each round links every node's larger neighbours to its smallest one, then every node and its smaller neighbours to
    the smallest of those; the number of rounds grows with the logarithm of the nodes, and they end when all edges point
    to roots. Each round is a table of at most as many rows as there are edges; hubs are joined by broadcast. Loops and
    repeated edges are harmless; nodes with only loops are left out.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch(edges.filter("a <> b").select(u, v).distinct())
    while not _is_finished(now):
        total = now.count()
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both.filter("v > u"), both, 2 * total)
        large = scratch(large.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _with_least(large, large, large.count())
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, now = now, scratch(after)
        forget(before, large)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
