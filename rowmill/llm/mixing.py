"""Mixing sources to target weights by capped water-filling.

Sources get words in proportion to their weights; those that would exceed ``epochs`` times their own size are clamped
there and their excess goes to the others by weight, until none is above. Each round is one aggregate over the sources,
whose sums of whole numbers are exact in any order; the level of words a weight only rises, so few rounds are needed.

Within a source, each document is repeated as often as the target's whole part says, and the fractional part takes
documents in a seeded order up to the words still missing (the document on the border partly). The order is hashed
into buckets whose sums give every bucket its start, so no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.llm.common import BROADCAST_BYTES, WORD, blocks_for, columns_of, forget, fresh, left_join_groups, scratch, with_rank
from rowmill.session import table

#: Documents that a bucket is meant for, and the fewest buckets of a source.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 12, 64


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Targets of ``sources`` (columns name, missing, source_size: one row a source; NULL names have ``missing``).

    Weights (whole numbers) repeat over the sources in code point order, NULL last. Targets sum to ``share`` times all
    sizes, or to all caps where that is less. A source of size 0 has target 0; a table without sources gives none. Adds
    weight and target to the columns.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = scratch(with_rank(sources, "missing", "name").withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs))
    budget = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        sums = rows.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if sums[0] == clamped or not sums[2]:
            break
        clamped, level = sums[0], (budget - (sums[1] or 0)) / sums[2]
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return rows.select("name", "missing", "source_size", "weight", target.alias("target"))


def _source(source: str) -> tuple[Column, Column]:
    """Name of a row's source, and whether it is NULL."""
    return F.coalesce(F.col(source), F.lit("")).alias("name"), F.col(source).isNull().alias("missing")


def _order(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's place in the seeded order of its source."""
    return F.xxhash64(F.lit(seed), doc_id, text)


def _bucket(order: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(order), F.lit(buckets))


def _dealt(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, seed: int, text: str, doc_id: str, source: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows with size, order and bucket; for each bucket of a source its size, where it starts in the source's order, the
    source's size, rows and target, and of that the ``whole`` repetitions and the ``extra`` words; and the number of buckets."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = scratch(docs.select(F.col(doc_id).alias("doc_id"), *_source(source), size.alias("size"), _order(F.col(doc_id), F.col(text), seed).alias("order")))
    buckets = blocks_for(rows.count(), BUCKET_ROWS, LEAST_BUCKETS)
    rows = rows.withColumn("bucket", _bucket(F.col("order"), buckets))

    sums = scratch(rows.groupBy("name", "missing", "bucket").agg(F.sum("size").alias("bucket_size"), F.count(F.lit(1)).alias("bucket_rows")))
    sources = sums.groupBy("name", "missing").agg(F.sum("bucket_size").alias("source_size"), F.sum("bucket_rows").alias("source_rows"))
    targets = water_fill(sources, weights, share, epochs).join(sources.select("name", "missing", "source_rows"), ["name", "missing"])
    before = Window.partitionBy("name", "missing").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(targets, ["name", "missing"])
    starts = starts.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round("target").cast("long") / F.col("source_size"))).otherwise(0).cast("long"))
    return rows, starts.withColumn("extra", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), buckets


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """How many words of each document the mix takes; one row for each row of ``docs``.

    A NULL or empty text has size 0 and takes 0. NULL is a source of its own; a source of size 0 has target 0. Repeated
    rows count as documents of their own; which of two equal rows stands on the border can't be told apart. A source's
    taken words equal its target, rounded. An empty table gives an empty result. Other columns are not read.

    Returns doc_id, source, size, source_size, target, taken. Built-in functions only.
    """
    rows, starts, _ = _dealt(docs, weights, share, epochs, seed, text, doc_id, source)
    inside = Window.partitionBy("name", "missing", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts.drop("bucket_size", "bucket_rows"), ["name", "missing", "bucket"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("start") - F.col("before")))
    return placed.select(
        "doc_id", F.when(~F.col("missing"), F.col("name")).alias("source"), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + part).cast("long").alias("taken"),
    )


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` as the mix has them, with their columns, whatever their names: each row as often as it is taken, the one on a
    source's border once more if at least half of it is. Rows that aren't taken go; so do NULL and empty texts and others of
    size 0, which the mix takes no words of. Repeated rows stand on the same side of a border. An empty table gives an
    empty result.

    A source's order and its border, one row a source, say for each row how often it is taken. Borders of up to
    BROADCAST_BYTES are broadcast, so texts aren't shuffled; of more, only those of the hot sources are.
    """
    rows, starts, buckets = _dealt(docs, weights, share, epochs, seed, "text", "doc_id", "source")
    # The border lies in the first bucket, and on the first document of its order, that the extra words don't fill.
    ends = starts.filter("start + bucket_size > extra").groupBy("name", "missing").agg(F.min(F.struct("bucket", "start", "extra", "whole", "source_rows")).alias("end"))
    ends = scratch(ends.select("name", "missing", "end.*"))
    inside = Window.partitionBy("name", "missing", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.join(ends, ["name", "missing", "bucket"]).withColumn("left", F.col("extra") - F.col("start") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    first = F.min(F.struct("order", (-F.col("left")).alias("over"), (F.col("left") * 2 >= F.col("size")).alias("taken")))
    borders = near.filter("size > left").groupBy("name", "missing", "bucket", "whole", "source_rows").agg(first.alias("first"))
    key, bucket, whole, order, taken, hits = (fresh(docs, f"_border_{c}") for c in ("key", "bucket", "whole", "order", "taken", "hits"))
    # A source's key: its name behind a mark, or another mark alone for NULL.
    named = F.when(F.col("missing"), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("name")))
    borders = scratch(borders.select(named.alias(key), F.col("bucket").alias(bucket), F.col("whole").alias(whole), F.col("first.order").alias(order), F.col("first.taken").alias(taken), F.col("source_rows").alias(hits)))
    forget(ends)

    own = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    wide = borders.agg(F.sum(F.octet_length(key) + 64)).first()[0] or 0
    kept = docs.filter(F.col("text").rlike(WORD)).withColumn(fresh(docs, "_own_key"), own)
    if wide <= BROADCAST_BYTES:
        kept = kept.join(F.broadcast(borders), F.col(fresh(docs, "_own_key")) == F.col(key))
    else:
        kept = left_join_groups(kept.withColumnRenamed(fresh(docs, "_own_key"), key), borders, key, hits, rows.count(), F.xxhash64("doc_id", "text")).filter(F.col(whole).isNotNull())
    place = _order(F.col("doc_id"), F.col("text"), seed)
    spot = _bucket(place, buckets)
    more = (spot < F.col(bucket)) | ((spot == F.col(bucket)) & ((place < F.col(order)) | ((place == F.col(order)) & F.col(taken))))
    times = (F.col(whole) + F.when(more, 1).otherwise(0)).cast("int")
    return kept.select(*columns_of(docs), F.explode(F.array_repeat(F.lit(1), times)).alias(fresh(docs, "_copy"))).select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
