"""Exact deduplication with counting quotient filters.

1. Every text is normalised and fingerprinted (60 bits of xxHash64) on the executors.
2. Each task builds counting quotient filters over the fingerprints it sees: the high bits (quotient) address a run,
   the low bits (remainder) stand sorted in the run, each with a counter. A filter leaves its task as slices, one for
   each block of quotients.
3. Slices of a block meet in one task and merge by their sorted remainders: runs are concatenated in order and the
   counters of equal remainders added. Nothing is lost, so a merged counter is the fingerprint's count in the corpus.
4. Fingerprints counted once are unique texts. The rest go to byte verification: a bitmap of them, of bounded size, tells
   the scan which texts to send on, and those are grouped by all their bytes, partially aggregated before the shuffle, so
   a copy group sends one row from each task. Where the bitmap lets a unique text through, it is a group of one.

A block holds a bounded number of distinct fingerprints whatever the corpus size, since the number of blocks follows
the number of rows. No fingerprints come to the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import SPACES, blocks_for, forget, fresh, left_join_groups, perhaps_among, scratch, split_by_keys
from rowmill.session import table

FINGERPRINT_BITS = 60
#: Fingerprints that one filter takes before it leaves the task: bounds the memory of a task.
FILTER_ROWS = 1 << 20
#: Distinct fingerprints that a block of quotients is meant for.
BLOCK_ROWS = 1 << 17


class CountingQuotientFilter:
    """Lossless counts of fingerprints: run lengths by quotient, sorted remainders in each run, a counter each."""

    def __init__(self, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, counters: np.ndarray, first: int = 0):
        self.quotient_bits, self.runs, self.remainders, self.counters, self.first = quotient_bits, runs, remainders, counters, first

    @property
    def remainder_bits(self) -> int:
        return FINGERPRINT_BITS - self.quotient_bits

    @classmethod
    def _of_sorted(cls, quotient_bits: int, fingerprints: np.ndarray, counters: np.ndarray, first: int, quotients: int) -> CountingQuotientFilter:
        """From sorted fingerprints, equal ones added up; covers ``quotients`` quotients from ``first`` on."""
        remainder_bits = FINGERPRINT_BITS - quotient_bits
        if len(fingerprints):
            starts = np.flatnonzero(np.concatenate(([True], fingerprints[1:] != fingerprints[:-1])))
            fingerprints, counters = fingerprints[starts], np.add.reduceat(counters, starts)
        runs = np.bincount((fingerprints >> np.uint64(remainder_bits)).astype(np.int64) - first, minlength=quotients).astype(np.uint32)
        return cls(quotient_bits, runs, fingerprints & np.uint64((1 << remainder_bits) - 1), counters, first)

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        ordered = np.sort(fingerprints.astype(np.uint64))
        return cls._of_sorted(quotient_bits, ordered, np.ones(len(ordered), np.uint64), 0, 1 << quotient_bits)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + np.uint64(self.first), self.runs)
        return (quotients << np.uint64(self.remainder_bits)) | self.remainders

    def slices(self, blocks: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """The filter cut at block borders (blocks of equally many quotients); empty blocks are left out."""
        width = (1 << self.quotient_bits) // blocks
        ends = np.concatenate(([0], np.cumsum(self.runs, dtype=np.int64)))[::width]
        for block in np.flatnonzero(np.diff(ends)):
            cut = slice(ends[block], ends[block + 1])
            yield int(block), CountingQuotientFilter(self.quotient_bits, self.runs[block * width : (block + 1) * width], self.remainders[cut], self.counters[cut], self.first + int(block) * width)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Merge filters over the same quotients: their sorted remainders are merged run by run, counters added."""
        one = filters[0]
        fingerprints = np.concatenate([f.fingerprints() for f in filters])
        counters = np.concatenate([f.counters for f in filters])
        order = np.argsort(fingerprints, kind="stable")
        return cls._of_sorted(one.quotient_bits, fingerprints[order], counters[order], one.first, len(one.runs))

    def to_bytes(self) -> bytes:
        """Remainders take the whole bytes that their bits need, counters those of the largest one."""
        wide, tall = (self.remainder_bits + 7) // 8, max(1, -(-int(self.counters.max(initial=1)).bit_length() // 8))
        head = struct.pack("<IQIIB", self.quotient_bits, self.first, len(self.runs), len(self.remainders), tall)
        return head + self.runs.tobytes() + _low_bytes(self.remainders, wide) + _low_bytes(self.counters, tall)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        quotient_bits, first, runs, n, tall = struct.unpack_from("<IQIIB", data)
        at = struct.calcsize("<IQIIB")
        middle = at + 4 * runs
        wide = (FINGERPRINT_BITS - quotient_bits + 7) // 8
        return cls(quotient_bits, np.frombuffer(data, np.uint32, runs, at), _from_low_bytes(data, middle, n, wide), _from_low_bytes(data, middle + n * wide, n, tall), first)


def _low_bytes(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low_bytes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return out.view(np.uint64).ravel()


def repeated_fingerprints(fingerprints: DataFrame, rows: int) -> DataFrame:
    """``fp, n`` of the fingerprints (column ``fp``) that occur more than once among ``rows`` rows."""
    blocks = blocks_for(rows, BLOCK_ROWS, least=16)
    quotient_bits = max(blocks.bit_length() - 1, min(18, max(10, rows.bit_length() - 4)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            cut = list(CountingQuotientFilter.build(np.concatenate(parts), quotient_bits).slices(blocks))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int32()), pa.array([s.to_bytes() for _, s in cut], pa.binary())], ["block", "slice"])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= FILTER_ROWS:
                yield out(parts)
                parts, held = [], 0
        if held:
            yield out(parts)

    def merge(pages: pa.Table) -> pa.Table:
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(s) for s in pages.column("slice").to_pylist()])
        more = merged.counters > 1
        return pa.table({"fp": merged.fingerprints()[more].astype(np.int64), "n": merged.counters[more].astype(np.int64)})

    slices = fingerprints.select("fp").mapInArrow(build, "block int, slice binary")
    return slices.groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group equal texts; one row for each row of ``docs``.

    Texts are equal when identical after every run of white space becomes one space. NULL counts as empty, and empty
    texts are equal to each other. The row with the smallest id stays; of repeated rows with that id one stays, and
    rows without an id stay only in groups without any. Other columns are not read, so their names don't matter. An
    empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    fingerprint = F.shiftrightunsigned(F.xxhash64(normal), 64 - FINGERPRINT_BITS)
    ids = scratch(docs.select(F.col(doc_id).cast("long").alias("id"), F.sha2(normal, 256).alias("sha"), fingerprint.alias("fp")).withColumn("row", F.monotonically_increasing_id()))
    total = ids.count()
    repeated = scratch(repeated_fingerprints(ids, total))
    listed = repeated.count()

    texts = perhaps_among(docs.select(fingerprint.alias("fp"), normal.alias("normal")), F.col("fp"), repeated, "fp", listed, "perhaps").filter("perhaps")
    verified = texts.groupBy("fp", "normal").agg(F.count(F.lit(1)).alias("group_size"))
    verified = scratch(verified.filter("group_size > 1").select(F.sha2("normal", 256).alias("sha"), "group_size"))

    # Smallest (id, row) as one number, so that the aggregate stays a hash aggregate; rows without an id come last.
    rank = F.expr("cast(coalesce(id, 9223372036854775807) as decimal(38, 0)) * cast(9223372036854775808 as decimal(19, 0)) + row").cast("decimal(38, 0)")
    copies = perhaps_among(ids, F.col("fp"), repeated, "fp", listed, "perhaps").filter("perhaps")
    first = copies.select("sha", "id", rank.alias("rank")).groupBy("sha").agg(F.min("rank").alias("rank"), F.min("id").alias("keep_id"))
    groups = scratch(verified.join(first, "sha"))
    forget(repeated, verified)
    out = left_join_groups(ids.select("id", "sha", "row"), groups, "sha", "group_size", total, F.col("row"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("rank").isNull() | (F.col("rank") == rank)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("row").alias("row"),
    ).drop("row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest doc_id, with its columns, whatever their names.

    NULL and empty texts are one group. Of repeated rows, equal in doc_id and text, any one stays; of a group without
    ids any one. An empty table gives an empty result. Decisions travel by id and digest: texts are only shuffled where
    rows repeat, or where more rows are dropped than a broadcast may hold and a bitmap can't tell that a row stays.
    """
    found = scratch(exact_dedup(docs).select(F.col("doc_id").alias("id"), "keep_id", "kept", F.unhex("text_sha256").alias("sha")))
    sha = F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), 256))
    keys = {"id": F.col("doc_id").cast("long"), "sha": sha}
    # Beside the kept row, a row with its id is its repetition.
    again = found.filter(~F.col("kept") & F.col("id").eqNullSafe(F.col("keep_id")))
    out, _ = split_by_keys(docs, found.filter(~F.col("kept") & ~F.col("id").eqNullSafe(F.col("keep_id"))), keys, 64)
    if not again.isEmpty():
        out, repeated = split_by_keys(out, again, keys, 64)
        names = [fresh(docs, f"_{c}") for c in keys]
        out = out.unionAll(repeated.withColumns(dict(zip(names, keys.values(), strict=True))).dropDuplicates(names).drop(*names))
    forget(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
