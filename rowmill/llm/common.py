"""What several operators share: scratch tables, sizes of key groups and hot-key joins."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the text contracts, as a Java and RE2 regular expression.
SPACES = r"[\x20\x09-\x0D]+"
#: A word of the text contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: A key group with at least this share of all rows is hot, so there are at most ``1 / HOT_SHARE`` hot groups.
HOT_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (local runs, tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="rowmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: lineage is cut, and a lost executor
    costs no recomputation of what stands before. ``forget`` deletes the table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rowmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _open_tables().append(out)
    return out


_LOCAL = threading.local()


def _open_tables() -> list[DataFrame]:
    """Tables of this thread's ``scratch`` calls that are not forgotten."""
    if not hasattr(_LOCAL, "tables"):
        _LOCAL.tables = []
    return _LOCAL.tables


def written(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns as a table of ``scratch``; the tables that it made itself are forgotten once it is written."""
    earlier = {id(t) for t in _open_tables()}
    out = scratch(make())
    forget(*(t for t in list(_open_tables()) if t is not out and id(t) not in earlier))
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``scratch`` that nothing reads any more; other tables are left alone."""
    for each in tables:
        path = each.__dict__.get("_scratch_path")
        if path:
            where = each.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(each.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
            _open_tables()[:] = [t for t in _open_tables() if t is not each]


#: Bytes of rows that an Arrow batch of whole texts is meant for; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, to be read by Python in Arrow batches of about BATCH_BYTES; a larger setting of the session is lowered."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < parsed_bytes(conf.get(name)) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return docs


def parsed_bytes(said: str) -> int:
    """Bytes of a setting like ``64MB``."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    said = said.strip().lower().removesuffix("b")
    return int(said[:-1]) * units[said[-1]] if said[-1:] in units else int(said)


def release_memory() -> None:
    """Give what this Python worker has freed back to the system: workers outlive their tasks, idle ones too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def left_join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """``rows`` left-joined with one row of ``groups`` a key (a long or a string), safe for keys with any share of the rows.

    Groups with ``size >= HOT_SHARE * total`` are broadcast: sizes sum to at most ``total``, so there are at most
    ``1 / HOT_SHARE`` of them. Rows that they match get a spread key, so the shuffled join of the rest never meets a
    hot key; nor do rows without a key, which match nothing. ``size`` is the number of rows with the key.
    """
    least = max(1, int(total * HOT_SHARE))
    value = [c for c in groups.columns if c != key]
    hot_key, cold_key, spread_key = (fresh(rows, c) for c in ("_hot_key", "_cold_key", "_spread_key"))
    hot_of, cold_of = ({c: fresh(rows, f"_{kind}_{c}") for c in value} for kind in ("hot", "cold"))
    hot = groups.filter(F.col(size) >= least).select(F.col(key).alias(hot_key), *(F.col(c).alias(name) for c, name in hot_of.items()))
    cold = groups.filter(F.col(size) < least).select(F.col(key).alias(cold_key), *(F.col(c).alias(name) for c, name in cold_of.items()))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    alone = F.col(hot_key).isNotNull() | F.col(key).isNull()
    # A spread key may be some cold key by chance; what it finds there isn't used.
    out = out.withColumn(spread_key, F.when(alone, F.xxhash64(F.lit(3), spread).cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    out = out.join(cold, F.col(spread_key) == F.col(cold_key), "left")
    found = (F.when(F.col(hot_key).isNotNull(), F.col(hot_of[c])).when(F.col(key).isNotNull(), F.col(cold_of[c])).alias(c) for c in value)
    return out.select(*columns_of(rows), *found)


def blocks_for(rows: int, per_block: int, least: int = 1) -> int:
    """A power of two of blocks, so that a block has about ``per_block`` of ``rows`` rows or fewer."""
    blocks = least
    while blocks * per_block < rows:
        blocks *= 2
    return blocks


def fresh(docs: DataFrame, name: str) -> str:
    """``name`` if ``docs`` has no column of that name (in any case), else with a number behind it."""
    taken, out, n = {c.lower() for c in docs.columns}, name, 0
    while out.lower() in taken:
        n += 1
        out = f"{name}{n}"
    return out


#: Bits of the largest bitmap (64 MB) and bits for each key up to there.
BITMAP_BITS, BITS_A_KEY = 1 << 29, 64
#: Bits of one page of a bitmap: what the built-in aggregate makes.
PAGE_BITS = 1 << 15


def perhaps_among(rows: DataFrame, hashed: Column, keys: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where the long ``hashed`` is none of ``keys`` (column ``key``).

    The keys set bits of a bitmap, which is broadcast in pages: at most BITMAP_BITS bits however many keys there are.
    With ``n`` keys about n / bits of the other rows are marked too, so whoever uses the mark has to look closer there.
    ``rows`` aren't shuffled. A NULL hash isn't marked.
    """
    bits = min(BITMAP_BITS, blocks_for(n * BITS_A_KEY, 1, least=PAGE_BITS))
    page, bitmap, place, byte = (fresh(rows, c) for c in ("_page", "_bits", "_place", "_byte"))
    spot = F.pmod(F.col(key), F.lit(bits))
    pages = keys.groupBy(F.shiftright(spot, 15).alias(page)).agg(F.bitmap_construct_agg(spot.bitwiseAND(PAGE_BITS - 1)).alias(bitmap))
    out = rows.withColumn(place, F.pmod(hashed, F.lit(bits)))
    out = out.join(F.broadcast(pages), F.shiftright(place, 15) == F.col(page), "left")
    at = F.shiftright(F.col(place).bitwiseAND(PAGE_BITS - 1).cast("int"), 3) + 1
    out = out.withColumn(byte, F.conv(F.hex(F.substr(bitmap, at, F.lit(1))), 16, 10).cast("int"))
    bit = F.expr(f"shiftright({byte}, cast({place} & 7 AS int)) & 1")
    return out.withColumn(name, F.coalesce(bit == 1, F.lit(False))).select(*columns_of(rows), name)


#: Lists of keys up to so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20


def columns_of(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def split_by_keys(docs: DataFrame, listed: DataFrame, keys: dict[str, Column], width: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose keys (NULL equals NULL) aren't among ``listed``, and those whose keys are: the columns of
    ``listed`` by name, each with the expression over ``docs`` that stands for it; ``width`` is the bytes of a row of them.

    A list of up to BROADCAST_BYTES is broadcast. For a longer one a bitmap, whose size is bounded, tells most of the rows
    that aren't listed; only those it marks are shuffled and compared.
    """
    named = {c: fresh(docs, f"_listed_{c}") for c in keys}
    listed = scratch(listed.select(*(F.col(c).alias(name) for c, name in named.items())).distinct())
    n = listed.count()
    on = [column.eqNullSafe(F.col(named[c])) for c, column in keys.items()]
    if n * width <= BROADCAST_BYTES:
        return tuple(docs.join(F.broadcast(listed), on, kind) for kind in ("left_anti", "left_semi"))
    mark, hashed = fresh(docs, "_perhaps"), fresh(docs, "_hashed")
    rows = perhaps_among(docs, F.xxhash64(*keys.values()), listed.select(F.xxhash64(*named.values()).alias(hashed)), hashed, n, mark)
    surely, closer = rows.filter(~F.col(mark)).select(*columns_of(docs)), rows.filter(mark).select(*columns_of(docs))
    return surely.unionAll(closer.join(listed, on, "left_anti")), closer.join(listed, on, "left_semi")


def with_rank(values: DataFrame, *order: str) -> DataFrame:
    """``values`` with ``rank``, 0, 1, 2 and so on in order of the columns, by which rows are unique. Ranges of the order are
    numbered on their own, so no task gets all rows; their counts, one a range, say where each begins."""
    placed = scratch(values.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_inside", inside).join(F.broadcast(starts), "_range").select(*values.columns, (F.col("_start") + F.col("_inside")).alias("rank"))
