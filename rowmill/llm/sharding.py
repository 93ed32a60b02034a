"""K-d tree partitioning into shards of nearly equal bytes.

Every row becomes a point of numeric metadata (id, size, ranks of language and source among all their values). Rows of
equal texts become one point, that of their smallest values, as long as together they are within the tolerance of a
shard; larger groups are cut like other rows. A node that has to become k leaves is split
along its widest dimension (extent relative to the whole table) at the weighted quantile that gives each side bytes in
proportion to its leaves, until a node is one leaf of the target bytes. The quantile is found by distributed
histograms of bytes over the dimension, refined inside the bin that holds it; equal coordinates are split further by
a hash of the row. All nodes of a level share each pass.

A split is a comparison, so the tree is one column expression: no row is shuffled to build it. Per pass the driver gets
at most nodes x BINS sums, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.llm.common import BROADCAST_BYTES, blocks_for, forget, left_join_groups, scratch, with_rank
from rowmill.session import table

#: Bins of a histogram pass.
BINS = 1024
#: A border may be off by this part of a leaf's bytes.
TOLERANCE = 0.001
#: Equal texts stay together up to this part of a leaf's bytes, or up to the largest row if that is more.
TOGETHER = 0.02
#: Rows that one block of a shard, numbered in one task, is meant for.
SLOT_ROWS = 1 << 16

DIMENSIONS = ("d_id", "d_size", "d_lang", "d_source")
TIE = "tie"
_TIE_TOP = (1 << 62) - 1
_TOP = (1 << 63) - 1


@dataclass
class Node:
    first: int
    leaves: int
    dimension: str | None = None
    #: Rows go left below ``value``, and at ``value`` with a tie hash below ``tie``.
    value: int = 0
    tie: int = 0
    children: list[Node] = field(default_factory=list)


def _leaf_of(node: Node) -> Column:
    """The first shard of the deepest node that a row falls in."""
    if not node.children:
        return F.lit(node.first)
    d = F.col(node.dimension)
    left = (d < F.lit(node.value)) | ((d == F.lit(node.value)) & (F.col(TIE) < F.lit(node.tie)))
    return F.when(left, _leaf_of(node.children[0])).otherwise(_leaf_of(node.children[1]))


def _open_nodes(node: Node) -> list[Node]:
    return [x for c in node.children for x in _open_nodes(c)] if node.children else [node] * (node.leaves > 1)


@dataclass
class _Search:
    """The state of one node's quantile search: the range that holds it and the bytes below that range."""

    node: Node
    target: float
    low: int
    high: int
    below: int = 0
    on_tie: bool = False
    done: bool = False

    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def row(self) -> str:
        """The parameters of the next pass: node, dimension, fixed value of that dimension on a tie, range, bin width."""
        dimension = DIMENSIONS.index(self.node.dimension) + 1
        # Differences of ids may exceed a long; halved twice, both sides fit.
        shift = 0 if self.high - self.low < 1 << 62 else 2
        return f"({self.node.first}, {dimension}, {'true' if self.on_tie else 'false'}, {self.node.value}L, {self.low}L, {self.high}L, {self.width() >> shift}L, {shift})"

    def cut(self, edge: int) -> None:
        self.done = True
        if self.on_tie:
            self.node.tie = edge
        elif edge > _TOP:
            self.node.value, self.node.tie = _TOP, _TIE_TOP + 1
        else:
            self.node.value, self.node.tie = edge, 0

    def take(self, bins: dict[int, tuple[int, int, int]], tolerance: float) -> None:
        """Use a pass (bytes, least and greatest coordinate by bin): cut if the border is exact enough, else go on
        inside the bin that holds the target, over the coordinates that it really has."""
        for b in sorted(bins):
            mass, low, high = bins[b]
            if self.below + mass >= self.target:
                break
            self.below += mass
        else:  # the target lies at the end of the range
            self.cut(self.high + 1)
            return
        if mass <= tolerance or (low == high and self.on_tie):
            self.cut(high + 1 if self.target - self.below > mass / 2 else low)
        elif low < high:
            self.low, self.high = low, high
        else:  # many rows share the coordinate
            self.node.value, self.on_tie, self.low, self.high = low, True, 0, _TIE_TOP


def _histogram(leaves: DataFrame, searches: str) -> DataFrame:
    """Bytes by node and bin for the searches of a pass. They come as a broadcast table of at most one row a node, not
    as literals, so that every pass runs the same compiled code."""
    passed = leaves.sparkSession.sql(f"SELECT * FROM VALUES {searches} AS v(leaf, dimension, on_tie, value, low, high, width, shift)")
    rows = leaves.join(F.broadcast(passed), "leaf").withColumn("own", F.element_at(F.array(*DIMENSIONS), F.col("dimension")))
    rows = rows.withColumn("at", F.when(~F.col("on_tie"), F.col("own")).when(F.col("own") == F.col("value"), F.col(TIE)))
    rows = rows.filter(F.col("at").between(F.col("low"), F.col("high"))).withColumn("bin", F.expr("(shiftright(at, shift) - shiftright(low, shift)) div width"))
    return rows.groupBy("leaf", "bin").agg(F.sum("size").alias("bytes"), F.min("at").alias("least"), F.max("at").alias("most"))


def build_tree(points: DataFrame, shards: int) -> Node:
    """The k-d tree over ``points`` (DIMENSIONS, TIE, size), as splits on the driver: shards - 1 comparisons."""
    root = Node(0, shards)
    spans = [F.min(d).alias(f"min_{d}") for d in DIMENSIONS] + [F.max(d).alias(f"max_{d}") for d in DIMENSIONS]
    whole = None
    while nodes := _open_nodes(root):
        leaf = _leaf_of(root)
        leaves = points.withColumn("leaf", leaf)
        stats = {r["leaf"]: r for r in leaves.groupBy("leaf").agg(F.sum("size").alias("bytes"), *spans).collect()}
        if whole is None:
            whole = {d: max(1, stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) for d in DIMENSIONS} if stats else {}
            tolerance = TOLERANCE * stats[0]["bytes"] / shards if stats else 0
        searches = []
        for node in nodes:
            left = node.leaves // 2
            if node.first in stats:
                s = stats[node.first]
                node.dimension = max(DIMENSIONS, key=lambda d: (s[f"max_{d}"] - s[f"min_{d}"]) / whole[d])
                searches.append(_Search(node, s["bytes"] * left / node.leaves, s[f"min_{node.dimension}"], s[f"max_{node.dimension}"]))
            else:
                node.dimension = DIMENSIONS[0]
        while active := [x for x in searches if not x.done]:
            counted = _histogram(leaves, ", ".join(x.row() for x in active)).collect()
            for x in active:
                x.take({r["bin"]: (r["bytes"], r["least"], r["most"]) for r in counted if r["leaf"] == x.node.first}, tolerance)
        for node in nodes:
            left = node.leaves // 2
            node.children = [Node(node.first, left), Node(node.first + left, node.leaves - left)]
    return root


def _with_text_rank(points: DataFrame, column: str, name: str, total: int) -> DataFrame:
    """``points`` with the rank ``name`` of their ``column`` among all its values; -1 for NULL."""
    values = points.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    ranked = scratch(with_rank(values, column).select(column, "rows", F.col("rank").alias(name)))
    wide = ranked.agg(F.sum(F.octet_length(column) + 32)).first()[0] or 0
    if wide <= BROADCAST_BYTES:
        out = points.join(F.broadcast(ranked.drop("rows")), column, "left")
    else:
        out = left_join_groups(points, ranked, column, "rows", total, F.col("spread")).drop("rows")
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(-1)).cast("long"))


def _points(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """The rows as points, and their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("words"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
    )
    # Rows without an id are told apart by their number.
    rows = scratch(rows.withColumn("spread", F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "words"), 2)))
    total, mass, largest = rows.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    points = _with_text_rank(_with_text_rank(rows, "lang", "d_lang", total), "source", "d_source", total)
    points = scratch(points.select("doc_id", "size", "text_crc32", "words", "spread", F.coalesce("doc_id", F.lit(-1)).alias("d_id"), (F.col("size") - 8).alias("d_size"), "d_lang", "d_source"))
    limit = int(max(TOGETHER * (mass or 0) / shards, largest or 0))
    own = ("d_id", "d_lang", "d_source")
    groups = points.groupBy("words").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("mass"), *(F.min(c).alias(f"least_{c}") for c in own)).filter("rows > 1")
    points = left_join_groups(points, groups.withColumn("together", F.col("mass") <= limit), "words", "rows", total, F.col("spread"))
    one = F.coalesce(F.col("together"), F.lit(False))
    moved = [F.when(one, F.col(f"least_{c}")).otherwise(F.col(c)).alias(c) for c in own]
    tie = F.when(one, F.shiftrightunsigned(F.xxhash64(F.col("words")), 2)).otherwise(F.col("spread"))
    out = scratch(points.select("doc_id", "size", "text_crc32", "spread", "d_size", *moved, tie.alias(TIE)))
    forget(rows)
    return out, total


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal the documents out; one row for each row of ``docs``.

    The law is ``bytes``: shards differ by about TOLERANCE of a shard's bytes at each border, and by a document, or a group
    of equal texts, where one is larger than that. Equal texts are in one shard if together they have at most TOGETHER of
    a shard's bytes, or no more than the largest row. NULL texts and empty texts have size 8 and crc 0, NULL metadata sorts
    first, repeated rows stand together on a border (but for those without an id), and shards may stay empty where
    there are fewer rows than shards. Ids may be any longs. Other columns are
    not read. Slots number a shard's rows without gaps; which of two equal rows has which slot is arbitrary.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. Built-in functions only.
    """
    points, total = _points(docs, shards)
    tree = build_tree(points, shards)

    # Slots: a hash cuts each shard into blocks that are numbered on their own; block counts give their starts.
    blocks = blocks_for(total, SLOT_ROWS * shards)
    placed = points.select("doc_id", "size", "text_crc32", "spread", _leaf_of(tree).alias("shard"), F.pmod(F.col("spread"), F.lit(blocks)).alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("spread", "doc_id", "size", "text_crc32")
    slotted = placed.withColumn("slot", F.row_number().over(inside) - 1).join(starts, ["shard", "block"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
