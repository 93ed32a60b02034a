"""Exact Jaccard self-join on word shingles with token-combination prefixes.

1. One scan of the texts makes the shingle sets and notes their size and id. Documents with equal sets are one class, and
   from here on a class counts once. Tokens are counted in windows of each task; those that come to a high count in the
   corpus are hot, and their list, which has a bound, is broadcast.
2. A second scan, over one document of a class (as far as a bitmap of bounded size tells), sends its tokens in packed blobs, by ranges of their hash, so that each range meets in one
   task, which counts in how many of the sent sets each token is. Tokens of one set only can't be shared, so they are dropped
   there and only counted. A set goes by a short number, its window's and its own, so that a token costs about as much
   in a large table, where few tokens of a set fall into one range, as in a small one. The range says a token's high bits, so
   only LOW_BYTES of it travel, here and in step 3; of hot tokens those alone tell them apart. A hot token would fill one range with its classes: its occurrences are
   dealt by class instead, and its frequency is the noted count.
3. A class with n tokens links at least at overlap o = ceil(t n); one with more than n - o unshared tokens
   links with nothing, and its tokens go no further. For the others tokens stand in order of frequency, rare ones first.
4. Prefixes: of two linked classes the first shared token stands among the first n - o + 1 of both, and the first m + 1
   shared ones among the first n - o + m + 1. If the first is rare it is indexed alone. Else all are frequent; those are
   dealt into m hash classes, two of the m + 1 fall into one, and every pair of a hash class is indexed. m follows the size, so
   the number of pairs is in proportion to it. Both sides index for each size class that a partner may have.
5. Classes that meet at an index entry are candidates. Entries are chained, not expanded into pairs: a star to the
   smallest class each, and components of those stars are clusters. A cluster of up to CHUNK classes meets in one task,
   which verifies all its pairs exactly with matrix products. A larger one is dealt into chunks; each task verifies the
   pairs of its chunk and those with the cluster's pivots (PIVOTS of its classes). Copies of one text link with a pivot
   or through a chunk, so one component is left of them and the work is in proportion to the cluster.
6. Where a cluster is still in several components, pairs across those remain. Jaccard distance is a metric: two classes
   whose distances to a pivot differ by more than 1 - t can't link. So classes are dealt into cells by their distances to
   two pivots, and only chunks of adjacent cells and of different components are verified, pair by pair of chunks.

No pair of copies is ever made, nothing but counts comes to the driver, and nothing is dropped to bound a group.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import blocks_for, bounded_batches, forget, left_join_groups, perhaps_among, release_memory, scratch, split_by_keys
from rowmill.llm.components import components
from rowmill.llm.shingles import Powers, mix, set_id, shingle_sets
from rowmill.session import table

#: Tokens that a range of hashes is meant for.
RANGE_TOKENS = 1 << 21
#: Tokens that a task holds before it counts or sends them.
HELD_TOKENS = 1 << 20
#: Classes of a window in which a token is before the window notes it, and classes from which on a noted token is hot;
#: in large tables a token is hot from one in HOT_PART of all tokens on, so there are at most HOT_PART hot ones.
NOTED, HOT_CLASSES, HOT_PART = 3, 1 << 12, 1 << 20
#: Tokens in more classes than this are frequent: indexed in pairs.
RARE = 24
#: Classes of one chunk of a cluster, and the pivots of a cluster of several.
CHUNK, PIVOTS = 256, 8
#: From this many classes of a chunk on, a token is counted by matrix product, below by its pairs.
DENSE = 12
#: Bits of a set's number in its window, and of a window's in its task: a window holds at most HELD_TOKENS sets.
SET_BITS, WINDOW_BITS = 20, 19
#: Classes that one task remembers to have sent.
REMEMBERED = 1 << 18
#: Low bytes of a token that are sent; the range says its high bits. A range of RANGE_TOKENS tokens has about two pairs of
#: different ones that agree in these, however many ranges there are.
LOW_BYTES = 5
#: Frequencies go as levels of one byte: as they are up to EXACT_LEVELS, above it STEPS levels for each doubling.
EXACT_LEVELS, STEPS = 128, 8


def _pack(first: int, sets: np.ndarray, counts: np.ndarray, tokens: np.ndarray, wide: int) -> bytes:
    """Sets of a window, whose numbers begin at ``first``; the number of tokens of each; the ``wide`` low bytes of the tokens.
    Sets and counts take as many bytes as the largest needs."""
    widths = [next(w for w in (1, 2, 4) if int(x.max(initial=0)) < 1 << 8 * w) for x in (sets, counts)]
    low = np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :wide]
    return struct.pack("<qIBB", first, len(sets), *widths) + sets.astype(f"u{widths[0]}").tobytes() + counts.astype(f"u{widths[1]}").tobytes() + low.tobytes()


def _unpack(blob: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Set number and token of each entry."""
    first, n, one, two = struct.unpack_from("<qIBB", blob)
    at = struct.calcsize("<qIBB")
    sets, counts = np.frombuffer(blob, f"u{one}", n, at), np.frombuffer(blob, f"u{two}", n, at + one * n)
    low = np.frombuffer(blob, np.uint8, -1, at + (one + two) * n).reshape(-1, wide)
    tokens = np.zeros((len(low), 8), np.uint8)
    tokens[:, :wide] = low
    return np.repeat(sets.astype(np.int64) + first, counts), tokens.view(np.uint64).ravel()


def _entries(blobs: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Set number and token of every entry."""
    parts = [_unpack(b, wide) for b in blobs]
    return np.concatenate([x for x, _ in parts]), np.concatenate([t for _, t in parts])


def _shared(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low bytes of the token, set number and frequency of every token of a range that more than one set has."""
    sets, tokens = _entries(blobs, LOW_BYTES)
    order = np.argsort(tokens)
    tokens = tokens[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(tokens)))
    several = np.repeat(count > 1, count)
    return tokens[several], sets[order[several]], np.repeat(count[count > 1], count[count > 1])


def _low(tokens: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]


def _levels(frequency: np.ndarray) -> np.ndarray:
    """Levels of frequencies, in the same order; high ones may share a level."""
    doublings = np.log2(np.maximum(frequency, EXACT_LEVELS) / EXACT_LEVELS)
    return np.where(frequency < EXACT_LEVELS, frequency, np.minimum(EXACT_LEVELS + np.floor(STEPS * doublings), 255)).astype(np.uint8)


def _held_windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch | None, list[int], list[int | None], list[np.ndarray], list[int]]]:
    """For each batch (doc_id, text bytes) set sizes and classes; after some batches, and at the end, the window of the
    sets of classes that this task hasn't had yet, with their ids."""
    powers, sent = Powers(), set()
    held: list[np.ndarray] = []
    ids: list[int] = []
    waiting = 0
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
        sizes: list[int] = []
        classes: list[int | None] = []
        for tokens in shingle_sets(texts, k, powers):
            sizes.append(len(tokens))
            own = set_id(tokens) if len(tokens) else None
            classes.append(own)
            if own is not None and own not in sent:
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent.add(own)
                held.append(tokens)
                ids.append(own)
                waiting += len(tokens)
                if waiting >= HELD_TOKENS:
                    yield None, [], [], held, ids
                    held, ids, waiting = [], [], 0
        yield batch, sizes, classes, [], []
    if held:
        yield None, [], [], held, ids
    sent.clear()


def _bytes_of(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, class of every document (times NULL), and token, times for what windows note (times NOT NULL)."""
    names = ["doc_id", "n", "class", "token", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, classes, held, _ in _held_windows(batches, k):
            if batch is not None:
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), none, none], names)
            else:
                tokens = np.sort(np.concatenate(held))
                starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
                times = np.diff(np.append(starts, len(tokens)))
                noted = times >= NOTED
                none = pa.nulls(int(noted.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(tokens[starts[noted]].view(np.int64)), pa.array(times[noted].astype(np.int64))], names)
        release_memory()

    return _bytes_of(docs).mapInArrow(run, "doc_id long, n long, class long, token long, times long")


def _scan(docs: DataFrame, k: int, ranges: int, hot: Broadcast) -> DataFrame:
    """For each set that is sent, ``number`` and ``class`` in one row, and in a row for each range its number, how many shared
    tokens it ``holds``, their ``high`` bits, low bytes (``tokens``) and levels of frequency (``frequencies``). ``hot`` holds the sorted
    hot tokens and their frequencies; a hot token has no high bits, since its pieces are not of one range."""
    bits = ranges.bit_length() - 1

    def blobs(held: list[np.ndarray], ids: list[int], first: int, known: np.ndarray) -> pa.RecordBatch:
        tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
        part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            is_hot = known[place] == tokens
            # Hot tokens go by their place in the list, to the ranges 2 ** bits and up by set.
            tokens = np.where(is_hot, place.astype(np.uint64), tokens)
            part = np.where(is_hot, ranges + (first + owner) % ranges, part)
        order = np.argsort(part, kind="stable")
        tokens, owner, part = tokens[order], owner[order], part[order]
        begins = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        parts, packed = part[begins].tolist(), []
        for p, a, b in zip(parts, begins.tolist(), np.append(begins[1:], len(part)).tolist(), strict=True):
            own = owner[a:b]
            at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            packed.append(_pack(first, own[at], np.diff(np.append(at, len(own))), tokens[a:b], LOW_BYTES if p < ranges else 3))
        # Last the classes of the window, in order of their numbers.
        parts.append(2 * ranges + (first >> SET_BITS) % ranges)
        packed.append(struct.pack("<q", first) + np.array(ids, np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(packed, pa.binary())], ["part", "blob"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = TaskContext.get().partitionId() << WINDOW_BITS
        for batch, _, _, held, ids in _held_windows(batches, k):
            if batch is None:
                yield blobs(held, ids, window << SET_BITS, hot.value[0])
                window += 1
        release_memory()

    def reduce(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        part, sent = key[0].as_py(), rows.column("blob").to_pylist()
        if part >= 2 * ranges:
            ids = [np.frombuffer(b, np.int64) for b in sent]
            numbers = np.concatenate([x[0] + np.arange(len(x) - 1) for x in ids])
            none = pa.nulls(len(numbers), pa.binary())
            return pa.table({"number": pa.array(numbers), "class": pa.array(np.concatenate([x[1:] for x in ids])), "holds": pa.nulls(len(numbers), pa.int32()), "high": pa.nulls(len(numbers), pa.int64()), "tokens": none, "frequencies": none})
        if part < ranges:
            tokens, sets, frequency = _shared(sent)
        else:
            sets, places = _entries(sent, 3)
            places = places.astype(np.int64)
            tokens, frequency = hot.value[0][places], hot.value[1][places]
        order = np.argsort(sets, kind="stable")
        sets, low, level = sets[order], _low(tokens[order]), _levels(frequency[order])
        high = np.array([part << (64 - bits) if part < ranges else 0], np.uint64).view(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], sets[1:] != sets[:-1]))) if len(sets) else np.zeros(0, np.int64)
        ends = np.append(begins, len(sets))
        lists = [pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((ends * x.itemsize * (x.size // max(1, len(x)))).astype(np.int32)), pa.py_buffer(x.tobytes())]) for x in (low, level)]
        return pa.table({"number": pa.array(sets[begins]), "class": pa.nulls(len(begins), pa.int64()), "holds": pa.array(np.diff(ends).astype(np.int32)), "high": pa.array(np.repeat(high, len(begins))), "tokens": lists[0], "frequencies": lists[1]})

    packed = _bytes_of(docs).mapInArrow(send, "part int, blob binary")
    return packed.groupBy("part").applyInArrow(reduce, "number long, class long, holds int, high long, tokens binary, frequencies binary")


def _pieces(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of packed pieces: their numbers, ``width`` bytes each, as rows of bytes; how many each piece has; and where
    those of each list end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    pieces = column.flatten()
    numbers = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8).reshape(-1, width)
    counts = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) // width
    ends = np.append(0, np.cumsum(counts))[np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]
    return numbers, counts, ends


def _levels_of(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The levels of frequency of each row."""
    numbers, _, ends = _pieces(column, 1)
    return np.split(numbers.ravel(), ends)[:-1]


def _tokens_of(high: pa.ChunkedArray | pa.Array, column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The tokens of each row, from the high bits of its pieces and the low bytes in them."""
    numbers, counts, ends = _pieces(column, LOW_BYTES)
    high = (high.combine_chunks() if isinstance(high, pa.ChunkedArray) else high).flatten()
    tokens = np.zeros((len(numbers), 8), np.uint8)
    tokens[:, :LOW_BYTES] = numbers
    return np.split(tokens.view(np.int64).ravel() | np.repeat(high.to_numpy(zero_copy_only=False), counts), ends)[:-1]


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def signatures(n: int, tokens: np.ndarray, frequency: np.ndarray, percent: int) -> list[int]:
    """Index entries of a class of n tokens, of which ``tokens`` are shared, rare ones first."""
    least = least_overlap(n, percent)
    spare, position = n - least, n - len(tokens)
    if position > spare:
        return []
    out: list[int] = []
    rare = tokens[: int(np.searchsorted(frequency, RARE, side="right"))][: spare - position + 1].view(np.uint64)
    for scheme in {least.bit_length() - 1, n.bit_length() - 1}:
        out += mix(rare + np.uint64(scheme + 1)).view(np.int64).tolist()
        dealt = max(1, (100 - percent) * (1 << scheme) // 200)
        begin = int(np.searchsorted(frequency, RARE, side="right"))
        frequent = tokens[begin : max(begin, spare + dealt + 1 - position)].view(np.uint64)
        if len(frequent) > 1:
            by_class: dict[int, list[int]] = {}
            for token, group in zip(frequent.tolist(), (mix(frequent) % np.uint64(dealt)).tolist(), strict=True):
                by_class.setdefault(group, []).append(token)
            pairs = [p for own in by_class.values() for p in combinations(sorted(own), 2)]
            if pairs:
                both = np.array(pairs, np.uint64)
                out += mix(mix(both[:, 0] + np.uint64(scheme + 1)) + both[:, 1]).view(np.int64).tolist()
    return out


def _index(sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, counts = [], []
            for n, tokens, frequency in zip(batch.column(1).to_pylist(), _tokens_of(batch.column(2), batch.column(3)), _levels_of(batch.column(4)), strict=True):
                order = np.lexsort((tokens, frequency))
                own = signatures(n, tokens[order], frequency[order], percent)
                entries += own
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.int64()), pa.array(np.repeat(batch.column(0).to_numpy(), counts))], ["entry", "class"])

    return sets.select("class", "n", "high", "tokens", "frequencies").mapInArrow(run, "entry long, class long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (distinct tokens each)."""
    tokens = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.int64)
    dense = np.flatnonzero(count >= DENSE)
    place = np.full(len(count), -1)
    place[dense] = np.arange(len(dense))
    spot = place[column]
    for at in range(0, len(dense), 4096):
        here = (spot >= at) & (spot < at + 4096)
        m = np.zeros((len(left) + len(right), min(4096, len(dense) - at)), np.float32)
        m[row[here], spot[here] - at] = 1
        out += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    some = (spot < 0) & (count[column] > 1)
    row, column = row[some], column[some]
    order = np.lexsort((row, column))
    row, column = row[order], column[order]
    for gap in range(1, DENSE):  # pairs of the few owners of a token: each with the one ``gap`` places on
        same = np.flatnonzero(column[gap:] == column[:-gap]) if len(column) > gap else np.zeros(0, np.int64)
        a, b = row[same], row[same + gap]
        cross = (a < len(left)) & (b >= len(left))
        np.add.at(out, (a[cross], b[cross] - len(left)), 1)
    return out


def _local_roots(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """The first node of each node's component under the links a-b."""
    root = list(range(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(nodes)], np.int64)


def _sorted_sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], pa.Table]:
    """Classes, sizes and token sets of the rows in order of class."""
    rows = rows.combine_chunks().sort_by("class")
    return rows.column("class").to_numpy(), rows.column("n").to_numpy(), _tokens_of(rows.column("high"), rows.column("tokens")), rows


def _verify_chunks(sets: DataFrame, percent: int) -> DataFrame:
    """For each member of a chunk (columns cluster, chunk, pivot, class, n, high, tokens) the smallest class that it links with
    through the chunk and its pivots, and its Jaccard distances to those (``pivot`` numbers them, NULL for members)."""

    def run(rows: pa.Table) -> pa.Table:
        ids, n, tokens, rows = _sorted_sets(rows)
        pivot = rows.column("pivot").to_numpy(zero_copy_only=False)
        is_pivot = ~np.isnan(pivot.astype(float))
        common = overlaps(tokens, tokens)
        union = n[:, None] + n[None, :] - common
        a, b = np.nonzero(np.triu(100 * common >= percent * union, 1))
        roots = _local_roots(a, b, len(ids))
        member = np.flatnonzero(~is_pivot)
        order = np.flatnonzero(is_pivot)[np.argsort(pivot[is_pivot].astype(float))]
        distance = 1 - common[member][:, order] / union[member][:, order]
        ends = np.arange(len(member) + 1, dtype=np.int32) * len(order)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(distance.ravel().astype(np.float64)))
        # A pivot is a member of some chunk too; here it stands beside itself, so ids may repeat.
        return pa.table({"cluster": pa.array(np.repeat(rows.column("cluster")[0].as_py(), len(member)).astype(np.int64)), "node": pa.array(ids[member]), "root": pa.array(ids[roots[member]]), "far": lists})

    return sets.groupBy("cluster", "chunk").applyInArrow(run, "cluster long, node long, root long, far array<double>")


def _verify_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links between the two chunks of each pair (columns x, y, chunk, class, n, high, tokens), as stars."""

    def run(rows: pa.Table) -> pa.Table:
        ids, n, tokens, rows = _sorted_sets(rows)
        chunk = rows.column("chunk").to_numpy()
        left = np.flatnonzero(chunk == rows.column("x")[0].as_py())
        right = np.flatnonzero(chunk == rows.column("y")[0].as_py())
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        common = overlaps([tokens[i] for i in left], [tokens[i] for i in right])
        a, b = np.nonzero(100 * common >= percent * (n[left][:, None] + n[right][None, :] - common))
        roots = _local_roots(left[a], right[b], len(ids))
        own = np.flatnonzero(roots != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[roots[own]]), "b": pa.array(ids[own])})

    return sets.groupBy("x", "y").applyInArrow(run, "a long, b long")


def _across(members: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links across the components ``linked`` of one cluster, if any clusters of several chunks have several.

    ``members`` holds cluster, node and distances to pivots. A class's cell is the distance to two pivots in steps of
    1 - t: linked classes are in the same or adjacent ones. Classes of a component that has more than CHUNK of a cell's
    classes are chunked apart from the others, so that pairs of its own chunks needn't be looked at again."""
    named = members.filter(F.size("far") > 0).select("cluster", "node", "far").join(linked, "node", "left").select("cluster", "node", "far", F.coalesce("root", "node").alias("label"))
    open_ = named.groupBy("cluster").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size")).filter("least <> most")
    open_ = scratch(open_.select("cluster", "size"))
    if open_.isEmpty():
        forget(open_)
        return None
    # Steps a little wider than 1 - t, so that rounding can't part linked classes by two.
    step = 1 - percent / 100 + 1e-6
    cell = [F.floor(F.coalesce(F.get("far", F.lit(i)), F.lit(0.0)) / step).cast("int") for i in (0, 1)]
    total = members.count()
    rows = left_join_groups(named.withColumn("p", cell[0]).withColumn("q", cell[1]), open_, "cluster", "size", total, F.col("node")).filter("size is not null")
    rows = scratch(rows.select("cluster", "node", "label", "p", "q"))
    own = rows.groupBy("cluster", "p", "q", "label").agg(F.count(F.lit(1)).alias("classes"))
    own = own.withColumn("apart", F.when(F.col("classes") > CHUNK, F.col("label")))
    cells = own.groupBy("cluster", "p", "q", "apart").agg(F.sum("classes").alias("classes"))
    cells = scratch(cells.withColumn("chunks", F.ceil(F.col("classes") / CHUNK).cast("int")).withColumn("cell", F.xxhash64("cluster", "p", "q", "apart")))
    # Components that are chunked apart are those rows of ``own``; a row finds its cell by them.
    big = own.filter("apart is not null").select(F.xxhash64("cluster", "p", "q", "label").alias("own"), F.col("label").alias("apart"), F.col("classes").alias("hits"))
    rows = left_join_groups(rows.withColumn("own", F.xxhash64("cluster", "p", "q", "label")), big, "own", "hits", total, F.col("node"))
    rows = scratch(rows.select("node", F.xxhash64("cluster", "p", "q", "apart").alias("cell")))

    one = cells.select("cluster", "p", "q", "apart", "cell", "chunks")
    two = one.select(F.col("cluster").alias("cluster2"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("apart").alias("apart2"), F.col("cell").alias("cell2"), F.col("chunks").alias("chunks2"))
    near = one.join(two, F.expr("cluster = cluster2 AND abs(p - p2) <= 1 AND abs(q - q2) <= 1 AND cell <= cell2 AND NOT coalesce(apart = apart2, false)"))
    near = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks2") - 1)))
    pairs = near.filter("cell < cell2 OR i <= j").select(F.xxhash64("cell", "i").alias("x"), F.xxhash64("cell2", "j").alias("y"))
    pairs = scratch(pairs)
    wanted = pairs.select(F.col("x").alias("chunk"), "x", "y").union(pairs.select(F.col("y").alias("chunk"), "x", "y")).distinct()

    placed = left_join_groups(rows, cells.select("cell", "chunks", "classes"), "cell", "classes", total, F.col("node"))
    placed = placed.select("node", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).alias("chunk"))
    placed = placed.join(sets, placed["node"] == sets["class"]).select("chunk", "class", "n", "high", "tokens")
    found = scratch(_verify_pairs(placed.join(wanted, "chunk").select("x", "y", "chunk", "class", "n", "high", "tokens"), percent))
    forget(open_, cells, rows, pairs)
    return found


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    A set holds the distinct shingles of ``words`` words (A-Z lower-cased); a text of fewer words is one shingle. NULL
    and empty texts and those of white space have an empty set and link with nothing. Repeated rows and equal sets link
    with each other. Rows without doc_id take part, but don't name a component; one of such rows only is NULL. Only
    doc_id and text are read. An empty table gives an empty result.

    Returns doc_id, n_shingles, component_id (the smallest doc_id of the component).
    """
    spark = docs.sparkSession
    surveyed = scratch(_survey(docs, words))
    members = surveyed.filter("times is null").select("doc_id", "n", "class")
    classes = scratch(members.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    total, sent = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    noted = surveyed.filter("times is not null").groupBy("token").agg(F.sum("times").alias("times"))
    hot = noted.filter(F.col("times") >= max(HOT_CLASSES, -(-sent // HOT_PART))).toArrow().combine_chunks()
    order = np.argsort(hot.column("token").to_numpy().view(np.uint64))
    listed = (hot.column("token").to_numpy().view(np.uint64)[order], hot.column("times").to_numpy()[order])

    # A class's first document sends its set. The bitmap lets some others through, and in tables beyond its size most of
    # them; what is sent twice counts once.
    first = classes.filter("least_id is not null").select(F.xxhash64("least_id").alias("h"))
    senders = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    senders = perhaps_among(senders, F.xxhash64("doc_id"), first, "h", classes.count(), "sends").filter("sends OR doc_id IS NULL")
    scanned = scratch(_scan(senders, words, blocks_for(tokens, RANGE_TOKENS, least=16), spark.sparkContext.broadcast(listed)))
    # Of sets that were sent twice the first stands for the class. Sets with too few shared tokens to link are left out
    # by their counts, before their tokens are brought together.
    names = scanned.filter("class IS NOT NULL").groupBy("class").agg(F.min("number").alias("number")).join(classes.select("class", "n"), "class")
    pieces = scanned.filter("class IS NULL")
    held = pieces.groupBy("number").agg(F.sum("holds").alias("held"))
    able = scratch(names.join(held, "number").filter(F.col("held") * 100 >= F.col("n") * percent).select("number", "class", "n"))
    perhaps = perhaps_among(pieces, F.xxhash64("number"), able.select(F.xxhash64("number").alias("h")), "h", able.count(), "able").filter("able")
    whole = perhaps.groupBy("number").agg(F.collect_list(F.struct("high", "tokens", "frequencies")).alias("all")).join(able, "number")
    sets = scratch(whole.select("class", "n", F.col("all")["high"].alias("high"), F.col("all")["tokens"].alias("tokens"), F.col("all")["frequencies"].alias("frequencies")))
    forget(scanned, able)

    entries = scratch(_index(sets, percent))
    stars = entries.groupBy("entry").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    edges = left_join_groups(entries, stars, "entry", "size", entries.count(), F.col("class")).filter("class <> a").select("a", F.col("class").alias("b"))
    clusters = scratch(components(edges))
    forget(entries)

    linked = _linked(clusters, sets, percent)
    forget(sets, clusters)

    # The component's smallest doc_id, by class; classes that link with nothing are their own.
    named = classes.join(linked, classes["class"] == linked["node"], "left").select("class", "least_id", "copies", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = scratch(left_join_groups(named, smallest, "root", "size", classes.count(), F.col("class")).select("class", "copies", "component_id"))
    forget(linked, classes)
    out = left_join_groups(members, named, "class", "copies", total, F.col("doc_id"))
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _linked(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, root``: components of the links within ``clusters`` (node, root) of candidates."""
    total = clusters.count()
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = left_join_groups(clusters, sizes, "root", "size", total, F.col("node"))
    placed = placed.select("node", F.col("root").alias("cluster"), F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    member = placed.select("node", "cluster", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(None).cast("int").alias("pivot"))
    # Pivots: the node with the smallest hash of each residue class.
    hashed = F.xxhash64(F.lit(5), "node")
    pivots = placed.filter("chunks > 1").groupBy("cluster", "chunks", F.pmod(hashed, F.lit(PIVOTS)).cast("int").alias("pivot")).agg(F.min(F.struct(hashed.alias("h"), "node"))["node"].alias("node"))
    member = member.join(sets, member["node"] == sets["class"]).select("cluster", "chunk", "pivot", "class", "n", "high", "tokens")
    pivots = pivots.join(sets, pivots["node"] == sets["class"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    verified = scratch(_verify_chunks(member.union(pivots.select("cluster", "chunk", "pivot", "class", "n", "high", "tokens")), percent))
    first = verified.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    linked = scratch(components(first))
    more = _across(verified, linked, sets, percent)
    if more is not None:
        before, linked = linked, scratch(components(linked.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)))
        forget(before, more)
    forget(verified)
    return linked


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with its smallest doc_id, with its columns, whatever their names. Rows
    without doc_id stay, and so do texts without words; repeated rows of the id that stays all do. An empty table gives
    an empty result."""
    found = jaccard_components(docs, words, percent).filter("component_id <> doc_id").select("doc_id")
    return split_by_keys(docs, found, {"doc_id": F.col("doc_id").cast("long")}, 16)[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) END AS c, s FROM sets),
classes AS (SELECT c, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS least FROM named WHERE c IS NOT NULL GROUP BY c),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
links AS (SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(c, root) AS (SELECT c, c FROM classes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.c),
roots AS (SELECT r.c, min(k.least) AS component_id FROM reach r JOIN classes k ON k.c = r.root GROUP BY r.c)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(r.component_id, m.doc_id) AS component_id FROM named m LEFT JOIN roots r ON r.c = m.c
"""
