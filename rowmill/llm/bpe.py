"""Byte-level BPE encoding and decoding in numpy matrices.

Texts are cut into pieces by the tokenizer's pattern; each distinct piece is encoded once
per worker. Pieces of similar
length stand as rows of a padded matrix of token ids beside a matrix of the ranks of their adjacent pairs. In each round
every row merges its leftmost pair of minimum rank: the row closes up (compaction) and only the two pairs beside
the merged token are looked up again, in an open-addressing hash table over all pairs whose concatenation is a token. Rows without
a mergeable pair leave the matrix. Pieces beyond LONG_PIECE bytes, whose rounds would cost the square of their length,
merge in the same order through a heap.

Documents are independent, so there is no shuffle. The vocabulary file is read on the driver, and its tables (a few MB
whatever the corpus) are broadcast.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm.common import bounded_batches, release_memory
from rowmill.session import table

#: Rank of what can't be merged.
NO_RANK = np.int32(2**31 - 1)
#: Longer pieces take the heap.
LONG_PIECE = 256
#: Cells of one matrix.
MATRIX_CELLS = 1 << 19
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 1 << 18
#: Bytes of text encoded together, so long as documents are shorter.
ENCODED_BYTES = 1 << 20

# Of the characters up to U+024F without controls and rare spaces, those that are letters and numbers.
LATIN = r"\t\n\r\x20-\x7e\xa1-\u024f"
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks have to be 0, 1, 2 and so on."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Hash table from a pair of token ids to the rank (and id) of their concatenation; linear probing."""

    def __init__(self, tokens: list[bytes]):
        rank = {t: i for i, t in enumerate(tokens)}
        keys, values = [], []
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = rank.get(t[:cut]), rank.get(t[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int32)
        key, value = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            first = np.zeros(len(key), bool)
            candidates = np.flatnonzero(free)
            first[candidates[np.unique(slot[candidates], return_index=True)[1]]] = True
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            key, value, slot = key[~first], value[~first], (slot[~first] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> PairTable:
        made = cls.__new__(cls)
        made.keys, made.values, made.bits = keys, values, len(keys).bit_length() - 1
        return made

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK for pairs that aren't in the table and for padding (negative ids)."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(key.shape, NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        wanted = key.reshape(-1)[todo]
        slot, flat = self._slot(wanted), out.reshape(-1)
        while len(todo):
            there = self.keys[slot]
            hit = there == wanted
            flat[todo[hit]] = self.values[slot[hit]]
            more = ~hit & (there >= 0)
            todo, wanted, slot = todo[more], wanted[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0] + 1, ... of all ranges, one range after another."""
    total = int(length.sum())
    step = np.ones(total, np.int64)
    full = length > 0
    start, length = start[full], length[full]
    if total:
        step[0] = start[0]
        step[np.cumsum(length)[:-1]] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


class _Places(dict):
    """Piece to place; a piece asked for the first time gets the next place and is listed in ``new``."""

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = place = len(self)
        return place


class Memory:
    """Pieces encoded before: their place, and at each place a range of one flat array of ids."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.known = _Places()
        self.start, self.length, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def places(self, pieces: Iterator[str], n: int, encode: Callable) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.clear()
        known = self.known
        first = len(known)
        known.new = new = []
        out = np.fromiter(map(known.__getitem__, pieces), np.int64, n)
        if new:
            ids = encode([p.encode() for p in new])
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start, self.length = self._room(self.start, len(known)), self._room(self.length, len(known))
            self.length[first : len(known)] = length
            self.start[first : len(known)] = self.used + np.cumsum(length) - length
            self.flat = self._room(self.flat, self.used + int(length.sum()))
            self.flat[self.used : self.used + int(length.sum())] = np.concatenate(ids)
            self.used += int(length.sum())
        return out


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, pairs: PairTable | None = None):
        self.tokens, self.pattern, self.pairs = tokens, pattern, pairs or PairTable(tokens)

    def parts(self) -> dict:
        """Plain values that an executor makes the encoder from."""
        return {"tokens": self.tokens, "pattern": self.pattern, "keys": self.pairs.keys, "values": self.pairs.values}

    @classmethod
    def on_worker(cls, parts: dict) -> Encoder:
        """The worker's encoder: made once for the ``parts`` that were broadcast and kept with them, with its memory."""
        if "encoder" not in parts:
            parts["encoder"] = cls(parts["tokens"], parts["pattern"], PairTable.of(parts["keys"], parts["values"]))
        return parts["encoder"]

    @cached_property
    def rank(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    @cached_property
    def memory(self) -> Memory:
        return Memory()

    @cached_property
    def split(self) -> Callable[[str], list[str]]:
        """Matches of the pattern. Texts of common Latin characters only take the same pattern with its classes
        spelled out for those, which the faster standard engine runs."""
        full = regex.compile(self.pattern).findall
        if not set(re.findall(r"\\p\{\w+\}", self.pattern)) <= {r"\p{L}", r"\p{N}"}:
            return full
        plain = re.compile(f"[{LATIN}]*").fullmatch
        spelled = self.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
        fast = re.compile(spelled).findall
        return lambda text: fast(text) if plain(text) else full(text)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. A piece that is a token stays whole."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None or not piece:
                out[i] = np.array([whole] if piece else [], np.int32)
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault((len(piece) + 1) // 2 if len(piece) <= 32 else 32 + (len(piece) - 1).bit_length(), []).append(i)
        for rows in buckets.values():
            step = max(1, MATRIX_CELLS // max(len(pieces[i]) for i in rows))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                for i, ids in zip(some, self._merge_matrix([pieces[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        length = np.array([len(p) for p in pieces])
        width = int(length.max())
        ids = np.full((len(pieces), width + 1), -1, np.int32)  # one column of padding stays at the end
        ids[np.arange(width + 1) < length[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        done: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equal minima
            every = np.arange(len(rows))
            best = ranks[every, at]
            over = best == NO_RANK
            if over.any():
                for k in np.flatnonzero(over):
                    done[rows[k]] = ids[k, : length[k]].copy()
                keep = ~over
                rows, ids, ranks, length, at, best = rows[keep], ids[keep], ranks[keep], length[keep], at[keep], best[keep]
                if not len(rows):
                    break
                every = np.arange(len(rows))
                width = int(length.max())
                ids, ranks = ids[:, : width + 1], ranks[:, :width]
            columns = np.arange(ranks.shape[1])
            # Close up: the right token of the pair goes, and with it the pair.
            shift = np.minimum(columns + (columns >= at[:, None]), ranks.shape[1] - 1)
            last = np.full((len(rows), 1), -1, np.int32)
            ids[every, at + 1] = best
            ids[:, :-1] = np.take_along_axis(ids, columns + (columns >= at[:, None]), axis=1)
            ids[:, -1:] = last
            ranks = np.take_along_axis(ranks, shift, axis=1)
            ranks[:, -1] = NO_RANK
            length = length - 1
            ranks[every, at] = self.pairs.ranks(ids[every, at], ids[every, at + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pairs.ranks(ids[before, at[before] - 1], ids[before, at[before]])
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        rank, n = self.rank.get, len(piece)
        end, following, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            right = following[i]
            if not alive[i] or right >= n or end[right] != stop:
                continue  # one of the two has been merged meanwhile
            alive[right] = False
            end[i], following[i] = stop, following[right]
            if following[i] < n:
                before[following[i]] = i
                if (r := rank(piece[i : end[following[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[following[i]]))
            if before[i] >= 0 and (r := rank(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        return np.array([self.rank[piece[i : end[i]]] for i in range(n) if alive[i]], np.int32)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` in a row and the number of ids of each. Pieces are remembered between calls."""
        cut = [self.split(t) for t in texts]
        found = self.memory.places(chain.from_iterable(cut), sum(map(len, cut)), self.encode_pieces)
        length = self.memory.length[found]
        ids = self.memory.flat[ragged(self.memory.start[found], length)]
        ends = np.concatenate(([0], np.cumsum(length)))[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Token ids of every whole text, and what they decode to; one row for each row of ``docs``.

    Ids are those of a byte-level BPE by ranks over each match of ``pattern``, without special tokens (their strings are
    ordinary text). NULL and empty texts have no ids. Repeated rows are encoded each; an empty table gives an empty
    result. Other columns are not read. Returns doc_id, ids, decoded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.on_worker(shared.value)
        for batch in batches:
            keys, sizes, at = batch.column(0), pc.binary_length(batch.column(1)).to_pylist(), 0
            while at < len(sizes):
                stop, held = at, 0
                while stop < len(sizes) and held < ENCODED_BYTES:
                    held += sizes[stop]
                    stop += 1
                ids, counts = encoder.encode_batch(batch.column(1).slice(at, stop - at).to_pylist())
                ends = np.concatenate(([0], np.cumsum(counts)))
                decoded = [encoder.decode(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(at, stop - at), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
                at = stop
        release_memory()

    rows = bounded_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_public(docs: DataFrame) -> DataFrame:
    """With the multilingual public vocabulary; the package that has it is found on the driver."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode_public(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
