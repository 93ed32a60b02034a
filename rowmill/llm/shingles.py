"""Word shingle sets of many texts at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash is a polynomial over a table
of random byte values modulo 2**64, which running sums give for all words of a buffer together; shingle hashes mix those
of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[_SPACE] = 0
_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
#: Bytes hashed together; a longer text is a buffer of its own.
BUFFER = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base and of its inverse, for buffers up to the longest seen so far."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_BASE, 1024), _powers(_INVERSE, 1024)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX_A
    h = (h ^ (h >> _SHIFT)) * _MIX_B
    return h ^ (h >> _SHIFT)


def shingle_sets(texts: Sequence[bytes], k: int, powers: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles. A text of fewer words has its whole sequence as its
    one shingle, and one without words none."""
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) < BUFFER):
            held += len(texts[stop]) + 1
            stop += 1
        yield from _sets(texts[at:stop], k, powers)
        at = stop


def _sets(texts: Sequence[bytes], k: int, powers: Powers) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    powers.reach(len(data) + 1)
    space = _SPACE[data]
    inside = np.concatenate(([False], ~space, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * powers.up[: len(data)], dtype=np.uint64)))
    words = mix((sums[ends] - sums[starts]) * powers.down[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(starts, borders)
    first = np.concatenate(([0], last[:-1]))
    if len(words) >= k:
        shingles = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            shingles = mix(shingles) + words[i : len(words) - k + 1 + i]
        shingles = mix(shingles)
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= k:
            own = np.sort(shingles[a : b - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield np.array([xxhash.xxh64_intdigest(words[a:b].tobytes(), b - a)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit id of a set, signed."""
    return xxhash.xxh64_intdigest(tokens.tobytes(), 7) - (1 << 63)
