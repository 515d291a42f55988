"""Words of whole texts as 64-bit hashes, by array operations over the bytes of many texts at once.

A word is a run of bytes other than space and 0x09 to 0x0D. Its hash is a polynomial in its bytes modulo 2^64,
mixed; equal words hash alike in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ._arrow import SLICE_BYTES

U = np.uint64
_FACTOR = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_FACTOR, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_VALUE = mix(np.arange(1, 257, dtype=U))
_VALUE[SPACE] = 0
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The factor's powers 0 to n - 1 and those of its inverse. What a slice needs is kept, more is not."""
    found = _powers
    if len(found["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        found = {}
        for name, base in (("up", _FACTOR), ("down", _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            found[name] = np.multiply.accumulate(steps)
        if size == SLICE_BYTES + 1:
            _powers.update(found)
    return found["up"][:n], found["down"][:n]


@dataclass
class Words:
    hashes: np.ndarray  # of each word
    begin: np.ndarray  # its first byte, counted from the slice's first
    end: np.ndarray  # the byte after it
    bounds: np.ndarray  # rows + 1: which words belong to which row

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def tiles(d: np.ndarray, rows: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Cuts of the bytes ``d`` into tiles of at most ``limit`` (``SLICE_BYTES``), after white space or where a row
    begins. A word longer than that is a tile of its own."""
    limit = limit or SLICE_BYTES
    x, n = 0, len(d)
    while x < n:
        y = min(x + limit, n)
        if y < n:
            edge = int(rows[np.searchsorted(rows, y, side="right") - 1])
            white = np.flatnonzero(SPACE[d[x:y]])
            cut = max(edge, x + int(white[-1]) + 1 if len(white) else 0)
            while cut <= x:  # nothing but one word so far
                edge = int(rows[np.searchsorted(rows, y, side="left")])
                z = min(y + limit, edge)
                white = np.flatnonzero(SPACE[d[y:z]])
                if len(white):
                    cut = y + int(white[0])
                elif z == edge:
                    cut = z
                y = z
            y = cut
        yield x, y
        x = y


def _long_word(d: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The hash of one word longer than a tile, a tile at a time."""
    up, _ = powers(SLICE_BYTES)
    total, factor = 0, 1
    for a in range(0, len(d), SLICE_BYTES):
        part = values[d[a : a + SLICE_BYTES]]
        total += factor * int((part * up[: len(part)]).sum())
        factor = factor * pow(_FACTOR, SLICE_BYTES, 1 << 64) % (1 << 64)
    return mix(np.array([(total + len(d)) % (1 << 64)], U))


def _tile_words(d: np.ndarray, rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and following bytes of the words of ``d``, in which rows begin at ``rows``."""
    n = len(d)
    solid = ~SPACE[d]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    edge[[0, n]] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if not len(begin):
        return np.zeros(0, U), begin, end
    if n > SLICE_BYTES:
        return _long_word(d, values), begin, end
    up, down = powers(n)
    sums = np.add.reduceat(values[d] * up, begin)
    return mix(sums * down[begin] + (end - begin).astype(U)), begin, end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """The words of rows whose texts are ``data[offsets[i]:offsets[i + 1]]``; lower: A-Z count as a-z. Beside the
    words themselves memory holds what one tile needs, however long a text is."""
    d = data[offsets[0] : offsets[-1]]
    rows, values = offsets - offsets[0], _LOWER if lower else _VALUE
    found = []
    for x, y in tiles(d, rows):
        inside = rows[np.searchsorted(rows, x) : np.searchsorted(rows, y)] - x
        hashes, begin, end = _tile_words(d[x:y], inside, values)
        found.append((hashes, begin + x, end + x))
    if not found:
        nothing = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), nothing, nothing, np.zeros(len(rows), np.int64))
    hashes, begin, end = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*found, strict=True))
    return Words(hashes, begin, end, np.searchsorted(begin, rows))


def sequence_hash(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n neighbouring hashes (len - n + 1 of them, across rows too)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    out = np.full(size, (n + 977 * salt + 1) % (1 << 64), U)
    up, _ = powers(n + 1)
    for k in range(n):
        out += hashes[k : k + size] * up[k + 1]
    return mix(out)


def padded(hashes: np.ndarray, counts: np.ndarray, pads: int, value: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows' hashes with ``pads`` times ``value`` after each row, and where each row begins there."""
    first = np.cumsum(counts + pads) - counts - pads
    out = np.full(int(counts.sum()) + pads * len(counts), value, U)
    out[np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))] = hashes
    return out, first


def runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] times, then the same for the next."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
