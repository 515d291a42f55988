"""Texts of an Arrow batch as one byte buffer, in slices of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (nulls: empty) and the n + 1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    large = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, off, data = large.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(large) + 1 + large.offset)[large.offset :]
    if data is None or not len(large):
        return np.empty(0, np.uint8), np.zeros(len(large) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8), offsets


def row_texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_bytes(column)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes together, a longer text alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass
