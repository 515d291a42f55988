"""Packing token sequences by minimum bin slack.

Documents longer than a window fill whole windows first; what is left of each document is one piece shorter
than a window. The pieces of a unit (a bounded run of documents) are packed together: a window takes the
longest piece, and a subset-sum over the *multiset of remaining lengths* finds the lengths that come closest
to the rest of the window. The dynamic programme keeps one big integer per step whose bit s says that the sum
s can be made; walking the steps backwards gives how many pieces of each length are taken.

A unit's pieces that cannot yet fill a window wait for the next unit, but never more than a unit's tokens: beyond
that, and at the end of a partition, windows are filled up with a cut from another waiting piece. The last, shorter
sequence is cut into powers of two, which need no padding. So at most two units are in memory.

Defined results: a null or empty text is its end id alone; null ids stay null; every id of every row lies in
exactly one piece; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import read_table
from ._tokens import encoded_rows, vocabulary_path

WINDOW = 4096
END_ID = 2
UNIT_TOKENS = 2_000_000

Piece = tuple[int | None, int, bytes, int]  # doc_id, start, ids, tokens of the document


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length sum to ``room``, or to the largest sum below it that can be made."""
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        chunk = 1
        while left:  # counts in chunks 1, 2, 4, ...: any number up to the count is a sum of chunks
            k = min(chunk, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            chunk *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:  # the sum needs this chunk
            taken[length] += k
            total -= length * k
    return dict(taken)


def fill_windows(waiting: dict[int, list[Piece]], window: int, keep: int) -> Iterator[list[Piece]]:
    """Windows made from ``waiting`` (pieces by length), which keeps what isn't used.

    As long as more than ``keep`` tokens wait, pieces are cut where none fits; below that only windows that whole
    pieces fill are made. With ``keep`` 0 every piece is placed.
    """
    held = sum(n * len(p) for n, p in waiting.items())
    while waiting:
        longest = max(waiting)
        counts = {n: len(p) - (n == longest) for n, p in waiting.items() if len(p) > (n == longest)}
        fill = closest_fill(counts, window - longest)
        total = longest + sum(n * k for n, k in fill.items())
        if total < window and held <= keep:
            return
        made = [_take(waiting, longest)]
        for n, k in fill.items():
            made += [_take(waiting, n) for _ in range(k)]
        if total < window and waiting:
            doc, start, ids, whole = _take(waiting, max(waiting))
            cut = 4 * (window - total)
            made.append((doc, start, ids[:cut], whole))
            _put(waiting, (doc, start + window - total, ids[cut:], whole))
        held -= min(window, held)
        yield made


def _take(waiting: dict[int, list[Piece]], length: int) -> Piece:
    found = waiting[length].pop()
    if not waiting[length]:
        del waiting[length]
    return found


def _put(waiting: dict[int, list[Piece]], piece: Piece) -> None:
    waiting.setdefault(len(piece[2]) // 4, []).append(piece)


def power_of_two_parts(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces in turn, cut into sequences whose lengths are powers of two, longest first."""
    total = sum(len(p[2]) // 4 for p in pieces)
    queue = list(reversed(pieces))
    while total:
        room = size = 1 << (total.bit_length() - 1)
        made = []
        while room:
            doc, start, ids, whole = queue.pop()
            made.append((doc, start, ids[: 4 * room], whole))
            if len(ids) > 4 * room:
                queue.append((doc, start + room, ids[4 * room :], whole))
            room -= len(made[-1][2]) // 4
        total -= size
        yield made


def pack(
    documents: Iterable[tuple[int | None, bytes]], window: int = WINDOW, unit_tokens: int = UNIT_TOKENS
) -> Iterator[list[Piece]]:
    """Sequences of pieces from (doc_id, little-endian 32-bit ids)."""
    waiting: dict[int, list[Piece]] = {}
    seen = 0
    for doc, ids in documents:
        n = len(ids) // 4
        for a in range(0, n - window + 1, window):
            yield [(doc, a, ids[4 * a : 4 * (a + window)], n)]
        if n % window:
            a = n - n % window
            _put(waiting, (doc, a, ids[4 * a :], n))
            seen += n - a
        if seen >= unit_tokens:
            yield from fill_windows(waiting, window, unit_tokens)
            seen = 0
    for made in fill_windows(waiting, window, 0):
        if sum(len(p[2]) for p in made) == 4 * window:
            yield made
        else:
            yield from power_of_two_parts(made)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, window: int = WINDOW, unit_tokens: int = UNIT_TOKENS
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): one row each, with its ids as little-endian unsigned 32-bit integers.

    Every input partition packs its own documents: nothing is shuffled.
    """
    path = path or vocabulary_path()

    def run(batches):
        first = TaskContext.get().partitionId() << 40

        def documents():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                yield from zip(ids, encoded_rows(path, batch.column(1), end_id), strict=True)

        rows, size = [], 0
        for k, made in enumerate(pack(documents(), window, unit_tokens)):
            offset = 0
            for doc, start, ids, n in made:
                rows.append((doc, start, len(ids) // 4, ids, n, first + k, offset))
                offset += len(ids) // 4
            size += offset
            if size >= 1 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names)
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packed(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
