"""Token-id files in Simple-8b: many small ids per 64-bit word.

A word holds a 4-bit selector (its top bits) and 60 bits of payload; the selector says how many ids of which
width lie in the payload, lowest first. Fixed table, by selector:

    0: 240 zeros      1: 120 zeros      2: 60 x 1 bit     3: 30 x 2     4: 20 x 3    5: 15 x 4
    6: 12 x 5         7: 10 x 6         8: 8 x 7          9: 7 x 8     10: 6 x 10   11: 5 x 12
   12: 4 x 15        13: 3 x 20        14: 2 x 30        15: escape, the payload indexes the block's escapes

Ids of more than 30 bits are escapes: kept whole, 64 bits each, beside the words. A word starts wherever the
one before ends; of the selectors that fit there the one with most ids is taken.

A file is a Parquet part written by Spark, so its commit is atomic and a lost task leaves nothing behind. Its
records are blocks of whole documents in ascending ``doc_id``: the words, the escapes, the word at which each
``STRIDE``-th id's word begins (``offsets``: pairs of word and id, for decoding from the middle), and the ids
and lengths of its documents. Parts are ranges of ``doc_id``, numbered in that order.

Defined results: null or empty texts are their end id alone; null ``doc_id`` comes first; rows with equal
``doc_id`` follow each other in the order of their texts' hashes; an empty table makes no block; other columns
of the input are ignored. A document is one block however long it is, encoded in slices, its ids held whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._store import read_table, save
from ._tokens import encoded_rows, vocabulary_path

END_ID = 1
BLOCK_IDS = 1 << 16
STRIDE = 4096
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
_COUNT = np.array(COUNTS)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 0 for 0, 31 for all that escape."""
    _, bits = np.frexp(np.minimum(ids, 1 << 30).astype(np.float64))  # exact: below 2^53
    return bits.astype(np.uint8)


def _choices(ids: np.ndarray) -> np.ndarray:
    """The selector a word would have if it started at each position."""
    n, bits = len(ids), _bits(ids)
    chosen = np.full(n, ESCAPE, np.uint8)
    widest, length = bits, 1  # the most bits of any ``length`` ids from each position on
    for selector in range(14, -1, -1):  # the one with most ids is set last
        count = COUNTS[selector]
        if count > n:
            break
        while 2 * length <= count:
            widest = np.maximum(widest[:-length], widest[length:])
            length *= 2
        over = np.maximum(widest[: n - count + 1], widest[count - length :]) > WIDTHS[selector]
        # selectors come down, so the least that fits is the last: 255 where it does not
        first = chosen[: n - count + 1]
        np.minimum(first, np.where(over, np.uint8(255), np.uint8(selector)), out=first)
    return chosen


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and the (word, id) pairs at which decoding can begin."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    chosen = _choices(ids)
    step = (np.arange(len(ids)) + _COUNT[chosen]).tolist()
    starts, i, n = [], 0, len(ids)
    while i < n:
        starts.append(i)
        i = step[i]
    starts = np.array(starts, np.int64)
    selectors = chosen[starts] if len(starts) else chosen[:0]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in range(2, ESCAPE):
        at = np.flatnonzero(selectors == selector)
        if len(at):
            for k in range(COUNTS[selector]):
                words[at] |= ids[starts[at] + k] << np.uint64(WIDTHS[selector] * k)
    at = np.flatnonzero(selectors == ESCAPE)
    words[at] |= np.arange(len(at), dtype=np.uint64)
    firsts = np.unique(np.searchsorted(starts, np.arange(0, n, STRIDE), side="right") - 1) if n else starts
    return words, ids[starts[at]], np.stack([firsts, starts[firsts]], 1).ravel() if n else firsts


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in range(2, ESCAPE):
        at = np.flatnonzero(selectors == selector)
        if len(at):
            own, begin, mask = words[at], starts[at], np.uint64((1 << WIDTHS[selector]) - 1)
            for k in range(COUNTS[selector]):
                out[begin + k] = (own >> np.uint64(WIDTHS[selector] * k)) & mask
    at = np.flatnonzero(selectors == ESCAPE)
    out[starts[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


def decode_from(words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, first: int, count: int) -> np.ndarray:
    """``count`` ids from id ``first`` of a block on, decoding only what lies near."""
    pairs = offsets.reshape(-1, 2)
    a = pairs[np.searchsorted(pairs[:, 1], first, side="right") - 1]
    later = pairs[pairs[:, 1] >= first + count]
    end = int(later[0][0]) if len(later) else len(words)
    return decode(words[int(a[0]) : end], escapes)[first - int(a[1]) :][:count]


BLOCKS = (
    "part int, block int, before long, n_ids long, words binary, escapes binary, offsets array<int>, "
    "doc_ids array<long>, doc_tokens array<int>"
)
_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("before", pa.int64()),
        ("n_ids", pa.int64()),
        ("words", pa.binary()),
        ("escapes", pa.binary()),
        ("offsets", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int32())),
    ]
)


def _block(part: int, block: int, before: int, docs: list, coded: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(coded), "<u4")
    words, escapes, offsets = encode(ids)
    row = (
        part, block, before, len(ids), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
        offsets.astype(np.int32).tolist(), docs, [len(x) // 4 for x in coded],
    )
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def blocks(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The records of the token files of ``docs`` (doc_id, text), in ascending ``doc_id``."""
    path = path or vocabulary_path()

    def run(batches):
        part = TaskContext.get().partitionId()
        block = before = size = 0
        ids, coded = [], []
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoded_rows(path, batch.column(1), end_id), strict=True):
                ids.append(doc)
                coded.append(raw)
                size += len(raw) // 4
                if size >= BLOCK_IDS:
                    yield _block(part, block, before, ids, coded)
                    block, before, size, ids, coded = block + 1, before + size, 0, [], []
        if ids:
            yield _block(part, block, before, ids, coded)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files to the shared folder; returns their records as read back."""
    return save(blocks(docs, path, end_id), "token-files")


READ = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Each document from the files: (doc_id, start, n_tokens, ids_crc32, ids); start counts the ids of all
    documents before. Ids are decoded and summed up where they are read; ``with_ids`` returns them as well."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8")).astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                begin, raw = ends - sizes, memoryview(ids).cast("B")
                found = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array([row["part"]] * len(found), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["before"] + begin),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x) for x in found], pa.int64()),
                ]
                names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(x) for x in found], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    # one row per part, and the shuffle's partitions bound the parts: small enough to go to every task
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    columns = ["part", "before", "words", "escapes", "doc_ids", "doc_tokens"]
    found = files.select(*columns).mapInArrow(run, READ + (", ids binary" if with_ids else ""))
    start = (F.col("first") + F.col("start_in_part")).alias("start")
    kept = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return found.join(F.broadcast(firsts), "part").select("doc_id", start, *kept)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(read_table(spark, sf_dir, "documents")), with_ids=False)


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}
