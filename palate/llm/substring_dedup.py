"""Repeated passages by seed and extend, exactly: every run of ``WINDOW`` words that occurs more than once.

Seeds. Of the ``WINDOW - ANCHOR + 1`` word runs of length ``ANCHOR`` inside a window the one with the smallest
hash (the first, on ties) is the window's anchor; equal windows have equal anchors at equal places. Neighbouring
windows mostly share theirs, so a text has one anchor in about fourteen words. Only anchors that occur more
than once, anywhere, go on: documents meet on them and nothing else.

Extension. The neighbouring windows that share an anchor form a stretch: the anchor extended both ways as far as
it is the smallest. Occurrences whose whole stretches are equal are settled at once, however many there are,
without pairing them. Where an anchor has different stretches, one example of each different stretch is
extended window by window, and windows found in two stretches are repeats too. Overlapping repeats of a
document join to maximal ones.

Nothing is paired, so a passage in n documents costs n rows; counting is by partial sums, and rows find what is
known of their anchor, stretch or text through salted joins. Equal texts are one text: a batch tells of each
at most twice (enough to make it a repeat), and spans are worked out once. Long texts go in tiles of words.

Defined results: null and empty texts have no words; repeated rows are repeats of each other; null doc_ids are
documents like others; an empty table gives an empty result; other columns of the input stay as they are, or
are ignored where only a report is asked for.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import SLICE_BYTES, row_texts, slices, text_bytes
from ._skew import hot_keys, join_back
from ._store import pin_splits, read_table, save
from ._words import U, Words, mix, powers, runs, sequence_hash, words

WINDOW, ANCHOR = 35, 8
TILE = 1 << 19  # windows of one text that are worked on at once
KEY = ["t1", "t2"]
_PLACE = U(0x9E3779B97F4A7C15)


def text_key(text):
    """Two hashes that together tell which text this is."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(7), whole).alias("t2")


def keyed(docs: DataFrame) -> DataFrame:
    """(t1, t2, doc_id, row, text): t1 and t2 tell the text, row tells the row as long as the scan is repeated."""
    return docs.select(
        *text_key(F.col("text")),
        F.col("doc_id").cast("long"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


class Spans:
    """Hashes of any spans of the words of some rows."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])
        self.other = np.zeros(len(hashes) + 1, U)
        np.cumsum(mix(hashes ^ _PLACE) * up[:-1], out=self.other[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U))

    def second(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Another 64 bits of the same spans."""
        return mix((self.other[end] - self.other[begin]) * self.down[begin] + (end - begin).astype(U))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first smallest of each ``width`` neighbours stands."""
    n = len(values) - width + 1
    at, have = np.arange(len(values)), 1
    while have < width:
        shift = min(have, width - have)
        left, right = at[: len(at) - shift], at[shift:]
        at = np.where(values[left] <= values[right], left, right)
        have += shift
    return at[:n]


def stretches(w: Words, window: int = WINDOW, anchor: int = ANCHOR):
    """Of each stretch: row, first window (as a word of the row), windows, anchor's hash, stretch's hash."""
    counts = w.counts
    many = np.maximum(0, counts - window + 1)
    rows = np.repeat(np.arange(len(counts)), many)
    if not len(rows):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, np.zeros(0, U), np.zeros(0, U)
    start = runs(w.bounds[:-1], many)  # each window's first word, in the slice
    grams = sequence_hash(w.hashes, anchor)
    at = smallest(grams, window - anchor + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    begin, spans = start[first], Spans(w.hashes)
    whole = spans.of(begin, begin + size + window - 1)
    whole = mix(whole ^ mix((at[first] - begin).astype(U) * _PLACE + size.astype(U)))
    return rows[first], begin - w.bounds[rows[first]], size, grams[at[first]], whole


def tiled_stretches(w: Words, window: int = WINDOW, anchor: int = ANCHOR, tile: int = TILE):
    """The stretches of some rows; a row of more than ``tile`` windows comes in tiles. A stretch that a tile's end
    cuts in two is two stretches: equal ones cut elsewhere still meet at their anchor, window by window."""
    if len(w.counts) > 1 or len(w.hashes) <= tile:
        yield stretches(w, window, anchor)
        return
    for a in range(0, len(w.hashes) - window + 1, tile):
        z = slice(a, a + tile + window - 1)
        part = Words(w.hashes[z], w.begin[z], w.end[z], np.array([0, len(w.hashes[z])]))
        row, start, *rest = stretches(part, window, anchor)
        yield row, start + a, *rest


def at_most_twice(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the first two rows of each text (columns 0 and 1)."""
    t1, t2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    order = np.lexsort((t2, t1))
    same = np.zeros(len(order), bool)
    same[2:] = (t1[order[2:]] == t1[order[:-2]]) & (t2[order[2:]] == t2[order[:-2]])
    if not same.any():
        return batch
    wanted = np.ones(len(order), bool)
    wanted[order[same]] = False
    return batch.filter(pa.array(wanted))


def anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(t1, t2, start, size, a, r) of every stretch of every text, of equal texts in a batch two at most."""

    def run(batches):
        for batch in map(at_most_twice, batches):
            data, offsets = text_bytes(batch.column(2))
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for a, b in slices(offsets, 2 << 20):
                for row, start, size, gram, whole in tiled_stretches(words(data, offsets[a : b + 1]), window, anchor):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(k[row + a]) for k in keys),
                            pa.array(start.astype(np.int32)),
                            pa.array(size.astype(np.int32)),
                            pa.array(gram.view(np.int64)),
                            pa.array(whole.view(np.int64)),
                        ],
                        names=["t1", "t2", "start", "size", "a", "r"],
                    )

    return keyed(docs).select(*KEY, "text").mapInArrow(run, "t1 long, t2 long, start int, size int, a long, r long")


def _windows(texts: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """Every window of the stretches in ``parts`` (t1, t2, start, size, c): (t1, t2, start, c, w1, w2)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            lists = batch.column(3)
            for a, b in slices(offsets, 2 << 20):
                w = words(data, offsets[a : b + 1])
                spans = Spans(w.hashes)
                own = lists.slice(a, b - a)
                many = own.value_lengths().to_numpy()
                flat = own.flatten()
                start, size, c = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
                row = np.repeat(np.arange(a, b), many)
                piece = np.cumsum(size) // TILE
                for k in np.unique(piece):
                    z = piece == k
                    first = runs(start[z], size[z])
                    at, of = np.repeat(row[z], size[z]), np.repeat(c[z], size[z])
                    begin = first + w.bounds[at - a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(x[at]) for x in keys),
                            pa.array(first.astype(np.int32)),
                            pa.array(of),
                            pa.array(spans.of(begin, begin + window).view(np.int64)),
                            pa.array(spans.second(begin, begin + window).view(np.int64)),
                        ],
                        names=["t1", "t2", "start", "c", "w1", "w2"],
                    )

    lists = parts.groupBy(*KEY).agg(F.collect_list(F.struct("start", "size", "c")).alias("parts"))
    return (
        texts.join(lists, KEY)
        .select(*KEY, "text", "parts")
        .mapInArrow(run, "t1 long, t2 long, start int, c long, w1 long, w2 long")
    )


def _held(rows: DataFrame, counts: DataFrame, on: list[str], n: str, by: list[str]) -> DataFrame:
    """The rows whose key is in ``counts`` (one row a key; ``n``: how many rows have it)."""
    return join_back(rows, counts.select(*on), on, hot_keys(counts, on, n), by)


def repeats(docs: DataFrame, copies: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """The texts that share an anchor (t1, t2, text), each once, and the repeats (t1, t2, spans): spans of windows,
    as structs of the first window's first word and the number of windows. ``copies``: see ``told_apart``."""
    every = anchors(docs, window, anchor)
    place = [*KEY, "start"]
    often = save(every.groupBy("a").agg(F.count("*").alias("c")).where("c > 1"), "anchor-counts")
    shared = save(_held(every, often, ["a"], "c", place), "anchors")
    example = F.min(F.struct(*KEY, "start", "size")).alias("example")
    kinds = save(shared.groupBy("a", "r").agg(F.count("*").alias("c"), example), "stretches")
    settled = _held(shared, kinds.where("c > 1"), ["a", "r"], "c", place).select(*place, "size")
    mixed = save(kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    parts = _held(kinds, mixed, ["a"], "kinds", ["r"]).select("example.*", "c")
    wanted = copies.join(shared.select(*KEY).distinct(), KEY, "left_semi").select("row")
    texts = save(keyed(docs).join(wanted, "row").select(*KEY, "text"), "texts")
    single = save(_windows(texts, parts, window), "windows")
    sums = [F.sum("c").alias("c"), F.count(F.when(F.col("c") == 1, 1)).alias("alone")]
    twice = save(single.groupBy("w1", "w2").agg(*sums).where("c > 1 AND alone > 0"), "twice")
    found = _held(single.where("c = 1"), twice, ["w1", "w2"], "alone", place)
    found = found.select(*place, F.lit(1).alias("size"))
    spans = settled.union(found).groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    return texts, spans


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, row, n) of every distinct text: its first row and how many there are; and the hot ones' salts."""
    pin_splits(docs.sparkSession)
    copies = keyed(docs).groupBy(*KEY).agg(F.min("row").alias("row"), F.count("*").alias("n"))
    copies = save(copies, "text-keys")
    return copies, hot_keys(copies, KEY, "n")


def covered(start: np.ndarray, size: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words the windows of some spans cover."""
    edges = np.zeros(n_words + 1, np.int32)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + size + window - 1, -1)
    return np.cumsum(edges[:-1]) > 0


def cut(text: bytes, w: Words, gone: np.ndarray) -> bytes:
    """``text`` without the words marked in ``gone``; white space between other words stays as it is."""
    change = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at = [], 0
    for first, last in zip(np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) - 1).tolist(), strict=True):
        out.append(text[at : int(w.begin[first])])
        at = int(w.begin[last + 1]) if last + 1 < len(w.begin) else len(text)
    out.append(text[at:])
    return b"".join(out)


def joined(text: bytes, gone: np.ndarray | None = None) -> tuple[int, bytes]:
    """How many words ``text`` has, and those not marked in ``gone`` joined by single spaces."""
    if len(text) <= SLICE_BYTES:
        found = text.split()
        left = found if gone is None else [w for w, o in zip(found, gone.tolist(), strict=True) if not o]
        return len(found), b" ".join(left)
    raw = np.frombuffer(text, np.uint8)
    w = words(raw, np.array([0, len(raw)]))
    begin, end = (w.begin, w.end) if gone is None else (w.begin[~gone], w.end[~gone])
    edges = np.zeros(len(raw) + 2, np.int8)
    edges[begin] += 1
    edges[end + 1] -= 1
    raw = np.append(raw, np.uint8(32))
    raw[end] = 32
    return len(w.begin), raw[np.cumsum(edges[:-1], dtype=np.int8) > 0][:-1].tobytes()


def _removed(texts: DataFrame, spans: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """(t1, t2, n_removed, kept): kept is the text left, or else its words joined by single spaces, hashed."""

    def run(batches):
        for batch in batches:
            gone, kept = [], []
            for text, marks in zip(row_texts(batch.column(2)), batch.column(3), strict=True):
                w = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                start, size = (marks.values.field(k).to_numpy() for k in range(2))
                out = covered(start, size, len(w.hashes), window)
                gone.append(int(out.sum()))
                kept.append(cut(text, w, out).decode() if keep_text else hashlib.sha256(joined(text, out)[1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string())],
                names=["t1", "t2", "n_removed", "kept"],
            )

    both = texts.join(spans, KEY).select(*KEY, "text", "spans")
    return both.mapInArrow(run, "t1 long, t2 long, n_removed long, kept string")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; every other column and row as it was, whatever the
    columns' names."""
    copies, hot = told_apart(docs)
    texts, spans = repeats(docs, copies, window, anchor)
    changed = save(_removed(texts, spans, window, keep_text=True).select(*KEY, "kept"), "cut-texts")
    rows = docs.select(F.struct("*").alias("doc"), *text_key(F.col("text")), F.monotonically_increasing_id().alias("row"))
    found = join_back(rows, changed, KEY, hot, ["row"], "left")
    text = F.coalesce("kept", "doc.text").alias("text")
    return found.select(*[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def word_digests(docs: DataFrame) -> DataFrame:
    """(t1, t2, row, doc_id, n_words, all_sha256) of every row: its words joined by single spaces, hashed."""

    def run(batches):
        for batch in batches:
            n, sums = [], []
            for text in row_texts(batch.column(4)):
                found, left = joined(text)
                n.append(found)
                sums.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(n, pa.int64()), pa.array(sums, pa.string())],
                names=["t1", "t2", "doc_id", "row", "n_words", "all_sha256"],
            )

    return keyed(docs).mapInArrow(run, "t1 long, t2 long, doc_id long, row long, n_words long, all_sha256 string")


def removal_report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    copies, hot = told_apart(docs)
    texts, spans = repeats(docs, copies, window, anchor)
    removed = save(_removed(texts, spans, window, keep_text=False), "removed")
    return join_back(word_digests(docs), removed, KEY, hot, ["row"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept", "all_sha256").alias("kept_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
ORACLES: dict[str, str] = {}
