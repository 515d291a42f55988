"""Phrases that hold together: n-grams counted by sketch first and exactly then, scored by their weakest cut.

1. Sketch. Each task counts all runs of one to five words of its share of the corpus in a count-min sketch: ``ROWS``
   rows of saturating eight-bit counters. Sketches of equal width add up, so the tasks' are merged cell by cell (each
   as slices that meet by number). A merged cell is never less than the true count of any run that hashes to it, so
   what is below the threshold in one row is rare for certain. One bit a cell is all that is needed of it then.
2. Survivors. The second pass looks every run up in those bits and hands only the survivors on, as text, to an
   exact aggregation. A run also needs each of its parts to survive. Too full a sketch lets more
   runs through, which costs shuffle, never a result. Nothing relies on hashes being unique.
3. Scores. Everything else is algebra over the frequent runs: each candidate meets the counts of the two sides
   of each of its cuts, which are frequent as well; the lowest cut is its score; and it goes if a longer candidate
   that holds it is as frequent. It is enough to look at those one word longer: what is inside a still longer one is
   inside one of these, which is no rarer.

The sketch's width follows the corpus (``LOAD`` runs a cell), up to ``WIDEST``: the bits that every task gets are
bounded by that, 32 MiB. One task a core of the cluster reads its share of the files in turn in step 1, so that sketches
written are as many as cores and not as many as files.

Text is lower-cased in A-Z alone; words are runs of bytes other than space and tab, within pieces that end at
``[.,;:!?\\x0A-\\x0D]``. Counts are per ``lang``.

Defined results: null texts count as empty, null languages as ``und`` (together with rows that say so); repeated rows count
each; ``doc_id`` and other columns are ignored; an empty table gives an empty result. Ties of scores go by count, then by
the bytes of the phrase; ties of cuts to the first. A very long text is worked off in tiles of ``TILE`` bytes that end
with a piece, so memory follows the longest piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import give_back, text_bytes
from ._store import read_table, save
from ._words import U, mix, runs, words

LONGEST = 5
LEAST = 100
SUBSUMED = 100  # per cent of a phrase's count that a longer one needs to take its place
TOP = 2000
ROWS = 2
LOAD = 32
NARROWEST, WIDEST = 1 << 16, 1 << 27
SLICE = 1 << 17  # cells that travel together
TILE = 1 << 20
SALTS = 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*b".,;:!?\x0b\x0c\x0d"]] = 0x0A
_FOLD[0x09] = 0x20


class Tile:
    """The words of some neighbouring rows, or of a stretch of one: hashes, places in ``data``, rows and pieces."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, langs: np.ndarray):
        w = words(data, rows)
        row = np.repeat(np.arange(len(rows) - 1), w.counts)
        self.data, self.begin, self.end = data, w.begin, w.end
        self.lang = langs[row]
        breaks = np.cumsum(data == 0x0A, dtype=np.int32)
        # pieces ascend within a row, rows within a tile: two words share both or neither
        self.piece = (breaks[w.begin] if len(w.begin) else breaks[:0]).astype(np.int64) + row
        self.hashes = w.hashes

    def keys(self, salts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length the first words of the runs within one piece and the runs' hashes, salted by language."""
        key = mix(self.hashes ^ salts[self.lang]) if len(self.hashes) else self.hashes
        yield 1, np.arange(len(key)), key
        for n in range(2, LONGEST + 1):
            size = len(self.hashes) - n + 1
            if size <= 0:
                return
            key = mix(key[:size] * U(0x9E3779B97F4A7C15) + self.hashes[n - 1 :])
            first = np.flatnonzero(self.piece[:size] == self.piece[n - 1 :])
            yield n, first, key[first]

    def texts(self, first: np.ndarray, last: np.ndarray, compact: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        at, size = begin[first], end[last] - begin[first]
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(size, out=offsets[1:])
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(compact[runs(at, size)]))

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words joined by one space each, and where they begin and end there."""
        size = self.end - self.begin
        end = np.cumsum(size + 1) - 1
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
        out[runs(end - size, size)] = self.data[runs(self.begin, size)]
        return out, end - size, end


def _tiles(batches) -> Iterator[tuple[Tile, list[str]]]:
    """Tiles of (text, lang) batches and the languages that their numbers stand for."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        coded = batch.column(1).dictionary_encode()
        names, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        d, rows = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        for x, y in _cuts(d, rows):
            a, b = int(np.searchsorted(rows, x, side="right")) - 1, int(np.searchsorted(rows, y, side="left"))
            yield Tile(_FOLD[d[x:y]], np.clip(rows[a : b + 1], x, y) - x, langs[a:b]), names
        give_back()


def _cuts(d: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``TILE`` bytes that end with a piece or a row."""
    x, n = 0, len(d)
    while x < n:
        y, z = x, x
        while y <= x:
            low, z = z, min(z + TILE, n)
            end = np.flatnonzero(_FOLD[d[low:z]] == 0x0A)
            edge = int(rows[np.searchsorted(rows, z, side="right") - 1])
            y = n if z == n else max(edge, low + int(end[-1]) + 1 if len(end) else 0)
        yield x, y
        x = y


def language_salts(names: list[str]) -> np.ndarray:
    """A number for each language, the same in every process."""
    found = []
    for name in names:
        x = U(len(name) + 1)
        for b in name.encode():
            x = mix(np.array([x ^ U(b + 1)], U))[0]
        found.append(x)
    return np.array(found, U)


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys + U((row + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) & U(width - 1)).astype(np.int64)


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
    )


def width_for(docs: DataFrame, load: int = LOAD, widest: int = WIDEST) -> int:
    """A power of two: the runs of all lengths, guessed from the bytes, over ``load``."""
    size = int(prepared(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    wanted = size * LONGEST // 8 // load
    return int(min(widest, max(NARROWEST, 1 << max(wanted - 1, 1).bit_length())))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(row, slice, cells binary): the merged sketch, a byte a cell."""
    each = min(SLICE, width)

    def run(batches):
        counted = np.zeros((ROWS, width), np.uint8)
        for tile, names in _tiles(batches):
            found = [key for _, _, key in tile.keys(language_salts(names))]
            keys = np.concatenate(found)
            for row in range(ROWS):
                at = cells(keys, row, width)
                at.sort()
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
                n, at = np.diff(np.append(first, len(at))), at[first]
                counted[row, at] = np.minimum(counted[row, at] + np.minimum(n, 255), 255)
        for row in range(ROWS):
            for k in range(0, width, each):
                part = counted[row, k : k + each]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([k // each]), pa.array([part.tobytes()])], names=["row", "slice", "cells"]
                    )

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(each, np.uint8)
        for x in table.column("cells"):
            total = np.minimum(total.astype(np.uint16) + np.frombuffer(x.as_buffer(), np.uint8), 255).astype(np.uint8)
        return pa.table({"row": table.column("row")[:1], "slice": table.column("slice")[:1], "cells": [total.tobytes()]})

    shares = prepared(docs).coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    form = "row long, slice long, cells binary"
    return shares.mapInArrow(run, form).groupBy("row", "slice").applyInArrow(merge, form)


def frequent_bits(merged: DataFrame, width: int, least: int) -> np.ndarray:
    """A bit for each cell of ``merged`` that reaches ``least``: at most ``ROWS * WIDEST / 8`` bytes, whatever the data."""

    def run(batches):
        for batch in batches:
            for row, part, x in zip(*(batch.column(k) for k in range(3)), strict=True):
                bits = np.packbits(np.frombuffer(x.as_buffer(), np.uint8) >= min(least, 255), bitorder="little")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row.as_py()]), pa.array([part.as_py()]), pa.array([bits.tobytes()])], names=["row", "slice", "cells"]
                )

    out = np.zeros((ROWS, max(width // 8, 1)), np.uint8)
    each = min(SLICE, width) // 8
    for x in merged.mapInArrow(run, "row long, slice long, cells binary").toLocalIterator():
        out[x["row"], x["slice"] * each : (x["slice"] + 1) * each] = np.frombuffer(x["cells"], np.uint8)
    return out


def survivors(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """(lang, words, phrase, f): counts by tile of the runs that may be frequent; a row without words has a
    language's number of words."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = sent.value
        for tile, names in _tiles(batches):
            compact = tile.compact()
            alive = None
            held = {"lang": [], "words": [], "phrase": [], "f": []}
            for n, first, key in tile.keys(language_salts(names)):
                if n == 1:
                    total = np.bincount(tile.lang, minlength=len(names))
                    some = np.flatnonzero(total)
                    held["lang"].append(pa.array(some.astype(np.int32)))
                    held["words"].append(np.zeros(len(some), np.int32))
                    held["phrase"].append(pa.array([""] * len(some), pa.string()))
                    held["f"].append(total[some])
                else:  # both runs one shorter have to be alive
                    both = alive[first] & alive[first + 1]
                    first, key = first[both], key[both]
                for row in range(ROWS):
                    at = cells(key, row, width)
                    there = (known[row, at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0
                    first, key = first[there], key[there]
                alive = np.zeros(len(tile.hashes) + 1, bool)
                alive[first] = True
                table = pa.table({"lang": pa.array(tile.lang[first].astype(np.int32)), "phrase": tile.texts(first, first + n - 1, *compact)})
                table = table.group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                if len(table):
                    held["lang"].append(table.column("lang").chunk(0))
                    held["words"].append(np.full(len(table), n, np.int32))
                    held["phrase"].append(table.column("phrase").chunk(0))
                    held["f"].append(table.column("count_all").to_numpy())
            if held["f"]:
                lang = pa.concat_arrays(held["lang"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.string()).take(lang),
                        pa.array(np.concatenate(held["words"])),
                        pa.concat_arrays(held["phrase"]),
                        pa.array(np.concatenate(held["f"]).astype(np.int64)),
                    ],
                    names=["lang", "words", "phrase", "f"],
                )

    return prepared(docs).mapInArrow(run, "lang string, words int, phrase string, f long")


def frequent(docs: DataFrame, least: int = LEAST, width: int | None = None) -> DataFrame:
    """(lang, words, phrase, f): all runs of one to five words with at least ``least`` occurrences, exactly counted, and
    for each language a row of no words that counts them all."""
    width = width or width_for(docs)
    bits = frequent_bits(save(sketch(docs, width), "phrase-sketch"), width, least)
    counted = survivors(docs, bits, width).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return save(counted.where((F.col("f") >= least) | (F.col("words") == 0)), "frequent-runs")


def scored(found: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among ``found`` (as ``frequent`` gives) that no longer one
    takes the place of. Counts below 10^18; integers throughout."""
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    part = lambda a, size: F.array_join(F.slice("w", F.lit(a) if isinstance(a, int) else a, size), " ")
    side = found.where("words > 0").select("lang", "phrase", "f")
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(1, F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(side.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(side.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    totals = F.broadcast(found.where("words = 0").select("lang", F.col("f").alias("n")))  # a row a language
    cuts = cuts.join(totals, "lang").withColumn("over", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")))
    cuts = cuts.withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    longer = candidates.where("words > 2").select(
        "lang", F.explode(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))).alias("phrase"), F.col("a").alias("longer")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {subsumed} * x.a"))
    return kept.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, width: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top``. No more than ``top`` rows of each of
    ``SALTS`` shares of a language meet in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = scored(frequent(docs, least, width)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    first = found.withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_phrases": op11_phrases}
ORACLES = {
    "op11_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
        ), totals AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
        runs AS (
            SELECT lang, size, array_to_string(ws[i + 1:i + size], ' ') AS phrase, count(*) AS f
            FROM (SELECT lang, ws, size, unnest(range(0, len(ws) - size + 1)) AS i
                  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(ws) >= size)
            GROUP BY ALL
        ), candidates AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM runs WHERE size > 1 AND f >= 100
        ), cuts AS (
            SELECT c.lang, c.phrase, c.size, a, k, x.f AS l, y.f AS r, n,
                   (1000::HUGEINT * a * n::HUGEINT) // (x.f::HUGEINT * y.f) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
            JOIN runs x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
            JOIN runs y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
            JOIN totals t ON t.lang = c.lang
        ), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (
            SELECT * FROM best b WHERE NOT EXISTS (
                SELECT 1 FROM candidates c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 100 * b.a
                AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
               CAST(score AS BIGINT) AS score
        FROM kept QUALIFY rank <= 2000
    """
}
