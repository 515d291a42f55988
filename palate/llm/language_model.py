"""Language-model scores by deleted interpolation of word n-grams.

The probability of a word w after h is a mixture of three estimates,

    l2 * c(h, w) / c(h)  +  l1 * c(w) / N  +  l0 * (c(w) + 0.1) / (N + 0.1 * (V + 1)),

whose weights depend on how often the context was seen (powers of two of c(h)). The weights are learned by
expectation-maximisation on counts held out for it: one ninth of the training documents, against estimates
from the others. The final estimates use all training documents.

Counting and looking up. Words are counted exactly; those above the count that leaves at most ``TABLE`` of them
go to all tasks as a table of bounded size. Everything else is asked for: a block of documents (at most
``BLOCK_BYTES`` of text, or one longer text) sends each distinct pair of neighbouring words, and each word
beyond the table, once, with how often it holds it. The questions meet by key, which gives the corpus's counts,
and go back to the blocks that need an answer: not to those that hold all there are themselves.
So no key gathers more rows than there are blocks, however common it is: a block asks some hundred thousand
questions, so that is far less than one in a hundred thousand of all rows, and Spark spills them.

A text longer than a block comes in pieces, cut after white space. A piece begins with the word before it, which
is only context there; the pieces' sums add up to the text's.

The scan is cut into the same blocks each time, so ``docs`` has to come from files or a saved table.

Defined results: null and empty texts are their end token; repeated rows count and are scored each; documents
without training rows score 0 per token; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import give_back, slices, text_bytes
from ._store import pin_splits, read_table, release, save
from ._words import U, mix, padded, tiles, words

FOLDS, EM_FOLD = 10, 1
TABLE = 1 << 20
BLOCK_BYTES = 6 << 20
ALPHA = 0.1
START, END = int(mix(np.array([11], U))[0]), int(mix(np.array([13], U))[0])
BUCKETS = 24
STEPS_PER_OCTAVE = 4
CHUNK = 1 << 16  # tokens whose intermediate values are in memory at once
EM_ROUNDS = 60
_RARE_WORD, _RARE_PAIR = U(1 << 62), U(1 << 63)


def folded(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fold, row)"""
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        number.cast("int").alias("fold"),
        F.monotonically_increasing_id().alias("row"),
    )


class Block:
    """The tokens of some rows: word hashes with an end token after each row's. Of a piece of one row: ``before`` is
    the hash of the word before it, a token that counts for nothing, and there is no end unless it is the last."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray, before: int | None = None, ended: bool = True):
        w = words(data, offsets, lower=True)
        self.hashes, self.first = padded(w.hashes, w.counts, int(ended), END)
        self.counts, self.context = w.counts + int(ended), int(before is not None)
        if self.context:
            self.hashes = np.concatenate([np.array([before], np.int64).view(U), self.hashes])
            self.counts = self.counts + 1
        self.before = np.empty_like(self.hashes)
        self.before[1:] = self.hashes[:-1]
        self.before[self.first] = START
        self.train = np.repeat(fold != 0, self.counts)
        self.em = np.repeat(fold == EM_FOLD, self.counts)
        self.train[: self.context] = self.em[: self.context] = False


def blocks(batches, limit: int) -> Iterator[tuple[int, pa.RecordBatch, int, int, tuple]]:
    """The blocks of a partition, the same for every scan of the same rows: number, batch, its rows from and to, and
    what makes the block."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        fold = batch.column(2).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets, limit):
            for x, y, before, ended in _pieces(data, offsets[a : b + 1], limit):
                cuts = offsets[a : b + 1] if b > a + 1 else np.array([x, y])
                yield (part << 24) + number, batch, a, b, (data, cuts, fold[a:b], before, ended)
                give_back()
                number += 1


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, int | None, bool]]:
    """The bytes of some rows, or in turn those of the pieces of one long row."""
    begin, end = int(offsets[0]), int(offsets[-1])
    if end - begin <= limit or len(offsets) > 2:
        yield begin, end, None, True
        return
    before = None
    for x, y in tiles(data[begin:end], np.array([0, end - begin]), limit):
        last = y == end - begin
        w = words(data, np.array([begin + x, begin + y]), lower=True)
        if last or len(w.hashes):  # white space alone is no piece
            yield begin + x, begin + y, before, last
        if len(w.hashes):
            before = int(w.hashes[-1:].view(np.int64)[0])


def totals(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, the sums of their weights, and where each stood first."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else order
    sums = [np.add.reduceat(w[order].astype(np.int64), at) if len(keys) else w[:0].astype(np.int64) for w in weights]
    return (ordered[at], *sums, order[at])


def word_counts(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(w, c, e): how often training documents hold each word, and how often those held out for the weights."""

    def run(batches):
        for *_, given in blocks(batches, limit):
            block = Block(*given)
            w, c, e, _ = totals(block.hashes, block.train, block.em)
            some = c > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(w[some].view(np.int64)), pa.array(c[some]), pa.array(e[some])], names=["w", "c", "e"]
            )
            del block, w, c, e, some

    return (
        folded(docs).mapInArrow(run, "w long, c long, e long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    )


class Table:
    """The most frequent words: hashes in ascending order and their counts."""

    def __init__(self, w: np.ndarray, c: np.ndarray, e: np.ndarray):
        order = np.argsort(w)
        self.w, self.c, self.e = w[order], c[order], e[order]
        self.by_number = np.argsort(-self.c, kind="stable").astype(np.int32)
        self.number = np.empty_like(self.by_number)  # by falling count: frequent words have small numbers
        self.number[self.by_number] = np.arange(len(w), dtype=np.int32)

    def light(self) -> Table:
        """Without what only the held-out counts need: the copy that goes to every worker."""
        out = object.__new__(Table)
        out.w, out.c, out.number = self.w, self.c, self.number
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and whether the words are there."""
        at, there = np.zeros(len(hashes), np.int32), np.zeros(len(hashes), bool)
        for a in range(0, len(hashes) if len(self.w) else 0, CHUNK):
            z = slice(a, a + CHUNK)
            at[z] = np.minimum(np.searchsorted(self.w, hashes[z]), len(self.w) - 1)
            there[z] = self.w[at[z]] == hashes[z]
        return at, there


def frequent(counts: DataFrame, most: int) -> Table:
    """The words of the smallest count that leaves at most ``most`` of them (ties all in or all out)."""
    sizes = counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).limit(most).toPandas()
    fits = sizes["words"].cumsum() <= most
    least = int(sizes["c"][fits].min()) if fits.any() else 1 << 62
    found = counts.where(F.col("c") >= least).toArrow()
    w, c, e = (found.column(k).to_numpy() for k in ("w", "c", "e"))
    w = w.view(U)
    ends = c[w == U(END)], e[w == U(END)]  # a document begins as often as one ends
    if len(ends[0]):
        w, c, e = np.append(w, U(START)), np.append(c, ends[0]), np.append(e, ends[1])
    return Table(w, c, e)


def pair_keys(table: Table, block: Block) -> tuple[np.ndarray, ...]:
    """Each token's pair key; places of h and w in the table and whether they are there."""
    at_w, has_w = table.find(block.hashes)
    at_h, has_h = np.empty_like(at_w), np.empty_like(has_w)
    at_h[1:], has_h[1:] = at_w[:-1], has_w[:-1]
    start, known = table.find(np.array([START], U))
    at_h[block.first], has_h[block.first] = start[0], known[0]
    keys = np.empty(len(at_w), U)
    for a in range(0, len(keys), CHUNK):
        z = slice(a, a + CHUNK)
        keys[z] = mix(block.before[z] * U(0x9E3779B97F4A7C15) + block.hashes[z]) >> U(2) | _RARE_PAIR
        near = np.flatnonzero(has_w[z] & has_h[z])
        if len(near):
            h, w = table.number[at_h[z][near]].astype(U), table.number[at_w[z][near]].astype(U)
            keys[z][near] = h << U(20) | w
    return keys, at_h, has_h, at_w, has_w


def questions(docs: DataFrame, table: Table, limit: int = BLOCK_BYTES) -> DataFrame:
    """(k, p, ce, hw): each block's distinct pairs and rare words, with its own training counts (c << 32 | e); where some
    of those are held out and the key does not name the words, hw holds their hashes. Rows are few numbers, since there
    are nearly as many as tokens."""
    table = table.light()

    def run(batches):
        for p, *_, given in blocks(batches, limit):
            block = Block(*given)
            keys, _, has_h, _, has_w = pair_keys(table, block)
            k, c, e, at = totals(keys, block.train, block.em)
            rare = np.flatnonzero(~has_w)
            k1, c1, e1, at1 = totals(block.hashes[rare] >> U(2) | _RARE_WORD, block.train[rare], block.em[rare])
            named = ~(has_h & has_w)[at]
            columns = [
                np.concatenate(x)
                for x in (
                    (k.view(np.int64), k1.view(np.int64)),
                    (c << 32 | e, c1 << 32 | e1),
                    (block.before[at].view(np.int64), k1.view(np.int64)),
                    (block.hashes[at].view(np.int64), k1.view(np.int64)),
                    (~named | (e == 0), np.ones(len(k1), bool)),
                )
            ]
            del block, keys, has_h, has_w, k, c, e, at, k1, c1, e1, at1, rare, named
            for a in range(0, len(columns[0]), CHUNK):
                key, ce, h, w, hide = (x[a : a + CHUNK] for x in columns)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(np.full(len(key), p, np.int64)),
                        pa.array(ce),
                        pa.StructArray.from_arrays([pa.array(h), pa.array(w)], ["h", "w"], mask=pa.array(hide)),
                    ],
                    names=["k", "p", "ce", "hw"],
                )
            del columns

    return folded(docs).mapInArrow(run, "k long, p long, ce long, hw struct<h: long, w: long>")


def answers(asked: DataFrame) -> DataFrame:
    """(k, p, total, held, first, h, w): the corpus's counts of what each block asked for. Left out are keys that
    training holds in this block only, or not at all; ``first`` marks one row of each key that has held-out counts."""
    w = Window.partitionBy("k")
    c, e = F.shiftright("ce", 32), F.col("ce").bitwiseAND((1 << 32) - 1)
    asked = asked.repartition("k").select("k", "p", c.alias("c"), e.alias("e"), "hw")
    first = F.col("p") == F.min(F.when(F.col("e") > 0, F.col("p"))).over(w)
    told = asked.select(
        "*", F.sum("c").over(w).alias("total"), F.sum("e").over(w).alias("held"), F.coalesce(first, F.lit(False)).alias("first")
    )
    useful = F.col("total") != F.col("c")
    return told.where(useful | F.col("first")).select("k", "p", "total", "held", "first", "hw.h", "hw.w")


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count)), at most BUCKETS - 1."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def estimates(pair, context, word, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return p2, word / max(n, 1), (word + ALPHA) / (n + ALPHA * (v + 1))


def _held_out(answered: DataFrame, counts: DataFrame, table: Table, n: int, v: int) -> dict[tuple[int, int, int], float]:
    """Held-out pairs by (bucket, step of p2 / p0, step of p1 / p0): a histogram of bounded size."""

    def cells(pair, context, word, held):
        p2, p1, p0 = estimates(pair, context, word, n, v)
        with np.errstate(divide="ignore"):
            q2, q1 = (np.where(x > 0, np.rint(np.log2(np.maximum(x, 1e-300) / p0) * STEPS_PER_OCTAVE), -999) for x in (p2, p1))
        key = (bucket(context) * 4096 + (q2 + 1024).clip(0, 4095).astype(np.int64)) * 4096 + (q1 + 1024).clip(0, 4095).astype(np.int64)
        k, c, _ = totals(key.astype(U), held)
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["cell", "held"])

    def known(batches):
        for b in batches:
            k, total, held = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            h, w = table.by_number[k >> 20], table.by_number[k & ((1 << 20) - 1)]
            yield cells(total - held, table.c[h] - table.e[h], table.c[w] - table.e[w], held)

    def others(batches):
        for b in batches:
            total, held, ch, cw = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            yield cells(total - held, ch, cw, held)

    once = answered.where("first")
    near = once.where("k >= 0 AND k < 1099511627776")
    near = near.select("k", "total", "held").mapInArrow(known, "cell long, held long")
    far = once.where("h IS NOT NULL")
    left = counts.select(F.col("w").alias("h"), (F.col("c") - F.col("e")).alias("ch"))
    right = counts.select("w", (F.col("c") - F.col("e")).alias("cw"))
    begin = F.lit(np.uint64(START).astype(np.int64).item())
    end = F.lit(np.uint64(END).astype(np.int64).item())
    far = far.withColumn("h", F.when(F.col("h") == begin, end).otherwise(F.col("h")))  # as often as the end
    far = far.join(left, "h", "left").join(right, "w", "left").select("total", "held", F.coalesce("ch", F.lit(0)).alias("ch"), F.coalesce("cw", F.lit(0)).alias("cw"))
    far = far.mapInArrow(others, "cell long, held long")
    rows = near.union(far).groupBy("cell").agg(F.sum("held").alias("held")).collect()
    return {(r.cell >> 24, (r.cell >> 12 & 4095) - 1024, (r.cell & 4095) - 1024): float(r.held) for r in rows}


def mixture_weights(held: dict[tuple[int, int, int], float], rounds: int = EM_ROUNDS) -> np.ndarray:
    """(BUCKETS, 3) weights of p2, p1, p0 by expectation-maximisation; buckets without data take the next
    smaller one's. The smoothed estimate keeps a little weight, so no word is impossible."""
    out = np.zeros((BUCKETS, 3))
    out[:] = (0.0, 0.0, 1.0)
    for b in range(BUCKETS):
        cells = [(q2, q1, c) for (own, q2, q1), c in held.items() if own == b]
        if not cells:
            if b > 1:
                out[b] = out[b - 1]
            continue
        q2, q1, c = (np.array(x, float) for x in zip(*cells, strict=True))
        ratio = np.stack(
            [np.where(q2 <= -999, 0, 2 ** (q2 / STEPS_PER_OCTAVE)), np.where(q1 <= -999, 0, 2 ** (q1 / STEPS_PER_OCTAVE)), np.ones(len(c))], 1
        )
        own = np.full(3, 1 / 3) if b else np.array([0, 0.5, 0.5])
        for _ in range(rounds):
            part = ratio * own
            own = (c[:, None] * part / part.sum(1, keepdims=True)).sum(0) / c.sum()
        own[2] = max(own[2], 1e-4)
        out[b] = own / own.sum()
    return out


class Model:
    def __init__(self, table: Table, weights: np.ndarray, n: int, v: int):
        self.table, self.weights, self.n, self.v = table, weights, n, v

    def rows(self, block: Block, k: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of a block's rows, given its answers (ascending keys)."""
        table = self.table
        keys, _, _, at_w, has_w = pair_keys(table, block)
        word = np.zeros(len(keys), np.int64)
        word[has_w] = table.c[at_w[has_w]]
        rare = np.flatnonzero(~has_w)
        word[rare] = _look_up(block.hashes[rare] >> U(2) | _RARE_WORD, block.train[rare], k, total)
        del at_w, has_w, rare
        context = np.empty_like(word)
        context[1:] = word[:-1]
        start, known = table.find(np.array([START], U))
        context[block.first] = table.c[start[0]] if known[0] else self._ends(block, k, total)
        pair = _look_up(keys, block.train, k, total)
        del keys
        base, mixed = np.empty(len(word)), np.empty(len(word))
        for a in range(0, len(word), CHUNK):
            z = slice(a, a + CHUNK)
            p = estimates(pair[z], context[z], word[z], self.n, self.v)
            base[z] = np.log10(p[2])
            mixed[z] = np.log10((self.weights[bucket(context[z])] * np.stack(p, 1)).sum(1))
        known = (word > 0).astype(np.int64)
        own = slice(0, block.context)  # the word before a piece
        known[own] = base[own] = mixed[own] = 0
        add = lambda x: np.add.reduceat(x, block.first)
        return block.counts - block.context, add(known), add(base), add(mixed)

    @staticmethod
    def _ends(block: Block, k: np.ndarray, total: np.ndarray) -> int:
        key = np.array([END], U) >> U(2) | _RARE_WORD
        own = int(block.train[block.first].sum())
        at = np.searchsorted(k, key)[0]
        return int(total[at]) if at < len(k) and k[at] == key[0] else own


def _look_up(keys: np.ndarray, train: np.ndarray, k: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The corpus's counts of ``keys``: as answered, or else this block's own."""
    distinct, index = np.unique(keys, return_inverse=True)
    index = index.astype(np.int32)
    count = np.bincount(index[train], minlength=len(distinct))
    if len(k):
        at = np.minimum(np.searchsorted(k, distinct), len(k) - 1)
        there = k[at] == distinct
        count[there] = total[at[there]]
    return count[index]


def learn(docs: DataFrame, limit: int = BLOCK_BYTES) -> tuple[Model, DataFrame]:
    """The model, and the answers (k, p, total, ...) to each block's questions."""
    spark = docs.sparkSession
    counts = save(word_counts(docs, limit), "word-counts")
    release(spark)
    size = counts.agg(F.sum("c"), F.count("*"), F.sum("e"), F.sum(F.when(F.col("c") > F.col("e"), 1))).first()
    n, v, held, main_v = (int(x or 0) for x in size)
    table = frequent(counts, TABLE - 1)
    answered = save(answers(questions(docs, table, limit)), "answers")
    release(spark)
    weights = mixture_weights(_held_out(answered, counts, table, n - held, main_v))
    return Model(table, weights, n, v), answered


_SCORES_ARROW = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("fold", pa.int32()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
SCORES = "row long, doc_id long, fold int, n_tokens long, n_known long, base_score double, score double"


def scored(docs: DataFrame, limit: int = BLOCK_BYTES) -> tuple[DataFrame, Model]:
    """(doc_id, fold, n_tokens, n_known, base_score, score) of every row, and the model."""
    pin_splits(docs.sparkSession)
    full, answered = learn(docs, limit)
    model = Model(full.table.light(), full.weights, full.n, full.v)

    def numbered(batches):
        for p, batch, a, b, (data, cuts, _, before, ended) in blocks(batches, limit):
            n, rows = b - a, batch.slice(a, b - a)
            text = rows.column(1) if n > 1 or (before is None and ended) else pa.array([data[cuts[0] : cuts[1]].tobytes()]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p] * n, pa.int64()),
                    rows.column(3),
                    rows.column(0),
                    rows.column(2),
                    text,
                    pa.array([before] * n, pa.int64()),
                    pa.array([ended] * n),
                ],
                names=["p", "row", "doc_id", "fold", "text", "before", "ended"],
            )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({f.name: pa.array([], f.type) for f in _SCORES_ARROW}, schema=_SCORES_ARROW)
        text = left.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        data, offsets = text_bytes(text)
        before, ended = left.column("before")[0].as_py(), left.column("ended")[0].as_py()
        block = Block(data, offsets, left.column("fold").to_numpy(), before, ended)
        k = right.column("k").to_numpy().view(U)
        total = right.column("total").to_numpy()
        order = np.argsort(k)
        k, total = k[order], total[order]
        del order
        found = model.rows(block, k, total)
        out = [left.column(c) for c in ("row", "doc_id", "fold")]
        del block, k, total, left, right, text, data
        give_back()
        return pa.table([*out, *(pa.array(x) for x in found)], schema=_SCORES_ARROW)

    kept = "p long, row long, doc_id long, fold int, text string, before long, ended boolean"
    rows = folded(docs).mapInArrow(numbered, kept)
    told = answered.select("p", "k", "total")
    pieces = rows.groupBy("p").cogroup(told.groupBy("p")).applyInArrow(run, SCORES)
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    ids = [F.first(c).alias(c) for c in ("doc_id", "fold")]
    return pieces.groupBy("row").agg(*ids, *sums).drop("row"), full


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model = scored(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        (F.col("fold") == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op7_language_model": op7_language_model}
ORACLES: dict[str, str] = {}
