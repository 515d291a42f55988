"""Quality classifier: a byte-level convolutional network in numpy.

A text is a row of symbols, one per byte: the byte itself and one bit that says whether the ``GRAM`` bytes
beginning there also began at most ``LAGS`` bytes earlier. ``FILTERS`` learned filters, each ``WIDTH`` symbols wide, slide over
the whole text, a byte at a time. The text is cut into chunks of ``CHUNK`` positions whose windows reach into
the next chunk, so every byte of every text is seen (a last chunk that is not full
ends in pads, which weigh nothing); each chunk keeps the maximum of each filter. The mean and
the maximum over a text's chunks go into one logistic unit: the probability that the text's label is 1.

The fit is plain gradient descent (Adam) through the maxima, with fixed seed and number of steps, in one task,
over a bounded sample of labelled rows: ``SAMPLE_ROWS`` rows of at most ``SAMPLE_BYTES`` bytes, by hash of
their id. Scoring reads every byte of every row.

Defined results: null and empty texts get the score of no evidence at all; labels other than 0 and 1 are no
labels; without any label of both kinds every score is the mean label (0.5 without labels); repeated rows are
scored alike; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import SLICE_BYTES, slices, text_bytes
from ._store import free_name, in_fold, read_table, with_text

WIDTH, FILTERS, CHUNK, GRAM, LAGS = 6, 16, 256, 6, 48
PAD = 512
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 32_768
STEPS, BATCH, RATE, DECAY = 600, 32, 0.01, 2e-4
HELD_OUT_FOLDS = 5
THRESHOLD = 0.3

Model = dict[str, np.ndarray]


def symbols(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols with ``LAGS`` pads after each text, and where each text begins there.

    So many pads that no text's forerunners can lie in the text before.
    """
    size = end - begin
    first = np.cumsum(size + LAGS) - size - LAGS
    out = np.full(int(size.sum()) + LAGS * len(size), PAD, np.int16)
    place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[place] = data[begin[0] : end[-1]] if len(size) else data[:0]
    n = max(0, len(out) - GRAM + 1)
    gram = out[:n].astype(np.uint64)
    for k in range(1, GRAM):  # symbols below 1024: ten bits each
        gram = gram << np.uint64(10) | out[k : n + k].astype(np.uint64)
    seen = np.zeros(n, bool)
    for lag in range(1, min(LAGS, n - 1) + 1):
        seen[lag:] |= gram[lag:] == gram[:-lag]
    pads = np.concatenate([[0], np.cumsum(out == PAD)])
    seen &= pads[GRAM:] == pads[:-GRAM] if n else seen  # a gram with a pad is no evidence
    out[:n][seen] += 256
    return out, first


def chunk_maxima(model: Model, syms: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's maximum of each filter, and the n + 1 offsets of each text's chunks."""
    parts = np.maximum(1, -(-size // CHUNK))
    at = np.concatenate([[0], np.cumsum(parts)])
    starts = np.repeat(first, parts) + CHUNK * (np.arange(at[-1]) - np.repeat(at[:-1], parts))
    ends = np.minimum(starts + CHUNK, np.repeat(first + size + 1, parts))
    n = len(syms) - WIDTH + 1
    act = np.take(model["filters"][0], syms[:n], axis=0)
    for k in range(1, WIDTH):
        act += np.take(model["filters"][k], syms[k : n + k], axis=0)
    return np.maximum.reduceat(act, np.stack([starts, ends], 1).ravel(), axis=0)[::2], at


def long_maxima(model: Model, text: np.ndarray) -> np.ndarray:
    """The chunk maxima of one long text, a tile of whole chunks at a time with what its windows look back and
    reach ahead for."""
    found = []
    for x in range(0, len(text), SLICE_BYTES):
        y, back = min(x + SLICE_BYTES, len(text)), min(LAGS, x)
        part = text[x - back : y + WIDTH + GRAM]
        syms, _ = symbols(part, np.array([0]), np.array([len(part)]))
        found.append(chunk_maxima(model, syms, np.array([back]), np.array([y - x]))[0])
    return np.concatenate(found)


def combine(model: Model, maxima: np.ndarray, at: np.ndarray) -> np.ndarray:
    hidden = np.maximum(maxima + model["bias"], 0)
    mean = np.add.reduceat(hidden, at[:-1], axis=0) / np.diff(at)[:, None]
    top = np.maximum.reduceat(hidden, at[:-1], axis=0)
    z = mean @ model["mean"] + top @ model["top"] + model["rest"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    if "flat" in model:
        return np.full(len(offsets) - 1, float(model["rest"][0]))
    out = np.zeros(len(offsets) - 1)
    for a, b in slices(offsets):
        if offsets[b] - offsets[a] > SLICE_BYTES:
            maxima = long_maxima(model, data[offsets[a] : offsets[b]])
            at = np.array([0, len(maxima)])
        else:
            syms, first = symbols(data, offsets[a:b], offsets[a + 1 : b + 1])
            maxima, at = chunk_maxima(model, syms, first, np.diff(offsets[a : b + 1]))
        out[a:b] = combine(model, maxima, at)
    return out


def _chunks(text: bytes) -> np.ndarray:
    """The chunks of one text, each with the symbols its last windows reach into."""
    data = np.frombuffer(text, np.uint8)
    syms, _ = symbols(data, np.array([0]), np.array([len(data)]))
    n = max(1, -(-len(data) // CHUNK))
    full = np.full(n * CHUNK + WIDTH - 1, PAD, np.int16)
    full[: len(data)] = syms[: len(data)]
    return np.lib.stride_tricks.sliding_window_view(full, CHUNK + WIDTH - 1)[::CHUNK].copy()


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Model:
    if len(set(labels.tolist())) < 2:
        return {"flat": np.ones(1), "rest": np.array([labels.mean() if len(labels) else 0.5])}
    rng = np.random.default_rng(seed)
    model: Model = {
        "filters": rng.normal(0, 0.15, (WIDTH, PAD + 1, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "mean": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "top": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "rest": np.array([np.log(labels.mean() / (1 - labels.mean()))], np.float32),
    }
    model["filters"][:, PAD] = 0
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    chunks = [_chunks(t) for t in texts]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(texts))])
        picked, order = order[:BATCH], order[BATCH:]
        for name, g in _gradient(model, [chunks[i] for i in picked], labels[picked]).items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.001 * (g * g - second[name])
            rate = RATE * (1 - 0.9 * step / steps)
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-6)
            model[name] -= (rate * (move + DECAY * model[name])).astype(np.float32)
    return model


def _gradient(model: Model, texts: list[np.ndarray], labels: np.ndarray) -> Model:
    syms = np.concatenate(texts)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    filters = model["filters"]
    act = np.take(filters[0], syms[:, :CHUNK], axis=0)
    for k in range(1, WIDTH):
        act += np.take(filters[k], syms[:, k : k + CHUNK], axis=0)
    best = act.argmax(axis=1)
    maxima = np.take_along_axis(act, best[:, None, :], axis=1)[:, 0]
    hidden = np.maximum(maxima + model["bias"], 0)
    sizes = np.diff(at)
    mean = np.add.reduceat(hidden, at[:-1], axis=0) / sizes[:, None]
    top = np.maximum.reduceat(hidden, at[:-1], axis=0)
    z = mean @ model["mean"] + top @ model["top"] + model["rest"]
    dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels).astype(np.float32) / len(labels)
    dhidden = np.repeat(dz[:, None] * model["mean"] / sizes[:, None], sizes, axis=0)
    highest = hidden == np.repeat(top, sizes, axis=0)
    ties = np.add.reduceat(highest.astype(np.float32), at[:-1], axis=0)  # equal chunks share what the top gets
    dhidden += np.where(highest, np.repeat(dz[:, None] * model["top"] / ties, sizes, axis=0), 0)
    dact = np.where(maxima + model["bias"] > 0, dhidden, 0)
    dfilters = np.zeros_like(filters)
    rows, columns = np.arange(len(syms))[:, None], np.arange(FILTERS)[None, :]
    for k in range(WIDTH):
        np.add.at(dfilters[k], (syms[rows, best + k], columns), dact)
    dfilters[:, PAD] = 0
    return {
        "filters": dfilters,
        "bias": dact.sum(0),
        "mean": mean.T @ dz,
        "top": top.T @ dz,
        "rest": np.array([dz.sum()], np.float32),
    }


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The labelled rows to learn from, as (doc_id, text, label): outside the held-out fold, at most ``rows``."""
    usable = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), HELD_OUT_FOLDS))
        .groupBy(F.col("doc_id").alias("labelled"))
        .agg(F.min("quality").alias("label"))
    )
    picked = usable.orderBy(F.xxhash64("labelled"), "labelled").limit(rows)  # at most ``rows`` ids: small
    fitting = with_text(docs.select(F.col("doc_id").cast("long"), "text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    found = fitting.join(F.broadcast(picked), F.col("doc_id") == F.col("labelled"))
    return found.select("doc_id", "text", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)


def learn(docs: DataFrame, labels: DataFrame, steps: int = STEPS) -> Model:
    """The model, fitted in one task; only its weights come to the driver."""

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1]))
        model = fit([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows], np.float64), steps)
        out = io.BytesIO()
        np.savez(out, **model)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    found = sample(docs, labels).repartition(1).mapInArrow(run, "model binary").collect()
    if not found:
        return fit([], np.zeros(0))
    return dict(np.load(io.BytesIO(found[0].model)))


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``, the score; other columns stay (one of that name is replaced)."""
    kept = [c for c in docs.columns if c != into]
    schema = docs.select(*kept).withColumn(into, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            score = pa.array(scores(model, batch.column(names.index("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*names, into])

    return docs.select(*kept).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose texts score at least ``threshold``, all columns unchanged, whatever their names."""
    into = free_name(docs, "score")
    return scored(docs, model, into).where(F.col(into) >= threshold).select(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_text(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        in_fold(F.col("doc_id"), HELD_OUT_FOLDS).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
