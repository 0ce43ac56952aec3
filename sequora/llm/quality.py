"""Quality classifier: random-indexing vectors pooled per document, then a small network.

Every word falls into one of 32 768 hash buckets and every word shape (runs of upper case,
lower case, digits and each punctuation mark, and a mark for a word that repeats the one
before it) into one of 1 024. A bucket's index vector is sparse and ternary, drawn from its
number. A word's vector adds up the index vectors of its neighbours (two on either side) over
the fitting sample, scaled to unit length, plus its own index vector. A document is the mean
of its word vectors beside the mean of its shapes' index vectors. A two-layer network in numpy
gives a logit, and a temperature fitted on a fifth of the sample makes it a probability.

Fitting uses at most ``most_rows`` (8 000) labelled rows outside the held-out fold, those of
the smallest hash of their id; that bound is the only sample. The rows are found by a
broadcast of those ids, so no text is shuffled for it but the sample's, and their vectors are
summed in four tasks whose size is fixed by the number of buckets. Scoring reads each text
once, whole, and shuffles nothing.

Defined cases: null and empty texts have the zero vector and get its score; unlabelled rows
and null labels are not learned from; rows of one id with several labels count as the largest
label; with no labels at all, or one class only, every score is that class's share (0.5 if
none); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, documents, id_fold, settle, span_hashes, text_bytes, word_spans

_POWERS = Powers(0x2545F4914F6CDD1D)
WORDS, SHAPES, SIZE, NEAR = 1 << 15, 1 << 10, 64, 2
_KIND = np.arange(256, dtype=np.uint8)
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:256] = 1, 2, 3, 3
_KIND[0xC3] = 3


def index_vectors(rows: int, seed: int, size: int = SIZE, marks: int = 8) -> np.ndarray:
    """Sparse ternary vectors: ``marks`` places of each row hold +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, size), np.float32)
    places = rng.permuted(np.tile(np.arange(size), (rows, 1)), axis=1)[:, :marks]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (rows, marks)), axis=1)
    return out


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets and shape buckets of a text, in order."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = span_hashes(raw, starts, ends, _POWERS)
    kind = _KIND[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] < 0x9F))  # Latin-1 capitals
    kind[upper], kind[upper + 1] = 2, 2
    begin = np.zeros(len(raw) + 1, bool)
    begin[starts], begin[ends] = True, True
    run = begin[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(run)
    shapes = span_hashes(kind[at], np.searchsorted(at, starts), np.searchsorted(at, ends), _POWERS)
    shape = (shapes >> np.uint64(54)).astype(np.int64)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    shape[again] = SHAPES - 1
    return (words >> np.uint64(49)).astype(np.int64), shape


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def vector(self, data: bytes) -> np.ndarray:
        words, shapes = tokens(data)
        if not len(words):
            return np.zeros(2 * SIZE, np.float32)
        total = np.zeros(SIZE)
        for at in range(0, len(words), 1 << 16):
            total += self.words[words[at : at + (1 << 16)]].sum(axis=0)
        counts = np.bincount(shapes, minlength=SHAPES)
        return np.concatenate([total / len(words), counts @ self.shapes / len(words)]).astype(np.float32)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(vectors), self.constant)
        logits = _logits(self.layers, (vectors - self.mean) / self.spread)[0]
        # rounded, as products of matrices may differ in the last digits with the rows of a batch
        return np.round(1.0 / (1.0 + np.exp(-np.clip(logits / self.temperature, -40, 40))), 9)


def _logits(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden @ layers[2] + layers[3], hidden


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 0) -> list[np.ndarray]:
    """Two layers, log loss with both classes weighed alike, Adam."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(())]
    first, second, t = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            part = order[at : at + 256]
            logit, h = _logits(layers, x[part])
            d = (1 / (1 + np.exp(-logit)) - y[part]) / len(part)
            back = np.outer(d, layers[2]) * (1 - h * h)
            grads = [x[part].T @ back + decay * layers[0], back.sum(axis=0), h.T @ d + decay * layers[2], d.sum()]
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return layers


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits of the least log loss."""
    grid = np.geomspace(0.25, 8.0, 61)
    losses = [np.logaddexp(0, np.where(y > 0.5, -logits, logits) / t).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, folds: int = 5, held_out: int = 0, id_column: str = "doc_id", text_column: str = "text", label_id: str = "doc_id") -> DataFrame:
    """(doc_id, t bytes, y): at most ``most_rows`` labelled rows outside the held-out fold."""
    usable = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull() & (id_fold(F.col(label_id), folds) != held_out))
    each = usable.groupBy(F.col(label_id).alias("__lid")).agg(F.max(label).cast("int").alias("y"))
    chosen = each.orderBy(F.xxhash64("__lid"), "__lid").limit(most_rows)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("t"))
    return rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["__lid"]).select("doc_id", "t", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 8000, seed: int = 7, **options) -> Model:
    sample = settle(labelled_sample(docs, labels, label, most_rows, **options).repartition(4, "doc_id"))
    index, shapes = index_vectors(WORDS, seed), index_vectors(SHAPES, seed + 1)
    near = docs.sparkSession.sparkContext.broadcast(index)

    def contexts(batches):
        places = np.nonzero(near.value)[1].reshape(WORDS, -1)
        signs = np.take_along_axis(near.value, places, axis=1)
        total = np.zeros(WORDS * SIZE)
        words_, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add() -> None:
            w, o = np.concatenate(words_), np.concatenate(others)
            for at in range(0, len(w), 1 << 17):
                part, other = w[at : at + (1 << 17)], o[at : at + (1 << 17)]
                total[:] += np.bincount((part[:, None] * SIZE + places[other]).ravel(), signs[other].ravel(), WORDS * SIZE)
            del words_[1:], others[1:]

        for batch in batches:
            for text in batch.column(0):
                words, _ = tokens(text.as_py() or b"")
                for gap in range(1, NEAR + 1):
                    words_ += [words[:-gap], words[gap:]]
                    others += [words[gap:], words[:-gap]]
                if sum(map(len, words_)) >= 1 << 17:
                    add()
        add()
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["sums"])

    def summed(batches):
        total = np.zeros(WORDS * SIZE, np.float32)
        for batch in batches:
            for table in batch.column(0):
                total += np.frombuffer(table.as_buffer(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # four tasks at any size, each with a table of fixed size; one task adds them up for the driver
    tables = sample.select("t").coalesce(4).mapInArrow(contexts, "sums binary").repartition(1).mapInArrow(summed, "sums binary")
    sums = np.frombuffer(tables.first()["sums"], np.float32).reshape(WORDS, SIZE)
    near.destroy()
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    words = (sums / np.maximum(norm, 1e-9) + index / np.sqrt(8.0)).astype(np.float32)
    model = Model(words, shapes, np.zeros(2 * SIZE, np.float32), np.ones(2 * SIZE, np.float32), [], 1.0)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches):
        for batch in batches:
            made = [spread.value.vector(t.as_py() or b"").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["doc_id", "v", "y"])

    rows = sample.select("doc_id", "t", "y").mapInArrow(vectors, "doc_id long, v binary, y int").toPandas().sort_values(["doc_id", "v"])
    spread.destroy()
    if rows["y"].nunique() < 2:
        model.constant = float(rows["y"].mean()) if len(rows) else 0.5
        return model
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["v"]])
    y = rows["y"].to_numpy(np.float64)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    scaled = (x - model.mean) / model.spread
    last = (pd.util.hash_array(rows["doc_id"].to_numpy()) % 5 == 4) if len(rows) >= 50 else np.zeros(len(rows), bool)
    if len(set(y[~last])) < 2:
        last[:] = False
    model.layers = train(scaled[~last], y[~last])
    if last.any():
        model.temperature = temperature(_logits(model.layers, scaled[last])[0], y[last])
    return model


def scores(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.stack([spread.value.vector(t.as_py() or b"") for t in part.column(1)])
                s = spread.value.score(x)
                predicted = pa.array((s >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s.astype(np.float64)), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("t"), (id_fold(F.col(id_column), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Only the text goes to Python; the other columns stay where they are.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=np.float64)
        return pd.Series(spread.value.score(np.stack([spread.value.vector(bytes(t)) if t is not None else np.zeros(2 * SIZE, np.float32) for t in texts])))

    return docs.where(score(text_bytes(text_column)) >= threshold)
