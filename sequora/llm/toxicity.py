"""Toxicity: a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel of two words counts the letter triples that both hold in order, gaps allowed; a
triple that spans g extra letters weighs ``decay`` to the power g in either word, and the
kernel is normalised to 1 for equal words. So a word with letters inserted stays close to the
word itself. Marks and digits inside a word are dropped first, and letters set apart by
spaces are read as one word. Landmarks are words of the fitting sample that are far commoner
in toxic texts than in others, no two of them too alike. A word is a row of kernel values to
the landmarks, a sentence the largest of its words' values, mapped by the inverse root of the
landmarks' own kernel (Nyström), so that a linear machine on it is a kernel machine.

The machine is trained on sentences: every sentence of a text labelled clean is clean, and of
a toxic text the most suspect one is toxic, picked again after each of three fits. A text's
score is that of its worst sentence, made a probability by Platt's logistic fit. Fitting uses
at most ``most_rows`` (8 000) labelled rows outside the held-out fold, those of the smallest
hash of their id; that bound is the only sample.

A triple's weight in every landmark is a broadcast table whose size is fixed by the
landmarks' alphabet and number. Words are remembered per Python worker in a bounded memory
that is emptied when full, as a word's row depends on nothing else. A run of more than 24
letters is read as overlapping runs of 24. Kernel values under ``least`` count as 0.

Defined cases: null and empty texts, and texts without letters, get the score of a sentence
with no landmark near; unlabelled rows and null labels are not learned from; rows of one id
with several labels count as the largest; with one class only, every score is its share (0.5
if there are no labels); repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_fold, settle
from .quality import labelled_sample

_RUN = 24
_END = re.compile(r"(?<=[.!?])\s+|\n+")
_ROWS: dict[str, np.ndarray | str | None] = {}


@lru_cache(maxsize=64)
def _triples(n: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    places = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return places, (decay ** (places[:, 2] - places[:, 0] - 2.0)).astype(np.float32)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def runs(word: str) -> list[str]:
    """The word's letters, or overlapping runs of them."""
    word = letters(word)
    if len(word) <= _RUN:
        return [word] if len(word) >= 3 else []
    return [word[i : i + _RUN] for i in range(0, len(word) - _RUN // 2, _RUN // 2)]


def units(sentence: str) -> list[str]:
    """Its words, and single letters in a row as one more word."""
    words = sentence.split()
    if sum(len(w) == 1 for w in words) >= 4:
        spaced = "".join(w if len(w) == 1 else " " for w in words).split()
        words += [w for w in spaced if len(w) >= 4]
    return words


def kernel(a: str, b: str, decay: float = 0.4) -> float:
    """The normalised subsequence kernel of two words, directly from its definition."""

    def features(s: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for i, j, k in combinations(range(len(s)), 3):
            out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0.0) + decay ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    dot = sum(v * y.get(u, 0.0) for u, v in x.items())
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return dot / norm if norm else 0.0


@dataclass
class Landmarks:
    words: list[str]
    decay: float = 0.4
    least: float = 0.5
    letters: dict[str, int] = field(init=False)
    table: np.ndarray = field(init=False)  # (triple code, landmark): the triple's weight in it, normalised
    bounds: np.ndarray = field(init=False)
    key: str = field(init=False)

    def __post_init__(self):
        self.letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(self.words))))}
        side = len(self.letters) + 1
        self.table = np.zeros((side**3, len(self.words)), np.float32)
        for j, word in enumerate(self.words):
            places, weight = _triples(len(word), self.decay)
            np.add.at(self.table[:, j], self._codes([word])[0][places] @ np.array([side * side, side, 1]), weight)
        self.table /= np.maximum(np.linalg.norm(self.table, axis=0, keepdims=True), 1e-9)
        # landmarks of one family (a common start) bound each other: the most any of eight gives
        order = np.argsort(np.array(self.words))
        groups = [order[i : i + 8] for i in range(0, len(order), 8)]
        self.bounds = np.stack([self.table[:, g].max(axis=1) for g in groups], axis=1)
        self.key = "|".join([str(self.decay), str(self.least), *self.words])

    def _codes(self, words: list[str]) -> np.ndarray:
        return np.array([[self.letters.get(c, 0) for c in w] for w in words], np.int64)

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words near any landmark, and their rows of kernel values."""
        side = len(self.letters) + 1
        seen = self.table.any(axis=1)
        near, rows = [], []
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for n, where in by_length.items():
            if n < 3:
                continue
            places, weight = _triples(n, self.decay)
            floor = float(np.sqrt((weight * weight).sum()))  # the norm is at least this
            for at in range(0, len(where), 1024):
                part = np.array(where[at : at + 1024])
                c = self._codes([words[i] for i in part])
                code = (c[:, places[:, 0]] * side + c[:, places[:, 1]]) * side + c[:, places[:, 2]]
                row, column = np.nonzero(seen[code])
                if not len(row):
                    continue
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                most = np.add.reduceat(self.bounds[code[row, column]] * weight[column, None], first, axis=0).max(axis=1)
                able = np.zeros(len(part), bool)
                able[row[first]] = most >= self.least * floor
                keep = able[row]
                row, column = row[keep], column[keep]
                if not len(row):
                    continue
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                dot = np.add.reduceat(self.table[code[row, column]] * weight[column, None], first, axis=0)
                hot = np.flatnonzero(dot.max(axis=1) >= self.least * floor)
                for h in hot:
                    i = part[row[first[h]]]
                    raw = np.array([ord(x) for x in words[i]], np.int64)[places] @ np.array([1 << 42, 1 << 21, 1])
                    norm = np.sqrt((np.bincount(np.unique(raw, return_inverse=True)[1], weight) ** 2).sum())
                    value = dot[h] / norm
                    if value.max() >= self.least:
                        near.append(int(i))
                        rows.append(np.where(value >= self.least, value, 0.0))
        return np.array(near, np.int64), np.array(rows, np.float32).reshape(len(near), len(self.words))


def rows_of(words: set[str], landmarks: Landmarks, most: int = 1_200_000) -> dict[str, np.ndarray | None]:
    """Each word's kernel row (None: no landmark near), from this worker's memory."""
    if _ROWS.get(" ") != landmarks.key or len(_ROWS) > most:
        _ROWS.clear()
        _ROWS[" "] = landmarks.key  # no word is a space
    new = [w for w in words if w not in _ROWS]
    known = {}
    for w in new:  # a word with marks is its letters
        if not w.isalpha() and (bare := letters(w)) in _ROWS:
            known[w] = _ROWS[bare]
    _ROWS.update(known)
    new = [w for w in new if w not in known]
    if new:
        parts = [(w, r) for w in new for r in runs(w)]
        distinct = list({r for _, r in parts})
        near, values = landmarks.values(distinct)
        found = {distinct[i]: v for i, v in zip(near, values, strict=True)}
        _ROWS.update(dict.fromkeys(new))
        for run in distinct:
            _ROWS.setdefault(run, found.get(run))
        for word, run in parts:
            if run in found and _ROWS[word] is not found[run]:
                old = _ROWS[word]
                _ROWS[word] = found[run] if old is None else np.maximum(old, found[run])
    return {w: _ROWS[w] for w in words if _ROWS[w] is not None}


def sentences(texts: list[str], landmarks: Landmarks) -> list[np.ndarray]:
    """For each text, a row for every sentence that has a word near a landmark.

    Sentences are cut at line ends and after words that end in a full stop, ! or ?.
    """
    lowered = [t.lower() for t in texts]
    words = [set(units(t)) for t in lowered]
    hot = rows_of(set().union(*words), landmarks)
    out = []
    for text, own in zip(lowered, words, strict=True):
        rows = []
        if not own.isdisjoint(hot):
            for sentence in _END.split(text):
                if near := {w for w in units(sentence) if w in hot}:
                    rows.append(np.maximum.reduce([hot[w] for w in near]))
        out.append(np.array(rows, np.float32).reshape(len(rows), len(landmarks.words)))
    return out


@dataclass
class Model:
    landmarks: Landmarks | None
    root: np.ndarray | None = None
    weights: np.ndarray | None = None
    platt: tuple[float, float] = (1.0, 0.0)
    constant: float = 0.5

    def decide(self, rows: np.ndarray) -> np.ndarray:
        x = np.hstack([rows @ self.root, np.ones((len(rows), 1))])
        return x @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(texts), self.constant)
        bare = np.zeros((1, len(self.landmarks.words)), np.float32)
        rows = sentences(texts, self.landmarks)
        worst = np.array([self.decide(np.vstack([bare, r])).max() for r in rows])
        return np.round(1.0 / (1.0 + np.exp(-np.clip(self.platt[0] * worst + self.platt[1], -40, 40))), 9)


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, steps: int = 30) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        a, d = x[active], weight[active] * c
        new = np.linalg.solve(np.eye(x.shape[1]) + (a * d[:, None]).T @ a, (a * d[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = w + 0.7 * (new - w)
    return w


def platt(decisions: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic of the least log loss, slightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * decisions + b, -30, 30)))
        d, h = p - y, p * (1 - p) + 1e-6
        grad = np.array([(d * decisions).sum() + 0.01 * (a - 1), d.sum() + 0.01 * b])
        hess = np.array([[(h * decisions * decisions).sum() + 0.01, (h * decisions).sum()], [(h * decisions).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        a = max(a, 1e-3)
    return float(a), float(b)


def pick_landmarks(sample: DataFrame, most: int = 120, pool: int = 600, alike: float = 0.9, decay: float = 0.4) -> list[str]:
    """Words far commoner in toxic texts of the sample, no two of them more alike than ``alike``."""
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("t").cast("string")), F.lit(r"(\p{L}{3,24})"), F.lit(1)))).alias("w"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    counts = words.groupBy("w").agg(F.sum(F.col("y").cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("q", F.col("n") - F.col("p"))
    odds = F.log((F.col("p") / positive) / ((F.col("q") + 0.5) / negative))
    best = counts.where(F.col("p") >= 3).withColumn("odds", odds).where("odds > 2.0").orderBy(F.desc(F.col("p") * F.col("odds")), "w").limit(pool).collect()
    chosen: list[str] = []
    for row in best:
        word = row["w"]
        if word.isalpha() and all(kernel(word, old, decay) < alike for old in chosen):
            chosen.append(word)
            if len(chosen) == most:
                break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 8000, **options) -> Model:
    sample = settle(labelled_sample(docs, labels, label, most_rows, **options).repartition(8, "doc_id"))
    classes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return Model(None, constant=float(next(iter(classes), 0.5)))
    found = pick_landmarks(sample)
    if not found:
        return Model(None, constant=classes.get(1, 0) / sum(classes.values()))
    landmarks = Landmarks(found)
    spread = docs.sparkSession.sparkContext.broadcast(landmarks)

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or b"").decode() for t in part.column(1).to_pylist()]
                made = [r.astype(np.float32).tobytes() for r in sentences(texts, spread.value)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary()), part.column(2)], ["doc_id", "v", "y"])

    rows = sample.select("doc_id", "t", "y").mapInArrow(vectors, "doc_id long, v binary, y int").toPandas().sort_values(["doc_id", "v"])
    size = len(found)
    bags = [np.vstack([np.zeros((1, size), np.float32), np.frombuffer(v, np.float32).reshape(-1, size)]) for v in rows["v"]]
    y = rows["y"].to_numpy(np.float64)
    gram = np.array([[kernel(a, b, landmarks.decay) for b in found] for a in found])
    values, vectors_ = np.linalg.eigh(gram + 1e-3 * np.eye(size))
    model = Model(landmarks, root=(vectors_ / np.sqrt(np.maximum(values, 1e-6))) @ vectors_.T)
    clean = np.vstack([b for b, t in zip(bags, y, strict=True) if t == 0])
    clean, often = np.unique(clean, axis=0, return_counts=True)
    witness = np.vstack([b[b.sum(axis=1).argmax()] for b, t in zip(bags, y, strict=True) if t == 1])
    for _ in range(3):
        x = np.vstack([clean, witness]) @ model.root
        label_ = np.concatenate([-np.ones(len(clean)), np.ones(len(witness))])
        weight = np.concatenate([often.astype(np.float64), np.full(len(witness), 2.0)])
        model.weights = machine(x, label_, weight)
        witness = np.vstack([b[model.decide(b).argmax()] for b, t in zip(bags, y, strict=True) if t == 1])
    model.platt = platt(np.array([model.decide(b).max() for b in bags]), y)
    return model


def scores(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = spread.value.score([t or "" for t in part.column(1).to_pylist()])
                predicted = pa.array((s >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(s.astype(np.float64)), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("t"), (id_fold(F.col(id_column), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scores(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
