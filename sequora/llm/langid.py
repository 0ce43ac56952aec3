"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (a SentencePiece
model's pieces; their texts only, its own scores are not used). A word's likelihood is the
sum over all its segmentations into pieces of the product of their probabilities, computed by
the forward algorithm; a text's likelihood is the product over its words. The prediction is
the language of the largest likelihood and the score its posterior under equal priors.

Learning counts pieces over every training text: each word is cut once by the vocabulary's
own tokenizer, counts are summed per task and then per (language, piece) by Spark. Only that
table, languages times pieces, reaches the driver and is broadcast; its size is bounded by the
vocabulary. Words are remembered per Python worker (a bounded memory that is emptied when
full), as a word's likelihoods depend on nothing else. Words longer than 24 characters are
scored as consecutive runs of 24, so no table grows with a word.

Defined cases: null texts and texts without a letter are ``und`` with score 0; if nothing
could be learned every text is; ties go to the smallest language name; repeated rows count
as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_fold, tokenizer_path

_LETTER = re.compile(r"[^\W\d_]")
_RUN = 24
_SPLIT: dict[str, bytes] = {}
_MODEL: dict[str, object] = {}


def _processor(path: str):
    if path not in _MODEL:
        import sentencepiece

        _MODEL[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        _SPLIT.clear()
    return _MODEL[path]


def _pieces(path: str) -> list[str]:
    sp = _processor(path)
    return [sp.id_to_piece(i) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) else "" for i in range(sp.get_piece_size())]


def _words(text: str) -> list[str]:
    return text.lower().split()


def _cut(texts: list[list[str]], path: str, most: int = 400_000) -> list[np.ndarray]:
    """The piece ids of each list of words; a word's ids are remembered."""
    if len(_SPLIT) > most:
        _SPLIT.clear()
    new = [w for w in set().union(*texts) if w not in _SPLIT]
    for at in range(0, len(new), 10_000):
        part = new[at : at + 10_000]
        for word, ids in zip(part, _processor(path).encode(part, num_threads=1), strict=True):
            _SPLIT[word] = np.array(ids, np.uint16).tobytes()
    return [np.frombuffer(b"".join(map(_SPLIT.__getitem__, words)), np.uint16) for words in texts]


def piece_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", vocabulary: str = "piece_bpe_32k.model", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(lang, piece, n) over the training documents."""

    def run(batches):
        path = tokenizer_path(vocabulary)
        size = _processor(path).get_piece_size()
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [_words(t) for t in batch.column(0).slice(at, 256).to_pylist()]
                langs = batch.column(1).slice(at, 256).to_pylist()
                for ids, lang in zip(_cut(texts, path), langs, strict=True):
                    if lang not in counts:
                        counts[lang] = np.zeros(size, np.int64)
                    counts[lang] += np.bincount(ids, minlength=size)
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "piece", "n"])

    rows = docs.where((id_fold(F.col(id_column), folds) != held_out) & F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    made = rows.select(F.col(text_column).alias("t"), F.col(lang_column).cast("string").alias("l")).mapInArrow(run, "lang string, piece int, n long")
    return made.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Unigrams:
    """Piece probabilities per language and the forward algorithm over unique words."""

    def __init__(self, langs: list[str], pieces: list[str], counts: np.ndarray, smoothing: float = 0.1, unknown: float = 1e-7):
        self.langs = langs
        known = np.array([bool(p) for p in pieces])
        smooth = np.where(known, counts + smoothing, 0.0)
        self.p = np.zeros((len(pieces) + 2, len(langs)))
        self.p[: len(pieces)] = (smooth / smooth.sum(axis=1, keepdims=True)).T
        self.p[len(pieces) + 1] = unknown  # a single character that is no piece; the row before stays 0: no piece
        hashes = {}
        for i, piece in enumerate(pieces):
            if piece:
                hashes[int(self._hash(piece))] = i
        assert len(hashes) == known.sum(), "two pieces share a hash"
        self.keys = np.array(sorted(hashes), np.uint64)
        self.ids = np.array([hashes[int(k)] for k in self.keys], np.int64)
        self.longest = min(max(map(len, pieces)), _RUN + 1)
        self.none = len(pieces)

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        value = 0
        for c in piece:
            value = (value * 0x100000001B3 + ord(c) + 1) & (2**64 - 1)
        return np.uint64(value)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], self.none)

    def runs(self, runs: list[str]) -> np.ndarray:
        """Log likelihood of each run of characters (a row) in each language (a column)."""
        out = np.empty((len(runs), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        for i, run in enumerate(runs):
            by_length.setdefault(len(run), []).append(i)
        for n, where in by_length.items():
            for at in range(0, len(where), 2048):
                part = where[at : at + 2048]
                codes = np.frombuffer("".join(runs[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n).astype(np.uint64) + np.uint64(1)
                forward = np.zeros((n + 1, len(part), len(self.langs)))
                forward[0] = 1.0
                scale = np.zeros((len(part), 1))
                found = []
                hashes = np.zeros((len(part), n + 1), np.uint64)
                for k in range(1, min(n, self.longest) + 1):
                    hashes = hashes[:, : n - k + 1] * np.uint64(0x100000001B3) + codes[:, k - 1 :]
                    ids = self._find(hashes)
                    found.append(np.where(ids == self.none, self.none + 1, ids) if k == 1 else ids)
                for end in range(1, n + 1):
                    for k in range(1, min(end, self.longest) + 1):
                        ids = found[k - 1][:, end - k]
                        if k == 1 or (ids != self.none).any():
                            forward[end] += forward[end - k] * self.p[ids]
                    if end % 8 == 0:  # rescale what is still in use, so that nothing underflows
                        top = forward[end].max(axis=1, keepdims=True)
                        forward[max(0, end - self.longest) : end + 1] /= top
                        scale += np.log(top)
                out[part] = np.log(np.maximum(forward[n], 1e-300)) + scale
        return out

    def words(self, words: list[str]) -> np.ndarray:
        runs, owner = [], []
        for i, word in enumerate(words):
            whole = "▁" + word
            for at in range(0, len(whole), _RUN):
                runs.append(whole[at : at + _RUN])
                owner.append(i)
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, np.array(owner, np.int64), self.runs(runs))
        return out


def fit(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", **options) -> Unigrams | None:
    rows = piece_counts(docs, vocabulary=vocabulary, **options).collect()
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    pieces = _pieces(tokenizer_path(vocabulary))
    counts = np.zeros((len(langs), len(pieces)))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        counts[place[r["lang"]], r["piece"]] = r["n"]
    return Unigrams(langs, pieces, counts)


def predict(docs: DataFrame, model: Unigrams | None, id_column: str = "doc_id", text_column: str = "text", folds: int = 4, held_out: int = 2, most_words: int = 400_000) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = spread.value
        place: dict[str, int] = {}
        table = np.zeros((1024, len(m.langs) if m else 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = part.column(1).to_pylist()
                texts = [_words(t) if m and t and _LETTER.search(t) else [] for t in raw]
                if len(place) > most_words:
                    place.clear()
                new = [w for w in set().union(*texts) if w not in place]
                if new:
                    need = len(place) + len(new)
                    if need > len(table):
                        table = np.concatenate([table, np.zeros((max(need - len(table), len(table)), table.shape[1]))])
                    table[len(place) : need] = m.words(new)
                    place.update(zip(new, range(len(place), need), strict=True))
                langs, scores = [], []
                for words in texts:
                    if not words:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    total = table[np.fromiter(map(place.__getitem__, words), np.int64, len(words))].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(m.langs[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("t"), (id_fold(F.col(id_column), folds) == held_out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))
