"""Finding strings of a fixed length that also start in an earlier document.

The engine under both substring deduplications; a unit is a word or a byte, and a window is
``window`` consecutive units of one document. It is exact, and never handles all windows:

1. Each window is named by its anchor, the ``gram``-unit hash that is least in it (leftmost
   of equals). Equal windows have equal anchors at equal places. Consecutive windows with the
   same anchor form a run, so there are some 2/(window-gram+2) runs a unit. One aggregation,
   combined before its shuffle, tells for each anchor whether two documents hold it (shared)
   and whether its runs differ (mixed).
2. Shared and mixed anchors become two bitmaps of bounded size (``most_bits``), which are
   broadcast. A bit set by chance only adds work, alike in every document.
3. A second scan emits fingerprints where they can matter: a whole run under 128 bits where
   all runs of its anchor are the same, and each window of a run under 128 bits where they
   differ. Runs of unshared anchors emit nothing.
4. The least document per fingerprint decides; a row whose document is not the least is
   removed, its units returned to its document as (start, count).

The 64 bits beside the first 64 verify a match: a false one needs two independent hashes of
the units to collide at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Bitmap, bitmaps, least_of
from .common import Powers, mix64, rolling, settle, text_bytes

_ONE, _TWO, _RUNS = Powers(0x9FB21C651E98DF25), Powers(0xC2B2AE3D27D4EB4F), Powers(0xFF51AFD7ED558CCD)
_HIGH, _LOW = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFF)
_LAST = (1 << 63) - 1
CHUNK = 1 << 22


def chunks(values: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bounded parts of a document's units that hold each of its windows once."""
    for at in range(0, len(values) - window + 1, CHUNK):
        yield at, values[at : at + CHUNK + window - 1]


def anchored_runs(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, first window, windows) of each run; len(values) >= window."""
    grams = rolling(values, gram, _ONE)
    least = least_of((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    place = (least & _LOW).astype(np.int64)
    first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
    count = np.diff(np.append(first, len(place)))
    up, down = _RUNS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    content = (total[first + count + window - 1] - total[first]) * down[first]
    content += (count.astype(np.uint64) << np.uint64(32)) + (place[first] - first).astype(np.uint64)
    return grams[place[first]], mix64(content), first, count


Units = Callable[[bytes], np.ndarray]


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """o: the id by which documents are ordered, a null one last; r: tells repeated ids apart."""
    return docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("o"),
        F.xxhash64(F.col(text_column)).alias("r"),
        text_bytes(text_column).alias("t"),
    )


def _batch(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)


def shared_anchors(rows: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """(a, mixed) for the anchors that two documents or more hold."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list[np.ndarray]] = [[], [], []]
                for o, text in zip(part.column(0), part.column(1), strict=True):
                    values = units(text.as_py() or b"")
                    for _, piece in chunks(values, window):
                        anchor, content, _, _ = anchored_runs(piece, window, gram)
                        out[0].append(anchor.view(np.int64))
                        out[1].append(content.view(np.int64))
                        out[2].append(np.full(len(anchor), o.as_py(), np.int64))
                if out[0]:
                    yield _batch(out, ["a", "s", "o"])

    anchors = rows.select("o", "t").mapInArrow(run, "a long, s long, o long")
    each = anchors.groupBy("a").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    return each.where("lo < hi").select("a", (F.col("s0") != F.col("s1")).alias("mixed"))


def fingerprints(rows: DataFrame, units: Units, window: int, gram: int, maps: tuple[Bitmap, Bitmap]) -> DataFrame:
    """(o, r, start, n, k1, k2): n windows from start, under one fingerprint."""
    spread = rows.sparkSession.sparkContext.broadcast(maps)
    names = ["o", "r", "start", "n", "k1", "k2"]

    def run(batches):
        some, many = spread.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                out: list[list[np.ndarray]] = [[] for _ in names]
                for o, r, text in zip(*part.columns, strict=True):
                    values = units(text.as_py() or b"")
                    for at, piece in chunks(values, window):
                        anchor, content, first, count = anchored_runs(piece, window, gram)
                        mixed = many.has(anchor)
                        whole = np.flatnonzero(some.has(anchor) & ~mixed)
                        each = np.flatnonzero(np.repeat(mixed, count))
                        if not len(whole) + len(each):
                            continue
                        keys = [anchor[whole], content[whole]]
                        if len(each):
                            keys = [np.concatenate([k, rolling(piece, window, p)[each]]) for k, p in zip(keys, (_ONE, _TWO), strict=True)]
                        starts = np.concatenate([first[whole], each]) + at
                        ns = np.concatenate([count[whole], np.ones(len(each), np.int64)])
                        for column, x in zip(out, (np.full(len(starts), o.as_py(), np.int64), np.full(len(starts), r.as_py(), np.int64), starts, ns, keys[0].view(np.int64), keys[1].view(np.int64)), strict=True):
                            column.append(x)
                if out[0]:
                    yield _batch(out, names)

    return rows.mapInArrow(run, "o long, r long, start long, n long, k1 long, k2 long")


def candidates(docs: DataFrame, units: Units, window: int, gram: int, id_column: str, text_column: str) -> DataFrame:
    rows = _rows(docs, id_column, text_column)
    shared = settle(shared_anchors(rows, units, window, gram))
    return fingerprints(rows, units, window, gram, bitmaps(shared))


def earliest(found: DataFrame) -> DataFrame:
    """(o, r, start, n): the fingerprints' windows that a smaller document also holds."""
    least = found.groupBy("k1", "k2").agg(F.min("o").alias("least"))
    return found.join(least, ["k1", "k2"]).where("least < o").select("o", "r", "start", "n")


def removed_spans(hits: DataFrame) -> DataFrame:
    """A row per document with its (start, n) pairs; as many as the document's own windows at most."""
    return hits.groupBy("o", "r").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def cut(docs: DataFrame, hits: DataFrame, remove: Callable, schema: str, id_column: str, text_column: str) -> DataFrame:
    """Each row's text without its covered units: remove(text or None, mask starts, mask counts) -> values."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("o"),
        F.xxhash64(F.col(text_column)).alias("r"),
        text_bytes(text_column).alias("t"),
    )
    joined = rows.join(removed_spans(hits), ["o", "r"], "left").select("doc_id", "t", F.col("spans.start").alias("s"), F.col("spans.n").alias("n"))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for text, s, n in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    spans = (s.values.to_numpy(), n.values.to_numpy()) if s.is_valid else (np.zeros(0, np.int64),) * 2
                    made.append(remove(text.as_py() or b"", *spans))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*made, strict=True))], names)

    return joined.mapInArrow(run, f"doc_id long, {schema}")


def covered(size: int, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """True for units that a removed window covers."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0
