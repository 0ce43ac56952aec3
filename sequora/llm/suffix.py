"""Byte-level substring deduplication: strings of 50 bytes that an earlier document holds.

The texts' UTF-8 bytes lose every byte that is covered by a 50-byte string (a window) which also
starts in a document of smaller id. README.md says, with figures, why the suffixes are not sorted
by induction. What stands in its place handles a run of windows (``anchors``) as one row:

1. One aggregation over all runs, combined before its shuffle, tells for each anchor whether two
   documents hold it (shared) and whether its runs differ (mixed). Both become bitmaps of bounded
   size; a bit set by chance only adds work.
2. A second scan writes a row for each run of a shared anchor. A run that an earlier document
   holds as a whole is removed: only the first of equal runs is left to look into.
3. Different runs of one anchor can still share windows. Each distinct run of a mixed anchor is
   taken once, with its bytes. Its windows are dealt into ``parts`` by the place of the anchor in
   them; all windows of a part have a core of bytes in common, so a window can be shared only if
   another run has the same core. Only such windows become rows.

So the windows outside repeats are never rows, and a passage in a third of all documents is one
row per map task. Equal runs agree in two 64-bit hashes, one of the anchor and one of the whole
run; equal windows in two 64-bit hashes of their bytes.

Defined cases: a null text is an empty one; texts under 50 bytes lose nothing; a very long text is
scanned in bounded pieces, and its removed spans are gathered once each; matches never cross
documents; a cut may split a character, so the digest is over bytes; rows with the same id do not
remove each other's bytes; a null id comes last; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import discard, documents, release, store
from .repeats import _rows, covered, cut

WINDOW, GRAM, PARTS = 50, 24, 4


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(a, mixed) for the anchors that two documents or more hold."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for part in anchors.together(anchors.runs(*anchors.buffer(batch.column(1)), window, gram)):
                yield pa.RecordBatch.from_arrays([_signed(part.anchor), _signed(part.content), pa.array(ids[part.text])], ["a", "s", "o"])

    found = rows.select("o", "t").mapInArrow(run, "a long, s long, o long")
    each = found.groupBy("a").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    return each.where("lo < hi").select("a", (F.col("s0") != F.col("s1")).alias("mixed"))


def shared_runs(rows: DataFrame, window: int, gram: int, maps, turn: int, turns: int) -> DataFrame:
    """(o, r, start, n, a, s, mixed, left, bytes): the runs of shared anchors, of one turn's anchors.

    maps: a broadcast of the bitmaps of shared and of mixed anchors.

    left: windows begin up to so many bytes before the anchor. bytes: of a mixed anchor's run, once
    for each distinct run of a batch.
    """
    names = ["o", "r", "start", "n", "a", "s", "mixed", "left", "bytes"]

    def run(batches):
        some, many = maps.value
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, edges = anchors.buffer(batch.column(2))
            for part in anchors.together(anchors.runs(raw, edges, window, gram)):
                used = some.has(part.anchor) & (part.anchor % np.uint64(turns) == turn)
                part = anchors.Runs(*(x[used] for x in part))
                if not len(part.text):
                    continue
                several = many.has(part.anchor)
                own = np.flatnonzero(several)
                own = own[np.unique(part.content[own] ^ (part.anchor[own] << np.uint64(1)), return_index=True)[1]]
                size = np.zeros(len(several), np.int64)
                size[own] = part.count[own] + window - 1
                ends = np.cumsum(size)
                data = raw[np.repeat(edges[part.text] + part.start - ends + size, size) + np.arange(ends[-1])]
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                columns = [pa.array(ids[part.text]), pa.array(tags[part.text]), pa.array(part.start), pa.array(part.count.astype(np.int32)), _signed(part.anchor), _signed(part.content)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(several), pa.array((part.at - part.start).astype(np.int32)), held], names)

    return rows.mapInArrow(run, "o long, r long, start long, n int, a long, s long, mixed boolean, left int, bytes binary")


def inner_windows(found: DataFrame, window: int, gram: int, parts: int = PARTS) -> DataFrame:
    """(a, s, gone): for distinct runs of mixed anchors, the windows j that a run of an earlier document holds.

    A run's document is its first; later ones lose the whole run anyway.
    """
    each = found.where("mixed").groupBy("a", "s").agg(F.min("o").alias("lo"), F.max("n").alias("n"), F.max("left").alias("left"), F.max("bytes").alias("bytes"))
    each = store(each)
    release(found.sparkSession)
    wide = -(-(window - gram + 1) // parts)
    # windows of part p begin p*wide to (p+1)*wide-1 bytes before the anchor; j counts from the run's first window
    spans = []
    for p in range(parts):
        low, high = p * wide, min((p + 1) * wide - 1, window - gram)
        first, last = F.greatest(F.lit(0), F.col("left") - high), F.least(F.col("n") - 1, F.col("left") - low)
        core = F.substring(F.col("bytes"), F.col("left") - low + 1, F.lit(window - high + low))
        spans.append(F.struct(F.lit(p).alias("p"), first.alias("j0"), last.alias("j1"), F.xxhash64("a", F.lit(p), core).alias("core")))
    cores = each.select("a", "s", "lo", F.inline(F.array(*spans))).where("j0 <= j1")
    several = cores.groupBy("core").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least < most").select("core")
    close = cores.select("a", "s", "p", "core").join(several, "core", "left_semi").groupBy("a", "s").agg(F.bit_or(F.expr("shiftleft(1, p)")).alias("open"))
    close = store(close)
    release(found.sparkSession)
    part = F.floor((F.col("left") - F.col("j")) / wide).cast("int")
    there = each.join(close, ["a", "s"]).select("a", "s", "lo", "bytes", "open", "left", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    there = there.where(F.getbit("open", part) == 1).withColumn("w", F.substring(F.col("bytes"), F.col("j") + 1, F.lit(window)))
    there = there.select("a", "s", "lo", "j", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit(1), "w").alias("k2"))
    least = there.groupBy("k1", "k2").agg(F.min("lo").alias("least"), F.max("lo").alias("most")).where("least < most").select("k1", "k2", "least")
    gone = store(there.join(least, ["k1", "k2"]).where("least < lo").groupBy("a", "s").agg(F.collect_set("j").alias("gone")))
    discard(each, close)
    return gone


def removed(docs: DataFrame, window: int, gram: int, id_column: str, text_column: str, turns: int = 2) -> DataFrame:
    """(o, r, start, n): windows that also start in an earlier document.

    Anchors are worked through in ``turns`` equal shares, each with a scan, so that the rows of one
    share are on disk at a time.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_column, text_column)
    shared = store(shared_anchors(rows, window, gram))
    release(spark)
    maps = spark.sparkContext.broadcast(anchors.bitmaps(shared))
    discard(shared)
    hits = None
    for turn in range(turns):
        found = store(shared_runs(rows, window, gram, maps, turn, turns))
        gone = inner_windows(found, window, gram)
        first = found.groupBy("a", "s").agg(F.min("o").alias("lo")).join(gone, ["a", "s"], "left")
        first = store(first)  # so that both sides of the join are shuffles, and a passage in many documents can be split
        joined = found.select("o", "r", "start", "n", "a", "s").join(first, ["a", "s"]).where("lo < o or gone is not null")
        whole = F.array(F.struct(F.col("start"), F.col("n").cast("long").alias("n")))
        some = F.transform("gone", lambda j: F.struct((F.col("start") + j).alias("start"), F.lit(1).cast("long").alias("n")))
        more = store(joined.select("o", "r", F.inline(F.when(F.col("lo") < F.col("o"), whole).otherwise(some))))
        hits = more if hits is None else hits.unionByName(more)
        discard(found, gone, first)
    maps.destroy()
    return hits


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay)."""
    hits = removed(docs, window, gram, id_column, text_column)

    def remove(text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple:
        total, gone, spans = len(text), 0, 0
        if len(starts):
            mask = covered(total, starts, counts, window)
            gone = int(mask.sum())
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            text = np.frombuffer(text, np.uint8)[~mask].tobytes()
        row = (total, gone, spans, hashlib.sha256(text).hexdigest())
        return (*row, text) if with_bytes else row

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return cut(docs, hits, remove, schema, id_column, text_column)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(documents(spark, sf_dir))
