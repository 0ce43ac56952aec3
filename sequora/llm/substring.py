"""Substring deduplication with a log-structured fingerprint index.

A window is 50 consecutive words of one document. A word goes when a window that covers it
also starts in a document of smaller id. Documents arrive in batches by ascending id; the
index keeps, for every window fingerprint seen, its earliest document. It is log-structured:
sorted immutable runs, bucketed and sorted by fingerprint, so that a batch is merge-joined
with each run without moving the run. What a batch adds becomes a new run, and runs of one
level are compacted into one of the next when there are ``fanout`` of them. Keys are unique
across runs, as only unseen ones are added.

Fingerprints come from ``repeats``: only windows whose anchor two documents share get one, a
whole run of windows under one where all copies agree. Matches are verified by a second,
independent 64-bit hash beside the key. Within a batch copies meet by aggregation, combined
before the shuffle, so that a passage in a third of all documents is one row per map task.

Defined cases: null and empty texts have no words and hash the empty string; documents under
50 words lose nothing; rows with the same id are one document in the order, and do not
remove each other's words; a null id comes last; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, documents, quantiles, release, span_hashes, store, word_spans
from .repeats import candidates, covered, cut

WINDOW, GRAM = 50, 25
_POWERS = Powers(0x2545F4914F6CDD1D)


def word_units(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    return span_hashes(raw, starts, ends, _POWERS) if len(starts) else np.zeros(0, np.uint64)


class RunIndex:
    """fingerprint (k1, k2) -> earliest document, in sorted runs.

    A run is a bucketed, sorted Parquet table in the warehouse, never changed once written.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 2):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.name, self.runs, self.made = f"sequora_run_{uuid.uuid4().hex[:12]}", [], 0

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "k1").write.bucketBy(self.buckets, "k1").sortBy("k1").format("parquet").saveAsTable(table)
        self.runs.append((level, table))

    def add(self, batch: DataFrame) -> DataFrame:
        """Look a batch (o, r, start, n, k1, k2) up, then add what it has that is new.

        Returns (o, r, start, n) for the windows that an earlier document holds.
        """
        known = batch.groupBy("k1", "k2").agg(F.min("o").alias("own"))
        old = F.lit(None).cast("long")
        for i, (_, table) in enumerate(self.runs):
            run = self.spark.table(table).select("k1", "k2", F.col("first").alias(f"f{i}"))
            known = known.join(run.hint("merge"), ["k1", "k2"], "left")
            old = F.coalesce(old, F.col(f"f{i}"))
        known = store(known.select("k1", "k2", "own", old.alias("old")))
        self._write(known.where("old is null").select("k1", "k2", F.col("own").alias("first")), 0)
        first = known.select("k1", "k2", F.least("own", "old").alias("first"))
        hits = store(batch.join(first, ["k1", "k2"]).where("first < o").select("o", "r", "start", "n"))
        self._compact()
        release(self.spark)
        return hits

    def _compact(self) -> None:
        level = 0
        while len(same := [t for k, t in self.runs if k == level]) >= self.fanout:
            merged = self.spark.table(same[0])
            for table in same[1:]:
                merged = merged.unionByName(self.spark.table(table))
            self._write(merged, level + 1)
            self.runs = [(k, t) for k, t in self.runs if t not in same]
            for table in same:
                self.spark.sql(f"DROP TABLE {table}")
            level += 1

    def drop(self) -> None:
        for _, table in self.runs:
            self.spark.sql(f"DROP TABLE {table}")
        self.runs = []


def repeated_windows(docs: DataFrame, batches: int = 4, fanout: int = 2, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(o, r, start, n): windows that also start in an earlier document."""
    spark = docs.sparkSession
    found = store(candidates(docs, word_units, window, gram, id_column, text_column))
    release(spark)
    cuts = quantiles(found, "o", batches)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = RunIndex(spark, buckets, fanout)
    hits = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = found
        if low is not None:
            batch = batch.where(F.col("o").cast("double") >= low)
        if high is not None:
            batch = batch.where(F.col("o").cast("double") < high)
        more = index.add(batch)
        hits = more if hits is None else hits.unionByName(more)
    index.drop()
    return hits


def dedup_words(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, ``with_text``)."""
    hits = repeated_windows(docs, window=window, id_column=id_column, text_column=text_column, **options)

    def remove(text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple:
        words = text.split()
        total, gone = len(words), 0
        if len(starts):
            mask = covered(total, starts, counts, window)
            gone = int(mask.sum())
            words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
        kept = b" ".join(words)
        row = (total, gone, hashlib.sha256(kept).hexdigest())
        return (*row, kept.decode()) if with_text else row

    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return cut(docs, hits, remove, schema, id_column, text_column)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(documents(spark, sf_dir))
