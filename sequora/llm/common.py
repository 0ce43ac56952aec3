"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words in every contract.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_SPACE_BYTES = re.compile(rb"[\x20\x09-\x0D]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The folder is the one in ``spark.checkpoint.dir``; only a session without it (a local
    test) gets a temporary folder of its own.
    """
    _folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files no plan needs any more go now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sequora-"))
    return context.getCheckpointDir()


def text_bytes(column: str = "text") -> Column:
    """The text's UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def word_blocks(data: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of ``data``, a bounded list at a time, cut at white space only."""
    at, end = 0, len(data)
    while at < end:
        stop = end
        if at + block < end:
            found = _SPACE_BYTES.search(data, at + block)
            stop = found.start() if found else end
        yield data[at:stop].split()
        at = stop


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns beside those of ``df``, which may hold any name, in any case."""
    taken = {c.lower() for c in df.columns}
    prefix = "__"
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def quantiles(df: DataFrame, column: str, parts: int) -> list[float]:
    """Distinct places that cut a numeric column into ``parts`` of about equal rows; none if it is empty."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), shares, max(10_000, 8 * parts)).alias("q")).first()
    return sorted(set(row["q"] or []))


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def id_fold_value(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def tokenizer_path(name: str) -> str:
    """A public tokenizer file; SEQUORA_TOKENIZERS may name another folder."""
    folder = os.environ.get("SEQUORA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (uint64, in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Growing tables of an odd multiplier's powers and of their inverses modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(self.base, -1, 1 << 64)
            for name, base in (("up", self.base), ("down", inverse)):
                table = np.full(size, np.uint64(base), np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))
        return self.up[:n], self.down[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of UTF-8 bytes."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:end], mixed; equal bytes, equal hash."""
    hashed = np.empty(len(starts), np.uint64)
    at, block = 0, 1 << 20
    while at < len(starts):  # a block of bytes at a time, so that memory does not follow the text
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + block)))
        part = data[base : ends[to - 1]]
        up, down = powers.get(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
        first, last = starts[at:to] - base, ends[at:to] - base
        hashed[at:to] = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _ODD
        at = to
    return mix64(hashed)


def rolling(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` consecutive values (uint64)."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[: len(values) - width + 1])


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again."""
    path = f"{_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame, collect: bool = True) -> None:
    """Delete what ``store`` wrote, once nothing that is still to run reads it; then ``release``.

    Without ``collect`` the driver's garbage stays for later: collections in quick succession take
    so much of the driver's time that its collector lets the heap grow, by half on small inputs.
    """
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for df in stored[: int(collect)]:
        release(df.sparkSession)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else; pure ASCII takes the quicker way to the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
