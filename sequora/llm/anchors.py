"""Anchored runs of the windows of many texts at once, and bitmaps of anchors.

Each ``window``-byte window is named by its anchor, the ``gram``-byte string of least hash in it
(the leftmost of equals). Equal windows have equal anchors at equal places. Consecutive windows
of a text with the same anchor form a run, so there are some 2/(window-gram+2) runs a byte, and
a run's content hash covers the bytes from its first window to its last.

The texts of an Arrow batch lie in one buffer, which is worked through a bounded piece at a time
whatever the length of a text. A run may be cut at the border of two pieces; it is then a run of
other content, which costs a comparison and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, mix64

PIECE = 1 << 16
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_GRAM = Powers(0x9FB21C651E98DF25)
_HIGH, _LOW = np.uint64(0xFFFFFFFFFF000000), np.uint64(0xFFFFFF)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Runs(NamedTuple):
    """Per run: text number in the batch, first window and anchor place in that text, windows, hashes."""

    text: np.ndarray
    start: np.ndarray
    at: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and each text's first byte, with the end; null is empty."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), edges


def runs(raw: np.ndarray, edges: np.ndarray, window: int, gram: int) -> Iterator[Runs]:
    """The runs of all texts, some at a time."""
    low, high = edges[:-1], edges[1:] - window + 1
    full = low < high
    base, end = int(edges[0]), int(edges[-1])
    change = np.zeros(max(end - base, 0) + 1, np.int8)
    change[low[full] - base], change[high[full] - base] = 1, -1
    inside = np.cumsum(change, dtype=np.int8).view(bool)
    for at in range(base, end - window + 1, PIECE):
        own = inside[at - base : at - base + PIECE]
        own = own[: end - window + 1 - at]
        if not own.any():
            continue
        values = _BYTE[raw[at : at + len(own) + window - 1]]
        up, down = _GRAM.get(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        grams = mix64((total[gram:] - total[:-gram]) * down[: len(values) - gram + 1])
        least = least_of((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        place = (least & _LOW).astype(np.int64)
        place[~own] = -1
        first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        count = np.diff(np.append(first, len(place)))
        used = place[first] >= 0
        first, count = first[used], count[used]
        where = place[first]
        content = (total[first + count + window - 1] - total[first]) * down[first]
        content += (count.astype(np.uint64) << np.uint64(32)) + (where - first).astype(np.uint64)
        text = np.searchsorted(edges, first + at, side="right") - 1
        shift = at - edges[text]
        yield Runs(text, first + shift, where + shift, count, grams[where], mix64(content))


def together(parts: Iterator[Runs], rows: int = 1 << 16) -> Iterator[Runs]:
    """The same runs in larger parts."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part.text)
        if n >= rows:
            yield Runs(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield Runs(*map(np.concatenate, zip(*held, strict=True)))


class Bitmap(NamedTuple):
    """A set of 64-bit hashes by their last bits: says yes to all of its own and to some others.

    An anchor is the least of many hashes, so its leading bits are nearly all zero; the last are even.
    """

    bits: int
    words: np.ndarray


    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64((1 << self.bits) - 1)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def bitmaps(shared: DataFrame, most_bits: int = 29) -> tuple[Bitmap, Bitmap]:
    """Bitmaps of the hashes ``a``, and of those that are ``mixed``, in shares of 32 KB.

    They have sixteen bits or more a row while that is within 2**most_bits bits (64 MB). A fuller
    one says yes more often. That lets more rows through, alike in every document. Each share is
    filled in one task, from rows that are not held; the last bits are even, so shares are too.
    """
    bits = int(min(most_bits, max(12, (16 * shared.count()).bit_length())))
    wide = min(bits, 18)
    slot: Column = F.col("a").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    rows = shared.select(F.shiftright(slot, wide).alias("share"), slot.bitwiseAND(F.lit((1 << wide) - 1)).cast("int").alias("at"), "mixed")

    def fill(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            share, at, mixed = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for k in np.unique(share).tolist():
                if k not in made:
                    made[k] = np.zeros((2, 1 << wide), bool)
                own = share == k
                made[k][0, at[own]] = True
                made[k][1, at[own & mixed]] = True
        for k, both in made.items():
            some, many = (np.packbits(x, bitorder="little").tobytes() for x in both)
            yield pa.RecordBatch.from_pydict({"share": [k], "some": [some], "many": [many]})

    found = rows.repartition(min(1 << (bits - wide), max(1, int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "share")
    words = np.zeros((2, 1 << (bits - 6)), np.uint64)
    size = 1 << (wide - 6)
    for row in found.mapInArrow(fill, "share long, some binary, many binary").collect():
        for k in range(2):
            words[k, row["share"] * size : (row["share"] + 1) * size] = np.frombuffer(row[k + 1], np.uint64)
    return Bitmap(bits, words[0]), Bitmap(bits, words[1])
