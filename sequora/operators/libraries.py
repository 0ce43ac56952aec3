"""Libraries of ready-made pieces: tiling texts with them, and the piece nearest to a block.

Greedy tiling is sequential by definition: where a tile starts depends on all tiles before it.
A library that fits a task is held there, and each text is walked once. With a larger one
every position gets the step that a tile there would take, and the table of steps is
joined with itself: after k rounds it holds leaps of 2**k tiles, and the positions reached from
the start double, so a text of n tiles is settled in about log2(n) rounds of equi-joins.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settled

#: Most different lengths that a library's pieces may have; a position is tried with each.
MOST_LENGTHS = 256


def _pieces(library: DataFrame) -> DataFrame:
    """The library with each sequence once, under its least entry."""
    return library.where(F.length("sequence") > 0).groupBy("sequence").agg(F.min("entry").alias("entry"))


def longest_prefixes(texts: DataFrame, library: DataFrame) -> DataFrame:
    """(id, start, length, entry): the longest piece of ``library`` at every position (from 1) that has one.

    A position's first letters, as many as the shortest piece has, must begin some piece; only
    those that do are tried with the other lengths.
    """
    pieces = _pieces(library)
    lengths = [r.n for r in pieces.select(F.length("sequence").alias("n")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"a library has pieces of {MOST_LENGTHS} lengths at most")
    short, long = min(lengths, default=1), max(lengths, default=1)
    places = texts.where(F.length("sequence") >= short).select("id", "sequence", F.explode(F.sequence(F.lit(1), F.length("sequence") - (short - 1))).alias("start"))
    heads = places.select("id", "start", F.col("sequence").substr(F.col("start"), F.lit(long)).alias("head"))
    stems = pieces.select(F.substring("sequence", 1, short).alias("stem")).distinct()
    able = heads.withColumn("stem", F.substring("head", 1, short)).join(stems, "stem", "left_semi")
    tried = able.select("id", "start", "head", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length")).where(F.length("head") >= F.col("length"))
    found = tried.select("id", "start", "length", F.col("head").substr(F.lit(1), F.col("length")).alias("sequence")).join(pieces, "sequence")
    return found.groupBy("id", "start").agg(F.max("length").alias("length"), F.max_by("entry", "length").alias("entry"))


#: Letters of a library up to which each task holds it as a tree of beginnings; and letters of texts tiled side by side.
MOST_LETTERS, TOGETHER = 1 << 19, 1 << 20


class _Tree:
    """Pieces by their beginnings: each node is a beginning, found by its parent and the next letter."""

    def __init__(self, pieces: list[tuple[str, int]]):
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, int]] = {}
        for sequence, entry in pieces:
            at = 0
            for c in sequence:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = (len(sequence), entry)
        keys = np.array([parent << 21 | c for parent, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.length, self.entry = np.zeros(len(nodes) + 1, np.int32), np.zeros(len(nodes) + 1, np.int64)
        for node, (size, entry) in ends.items():
            self.length[node], self.entry[node] = size, entry
        self.first = np.zeros(1 << 21, bool)
        self.first[self.keys[self.keys < 1 << 21]] = True

    def longest(self, letters: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, entry) of the longest piece at each place that has one; ``last`` is the end of a place's text."""
        place = np.flatnonzero(self.first[letters])
        node, best, depth, start = np.zeros(len(place), np.int64), np.zeros(len(letters), np.int64), 0, place
        while len(place):
            key = node << 21 | letters[place + depth]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            fits = self.keys[at] == key
            place, node = place[fits], self.nodes[at[fits]]
            ends = self.length[node] > 0
            best[place[ends]] = node[ends]
            depth += 1
            more = place + depth < last[place]
            place, node = place[more], node[more]
        found = start[best[start] > 0]
        return found, self.length[best[found]], self.entry[best[found]]


def _walk(starts: list[int], lengths: list[int], at: int, gap: int) -> list[int]:
    """Which of the places that have a piece are tiles, walking from ``at``."""
    kept = []
    for i, start in enumerate(starts):
        if start >= at and (start - at) % gap == 0:
            kept.append(i)
            at = start + lengths[i]
    return kept


def _tiled(texts: list[str], tree: _Tree, gap: int) -> tuple[np.ndarray, ...]:
    """(text's place, start, length, whether it is a piece, entry or -1) of all tiles of texts that are not empty."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    place, length, entry = tree.longest(letters, np.repeat(ends, sizes))
    cuts = np.searchsorted(place, np.append(0, ends)).tolist()
    begins, kept = (ends - sizes).tolist(), []
    for i, begin in enumerate(begins):
        low, high = cuts[i], cuts[i + 1]
        kept += [low + j for j in _walk(place[low:high].tolist(), length[low:high].tolist(), begin, gap)]
    place, length, entry = place[kept], length[kept].astype(np.int64), entry[kept]
    # what lies before each piece, and after the last of each text, is gaps
    stops = np.concatenate([place, ends])
    order = np.argsort(stops * 2 + np.append(np.zeros(len(place), np.int64), np.ones(len(ends), np.int64) * -1), kind="stable")
    after = np.concatenate([place + length, ends])[order]
    stops, free_from = stops[order], np.append(0, after[:-1])
    count = -(-(stops - free_from) // gap)
    index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(free_from, count) + index * gap
    size = np.minimum(gap, np.repeat(stops, count) - start)
    start, size, entry = np.concatenate([start, place]), np.concatenate([size, length]), np.concatenate([np.full(len(start), -1), entry])
    row = np.searchsorted(ends, start, side="right")
    return row, start - (ends - sizes)[row] + 1, size, np.append(np.zeros(len(start) - len(place), bool), np.ones(len(place), bool)), entry


def _tile_here(texts: DataFrame, pieces: DataFrame, gap: int) -> DataFrame:
    """``tile`` with the library in each task: one walk over each text."""
    rows = [(r.sequence, r.entry) for r in pieces.collect()]
    entries = pa.array([e for _, e in rows], to_arrow_type(pieces.schema["entry"].dataType))
    held = texts.sparkSession.sparkContext.broadcast((_Tree([(s, i) for i, (s, _) in enumerate(rows)]), entries))
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def run(batches):
        tree, entries = held.value
        for batch in batches:
            strings, low, size = batch[1].to_pylist(), 0, 0
            for high in range(1, len(strings) + 1):
                size += len(strings[high - 1])
                if size >= TOGETHER or high == len(strings):
                    row, start, length, piece, entry = _tiled(strings[low:high], tree, gap)
                    yield pa.RecordBatch.from_arrays([
                        batch[0].take(pa.array(row + low)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), entries.take(pa.array(entry, mask=~piece))
                    ], ["id", "start", "length", "entry"])
                    low, size = high, 0

    return texts.mapInArrow(run, f"id {kind(texts, 'id')}, start int, length int, entry {kind(pieces, 'entry')}")


def tile(texts: DataFrame, library: DataFrame, gap: int = 1) -> DataFrame:
    """(id, start, length, entry): each of ``texts`` (id, sequence) cut greedily, left to right, into pieces.

    At each place the longest piece of ``library`` (entry, sequence) that fits is taken, of equal
    pieces the least entry. Where none does, the next ``gap`` letters (or what is left) are a
    tile of entry null. Null and empty texts have no tile; ids must be unique and not null; an
    empty library leaves gaps only. A library of up to ``MOST_LETTERS`` letters is held by each
    task, which walks its texts; with a larger one texts are tiled in rounds of joins.
    """
    if gap < 1:
        raise ValueError("a gap has one letter or more")
    texts = texts.where("id is not null").select("id", "sequence").where(F.length("sequence") > 0)
    pieces = settled(_pieces(library))
    if (pieces.agg(F.sum(F.length("sequence"))).first()[0] or 0) <= MOST_LETTERS:
        return _tile_here(texts, pieces, gap)
    return _tile_in_rounds(texts, library, gap)


def _tile_in_rounds(texts: DataFrame, library: DataFrame, gap: int) -> DataFrame:
    sizes = texts.select("id", F.length("sequence").alias("size"))
    found = settled(longest_prefixes(texts, library))
    every = sizes.select("id", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("start"))
    after = every.join(found, ["id", "start"], "left").select("id", "start", "size", (F.col("start") + F.coalesce("length", F.lit(gap))).alias("next"))
    leaps = settled(after.where("next <= size").select("id", "start", "next"))
    reached = sizes.select("id", F.lit(1).alias("start"))
    while not leaps.isEmpty():
        reached = settled(reached.unionByName(reached.join(leaps, ["id", "start"]).select("id", F.col("next").alias("start"))))
        second = leaps.select("id", F.col("start").alias("next"), F.col("next").alias("then"))
        leaps = settled(leaps.join(second, ["id", "next"]).select("id", "start", F.col("then").alias("next")))
    left = F.col("size") - F.col("start") + 1
    tiles = reached.join(found, ["id", "start"], "left").join(sizes, "id")
    return tiles.select("id", "start", F.coalesce("length", F.least(F.lit(gap), left)).alias("length"), "entry")


def _changed(a: str, b: str, size: int) -> Column:
    """Letters in which two strings of ``size`` letters differ."""
    differs = lambda i: F.when(F.substring(a, i, 1) == F.substring(b, i, 1), 0).otherwise(1)
    return reduce(lambda x, y: x + y, map(differs, range(1, size + 1)))


def _segments(rows: DataFrame, column: str, size: int, parts: int) -> DataFrame:
    edges = [size * i // parts for i in range(parts + 1)]
    cut = [F.struct(F.lit(i).alias("part"), F.substring(column, low + 1, high - low).alias("piece")) for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False))]
    return rows.select("*", F.explode(F.array(*cut)).alias("segment")).select(*rows.columns, "segment.part", "segment.piece")


def _masked(rows: DataFrame, column: str, size: int, places: int) -> DataFrame:
    """A row for each choice of that many places: which they are (mask), and the string without what stands there (piece)."""
    out = rows.select("*", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("at"), F.col(column).alias("piece"))
    for rest in reversed(range(places)):
        out = out.withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.lit(size - rest))))
        piece = F.concat(F.col("piece").substr(F.lit(1), F.col("at") - 1), F.lit("\0"), F.col("piece").substr(F.col("at") + 1, F.lit(size)))
        out = out.select(*rows.columns, F.col("mask").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("mask"), "at", piece.alias("piece"))
    return out.drop("at")


def _neighbours(pieces: DataFrame, size: int, letters: list[str]) -> DataFrame:
    """(block, entry): every string one of ``letters`` away from a piece, with the least entry."""
    each = pieces.select("entry", "sequence", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("at")).select("*", F.explode(F.array(*map(F.lit, letters))).alias("letter"))
    block = F.concat(F.col("sequence").substr(F.lit(1), F.col("at") - 1), F.col("letter"), F.col("sequence").substr(F.col("at") + 1, F.lit(size)))
    return each.select(block.alias("block"), "entry").groupBy("block").agg(F.min("entry").alias("entry"))


def _pairs(a: DataFrame, b: DataFrame) -> int:
    """How many pairs a join on (part, piece) makes."""
    n = lambda d, name: d.groupBy("part", "piece").agg(F.count(F.lit(1)).cast("double").alias(name))
    return n(a, "x").join(n(b, "y"), ["part", "piece"]).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def nearest(blocks: DataFrame, library: DataFrame, most: int | None = None) -> DataFrame:
    """(block, entry, changed): for each distinct block the piece with the fewest letters changed, of equally near ones the least entry.

    Exact, by a widening radius; only blocks that no piece is so near to go on. Each wave takes
    the way that makes the fewest rows, as counted before it: the strings one letter around the
    pieces (radius 1); both sides without r of their letters, for each choice of these, where
    the least entry of a key is enough, so a crowded library makes no pairs; segments, of which
    pieces within r letters of a block equal one in r + 1; or the letters that a block shares
    with each piece, where what shares none takes the least entry, which ends the search.
    With ``most``, blocks without a piece that near are left out, and the last wave is spared if
    the others reach that far. All pieces and blocks have one length; others, null included, are an error.
    """
    pieces = settled(_pieces(library))
    distinct = settled(blocks.select("block").distinct())
    low, high, nulls = pieces.select(F.length("sequence").alias("n")).unionByName(distinct.select(F.length("block").alias("n"))).agg(F.min("n"), F.max("n"), F.count_if(F.isnull("n"))).first()
    if low != high or nulls:
        raise ValueError("pieces and blocks must have one length")
    if low is None or pieces.isEmpty():
        return distinct.limit(0).select("block", F.lit(None).cast("long").alias("entry"), F.lit(0).alias("changed"))
    size, most = low, low if most is None else most
    found = [distinct.join(pieces.withColumnRenamed("sequence", "block"), "block").select("block", "entry", F.lit(0).alias("changed"))]
    left = settled(distinct.join(found[0].select("block"), "block", "left_anti"))
    best = F.min(F.struct("changed", "entry")).alias("best")
    letters = [r.c for r in left.select(F.explode(F.split("block", "")).alias("c")).distinct().limit(65).collect()]
    known, limit, reach = pieces.count(), min(most, size), 0
    # the planner does not see that rows are multiplied, and would broadcast what looks small: the waves' joins are told to merge
    while reach < limit and (n := left.count()):
        near, wide = reach + 1, min(max(2 * reach, 1), limit)
        costs = {"shared": n * known * size}
        if size <= 62:
            costs["masked"] = comb(size, near) * (n + known)
        if reach == 0 and len(letters) <= 64:
            costs["around"] = known * size * len(letters) + n
        if (wide + 1) * 2 <= size:
            a, b = _segments(left, "block", size, wide + 1), _segments(pieces, "sequence", size, wide + 1)
            costs["segments"] = _pairs(a, b) + (n + known) * (wide + 1)
        way = min(costs, key=costs.get)
        if way == "shared":
            a, b = _segments(left, "block", size, size), _segments(pieces, "sequence", size, size)
            shared = a.join(b.hint("merge"), ["part", "piece"]).groupBy("block", "sequence", "entry").agg((F.lit(size) - F.count(F.lit(1))).cast("int").alias("changed"))
            some = settled(shared.groupBy("block").agg(best).select("block", "best.entry", "best.changed"))
            none = left.join(some.select("block"), "block", "left_anti").join(F.broadcast(pieces.agg(F.min("entry").alias("entry")))).select("block", "entry", F.lit(size).alias("changed"))
            found.append(some.unionByName(none).where(F.col("changed") <= most))
            break
        if way == "segments":
            wave = a.join(b.hint("merge"), ["part", "piece"]).select("block", "entry", _changed("block", "sequence", size).alias("changed")).where(F.col("changed") <= wide)
            wave, reach = wave.groupBy("block").agg(best).select("block", "best.entry", "best.changed"), wide
        elif way == "around":
            wave, reach = left.join(_neighbours(pieces, size, letters).hint("merge"), "block").select("block", "entry", F.lit(near).alias("changed")), near
        else:
            keys = _masked(pieces.select("entry", "sequence"), "sequence", size, near).groupBy("mask", "piece").agg(F.min("entry").alias("entry"))
            wave = _masked(left, "block", size, near).join(keys.hint("merge"), ["mask", "piece"]).groupBy("block").agg(F.min("entry").alias("entry"))
            wave, reach = wave.select("block", "entry", F.lit(near).alias("changed")), near
        found.append(settled(wave))
        left = settled(left.join(found[-1].select("block"), "block", "left_anti"))
    out = found[0]
    for wave in found[1:]:
        out = out.unionByName(wave)
    return out
