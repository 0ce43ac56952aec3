"""Best-fit packing by a configuration linear program over the length histogram.

Documents become token ids (a public tokenizer, then an end id) and are cut into pieces of
at most ``capacity`` tokens. Only the histogram of piece lengths, at most ``capacity`` rows,
goes to the driver. There the configuration LP (a configuration: how many pieces of each
length share a sequence) is solved by multiplicative weights: a length's dual value starts
at its length and falls as it gets covered, and each round prices the most valuable
configuration with an unbounded-knapsack dynamic program. The fractional solution is rounded
down, and what is left is placed best fit, longest first, on the histogram.

The solution is a table of slots by (length, rank): at most a few per configuration and
length, so its size is bounded by the capacity and the number of rounds, not by the data, and
it is broadcast. Each piece gets its rank among pieces of its length from distributed
counts: (length, hash cell) groups are numbered inside, and shifted by a running sum over
the cells of the length. No group of pieces meets in one task.

Defined cases: a null or empty text is its end id alone; a document of exactly the capacity
is one piece; repeated rows are packed once each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, settle, text_bytes, tokenizer_path, word_blocks

CAPACITY = 4096
_MARKS = frozenset(bytes([c]) for c in b".,!?;:")
_WORDS: dict[bytes, bytes] = {}
_TOKENIZER: dict[str, object] = {}


def token_ids(blocks: list[list[bytes]], path: str, most_words: int) -> list[bytes]:
    """Little-endian 32-bit ids of each list of words.

    White space never joins or splits tokens of this vocabulary's kind (it drops it), so a
    text's ids are its words' ids in order, and a word's ids are remembered. Letters and a
    mark after them are tokens of their own, so a word before a mark is remembered without
    it. The memory is emptied when it holds ``most_words``; nothing else depends on it.
    """
    if path not in _TOKENIZER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZER[path] = Tokenizer.from_file(path)
        _WORDS.clear()
    known = _WORDS
    if len(known) > most_words:
        known.clear()
    new = {w for words in blocks for w in words if w not in known}
    ended = [w for w in new if w[-1:] in _MARKS and w[:-1].decode().lower().isalpha()]
    new.difference_update(ended)
    new.update(x for w in ended for x in (w[:-1], w[-1:]) if x not in known)
    new = list(new)
    for at in range(0, len(new), 10_000):
        part = new[at : at + 10_000]
        made = _TOKENIZER[path].encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
        known.update(zip(part, (np.array(e.ids, np.uint32).tobytes() for e in made), strict=True))
    known.update((w, known[w[:-1]] + known[w[-1:]]) for w in ended)
    return [b"".join(map(known.__getitem__, words)) for words in blocks]


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, most_words: int = 800_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), a row a piece.

    ``most_words``: words whose ids a Python worker remembers (some 200 bytes each).
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        path = tokenizer_path(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(at, 512).to_pylist()
                texts = [t or b"" for t in batch.column(1).slice(at, 512).to_pylist()]
                # the vocabulary is lower case; a text that may name a special token stays as it is
                texts = [t if b"<|" in t else t.lower() for t in texts]
                blocks = [list(word_blocks(t)) for t in texts]
                made = iter(token_ids([b for bs in blocks for b in bs], path, most_words))
                rows = []
                for doc_id, bs in zip(ids, blocks, strict=True):
                    raw = b"".join([next(made) for _ in bs] + [end])
                    total, step = len(raw) // 4, 4 * capacity
                    rows += [(doc_id, i, i * capacity, min(capacity, total - i * capacity), zlib.crc32(raw[i * step : (i + 1) * step])) for i in range(-(-total // capacity))]
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("t"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_configuration(value: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths of the most value that fits: unbounded knapsack by dynamic program.

    value[l] is the worth of a piece of length l (0 where there is none).
    """
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = best[c - 1 :: -1] + value[1 : c + 1]
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], take[c] = worth[i], i + 1
        else:
            best[c], take[c] = best[c - 1], 0
    found: Counter = Counter()
    c = capacity
    while c > 0:
        if take[c]:
            found[int(take[c])] += 1
            c -= int(take[c])
        else:
            c -= 1
    return found


def solve(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 160, rate: float = 2.0) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Configurations with multiplicities that place every piece; counts[l] pieces of length l."""
    left = counts.astype(np.int64).copy()
    plan: Counter = Counter()
    if left[capacity]:
        plan[((capacity, 1),)] += int(left[capacity])
        left[capacity] = 0
    lengths = np.arange(capacity + 1)
    demand = np.maximum(left, 1).astype(np.float64)
    covered = np.zeros(capacity + 1)
    fraction: dict[tuple, float] = defaultdict(float)
    if left.sum() > 1:
        for _ in range(rounds):
            dual = np.where((left > 0) & (covered < 1.0), lengths * np.exp(-rate * covered), 0.0)
            if not dual.any():
                break
            config = best_configuration(dual, capacity)
            step = min(max(1.0 - covered[n], 0.0) * demand[n] / k for n, k in config.items())
            fraction[tuple(sorted(config.items(), reverse=True))] += step
            for n, k in config.items():
                covered[n] += k * step / demand[n]
    for config, amount in sorted(fraction.items(), key=lambda x: (-sum(n * k for n, k in x[0]), x[0])):
        times = min([int(amount + 1e-9), *(int(left[n]) // k for n, k in config)])
        if times > 0:
            plan[config] += times
            for n, k in config:
                left[n] -= k * times
    plan.update(_best_fit(left, capacity))
    return sorted(plan.items())


def _best_fit(left: np.ndarray, capacity: int) -> Counter:
    """Best fit decreasing on a histogram: sequences with equal contents are handled together."""
    open_: list[Counter] = [Counter() for _ in range(capacity + 1)]  # by space left: contents -> how many
    free = np.zeros(capacity + 1, bool)
    for n in np.flatnonzero(left)[::-1]:
        n, rest = int(n), int(left[n])
        while rest:
            at = n + int(free[n:].argmax())
            if not free[at]:
                per = min(capacity // n, rest)
                times = max(rest // per, 1)
                group, config, space = times, ((n, per),), capacity - n * per
                rest -= per * times
            else:
                old, have = next(iter(open_[at].items()))
                per = min(at // n, rest)
                group = min(have, rest // per)
                if have == group:
                    del open_[at][old]
                else:
                    open_[at][old] -= group
                free[at] = bool(open_[at])
                config, space = (*old, (n, per)), at - n * per
                rest -= per * group
            open_[space][config] += group
            free[space] = True
    done: Counter = Counter()
    for group in open_:
        done.update(group)
    return done


def slots(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[str, np.ndarray]:
    """Where rank r of length n goes: rows sorted by (length, first rank)."""
    rows, cursor, sequence = [], Counter(), 0
    for config, times in plan:
        offset = 0
        for n, k in config:
            rows.append((n, cursor[n], k, sequence, offset))
            cursor[n] += k * times
            offset += n * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "per", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY, cells: int = 1024, rounds: int = 160, **options) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    made = settle(pieces(docs, capacity=capacity, **options))
    histogram = made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    table = slots(solve(counts, capacity, rounds))
    spread = docs.sparkSession.sparkContext.broadcast(table)
    keyed = made.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("cell", F.pmod("key", F.lit(cells)))
    sizes = keyed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "cell").orderBy("key", "doc_id", "piece", "ids_crc32")
    ranked = keyed.join(shift, ["length", "cell"]).withColumn("rank", F.col("shift") + F.row_number().over(inside) - 1)

    def place(batches):
        t = spread.value
        for batch in batches:
            n, rank = (batch.column(i).to_numpy() for i in (3, 5))
            lo = np.searchsorted(t["length"], n)
            hi = np.searchsorted(t["length"], n, side="right")
            while (wide := lo < hi).any():  # the last row of the length whose first rank is <= rank
                mid = (lo + hi) // 2
                over = t["first"][np.minimum(mid, len(t["first"]) - 1)] > rank
                hi = np.where(wide & over, mid, hi)
                lo = np.where(wide & ~over, mid + 1, lo)
            at = lo - 1
            nth = rank - t["first"][at]
            sequence = pa.array(t["sequence"][at] + nth // t["per"][at])
            offset = pa.array(t["offset"][at] + nth % t["per"][at] * n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], sequence, offset], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
