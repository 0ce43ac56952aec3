"""MinHash near-duplicate linking, candidates checked by odd sketches.

A document's set is its distinct five-word shingles. ``bands`` x ``rows`` MinHash samples give
every distinct set that many band keys, and two sets that share a key are candidates. All
samples of a set are also folded into one odd sketch: a bitmap in which each (sample, value)
flips a bit, so what two sets have in common cancels out and the ones in the XOR of their
sketches tell how many samples differ. At high similarity few do, which is where the count is
sharpest. A candidate pair is dropped only where the count lies above ``sketch_bound``, which a
pair of the wanted similarity exceeds with a chance of 10**-9; the others are confirmed by the
Jaccard similarity of their full sets. With 56 bands of 8 samples a pair of 0.85 shares no band
with a chance of 2 * 10**-8; that is the only way to lose a link, at any number of documents.

Copies are folded into one distinct set first. Each bucket's members are compared with its
least id, a few bands at a time, unless they are in one component already; those that this leaves in another component than the least id's are compared with
all members of other components, in blocks of about ``block`` rows that are spread over the
tasks, where a pair becomes a row only if sizes and sketches pass, only if what the sets' rare
ends have in common lets them be alike, and only in the first band that it shares. Nothing
is capped; pairs within one component are implied.

Defined cases: a set of fewer words is the whole sequence as one shingle; null, empty and blank
texts have no shingle and are linked with nothing; ties and repeated rows share a component;
rows that share an id are one document as far as links go; a null id names no component unless
its whole component has none; very long texts are read in blocks of words; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, discard, documents, mix64, rolling, span_hashes, store, text_bytes, word_spans
from .graph import components
from .simhash import frequent_shingles, marks, shingle_sets, similar_pairs

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS, _SHINGLES = Powers(0x2545F4914F6CDD1D), Powers(0x5851F42D4C957F2D)


# One set -----------------------------------------------------------------------


def shingles(data: bytes, width: int = 5, block: int = 1 << 20) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted."""
    raw = np.frombuffer(data, np.uint8)
    held = np.zeros(0, np.uint64)
    found = []
    starts, ends = word_spans(raw)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block)))
        part = _LOWER[raw[starts[at] : ends[to - 1]]]
        held = np.concatenate([held, span_hashes(part, starts[at:to] - starts[at], ends[at:to] - starts[at], _WORDS)])
        if len(held) >= width:
            found.append(np.unique(rolling(held, width, _SHINGLES)))
            held = held[len(held) - width + 1 :]
        at = to
    if not found and len(held):
        found.append(rolling(held, len(held), _SHINGLES))
    return np.unique(np.concatenate(found)) if found else held


@cache
def _family(samples: int) -> tuple[np.ndarray, np.ndarray]:
    draw = mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (draw[:samples] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draw[samples:] >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples of a set that is not empty: the least value under each of ``samples`` permutations."""
    times, plus = _family(samples)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (short[at : at + 256, None] * times + plus).min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band's samples and number."""
    table = samples.reshape(bands, -1).astype(np.uint64)
    weights = mix64(np.arange(11, 11 + table.shape[1], dtype=np.uint64)) | np.uint64(1)
    return mix64(mix64(table * weights).sum(axis=1, dtype=np.uint64) + mix64(np.arange(101, 101 + bands, dtype=np.uint64)))


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity, bit by bit, of the (sample, value) pairs hashed to it, as 64-bit words."""
    placed = mix64(samples.astype(np.uint64) + (np.arange(1, len(samples) + 1, dtype=np.uint64) << np.uint64(32)))
    parity = np.bincount((placed % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def estimate(ones: float, samples: int, bits: int) -> float:
    """The similarity that ``ones`` set bits in the XOR of two sketches stand for."""
    if 2 * ones >= bits:
        return 0.0
    return max(0.0, 1.0 + bits / (4.0 * samples) * log(1.0 - 2.0 * ones / bits))


@cache
def sketch_bound(samples: int, bits: int, share: Fraction, miss: float = 1e-9) -> int:
    """The ones that two sets of similarity ``share`` exceed with a chance of at most ``miss``.

    Of the samples a binomial number differs; each that does flips two bits, and the number of
    ones after so many flips is a walk whose distribution is followed step by step.
    """
    p = float(1 - share)
    ones = np.zeros(bits + 1)
    ones[0] = 1.0
    up = 1.0 - np.arange(bits + 1) / bits
    total = np.zeros(bits + 1)
    for differ in range(samples + 1):
        chance = np.exp(lgamma(samples + 1) - lgamma(differ + 1) - lgamma(samples - differ + 1) + differ * log(p) + (samples - differ) * log(1 - p)) if p else float(differ == 0)
        total += chance * ones
        for _ in range(2):
            moved = np.zeros_like(ones)
            moved[1:] += ones[:-1] * up[:-1]
            moved[:-1] += ones[1:] * (1.0 - up[1:])
            ones = moved
    tail = np.cumsum(total[::-1])[::-1]  # tail[t]: t ones or more
    return int(np.flatnonzero(tail > miss).max(initial=0))


# Tables ------------------------------------------------------------------------

_BITS = 512
_SKETCH = [f"s{i}" for i in range(_BITS // 64)]


def signatures(docs: DataFrame, bands: int, rows: int, width: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, n, h, g, s0.., bands) a row: size and 128-bit hash of its set, odd sketch, band keys; bands is null for an empty set."""
    names = ["doc_id", "n", "h", "g", *_SKETCH, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, marks, sketches, keys = [], [], [], []
                for text in part.column(1):
                    hashes = shingles(text.as_py() or b"", width)
                    sizes.append(len(hashes))
                    up, _ = _SHINGLES.get(len(hashes) + 1)
                    marks.append((int(mix64(hashes.copy()).sum(dtype=np.uint64)), int((hashes * up[1:]).sum(dtype=np.uint64))))
                    if len(hashes):
                        least = minima(hashes, bands * rows)
                        sketches.append(odd_sketch(least, _BITS))
                        keys.append(band_keys(least, bands).view(np.int64))
                    else:
                        sketches.append(np.zeros(len(_SKETCH), np.uint64))
                        keys.append(None)
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                words = np.array(sketches, np.uint64).T
                columns = [part.column(0), pa.array(sizes, pa.int64()), *(long([m[i] for m in marks]) for i in (0, 1)), *(long(w) for w in words)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], names)

    schema = ", ".join(f"{c} long" for c in names[:-1]) + ", bands array<long>"
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("t")).mapInArrow(run, schema)


def _passes(share: Fraction, bound: int, a: str, b: str) -> Column:
    """Whether sizes and sketches let the rows ``a`` and ``b`` be alike."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    ones = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    return (F.least(n, m) * share.denominator >= F.greatest(n, m) * share.numerator) & (ones <= bound)


def prefixes(texts: DataFrame, ids: DataFrame, share: Fraction, width: int) -> DataFrame:
    """(id, prefix): of the ``ids``, the first n - ceil(share * n) + 1 of n shingles in one order of all shingles.

    Sets that are ``share`` alike have one of these in common. Shingles frequent in a sample
    come last, which decides how much this prunes and nothing else.
    """
    common = frequent_shingles(texts, width)
    order = np.argsort(common)
    known, late = common[order], order + 1
    up, down = share.numerator, share.denominator

    def first(hashes: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            rank = np.where(known[at] == hashes, late[at], 0)
        return hashes[np.lexsort((hashes, rank))][: len(hashes) + up * len(hashes) // -down + 1]

    return shingle_sets(texts, width, first, marks(ids)).select("id", F.col("keys").alias("prefix"))


def _apart(held: DataFrame, roots: DataFrame, mark: bool = False) -> DataFrame:
    """``held`` (.., id, first) with root: rows in another component than their bucket's first, or all, marked ``out``."""
    own = held.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    both = own.join(roots.select(F.col("id").alias("first"), F.col("root").alias("main")), "first", "left")
    out = F.col("root") != F.coalesce("main", "first")
    return both.withColumn("out", out).drop("main") if mark else both.where(out)


def similar_links(docs: DataFrame, sets: DataFrame, share: Fraction, bound: int, width: int, block: int, id_column: str, text_column: str, rounds: tuple[int, ...] = (0, 4, 16)) -> DataFrame:
    """(u, v) links whose components are those of all pairs of ``sets`` (id, n, sketch, bands) that are ``share`` alike.

    Bands are taken in ``rounds``: what the first few have brought into one component is not
    compared with the firsts of the others' buckets again.
    """
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("t"))
    entries = sets.select("id", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    held = store(entries.join(shared.select("key", "first"), "key"))
    light = sets.select("id", "n", *_SKETCH)
    found, tested, scraps = None, None, []
    roots = sets.select("id", F.col("id").alias("root")).limit(0)
    for low, high in zip(rounds, [*rounds[1:], None], strict=True):
        some = held.where((F.col("band") >= low) & (F.col("band") < high)) if high else held.where(F.col("band") >= low)
        stars = _apart(some.where("first < id"), roots).select(F.col("first").alias("u"), F.col("id").alias("v")).distinct()
        if tested is not None:
            stars = stars.join(tested, ["u", "v"], "left_anti")
        both = stars.join(light.alias("a"), F.col("u") == F.col("a.id")).join(light.alias("b"), (F.col("v") == F.col("b.id")) & _passes(share, bound, "a", "b"))
        stars = store(both.select("u", "v"))
        links = similar_pairs(texts, stars, share, width)
        scraps += [stars, links]
        tested = stars if tested is None else tested.unionByName(stars)
        found = links if found is None else found.unionByName(links)
        roots = components(found).select(F.col("node").alias("id"), "root")
    placed = store(_apart(held, roots, True))
    parts = lambda c: F.ceil(F.col(c) / block)
    split = placed.groupBy("key").agg(F.sum(F.col("out").cast("long")).alias("k"), F.count(F.lit(1)).alias("c")).where("k > 0 and c > 2")
    open_ = store(placed.join(split.select("key", parts("k").alias("i"), parts("c").alias("j")), "key"))
    heads = store(prefixes(texts, open_.select("id"), share, width))
    scraps, open_ = [*scraps, open_, heads], open_.join(sets, "id").join(heads, "id")
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).alias(c)
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).alias(c)
    kept = ["key", "id", "first", "root", "out", "n", *_SKETCH, "bands", "prefix"]
    a = open_.where("out").select(*kept, own("i"), every("j")).alias("a")
    b = open_.select(*kept, every("i"), own("j")).alias("b")
    once = F.col("a.key") == F.element_at(F.array_intersect("a.bands", "b.bands"), 1)  # keys hold the band's number
    # what two sets share beyond both prefixes follows the one that ends first in the common order
    beyond = F.greatest(F.col("a.n") - F.size("a.prefix"), F.col("b.n") - F.size("b.prefix"))
    most = F.size(F.array_intersect("a.prefix", "b.prefix")) + beyond
    may = most * (share.numerator + share.denominator) >= (F.col("a.n") + F.col("b.n")) * share.numerator
    near = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.i") == F.col("b.i"))
        & (F.col("a.j") == F.col("b.j"))
        & (F.col("a.root") != F.col("b.root"))
        & (~F.col("b.out") | (F.col("a.id") < F.col("b.id")))
        & _passes(share, bound, "a", "b")
        & may
        & once,
    )
    near = near.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()
    near = store(near.join(tested, ["u", "v"], "left_anti"))
    links = store(found.unionByName(similar_pairs(texts, near, share, width)))
    discard(held, placed, near, *scraps)
    return links


def near_components(docs: DataFrame, similarity: float = 0.85, bands: int = 56, rows: int = 8, width: int = 5, block: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per row: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    share = Fraction(str(similarity))
    bound = sketch_bound(bands * rows, _BITS, share)
    made = store(signatures(docs, bands, rows, width, id_column, text_column))
    some = [F.first(c).alias(c) for c in (*_SKETCH, "bands")]
    sets = store(made.where("n > 0").groupBy("h", "g", "n").agg(F.min("doc_id").alias("id"), *some))
    named = sets.where("id is not null")
    links = similar_links(docs, named, share, bound, width, block, id_column, text_column)
    roots = components(links).select(F.col("node").alias("id"), F.col("root").alias("component_id"))
    labels = sets.select("h", "g", "n", "id").join(roots, "id", "left").select("h", "g", "n", F.coalesce("component_id", "id").alias("component_id"))
    out = made.select("doc_id", "n", "h", "g").join(labels, ["h", "g", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = store(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    discard(made, sets, links)
    return out


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))
