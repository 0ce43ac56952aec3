"""SimHash near-duplicate linking by pigeonring filtering.

A 64-bit fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles.
Two fingerprints link when at most ``most_bits`` (2) bits differ. The fingerprint, laid out
as a ring of seven segments, must then hold a start from which every chain of l consecutive
segments differs in at most l*2/7 bits (pigeonring principle): the first three segments
agree exactly, the first six differ in at most one bit. So each distinct fingerprint is
entered seven times, under 27 or 28 exact bits, and pairs of a bucket are pruned by the
chain budgets before the full Hamming check.

Copies are folded into one distinct fingerprint first. A bucket of more than ``most_pairs``
distinct fingerprints is not paired up: its members are entered under themselves and under
each of their one-bit changes outside the exact segments. Two fingerprints differ in at most
two bits exactly when two such entries meet, and all that meet at an entry are within two
bits of each other, so linking each to the smallest is exact and linear in the bucket.

Defined cases: null and empty texts have fingerprint zero and link like any other; repeated
rows share a component; a null id is ignored as a component's name unless alone; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, discard, documents, settle, store, text_bytes, word_blocks
from .graph import components

SEGMENTS = (9, 9, 9, 9, 9, 9, 10)


def simhash(data: bytes, width: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """Majority of the shingles' hashes, bit by bit; a tie gives 0."""
    ones, count = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    digest = xxhash.xxh64_intdigest

    def add(hashes: Iterator[int]) -> int:
        seen = 0
        while True:
            part = np.fromiter(islice(hashes, block), np.uint64)
            if not len(part):
                return seen
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add(ones, bits.sum(axis=0, dtype=np.uint32), out=ones)
            seen += len(part)

    for words in word_blocks(data):
        held += (w.lower() for w in words)
        if len(held) >= width:
            shingles = map(b" ".join, zip(*(islice(held, i, None) for i in range(width)), strict=False))
            count += add(map(digest, shingles, repeat(seed)))
            held = held[len(held) - width + 1 :]
    if not count and held:
        count = add(map(digest, [b" ".join(held)], repeat(seed)))
    majority = np.flatnonzero(ones * 2 > count)
    return sum(1 << int(b) for b in majority)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            found = [simhash(t.as_py() or b"", width) for t in batch.column(1)]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _rotated(fp: Column, start: int) -> Column:
    if not start:
        return fp
    return F.shiftrightunsigned(fp, start).bitwiseOR(F.shiftleft(fp, 64 - start))


def links(distinct: DataFrame, most_pairs: int = 128) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) that differ in at most 2 bits.

    Every link is implied: hot buckets give stars whose arms may be two bits apart.
    """
    entries, inner = [], []
    for i in range(7):
        start, exact = sum(SEGMENTS[:i]), sum(SEGMENTS[(i + j) % 7] for j in range(3))
        chain = exact + sum(SEGMENTS[(i + j) % 7] for j in range(3, 6))
        ring = _rotated(F.col("fp"), start)
        low = ring.bitwiseAND(F.lit((1 << exact) - 1))
        entries.append(F.struct(F.lit(i).alias("seg"), low.alias("low"), ring.alias("ring")))
        inner.append((exact, chain))
    members = distinct.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.seg", "e.low", "e.ring")
    crowded = members.groupBy("seg", "low").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = members.join(crowded, ["seg", "low"])
    cold = members.where(F.col("n") <= most_pairs)
    a, b = cold.alias("a"), cold.alias("b")
    differ = F.col("a.ring").bitwiseXOR(F.col("b.ring"))
    budget = F.lit(None).cast("long")
    for i, (_, chain) in enumerate(inner):
        budget = F.when(F.col("a.seg") == i, F.lit((1 << chain) - 1)).otherwise(budget)
    near = (
        a.join(
            b,
            (F.col("a.seg") == F.col("b.seg"))
            & (F.col("a.low") == F.col("b.low"))
            & (F.col("a.fp") < F.col("b.fp"))
            & (F.bit_count(differ.bitwiseAND(budget)) <= 1)
            & (F.bit_count(differ) <= 2),
        )
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    changes = F.lit(None).cast("array<long>")
    for i, (exact, _) in enumerate(inner):
        flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(exact, 64)])
        changes = F.when(F.col("seg") == i, flips).otherwise(changes)
    hot = (
        members.where(F.col("n") > most_pairs)
        .select("fp", "seg", "ring", F.explode(changes).alias("flip"))
        .select("fp", "seg", F.col("ring").bitwiseXOR(F.col("flip")).alias("at"))
    )
    centre = hot.groupBy("seg", "at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("seg", "at", "v")
    stars = hot.join(centre, ["seg", "at"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return near.unionByName(stars).distinct()


def near_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, most_pairs: int = 128) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included."""
    prints = settle(fingerprints(docs, id_column, text_column, width))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), most_pairs)).select(F.col("node").alias("fp"), "root")
    joined = settle(distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


# Similarity of word shingles -------------------------------------------------
#
# The stage that drops near copies takes the components of the fingerprints' links first. Texts
# whose five-word shingles agree to 0.8 differ in some 15 % of a fingerprint's bits, so no chain
# of exact bits finds all of these in a large table too. What the fingerprints leave apart is
# joined by an exact similarity of the shingle sets. All shingles have one order; two sets of similarity t share one
# of the first n - ceil(t n) + 1 shingles of each, whatever the number of documents. So each text is
# entered under these, and a pair that meets is decided by the exact Jaccard similarity. The
# order puts shingles that are frequent in a sample last; it sets the cost, not the result.


def shingle_hashes(data: bytes, width: int = 5) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, sorted; a shorter text is one shingle, an empty one none."""
    held: list[bytes] = []
    found = [np.zeros(0, np.uint64)]
    for words in word_blocks(data):
        held += (w.lower() for w in words)
        if len(held) >= width:
            shingles = map(b" ".join, zip(*(islice(held, i, None) for i in range(width)), strict=False))
            found.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64))
            held = held[len(held) - width + 1 :]
    if len(found) == 1 and held:
        found.append(np.array([xxhash.xxh64_intdigest(b" ".join(held))], np.uint64))
    return np.unique(np.concatenate(found))


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(1 << bits))


def shingle_sets(rows: DataFrame, width: int, kept: Callable[[np.ndarray], np.ndarray] | None = None, only: np.ndarray | None = None) -> DataFrame:
    """(id, n, keys): n distinct shingles of each row (id, t) that has any, and those ``kept`` picks.

    With a bitmap ``only``, rows whose id is not marked there are left out.
    """
    spread = None if only is None else rows.sparkSession.sparkContext.broadcast(only)
    if spread:
        rows = rows.select("id", "t", _slot((64 * len(only)).bit_length() - 1).alias("s"))

    def run(batches):
        for batch in batches:
            if spread:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((spread.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [(i, shingle_hashes(t or b"", width)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                made = [(i, len(h), (kept(h) if kept else h).view(np.int64)) for i, h in made if len(h)]
                if made:
                    ids, ns, keys = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "keys"])

    return rows.mapInArrow(run, "id long, n long, keys array<long>")


def frequent_shingles(rows: DataFrame, width: int, share: int = 64, least_rows: int = 4096, most: int = 1 << 17) -> np.ndarray:
    """Up to ``most`` hashes that three sampled rows hold, rarest first; one row of ``share`` is sampled, or ``least_rows``."""
    step = max(1, min(share, rows.count() // least_rows))
    some = shingle_sets(rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0), width)
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    found = counts.orderBy(F.desc("c"), "key").limit(most).toPandas()
    return found["key"].to_numpy(np.int64)[::-1].view(np.uint64)


def prefixes(rows: DataFrame, share: Fraction, width: int) -> DataFrame:
    """(id, n, keys): the shingles a text is entered under, in the common order."""
    common = frequent_shingles(rows, width)
    order = np.argsort(common)
    spread = rows.sparkSession.sparkContext.broadcast((common[order], order + 1))
    up, down = share.numerator, share.denominator

    def first(hashes: np.ndarray) -> np.ndarray:
        known, rank = spread.value
        late = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            late = np.where(known[at] == hashes, rank[at], 0)
        return hashes[np.lexsort((hashes, late))][: len(hashes) + up * len(hashes) // -down + 1]

    return shingle_sets(rows, width, first)


def marks(ids: DataFrame, bits: int = 23) -> np.ndarray:
    """A bitmap of 2**bits bits of the ids' hashes."""
    words = ids.select(_slot(bits).alias("s")).groupBy(F.shiftright("s", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def similar_pairs(rows: DataFrame, pairs: DataFrame, share: Fraction, width: int) -> DataFrame:
    """The pairs (u, v) of ids whose shingle sets have a Jaccard similarity of ``share`` or more."""
    sets = store(shingle_sets(rows, width, only=marks(pairs.select(F.explode(F.array("u", "v")).alias("id")))))
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("keys").alias("ku")), "u")
    both = both.join(sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("keys").alias("kv")), "v")
    alike = both.select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), F.size(F.array_intersect("ku", "kv")).cast("long").alias("common"))
    alike = store(alike.where(F.col("common") * share.denominator >= (F.col("n") - F.col("common")) * share.numerator).select("u", "v").distinct())
    discard(sets, collect=False)
    return alike


def similar_links(docs: DataFrame, similarity: float = 0.8, width: int = 5, most_pairs: int = 64, id_column: str = "doc_id", text_column: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(u, v) links that have the components of all pairs of ids whose shingle sets are ``similarity`` alike.

    Links (u, v) that are ``known`` already count as links too, and what they bring into one
    component is compared with its buckets' least ids only.

    First every member of a bucket is compared with its least id. What that leaves in another
    component than the least id's is then compared with all members of other components, in
    blocks of ``most_pairs`` rows that are spread over the tasks; so each pair of a bucket is
    compared, or in one component already. Two rows of a bucket become a pair only where what
    follows their places can still reach ``similarity``, and of these pairs only those are
    verified whose common entries, and all that can follow them, reach it.
    """
    share = Fraction(str(similarity))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("t"))
    entered = store(prefixes(rows, share, width))
    entries = entered.select("id", "n", F.posexplode("keys").alias("at", "key"))
    entries = entries.select("key", "id", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place"))

    def may(n, at, m, to) -> Column:
        """Whether sets of n and m shingles that first meet at places ``at`` and ``to`` can be alike."""
        return F.least(n - at, m - to) * (share.numerator + share.denominator) >= (n + m) * share.numerator

    def close(pairs: DataFrame) -> DataFrame:
        """(u, v) of the pairs (u, v, n, nv) whose common entries, and all that one of the two has beyond its own, can make alike."""
        pairs = store(pairs)
        both = pairs.join(entered.select(F.col("id").alias("u"), F.col("keys").alias("ku")), "u")
        both = both.join(entered.select(F.col("id").alias("v"), F.col("keys").alias("kv")), "v")
        beyond = F.ceil(F.greatest("n", "nv") * share.numerator / share.denominator) - 1
        most = F.size(F.array_intersect("ku", "kv")) + beyond
        kept = store(both.where(most * (share.numerator + share.denominator) >= (F.col("n") + F.col("nv")) * share.numerator).select("u", "v").distinct())
        discard(pairs, collect=False)
        return kept

    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    held = store(entries.join(shared, "key").select("key", "id", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")))
    firsts = held.groupBy("key").agg(F.min(F.struct("id", "n", "at")).alias("first"))
    members = held.join(firsts, "key")
    stars = members.where((F.col("first.id") < F.col("id")) & may(F.col("first.n"), F.col("first.at"), F.col("n"), F.col("at")))
    stars = close(stars.select(F.col("first.id").alias("u"), F.col("id").alias("v"), F.col("first.n").alias("n"), F.col("n").alias("nv")).distinct())
    found = similar_pairs(rows, stars, share, width)
    if known is not None:
        found = found.unionByName(known)
    roots = components(found).select(F.col("node").alias("id"), "root")
    placed = members.select("key", "id", "n", "at", F.col("first.id").alias("least")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = laid = store(placed)
    discard(held)
    mains = placed.where("id = least").select("key", F.col("root").alias("main")).distinct()
    placed = placed.join(mains, "key").withColumn("out", F.col("root") != F.col("main"))
    split = placed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("out").cast("long")).alias("k")).where("k > 0")
    blocks = lambda c: F.ceil(F.col(c) / most_pairs)
    open_ = placed.join(split.select("key", blocks("k").alias("i"), blocks("c").alias("j")), "key")
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    a = open_.where("out").select("key", "id", "n", "at", "root", block("i").alias("i"), every("j").alias("j")).alias("a")
    b = open_.select("key", "id", "n", "at", "root", "out", every("i").alias("i"), block("j").alias("j")).alias("b")
    near = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.i") == F.col("b.i"))
        & (F.col("a.j") == F.col("b.j"))
        & (F.col("a.root") != F.col("b.root"))
        & (~F.col("b.out") | (F.col("a.id") < F.col("b.id")))
        & may(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at")),
    )
    # The keys that a pair shares are rows here up to the first at which it can no longer be alike
    # had it shared none before; a pair that fails at its first is gone. Beyond the last row's
    # places it shares at most what follows them.
    first = F.col("a.id") < F.col("b.id")
    of = lambda c, swap: F.when(first != swap, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c + "v" * swap)
    near = near.select(of("id", False), of("id", True), of("n", False), of("n", True), of("at", False), of("at", True))
    near = near.groupBy(F.col("id").alias("u"), F.col("idv").alias("v"), "n", "nv").agg(F.count(F.lit(1)).alias("c"), F.max("at").alias("at"), F.max("atv").alias("atv"))
    most = F.col("c") + F.least(F.col("n") - F.col("at") - 1, F.col("nv") - F.col("atv") - 1)
    near = near.where(most * (share.numerator + share.denominator) >= (F.col("n") + F.col("nv")) * share.numerator).select("u", "v", "n", "nv")
    near = close(near.join(stars, ["u", "v"], "left_anti"))
    discard(laid, stars, entered)
    return found.unionByName(similar_pairs(rows, near, share, width))


def near_links(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(u, v) links that have ``near_components``' components of the rows with an id and a word: each
    id and the smallest of its fingerprint, and the smallest of each two fingerprints that link."""
    rows = docs.where(F.col(id_column).isNotNull() & F.col(text_column).rlike(WORD))
    prints = store(fingerprints(rows, id_column, text_column, width))
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    least = lambda fp, name: distinct.select(F.col("fp").alias(fp), F.col("least").alias(name))
    near = links(distinct.select("fp")).withColumnsRenamed({"u": "a", "v": "b"}).join(least("a", "u"), "a").join(least("b", "v"), "b")
    copies = prints.join(distinct, "fp").where("doc_id <> least").select(F.col("least").alias("u"), F.col("doc_id").alias("v"))
    found = store(near.select("u", "v").unionByName(copies))
    discard(prints, distinct, collect=False)
    return found


def one_per_component(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of near copies: that of the least id.

    Near copies are texts whose fingerprints link, as in ``near_components``, and those whose
    shingle sets are alike, which fingerprints need not be near for; a group is all that either
    reaches. Rows that share an id stand or fall together; rows without an id, and texts without
    a word, stay.
    """
    known = near_links(docs, id_column, text_column)
    found = components(similar_links(docs, id_column=id_column, text_column=text_column, known=known, **options))
    gone = found.where("node <> root").select(F.col("node").alias("__gone")).distinct()
    return docs.join(gone, docs[id_column] == gone["__gone"], "left_anti")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
