"""Addresses against plain Python: codes, tolerant assignment, erasures."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sequora.operators import addresses as A


def plain_dna(strand, seed=0):
    raw = [strand >> 16 & 255, strand >> 8 & 255, strand & 255, seed]
    bits = "".join(f"{b ^ w:08b}" for b, w in zip(raw, A.WHITENING, strict=True))
    return "".join("ACGT"[int(bits[i : i + 2], 2)] for i in range(0, 32, 2))


def changed(dna, places, rng):
    out = list(dna)
    for p in places:
        out[p] = rng.choice([c for c in "ACGT" if c != out[p]])
    return "".join(out)


def test_codes_round_trip(spark):
    strands = [0, 1, 255, 256, 65535, 65536, (1 << 24) - 1]
    rows = spark.createDataFrame([(s, i % 4) for i, s in enumerate(strands)], "s long, seed int").withColumn("code", A.address_code(F.col("s"), F.col("seed")))
    rows = rows.withColumn("dna", A.address_dna(F.col("code"))).withColumn("back", A.read_code(F.concat("dna", F.lit("ACGT"))))
    for r in rows.select("*", A.strand_of(F.col("back")).alias("strand"), A.seed_of(F.col("back")).alias("found"), A.in_range(F.col("code"), 256, 2).alias("fits")).collect():
        assert r.dna == plain_dna(r.s, r.seed) and r.back == r.code and r.strand == r.s and r.found == r.seed
        assert r.fits == (r.s < 256 and r.seed < 2)
    odd = spark.createDataFrame([("ACGT",), ("N" * 16,), (None,), ("",), ("acgt" * 4,)], "d string")
    assert {r.c for r in odd.select(A.read_code(F.col("d")).alias("c")).collect()} == {None}


def test_changed_bases(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(50)] + [(5, 5)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", A.changed_bases(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        assert r.n == sum((r.a >> 2 * i & 3) != (r.b >> 2 * i & 3) for i in range(16))


@pytest.mark.parametrize("most", [0, 1, 2])
def test_assignment_against_brute_force(spark, most):
    """Dense and sparse strands, ties, equal reads, a crowded address, short and unreadable reads."""
    rng = random.Random(most)
    strands = [*range(0, 60), 5000, 70000, 1 << 23, 123456]
    reads = [changed(plain_dna(rng.choice(strands)), rng.sample(range(16), rng.choice([0, 0, 1, 2, 3, 4])), rng) + "ACGTTT" for _ in range(300)]
    reads += [plain_dna(7)] * 40 + ["ACG", "", None, "N" * 20, plain_dna(7)[:15] + "n"]
    refs = [(s, plain_dna(s)) for s in strands] + [(9_999_999, plain_dna(7))]
    want = {}
    for i, r in enumerate(reads):
        if r is None or len(r) < 16 or set(r[:16]) - set("ACGT"):
            want[i] = ("unreadable", None, None)
            continue
        d, s = min((sum(a != b for a, b in zip(r[:16], dna, strict=True)), s) for s, dna in refs)
        want[i] = ("unknown", None, None) if d > most else ("exact" if d == 0 else "near", s, d)
    table = spark.createDataFrame(refs, "strand long, dna string").select("strand", A.read_code(F.col("dna")).alias("code"))
    rows = spark.createDataFrame(list(enumerate(reads)), "i int, dna string")
    assigned = A.by_address(rows, "dna", table, most)
    assert {r.i: (r.outcome, r.strand, r.changed) for r in assigned.collect()} == want
    counts = {r.strand: (r.reads, r.near, r.discarded) for r in A.clusters(assigned).collect()}
    lost = sum(s is None for _, s, _ in want.values())
    assert counts[None] == (0, 0, lost) and sum(n for n, _, _ in counts.values()) == len(reads) - lost
    assert counts[7][0] >= 40


def test_assignment_of_empty_tables(spark):
    none = spark.createDataFrame([], "strand long, code long")
    rows = spark.createDataFrame([(1, "ACGT" * 4)], "i int, dna string")
    assert [(r.outcome, r.strand) for r in A.by_address(rows, "dna", none).collect()] == [("unknown", None)]
    assert A.by_address(rows.limit(0), "dna", none).count() == 0
    with pytest.raises(ValueError):
        A.nearest(none.select("code"), none, 3)


def test_no_cross_join(spark):
    refs = spark.range(50).select(F.col("id").alias("strand"), A.address_code(F.col("id")).alias("code"))
    plan = A.by_address(spark.createDataFrame([(1, plain_dna(3))], "i int, dna string"), "dna", refs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Cartesian" not in plan


def test_erasures_against_plain_python(spark):
    payloads = {1: "a", 2: "b", 3: None, 4: "", 6: "d", 8: "x"}
    address = lambda t: sha256(t.encode()).hexdigest()[:32]
    registry = {1: address("a"), 2: address("changed"), 3: address(""), 4: address(""), 5: address("gone"), 7: address("g"), 8: None}
    got = A.address_erasures(
        spark.createDataFrame(list(payloads.items()), "strand long, payload string"),
        spark.createDataFrame(list(registry.items()), "strand long, address string"),
        spark.createDataFrame([(7,), (9,), (9,), (1,)], "strand long"),
    )
    assert {r.strand: r.reason for r in got.collect()} == {1: "known", 2: "changed", 3: "changed", 5: "missing", 7: "known", 8: "changed", 9: "known"}
